import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm.quantise import Quantiser
from tonearm.llm.spectral import Graph, Spectral, beyond, described, grouped, together

RULE = Spectral(k=8, near=0.0005, vectors=12, steps=9, search=Quantiser(sample=400, books=3, words=8, beam=8, cell=200, depth=2, probes=8, rerank=60, rounds=4))


def test_groups_noise_and_edges(spark):
    r = np.random.default_rng(5)
    centres = np.eye(24)[:4]
    rows, truth = [], {}
    for i in range(240):
        g = 0 if i < 120 else 1 + i % 3
        rows.append((i, (centres[g] + 0.12 * r.normal(size=24)).tolist()))
        truth[i] = g
    rows += [(300 + i, (r.normal(size=24) * (1 - centres.sum(0))).tolist()) for i in range(4)]  # like nothing else
    rows += [(400, None), (401, [0.0] * 24), (3, rows[3][1]), (500, rows[0][1])]
    df = spark.createDataFrame([(*x, "g") for x in rows], "id long, v array<float>, group string")
    out = grouped(df, "id", "v", RULE).cache()
    got = {x.id: x.group for x in out.collect()}
    assert out.count() == len(got) == 245
    assert all(got[300 + i] is None for i in range(4)) and 400 not in got and 401 not in got
    assert got[500] == got[0]
    for g in range(4):
        assert len({got[i] for i in truth if truth[i] == g} - {None}) == 1
    assert len({got[i] for i in truth} - {None}) == 4
    d = described(out, 3).collect()
    assert max(x["size"] for x in d) >= 115 and all(len(x.typical) == 3 for x in d)
    probes = spark.createDataFrame([(0, 1, "x"), (0, 125, "x"), (0, 300, "x")], "a long, b long, c string")
    assert [(x.a, x.b) for x in together(probes, out, "a", "b").collect()] == [(0, 1)]
    assert grouped(df.limit(0), "id", "v", RULE).count() == 0


def test_near_copies_that_fill_their_cells(spark):
    r = np.random.default_rng(8)
    centres = np.eye(24)[:3]
    crowd = centres[0] + 0.1 * r.normal(size=24)
    x = [centres[i % 3] + 0.12 * r.normal(size=24) for i in range(240)] + [crowd + 0.004 * r.normal(size=24) for _ in range(900)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    rule = Spectral(k=8, near=0.03, vectors=12, steps=9, search=Quantiser(sample=400, books=3, words=8, beam=4, cell=60, depth=3, probes=2, rerank=20, rounds=4))
    edges = beyond(df, "id", "v", rule).toPandas()
    assert set(edges["id"]) == set(range(1140)) and (edges.groupby("id").size() == 8).all() and edges["distance"].min() >= 0.03
    got = {x.id: x.group for x in grouped(df, "id", "v", rule).collect()}
    assert got[240] is not None and all(got[i] == got[240] for i in range(240, 1140))
    assert not any(got[i] == got[240] for i in range(240) if i % 3)


@pytest.mark.parametrize(("n", "size"), [(30, 60), (100, 40)])
def test_more_groups_than_vectors_at_first(spark, n, size):
    r = np.random.default_rng(n)
    centres = r.normal(size=(n, 64)) / 8
    truth = np.repeat(np.arange(n), size)
    x = centres[truth] + 0.05 * r.normal(size=(n * size, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = {q.id: q.group for q in grouped(df, "id", "v", Spectral(part=500, hub=60)).collect()}
    found = [{got[i] for i in np.flatnonzero(truth == g)} - {None} for g in range(n)]
    assert all(len(f) == 1 for f in found) and len(set.union(*found)) == n
    assert sum(v is None for v in got.values()) < 0.05 * len(got)


def test_product_of_the_graph_with_hubs(spark):
    """A product by parts, one record with edges in all of them, against numpy."""
    n, r = 200, np.random.default_rng(3)
    w = np.triu((r.random((n, n)) < 0.03) * r.random((n, n)), 1)
    w[0, 1:] = r.random(n - 1)
    w += w.T
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, w double")
    places = spark.createDataFrame([(i, i % 7) for i in range(n)], "id long, part int")
    graph = Graph(edges, places, 7, Spectral(hub=100))
    assert graph.hubs
    x = r.normal(size=(n, 5)).astype(np.float32)
    start = graph.rows.withColumn("x", F.lit(b""))
    out = graph.product(graph.product(start, lambda ids, m: x[ids]), lambda ids, m: m, keep=True).collect()
    assert sorted(o.id for o in out) == list(range(n))
    got = np.stack([np.frombuffer(o.x, dtype=np.float32) for o in sorted(out, key=lambda o: o.id)])
    assert np.allclose(got, np.hstack([w @ (w @ x), w @ x]), rtol=1e-3, atol=1e-3)
