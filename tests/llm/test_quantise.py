from dataclasses import replace

import numpy as np

from tonearm.llm.quantise import Quantiser, close_pairs, encode, neighbours, train, unit

SMALL = Quantiser(sample=500, books=3, words=16, beam=8, cell=60, depth=3, probes=6, rerank=30, rounds=4)


def data(n=600, d=12, seed=3):
    r = np.random.default_rng(seed)
    return unit(r.normal(size=(20, d))[r.integers(0, 20, n)] + 0.25 * r.normal(size=(n, d))).astype(np.float32)


def brute(x, k):
    d = 1 - x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(d, 9)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def test_beam_search_lowers_the_error():
    x = data()
    books = train(x, SMALL)
    error = []
    for beam in (1, 8):
        code, kept = encode(x, books, beam)
        assert (kept[-1][:, 0] == code).all()
        error.append(float(((x - books[np.arange(3), code].sum(1)) ** 2).sum()))
    assert error[1] < error[0]


def test_recall_against_brute_force(spark):
    x = data()
    df = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "id long, v array<float>, distance double")
    got = {}
    for r in neighbours(df, "id", "v", 5, rule=SMALL).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want, d = brute(x, 5)
    assert sum(len(set(got[i]) & set(want[i].tolist())) for i in range(len(x))) >= 0.9 * 5 * len(x)
    asked = neighbours(df, "id", "v", 5, queries=df.where("id % 100 = 0").select("id"), rule=SMALL).collect()
    assert {r.id for r in asked} == set(range(0, 600, 100)) and len(asked) == 30
    assert all(abs(r.distance - d[r.id, r.neighbour]) < 1e-4 for r in asked)


def test_copies_and_edges(spark):
    x = data(80)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(30)]  # a large class of copies
    rows += [(5, x[5].tolist()), (200, None), (201, []), (202, [0.0] * 12), (203, [float("nan")] * 12), (None, x[1].tolist()), (204, (7 * x[1]).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    pairs = {(r.id_a, r.id_b) for r in close_pairs(df, "id", "v", 4, 1e-5, SMALL).collect()}
    copies = [0, *range(1000, 1030)]
    want = {(a, b) for i, b in enumerate(copies) for a in copies[:5] if a < b and copies.index(a) <= (3 if i > 3 else 4)}
    assert (1, 204) in pairs
    assert {p for p in pairs if p[0] in copies} == want
    assert not {i for p in pairs for i in p} & {200, 201, 202, 203, 5}
    assert close_pairs(df.limit(0), "id", "v", 4, 0.1, SMALL).count() == 0


def test_vectors_that_share_all_codes(spark):
    r = np.random.default_rng(9)
    x = np.vstack([data(60), unit(np.ones((1, 12)) + 0.05 * r.normal(size=(300, 12))).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    tight = Quantiser(sample=60, books=2, words=4, beam=4, cell=5, depth=2, probes=4, rerank=60, rounds=2)
    got = {}
    for row in neighbours(df, "id", "v", 3, rule=tight).collect():
        got.setdefault(row.id, set()).add(row.neighbour)
    want, _ = brute(x, 3)
    assert sum(len(got[i] & set(want[i].tolist())) for i in range(60, 360)) >= 0.9 * 3 * 300


def test_crowd_of_near_copies(spark):
    r = np.random.default_rng(6)
    x = np.vstack([data(600, 24), unit(r.normal(size=(1, 24)) / 5 + 0.015 * r.normal(size=(1200, 24))).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    rule = Quantiser(sample=600, books=3, words=16, beam=8, cell=60, depth=3, probes=4, rerank=20, rounds=4)
    got = {}
    for row in neighbours(df, "id", "v", 5, max_distance=0.06, rule=rule).collect():
        got.setdefault(row.id, set()).add(row.neighbour)
    want, _ = brute(x, 5)
    assert sum(len(got[i] & set(want[i].tolist())) for i in range(600, 1800)) >= 0.99 * 5 * 1200


def test_probes_follow_the_measured_recall(spark):
    """With few probes and fine cells the fixed search loses neighbours; the measured one reaches the recall, against brute force."""
    r = np.random.default_rng(21)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    d = 1 - x @ x.T
    np.fill_diagonal(d, 9)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:5]}
    rule = Quantiser(sample=2000, books=4, words=32, beam=4, cell=60, depth=3, probes=1, rerank=60, rounds=5)
    found = {}
    for recall in (0.0, 0.95):
        out = neighbours(df, "id", "v", 5, rule=replace(rule, recall=recall)).collect()
        found[recall] = len({(o.id, o.neighbour) for o in out} & want) / len(want)
    assert found[0.0] < 0.9 and found[0.95] >= 0.93
