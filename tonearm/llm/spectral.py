"""Groups of like records by power-iteration spectral clustering.

Each vector is joined to its nearest others beyond the distance of near-copies; where these crowd the cells, the search is repeated among
fewer and fewer of the crowd. The affinities
``exp(-(distance / scale)^2)`` form a sparse symmetric graph, normalised by the degrees of both ends. Records are placed in parts of
bounded size, near ones together, and the graph is stored as the parts' adjacency arrays. Several random vectors over the records are
multiplied by it again and again: a record's row of values, packed in one field, goes to the parts that hold its neighbours, and each part sums them
for its own records. In between the vectors are made orthogonal, so they turn to the leading eigenvectors, until the residuals of the Ritz vectors in front of the
largest gap between Ritz values are small against that gap, which gives the number of groups. Where the gap does not lie well inside the vectors iterated, their number is doubled. Rows of the embedding, scaled
to unit length, are clustered by k-means. Members are ranked by their internal affinity,
the mean cosine similarity with all members of their group; those far below the group's median belong to no group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm import quantise
from tonearm.plans.staging import stage


@dataclass(frozen=True)
class Spectral:
    """``k`` neighbours beyond ``near``; ``vectors`` iterated at first, ``every`` products between two looks at the Ritz values, ``steps`` products at most after the last doubling.

    A gap is taken if it makes up ``clear`` of the fall of the Ritz values in the first two thirds of the vectors (the last ones converge last), or if these have fallen below ``low``, where
    groups no longer part. ``close``: residuals against the gap. ``part``: records in a part, ``hub``: edges of one record beyond which they are spread over the parts.
    ``sample``: embedding rows on which k-means starts; ``loose``: least share of the group's median affinity a member has.
    """

    k: int = 12
    near: float = 0.06
    vectors: int = 24
    every: int = 3
    steps: int = 36
    clear: float = 0.4
    low: float = 0.5
    close: float = 0.3
    part: int = 8192
    hub: int = 50000
    sample: int = 10000
    rounds: int = 6
    loose: float = 0.68
    search: quantise.Quantiser = quantise.Quantiser(probes=8, rerank=128, recall=0.0)


def affinities(near: DataFrame) -> DataFrame:
    """(src, dst, w): the symmetric, degree-normalised graph of (id, neighbour, distance)."""
    scale = near.agg(F.percentile_approx("distance", 0.9, 1000)).first()[0]
    w = F.exp(-F.pow(F.col("distance") / F.lit(max(float(scale or 0), 1e-6)), 2))
    one = near.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), w.alias("w"))
    both = stage(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "affinities")
    degree = both.groupBy("src").agg(F.sum("w").alias("d"))
    other = degree.select(F.col("src").alias("dst"), F.col("d").alias("e"))
    return stage(both.join(degree, "src").join(other, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w")), "graph")


Row = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _matrix(column: pd.Series) -> np.ndarray:
    flat = np.frombuffer(b"".join(column), dtype=np.float32)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _packed(m: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(m, dtype=np.float32)]


def _sums(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``f`` over the rows packed in ``x``, a small matrix from each partition."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += f(_matrix(b["x"]).astype(np.float64))
        yield pd.DataFrame({"m": [total.tobytes()]})

    parts = df.select("x").mapInPandas(part, "m binary").collect()
    return sum((np.frombuffer(bytes(r.m)).reshape(shape) for r in parts), np.zeros(shape))


def _random(ids: np.ndarray, columns: range) -> np.ndarray:
    """Numbers from -0.5 to 0.5 that depend on the record and the column alone."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(columns.start, columns.stop, dtype=np.uint64)[None, :] + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(40)).astype(np.float64) / (1 << 24) - 0.5


def _basis(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes vectors with this Gram matrix orthonormal; dependent directions are dropped."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-12 * max(values[-1], 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


BLOBS = "part int, kind int, id long, x binary, a binary, b binary, c binary"
ROWS = "id long, parts array<int>, shared boolean, x binary"


class Graph:
    """The normalised affinities as adjacency arrays by part.

    ``blobs`` has for each part rows of kind 0 (its records, and the parts that want their values) and of kind 2 (edges by record); values travel as kind 1.
    The edges of a hub lie in many parts, whose sums for it are added up in a further step.
    """

    def __init__(self, edges: DataFrame, places: DataFrame, parts: int, rule: Spectral) -> None:
        hubs = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).select("dst", (F.col("n") > rule.hub).alias("shared"))
        home = places.select(F.col("id").alias("dst"), F.col("part").alias("home"))
        placed = edges.join(hubs.join(home, "dst"), "dst").withColumn("part", F.when(F.col("shared"), F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int")).otherwise(F.col("home")))
        placed = stage(placed.select("part", "src", "dst", "w", "shared"), "placed-edges")
        self.parts, self.hubs = parts, not placed.where("shared").isEmpty()
        own = placed.select("part", F.col("dst").alias("id"), "shared").distinct()
        wanted = placed.select("part", F.col("src").alias("id")).unionByName(own.select("part", "id")).groupBy("id").agg(F.sort_array(F.collect_set("part")).alias("parts"))
        self.rows = stage(own.groupBy("id").agg(F.max("shared").alias("shared")).join(wanted, "id"), "records")

        def edges_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _whole(batches, ["part", "dst"], 200_000):
                yield pd.DataFrame({"part": b["part"].iloc[:1], "kind": [2], "id": [0], "x": [None], "a": [b["src"].to_numpy(np.int64).tobytes()], "b": [b["dst"].to_numpy(np.int64).tobytes()], "c": [b["w"].to_numpy(np.float32).tobytes()]})

        def needs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _whole(batches, ["part", "id"], 50_000):
                sizes, flat = b["parts"].map(len).to_numpy(np.int32), np.concatenate([np.r_[p, int(s)] for p, s in zip(b["parts"], b["shared"])]).astype(np.int32)
                yield pd.DataFrame({"part": b["part"].iloc[:1], "kind": [0], "id": [0], "x": [None], "a": [b["id"].to_numpy(np.int64).tobytes()], "b": [sizes.tobytes()], "c": [flat.tobytes()]})

        a = placed.select("part", "src", "dst", "w").repartition("part").sortWithinPartitions("part", "dst").mapInPandas(edges_of, BLOBS)
        b = own.select("part", "id").join(self.rows, "id").repartition("part").sortWithinPartitions("part", "id").mapInPandas(needs_of, BLOBS)
        self.blobs = stage(a.unionByName(b), "graph")

    def product(self, x: DataFrame, turn: Row, keep: bool = False) -> DataFrame:
        """``ROWS``: the graph times the vectors whose rows are ``turn(ids, values)`` of ``x``; with ``keep``, those rows follow in the same field."""

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    ids, parts = b["id"].to_numpy(), b["parts"].to_numpy()
                    values = np.array(_packed(turn(ids, _matrix(b["x"]))), dtype=object)
                    at = np.repeat(np.arange(len(b)), [len(p) for p in parts])
                    yield pd.DataFrame({"part": np.concatenate(parts), "kind": 1, "id": ids[at], "x": values[at], "a": None, "b": None, "c": None})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, ids, values, own, parts, shared = None, [], [], [], [], []
            for b in batches:
                for part, kind, rows in _runs(b):
                    if part != now:
                        now, ids, values, own, parts, shared, table = part, [], [], [], [], [], None
                    if kind == 1:
                        ids.append(rows["id"].to_numpy())
                        values.append(_matrix(rows["x"]))
                        continue
                    for r in rows.itertuples():
                        if kind == 0:
                            own.append(np.frombuffer(r.a, dtype=np.int64))
                            for p in np.split(np.frombuffer(r.c, dtype=np.int32), np.cumsum(np.frombuffer(r.b, dtype=np.int32) + 1)[:-1]):
                                parts.append(p[:-1])
                                shared.append(bool(p[-1]))
                            continue
                        if table is None:
                            who, m, mine = np.concatenate(ids), np.concatenate(values), np.concatenate(own)
                            order, by = np.argsort(who), np.argsort(mine)
                            table = (who[order], m[order], mine[by])
                        who, m, mine = table
                        src, dst, w = np.frombuffer(r.a, dtype=np.int64), np.frombuffer(r.b, dtype=np.int64), np.frombuffer(r.c, dtype=np.float32)
                        starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
                        y = np.add.reduceat(m[np.searchsorted(who, src)] * w[:, None], starts, axis=0)
                        to = dst[starts]
                        at = by[np.searchsorted(mine, to)]
                        if keep:
                            y = np.hstack([y, m[np.searchsorted(who, to)]])
                        yield pd.DataFrame({"id": to, "parts": [parts[k] for k in at], "shared": [shared[k] for k in at], "x": _packed(y)})

        moved = x.mapInPandas(send, BLOBS).unionByName(self.blobs)
        out = moved.repartition("part").sortWithinPartitions("part", "kind").mapInPandas(add, ROWS)
        if not self.hubs:
            return out

        def total(key: tuple, b: pd.DataFrame) -> pd.DataFrame:  # a row from each part at most
            m = _matrix(b["x"])
            half = m.shape[1] // 2 if keep else m.shape[1]
            return pd.DataFrame({"id": b["id"].iloc[:1], "parts": b["parts"].iloc[:1], "shared": [True], "x": _packed(np.r_[m[:, :half].sum(0), m[0, half:]][None, :])})

        return out.where("not shared").unionByName(out.where("shared").groupBy("id").applyInPandas(total, ROWS))


def _runs(b: pd.DataFrame) -> Iterator[tuple[int, int, pd.DataFrame]]:
    part, kind = b["part"].to_numpy(), b["kind"].to_numpy()
    cuts = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
    for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(b)]):
        if end > start:
            yield int(part[start]), int(kind[start]), b.iloc[start:end]


def _whole(batches: Iterator[pd.DataFrame], keys: list[str], size: int) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew into pieces of one part and about ``size`` rows, never within the rows of one key."""
    rest: pd.DataFrame | None = None
    for b in batches:
        b = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        first, second = b[keys[0]].to_numpy(), b[keys[1]].to_numpy()
        ends = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        start = 0
        for k, end in enumerate(ends):
            if first[end] != first[end - 1] or end - start >= size:
                yield b.iloc[start:end]
                start = end
        rest = b.iloc[start:]
    if rest is not None and len(rest):
        yield rest


def placed(vectors: DataFrame, rule: Spectral) -> tuple[DataFrame, int]:
    """(id, part) and the number of parts: cells around some sampled centres, larger ones cut by a hash."""
    n = vectors.count()
    sample = np.stack([np.array(r.v, dtype=np.float32) for r in quantise.bounded_sample(vectors, rule.sample).select("v").collect()])
    centre = quantise._kmeans(_unit(sample), min(256, max(1, -(-2 * n // rule.part))), 5, np.random.default_rng(5))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(np.stack(b["v"].to_numpy()).astype(np.float32))
                yield pd.DataFrame({"id": b["id"], "cell": (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1).astype(np.int32)})

    filed = stage(vectors.select("id", "v").mapInPandas(cells, "id long, cell int"), "cells")
    sizes = sorted((r.cell, -(-r.n // rule.part)) for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per centre
    first = np.cumsum([0] + [m for _, m in sizes]).tolist()
    starts = vectors.sparkSession.createDataFrame([(c, m, f) for (c, m), f in zip(sizes, first)], "cell int, m int, first int")
    return filed.join(F.broadcast(starts), "cell").select("id", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("m"))).cast("int").alias("part")), first[-1]


def gap_of(values: np.ndarray, rule: Spectral, n: int) -> tuple[int, bool]:
    """The number of groups by the largest gap in the first two thirds of falling Ritz values, and whether it can be trusted not to lie farther on."""
    if len(values) < 3:
        return 1, True
    seen = max(2, 2 * len(values) // 3)
    gaps = (values[:-1] - values[1:])[: seen - 1]
    groups = 1 + int(np.argmax(gaps))
    return groups, bool(gaps.max() >= rule.clear * (values[0] - values[seen - 1]) or values[seen - 1] < rule.low * values[0] or 2 * len(values) >= n)


def embed(graph: Graph, rule: Spectral) -> tuple[DataFrame | None, int]:
    """(id, x) with the rows of the embedding, and the number of groups; None for an empty graph."""
    n = graph.rows.count()
    if not n:
        return None, 0
    r, step, nothing = min(rule.vectors, n), 0, F.lit(b"")
    x: DataFrame = graph.rows.withColumn("x", nothing)
    turn: Row = lambda ids, m, r=r: _random(ids, range(r))
    as_is: Row = lambda ids, m: m
    while True:
        for k in range(rule.every):
            x, turn = graph.product(x, turn, keep=k == rule.every - 1), as_is
        x, step = stage(x, "product"), step + rule.every
        both = _sums(x, lambda m: m.T @ m, (2 * r, 2 * r))
        yy, yx, xx = both[:r, :r], both[:r, r:], both[r:, r:]
        white = _basis(xx)
        values, vectors = np.linalg.eigh(white.T @ (yx + yx.T) @ white / 2)
        values, turned = values[::-1], white @ vectors[:, ::-1]
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turned, yy, turned) - values**2, 0))
        groups, inside = gap_of(values, rule, n)
        gap, behind = (values[groups - 1] - values[groups], residual[groups]) if len(values) > groups else (1.0, 0.0)
        # the groups' vectors have settled, and the one behind the gap cannot rise into it
        done = (residual[:groups].max() <= rule.close * gap and behind <= gap) or step >= rule.steps
        if done and inside:
            front = turned[:, :groups]

            def pick(batches: Iterator[pd.DataFrame], r: int = r) -> Iterator[pd.DataFrame]:
                for b in batches:
                    if len(b):
                        yield pd.DataFrame({"id": b["id"], "x": _packed(_matrix(b["x"])[:, r:] @ front)})

            return x.mapInPandas(pick, "id long, x binary"), groups
        onward = turned @ _basis(turned.T @ yy @ turned)
        more = range(onward.shape[1], min(2 * r, n)) if not inside and (done or step >= 3 * rule.every) else range(0)  # no clear gap: twice as many

        def turn(ids: np.ndarray, m: np.ndarray, r: int = r, onward: np.ndarray = onward, more: range = more) -> np.ndarray:
            return np.hstack([m[:, :r] @ onward, _random(ids, more) / np.sqrt(n)])

        step = 0 if more else step
        r = onward.shape[1] + len(more)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _seeds(y: np.ndarray, k: int) -> np.ndarray:
    """The best of several k-means runs on a sample: started from rows picked by pivoted orthogonalisation, and from far-apart rows, each the best of a few drawn."""
    best, chosen = np.inf, y[:1]
    for trial in range(4):
        rng = np.random.default_rng(trial)
        if trial == 0:
            rest, picked = y.copy(), []
            for _ in range(k):
                at = int((rest**2).sum(1).argmax())
                picked.append(at)
                q = rest[at] / max(np.linalg.norm(rest[at]), 1e-12)
                rest -= np.outer(rest @ q, q)
            centre = y[picked]
        else:
            c = [y[rng.integers(len(y))]]
            d = ((y - c[0]) ** 2).sum(1)
            while len(c) < k:
                drawn = rng.choice(len(y), size=2 + int(np.log(k)), p=d / d.sum()) if d.sum() > 0 else [0]
                d, at = min(((np.minimum(d, ((y - y[j]) ** 2).sum(1)), j) for j in drawn), key=lambda t: t[0].sum())
                c.append(y[at])
            centre = np.array(c)
        for _ in range(20):
            near = (y @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            centre = np.array([y[near == j].mean(0) if (near == j).any() else centre[j] for j in range(k)])
        error = ((y - centre[near]) ** 2).sum()
        if error < best:
            best, chosen = error, centre
    return chosen


def beyond(df: DataFrame, id_col: str, vec: str, rule: Spectral) -> DataFrame:
    """(id, neighbour, distance): the ``k`` nearest of every row at least ``near`` away.

    Rows whose cells hold so many near-copies that they end with fewer than ``k`` search again, in cells newly cut, among the rows that are not short and an eighth, a
    64th, ... of the short ones, which stand for their crowd; twice as many cells are probed each time. That ends when no row is short or none of them is left among those searched.
    """
    ids = stage(quantise._clean(df, id_col, vec).select("id").distinct(), "ids")
    first = Window.partitionBy("id").orderBy("distance", "neighbour")
    near = stage(quantise.neighbours(df, id_col, vec, rule.k, min_distance=rule.near, rule=rule.search), "neighbours")
    search, share, left = rule.search, 8, None
    while True:
        enough = near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rule.k)
        short = stage(ids.join(enough, "id", "left_anti").select("id"), "short")
        n = short.count()
        left = n if left is None else left
        if not n or share > 8 * left:
            return near
        search = replace(search, probes=min(2 * search.probes, search.words), beam=min(max(search.beam, 2 * search.probes), search.words))
        among = ids.join(short, "id", "left_anti").unionByName(short.where(F.pmod(F.xxhash64(F.lit("crowd"), "id"), F.lit(share)) == 0))
        more = quantise.neighbours(df, id_col, vec, rule.k, min_distance=rule.near, queries=short, among=among, rule=search)
        both = near.unionByName(more).groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
        near = stage(both.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rule.k).drop("n"), "neighbours")
        share *= 8


def grouped(df: DataFrame, id_col: str, vec: str, rule: Spectral = Spectral()) -> DataFrame:
    """(id, group, affinity): every record with its group, null for those of no group.

    Defined cases: rows without id or a vector that has a direction take no part; an id given twice counts once, with its
    least vector; records joined to no other belong to no group; exact copies are joined through their
    common neighbours and share their class's group; an empty frame gives an empty frame. Extra columns are ignored.
    """
    clean = quantise._clean(df, id_col, vec)
    vectors = stage(clean.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    near = beyond(df, id_col, vec, rule)
    nothing = vectors.select("id", F.lit(None).cast("int").alias("group"), F.lit(None).cast("double").alias("affinity"))
    if near.isEmpty():
        return nothing
    places, parts = placed(vectors, rule)
    y, groups = embed(Graph(affinities(near), places, parts, rule), rule)
    if y is None:
        return nothing
    y = stage(y, "embedding")
    rows = _matrix(quantise.bounded_sample(y, rule.sample).select("x").toPandas()["x"]).astype(np.float64)
    centre = _seeds(_unit(rows), min(groups, len(rows)))
    g = len(centre)

    def assign(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (m @ c.T - 0.5 * (c * c).sum(1)).argmax(1)

    for _ in range(rule.rounds):

        def sums(m: np.ndarray, c: np.ndarray = centre) -> np.ndarray:
            m = _unit(m)
            out, n = np.zeros((g, groups + 1)), assign(m, c)
            np.add.at(out, n, np.hstack([m, np.ones((len(m), 1))]))
            return out

        total = _sums(y, sums, (g, groups + 1))
        moved = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centre)
        still = np.abs(moved - centre).max() < 1e-4
        centre = moved
        if still:
            break

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"].to_numpy(), "group": assign(_unit(_matrix(b["x"]).astype(np.float64)), centre).astype(np.int32)})

    labels = y.mapInPandas(label, "id long, group int")
    joined = stage(vectors.join(labels, "id", "left"), "labelled")

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby("group"):
                x = _unit(np.stack(part["v"].to_numpy()).astype(np.float64))
                total[key] = total.get(key, 0) + np.r_[x.sum(0), len(x)]
        yield pd.DataFrame({"group": list(total), "m": [t.tolist() for t in total.values()]})

    means: dict[int, np.ndarray] = {}
    for r in joined.where("group is not null").mapInPandas(mean, "group int, m array<double>").collect():  # a vector per group and partition
        means[r.group] = means.get(r.group, 0) + np.array(r.m)
    centroids = {k: t[:-1] / t[-1] for k, t in means.items()}

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["id", "group"]].copy()
            out["affinity"] = np.nan
            for key, part in b.groupby("group"):
                out.loc[part.index, "affinity"] = _unit(np.stack(part["v"].to_numpy()).astype(np.float64)) @ centroids[int(key)]
            yield out

    ranked = stage(joined.where("group is not null").mapInPandas(rank, "id long, group int, affinity double"), "ranked")
    medians = ranked.groupBy("group").agg(F.percentile_approx("affinity", 0.5, 1000).alias("median"))
    member = ranked.join(F.broadcast(medians), "group").select("id", F.when(F.col("affinity") >= F.lit(rule.loose) * F.col("median"), F.col("group")).alias("group"), "affinity")  # a row per group
    return member.unionByName(nothing.join(ranked.select("id"), "id", "left_anti"))


def described(groups: DataFrame, typical: int = 5) -> DataFrame:
    """(group, size, typical): each group's size and most typical members, by internal affinity, ties by id."""
    w = Window.partitionBy("group").orderBy(F.col("affinity").desc(), "id")
    kept = groups.where("group is not null")
    heads = kept.withColumn("n", F.row_number().over(w)).where(F.col("n") <= typical).groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("typical"))
    return kept.groupBy("group").agg(F.count(F.lit(1)).alias("size")).join(heads, "group")


def together(probes: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of ``probes`` whose two ids are in one group."""
    g = groups.where("group is not null").select("id", "group")
    one = probes.join(g.select(F.col("id").alias(a), F.col("group").alias("__a")), a)
    return one.join(g.select(F.col("id").alias(b), F.col("group").alias("__b")), b).where("__a = __b").select(*probes.columns)
