"""Nearest vectors by additive quantisation.

Vectors (scaled to unit length) are written as sums of codewords, one from each of several
full-dimensional codebooks trained on residuals, found by beam search. The first codes also serve as
inverted index: a vector is filed under its code prefix, where a prefix with many vectors is
split by further codes, so no cell grows with the library. A query is sent to the prefixes of its own beam.
How many it visits follows from the recall measured on some held-out queries, searched exactly.
In a cell, candidates are scored from a table of query-codeword products and the
stored norms of the decoded vectors; the best are then ranked by exact cosine distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.plans.staging import spread, stage


@dataclass(frozen=True)
class Quantiser:
    """Sizes of the model and the search.

    ``sample``: vectors the codebooks are trained on at most. ``books`` codebooks of ``words`` each; ``beam``: encodings kept while encoding.
    ``cell``: vectors a cell should hold at most, ``depth``: longest prefix. ``probes``: prefixes of each length a query visits at least; more are visited until the cells hold
    the share ``recall`` of the exact neighbours of ``trial`` queries (0: not measured). ``rerank``: candidates ranked exactly in a cell.
    """

    sample: int = 12000
    books: int = 5
    words: int = 128
    beam: int = 8
    cell: int = 600
    depth: int = 4
    probes: int = 6
    rerank: int = 40
    rounds: int = 8
    recall: float = 0.95
    trial: int = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.r_[0, np.cumsum(n)[:-1]]
        full = n > 0
        c[full] = np.add.reduceat(x[order], starts[full], axis=0) / n[full, None]
        lost = np.flatnonzero(~full)
        if len(lost):
            c[lost] = x[rng.choice(len(x), len(lost), replace=False)]
    return c


def train(x: np.ndarray, rule: Quantiser) -> np.ndarray:
    """Codebooks of shape (books, words, d) from unit vectors ``x``; words beyond the sample's size are unused copies of the first."""
    rng = np.random.default_rng(7)
    residual, books = x.astype(np.float32), []
    for _ in range(rule.books):
        c = _kmeans(residual, rule.words, rule.rounds, rng)
        near = (residual @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        residual = residual - c[near]
        books.append(np.vstack([c, np.repeat(c[:1], rule.words - len(c), axis=0)]).astype(np.float32))
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The best code found for each vector, and after each step the prefixes kept in the beam, best first.

    Beam search: each step adds a word of the next codebook to each kept sum. The errors follow from inner products
    with the vector and between codewords alone.
    """
    n, m, k = len(x), len(books), books.shape[1]
    flat = books.reshape(m * k, -1)
    with_x = x @ flat.T  # lookup tables: product of each vector with each codeword
    cross = flat @ flat.T
    norms = np.einsum("ij,ij->i", flat, flat)
    codes = np.zeros((n, 1, 0), dtype=np.int32)
    error = np.zeros((n, 1), dtype=np.float32)
    kept = []
    for b in range(m):
        grown = np.repeat(error[:, :, None], k, axis=2)
        grown += (norms[b * k : (b + 1) * k] - 2 * with_x[:, b * k : (b + 1) * k])[:, None, :]
        for j in range(b):
            grown += (2 * cross[j * k : (j + 1) * k, b * k : (b + 1) * k])[codes[:, :, j]]
        wide = grown.reshape(n, -1)
        keep = min(beam, wide.shape[1])
        top = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
        value = np.take_along_axis(wide, top, axis=1)
        order = np.argsort(value, axis=1, kind="stable")
        top, error = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
        codes = np.concatenate([np.take_along_axis(codes, (top // k)[:, :, None], axis=1), (top % k)[:, :, None].astype(np.int32)], axis=2)
        kept.append(codes)
    return codes[:, 0], kept


def keys_of(codes: np.ndarray, words: int) -> np.ndarray:
    """One number for each code prefix (last axis), distinct across lengths."""
    out = np.zeros(codes.shape[:-1], dtype=np.int64)
    for j in range(codes.shape[-1]):
        out = out * words + codes[..., j]
    return out * 8 + codes.shape[-1]


CODED = "id long, v binary, q binary, scale float, code binary, norm float, own array<long>, probes array<long>"


def encoded(vectors: DataFrame, books: np.ndarray, rule: Quantiser) -> DataFrame:
    """``CODED`` rows: the unit vector, the same in 16 bits for travelling as a query, its code, the squared norm of the decoded sum,
    the numbers of its own prefixes by length, and those of the prefixes to visit."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # books * words * d floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for b in batches:
            step = max(10, min(1000, 16000 // rule.beam))  # bounds the beam's arrays
            for start in range(0, len(b), step):
                part = b.iloc[start : start + step]
                x = unit(np.stack(part["v"].to_numpy()).astype(np.float32))
                code, kept = encode(x, own, rule.beam)
                decoded = own[np.arange(len(own)), code].sum(1)
                scale = np.abs(x).max(1) / 32767
                short = np.round(x / scale[:, None]).astype(np.int16)
                prefixes = np.stack([keys_of(code[:, :n], rule.words) for n in range(1, rule.depth + 1)], axis=1)
                visit = np.concatenate([keys_of(kept[n][:, : rule.probes], rule.words) for n in range(rule.depth)], axis=1)
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "v": [r.tobytes() for r in x], "q": [r.tobytes() for r in short], "scale": scale, "code": [r.tobytes() for r in code.astype(np.uint8)],
                    "norm": np.einsum("ij,ij->i", decoded, decoded), "own": list(prefixes), "probes": list(visit),
                })

    return vectors.mapInPandas(run, CODED)


def search(queries: np.ndarray, members: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, rerank: int, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """Places (queries, <= k) and exact cosine distances of the nearest members.

    Scores come from the lookup table of query-codeword products, summed over the codes, and the stored norms;
    the ``rerank`` best are ranked by their vectors.
    """
    m, w = books.shape[:2]
    lookup = queries @ books.reshape(m * w, -1).T
    score = np.repeat(-0.5 * norms[None, :], len(queries), axis=0)
    for b in range(m):
        score += lookup[:, b * w : (b + 1) * w][:, codes[:, b]]
    n = min(rerank, len(members))
    top = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < len(members) else np.broadcast_to(np.arange(n), score.shape)
    d = 1 - np.einsum("qd,qnd->qn", queries, members[top])
    if least > 0:
        d = np.where(d < least, 9, d)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(top, order, axis=1), np.take_along_axis(d, order, axis=1)


def _by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks of cells, from batches sorted by cell and block."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        cells, blocks = b["cell"].to_numpy(), b["block"].to_numpy()
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(b)]):
            if not len(b):
                continue
            part = b.iloc[start:end]
            if rest and (rest[0]["cell"].iat[0], rest[0]["block"].iat[0]) != (part["cell"].iat[0], part["block"].iat[0]):
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _clean(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Rows with an id and a vector that has a direction, and two hashes that stand for the vector."""
    v = F.col(vec).cast("array<float>")
    ok = df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    ok = ok.where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0))
    return ok.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit("second"), "v")})


def bounded_sample(rows: DataFrame, most: int, key: str = "id") -> DataFrame:
    """About ``most`` rows, never more than twice that, chosen by a hash of their key, so no partition sends more than its part."""
    n = rows.count()
    if n <= most:
        return rows
    share = int(most / n * (1 << 40))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < share).limit(2 * most)


PAIRS = "id long, neighbour long, distance double"


def measured_probes(coded: DataFrame, filed: DataFrame, cells: DataFrame, books: np.ndarray, k: int, least: float, limit: float, rule: Quantiser) -> int:
    """The probes with which the cells visited hold ``rule.recall`` of the exact neighbours of some queries.

    About ``rule.trial`` vectors, chosen by hash, are compared with all; each partition keeps their ``k`` best. The cells of these neighbours are looked up in the queries' beams.
    """
    rows = bounded_sample(coded.select("id", "v"), rule.trial).orderBy("id").collect()
    ids, q = np.array([r.id for r in rows]), np.stack([np.frombuffer(bytes(r.v), dtype=np.float32) for r in rows])
    sent = coded.sparkSession.sparkContext.broadcast((ids, q))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        found, dist = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0), dtype=np.float32)
        for b in batches:
            if len(b):
                own = b["id"].to_numpy()
                d = 1 - q @ np.frombuffer(b"".join(b["v"]), dtype=np.float32).reshape(len(b), -1).T
                d[(ids[:, None] == own[None, :]) | (d < least) | (d > limit)] = 9
                found, dist = np.hstack([found, np.broadcast_to(own, d.shape)]), np.hstack([dist, d])
                n = min(k, dist.shape[1])
                top = np.argpartition(dist, n - 1, axis=1)[:, :n]
                found, dist = np.take_along_axis(found, top, axis=1), np.take_along_axis(dist, top, axis=1)
        keep = dist < 8
        yield pd.DataFrame({"id": np.broadcast_to(ids[:, None], dist.shape)[keep], "neighbour": found[keep], "distance": dist[keep].astype(np.float64)})

    near = filed.select("id", "v").mapInPandas(nearest, PAIRS).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("n") <= k)
    at = near.join(filed.select(F.col("id").alias("neighbour"), F.explode("own").alias("cell")), "neighbour").join(cells.select("cell"), "cell").select("id", "cell").collect()  # k for each trial
    if not at:
        return rule.probes
    most, rank = 8 * rule.words, []
    wanted: dict[int, list[int]] = {}
    for r in at:
        wanted.setdefault(r.id, []).append(r.cell)
    for i, x in zip(ids.tolist(), q):
        if i in wanted:
            places: dict[int, int] = {}
            for codes in encode(x[None, :], books[: rule.depth], most)[1]:
                for j, key in enumerate(keys_of(codes[0], rule.words).tolist()):
                    places.setdefault(key, j)
            rank += [places.get(c, most) for c in wanted[i]]
    probes = rule.probes
    while probes < most and np.mean(np.array(rank) < probes) < rule.recall:
        probes = min(probes + max(1, probes // 4), most)
    return probes


def neighbours(df: DataFrame, id_col: str, vec: str, k: int = 10, *, max_distance: float | None = None, min_distance: float | None = None, queries: DataFrame | None = None, among: DataFrame | None = None, rule: Quantiser = Quantiser()) -> DataFrame:
    """(id, neighbour, distance): for each query row the ``k`` other rows of ``df`` nearest by cosine distance, ties by id.

    ``queries``: a frame whose first column has the ids to search for (all rows when None), ``among``: likewise those that may be found. ``max_distance``: leave out farther ones; ``min_distance``: leave out nearer ones, copies too.
    The codebooks are fitted on a sample of at most ``rule.sample`` of the vectors that may be found; every vector is filed and searched.

    Defined cases: rows without id, vector or direction (null, empty, zero, NaN, infinite) take no part; rows
    delivered twice count once; of several vectors under one id, each is searched and the pair's least distance counts; exact
    copies of a vector travel as one class, and each member gets the ``k`` first others of its class, then the class's neighbours;
    vectors share one length; fewer than two vectors give an empty frame. Extra columns are ignored.
    """
    spark = df.sparkSession
    rows = _clean(df, id_col, vec)
    classes = rows.groupBy("h", "g").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("v").alias("v"))
    shown = rows if among is None else rows.join(among.select(F.col(among.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    sample = bounded_sample(shown, rule.sample).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], PAIRS)
    books = train(unit(np.stack(sample["v"].to_numpy()).astype(np.float32)), rule)
    # a class goes by its lowest id; a row with two vectors gives two classes that share it and are searched side by side
    coded = stage(encoded(classes.select("id", "v"), books, rule), "codes")
    filed = coded
    if among is not None:
        filed = stage(coded.join(classes.join(shown.select("h", "g").distinct(), ["h", "g"], "left_semi").select("id").distinct(), "id", "left_semi"), "filed")
    counts = filed.select(F.posexplode("own").alias("level", "key")).groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))
    parents = filed.select(F.explode(F.arrays_zip(F.slice("own", 2, rule.depth - 1).alias("key"), F.slice("own", 1, rule.depth - 1).alias("parent"))).alias("x")).select("x.key", "x.parent").distinct()
    size = {"blocks": F.ceil(F.col("n") / (8.0 * rule.cell)).cast("int")}
    large = counts.where((F.col("n") > rule.cell) & (F.col("level") < rule.depth - 1)).select("key")
    below = parents.join(large.select(F.col("key").alias("parent")), "parent", "left_semi").select("key").join(large, "key", "left_anti")
    top = counts.where("level = 0").select("key").join(large, "key", "left_anti")
    # vectors that share all codes of the longest prefix are cut into blocks by id, and each query visits all of them
    cells = stage(top.unionByName(below).join(counts.select("key", "n"), "key").withColumns(size).select(F.col("key").alias("cell"), "blocks"), "cells")
    limit, least = 3.0 if max_distance is None else max_distance, -1.0 if min_distance is None else min_distance
    probes = measured_probes(coded, filed, cells, books, k, least, limit, rule) if rule.recall > 0 else rule.probes
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    home = filed.select("id", "v", "code", "norm", "q", "scale", F.explode("own").alias("cell")).join(cells, "cell").withColumn("block", block)
    if queries is not None:
        asked = rows.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi").select("h", "g").distinct()
        firsts = classes.select("h", "g", "id").join(asked, ["h", "g"], "left_semi").select("id").distinct().withColumn("asks", F.lit(True))
        home = home.join(firsts, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        seeking = coded.join(firsts.select("id"), "id", "left_semi")
    else:
        home, seeking = home.withColumn("asks", F.lit(True)), coded
    if probes > rule.probes:
        v = seeking.select("id", F.col("v").alias("b"))

        def floats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "v": [np.frombuffer(x, dtype=np.float32) for x in b["b"]]})

        seeking = encoded(v.mapInPandas(floats, "id long, v array<float>"), books, replace(rule, probes=probes, beam=max(rule.beam, probes)))
    if among is not None:  # rows that are not filed visit their own cells too
        at_home = filed.select("id", F.lit(True).alias("filed"))
        seeking = seeking.join(at_home, "id", "left").withColumn("filed", F.coalesce("filed", F.lit(False)))
    else:
        seeking = seeking.withColumn("filed", F.lit(True))
    visit = seeking.select("id", "q", "scale", "own", "filed", F.explode(F.array_union("probes", "own")).alias("cell")).join(cells, "cell")
    here = F.col("filed") & F.array_contains("own", F.col("cell"))
    visit = visit.where((F.col("blocks") > 1) | ~here).withColumn("own_block", block).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visit = visit.where((F.col("block") != F.col("own_block")) | ~here)
    home = home.select("cell", "block", "id", "v", F.lit(None).cast("binary").alias("q"), F.lit(None).cast("float").alias("scale"), "code", "norm", "asks")
    both = home.unionByName(visit.select("cell", "block", "id", F.lit(None).cast("binary").alias("v"), "q", "scale", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("norm"), F.lit(True).alias("asks")))
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for b in _by_cell(batches):
            here = b["v"].notna().to_numpy()
            m, foreign = b[here], b[~here]
            if not len(m):
                continue
            x = np.frombuffer(b"".join(m["v"]), dtype=np.float32).reshape(len(m), -1)
            codes = np.frombuffer(b"".join(m["code"]), dtype=np.uint8).reshape(len(m), -1)
            ids, norms = m["id"].to_numpy(), m["norm"].to_numpy(dtype=np.float32)
            q, who = x[m["asks"].to_numpy(dtype=bool)], ids[m["asks"].to_numpy(dtype=bool)]
            if len(foreign):
                f = np.frombuffer(b"".join(foreign["q"]), dtype=np.int16).reshape(len(foreign), -1) * foreign["scale"].to_numpy(dtype=np.float32)[:, None]
                q, who = np.vstack([q, f]), np.r_[who, foreign["id"].to_numpy()]
            step = max(1, 400_000 // len(m))
            for start in range(0, len(q), step):
                at, d = search(q[start : start + step], x, codes, norms, own, k + 1, rule.rerank, least)
                asker = np.repeat(who[start : start + step], at.shape[1])
                found, d = ids[at].ravel(), d.ravel().clip(0)
                keep = (found != asker) & (d <= limit)
                if keep.any():
                    yield pd.DataFrame({"id": asker[keep], "neighbour": found[keep], "distance": d[keep].astype(np.float64)})

    found = both.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInPandas(run, PAIRS)
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    first = lambda f: f.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    between = first(found.groupBy("id", "neighbour").agg(F.min("distance").alias("distance")))
    if max_distance is not None and queries is None and among is None and least <= 0:
        between = stage(between, "between")
        full = between.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id")
        crowd = stage(coded.join(full, "id", "left_semi").select("id", "v"), "crowd")
        if not crowd.isEmpty():
            between = first(between.unionByName(_within(crowd, k, limit, rule)).groupBy("id", "neighbour").agg(F.min("distance").alias("distance")))
    return _expanded(rows, classes, between, k, first, queries, least)


def _within(crowd: DataFrame, k: int, limit: float, rule: Quantiser) -> DataFrame:
    """``PAIRS``: the ``k`` nearest within ``limit`` among the rows of a crowd (id, v), exactly.

    Rows go to the nearest of some leaders that lie farther than ``limit`` apart. A row visits each leader whose rows can lie within ``limit``, by
    the angles between them, and there all rows in blocks.
    """
    sample = np.stack([np.frombuffer(bytes(r.v), dtype=np.float32) for r in bounded_sample(crowd, rule.sample).orderBy("id").collect()] or [np.frombuffer(bytes(crowd.first().v), dtype=np.float32)])
    open_, chosen = np.ones(len(sample), dtype=bool), []
    while open_.any():
        chosen.append(sample[open_.argmax()])
        here = int(open_.argmax())
        open_ &= sample @ chosen[-1] < 1 - limit
        open_[here] = False
    leaders = crowd.sparkSession.sparkContext.broadcast(np.stack(chosen))

    def angles(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(b["v"]), dtype=np.float32).reshape(len(b), -1)
        return x, np.arccos(np.clip(x @ leaders.value.T, -1, 1))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 1000):
                part = b.iloc[start : start + 1000]
                _, a = angles(part)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "cell": a.argmin(1).astype(np.int64), "angle": a.min(1).astype(np.float64)})

    home = stage(crowd.mapInPandas(file, "id long, v binary, cell long, angle double"), "home")
    reach = np.full(len(chosen), -1.0)
    blocks = np.ones(len(chosen), dtype=np.int64)
    for r in home.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # a row per leader
        reach[r.cell], blocks[r.cell] = r.angle + np.arccos(1 - min(limit, 2.0)) + 1e-3, -(-r.n // (8 * rule.cell))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 1000):
                part = b.iloc[start : start + 1000]
                _, a = angles(part)
                who, cell = np.nonzero(a <= reach)
                times = blocks[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"cell": cell, "block": block, "id": part["id"].to_numpy()[who], "v": part["v"].to_numpy()[who], "asks": True})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell": b["cell"], "block": b["h"].to_numpy() % blocks[b["cell"].to_numpy()], "id": b["id"], "v": b["v"], "asks": False})

    kind = "cell long, block long, id long, v binary, asks boolean"
    there = home.withColumn("h", F.xxhash64("id")).mapInPandas(place, kind)
    both = there.unionByName(home.select("id", "v").mapInPandas(visit, kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _by_cell(batches):
            asks = b["asks"].to_numpy(dtype=bool)
            ids, who = b["id"].to_numpy()[~asks], b["id"].to_numpy()[asks]
            if not len(ids) or not len(who):
                continue
            x, q = (np.frombuffer(b"".join(b["v"].to_numpy()[m]), dtype=np.float32).reshape(int(m.sum()), -1) for m in (~asks, asks))
            n = min(k + 1, len(ids))
            for start in range(0, len(q), 250):
                d = 1 - q[start : start + 250] @ x.T
                top = np.argpartition(d, n - 1, axis=1)[:, :n]
                near, asker, found = np.take_along_axis(d, top, axis=1).ravel().clip(0), np.repeat(who[start : start + 250], n), ids[top].ravel()
                keep = (found != asker) & (near <= limit)
                if keep.any():
                    yield pd.DataFrame({"id": asker[keep], "neighbour": found[keep], "distance": near[keep].astype(np.float64)})

    return both.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInPandas(run, PAIRS)


def _expanded(rows: DataFrame, classes: DataFrame, between: DataFrame, k: int, first, queries: DataFrame | None, least: float) -> DataFrame:
    """Neighbours of classes brought back to their members."""
    shared = classes.where("id < last").select("h", "g", F.col("id").alias("rep"))
    members = stage(rows.select("h", "g", "id").join(shared, ["h", "g"]).select("rep", "id").distinct(), "copies")
    if members.isEmpty():
        out = between
    else:
        w = Window.partitionBy("rep").orderBy("id")
        heads = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).select("rep", "id")  # bounded by k + 1 a class
        inside = members.join(heads.withColumnRenamed("id", "neighbour"), "rep").where(F.col("id") != F.col("neighbour")).select("id", "neighbour", F.lit(0.0).alias("distance"))
        asking = between.join(members.select(F.col("rep").alias("id"), F.col("id").alias("member")), "id", "left").select(F.coalesce("member", "id").alias("id"), "neighbour", "distance")
        outside = asking.join(heads.select(F.col("rep").alias("neighbour"), F.col("id").alias("other")), "neighbour", "left").select("id", F.coalesce("other", "neighbour").alias("neighbour"), "distance")
        out = first((outside if least > 0 else outside.unionByName(inside)).where(F.col("id") != F.col("neighbour")).groupBy("id", "neighbour").agg(F.min("distance").alias("distance")))
    if queries is not None:
        out = out.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    return out


def close_pairs(df: DataFrame, id_col: str, vec: str, k: int, max_distance: float, rule: Quantiser = Quantiser()) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b: pairs at most ``max_distance`` apart of which one is among the ``k`` nearest of the other."""
    near = neighbours(df, id_col, vec, k, max_distance=max_distance, rule=rule)
    return near.groupBy(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).agg(F.min("distance").alias("distance"))
