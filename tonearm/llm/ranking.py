"""Ideal-point ranking (TOPSIS) of candidates with scores on different scales.

Within each group every criterion is winsorised to its own quantiles, shifted
to start at zero, and divided by its vector norm over the group, so that the squared
distances of the candidates to the anti-ideal add up to the same for each criterion, whatever its scale, and one whose values
crowd near its best does not outweigh the others. A criterion's weight is multiplied by the share of the group's candidates
that have it and divided by the distance of its ideal from its anti-ideal: one known for few, or with a few values far out, decides less. The ideal point takes the best value
of each criterion, the anti-ideal the worst. Candidates are ordered by relative
closeness ``d(anti) / (d(ideal) + d(anti))`` of the weighted Euclidean distances.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.plans.staging import stage


@dataclass(frozen=True)
class Criterion:
    """A score column. ``winsor`` is the share cut at each end (0 for a bounded scale)."""

    column: str
    higher_is_better: bool = True
    weight: float = 1.0
    winsor: float = 0.2


def _oriented(c: Criterion) -> Column:
    x = F.col(c.column).cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return x if c.higher_is_better else -x


def closeness(df: DataFrame, group: str, criteria: list[Criterion]) -> DataFrame:
    """``df`` with a column ``closeness`` in [0, 1], computed within each value of ``group``.

    Defined cases: null, NaN and infinite scores are missing, and a missing score stands midway between ideal and
    anti-ideal, in the norm too, neither for nor against. A criterion that is constant or
    wholly missing in a group is left out of that group; where all are, closeness is 0.5. Rows with a null group form a group.
    Repeated rows each keep their closeness. An empty frame gives an empty frame. Other columns are kept;
    one called ``closeness`` is replaced. All statistics are partial aggregates, so a group
    holding most rows is never gathered in one task.
    """
    base = df.drop("closeness").withColumns({f"__x{i}": _oriented(c) for i, c in enumerate(criteria)})
    quantiles = []
    for i, c in enumerate(criteria):
        quantiles += [
            F.percentile_approx(f"__x{i}", [c.winsor, 1 - c.winsor], 10000).alias(f"__q{i}"),
            F.min(f"__x{i}").alias(f"__min{i}"),
            F.max(f"__x{i}").alias(f"__max{i}"),
            (F.count(f"__x{i}") / F.count(F.lit(1))).alias(f"__known{i}"),
        ]
    limits = base.groupBy(F.col(group).alias("__g")).agg(*quantiles)
    for i in range(len(criteria)):  # where the quantiles coincide the whole range is used
        flat = F.col(f"__q{i}")[0] >= F.col(f"__q{i}")[1]
        low, high = F.when(flat, F.col(f"__min{i}")).otherwise(F.col(f"__q{i}")[0]), F.when(flat, F.col(f"__max{i}")).otherwise(F.col(f"__q{i}")[1])
        limits = limits.withColumns({f"__lo{i}": low, f"__range{i}": high - low})
    limits = limits.select("__g", *(f"__{k}{i}" for i in range(len(criteria)) for k in ("lo", "range", "known")))

    def above(i: int) -> Column:
        """The winsorised value above the worst one; a missing one is midway, and all of an unusable criterion are null."""
        x, low, span = F.col(f"__x{i}"), F.col(f"__lo{i}"), F.col(f"__range{i}")
        return F.when(span > 0, F.when(x.isNull(), span / 2).otherwise(F.least(F.greatest(x - low, F.lit(0.0)), span)))

    placed = base.join(limits, base[group].eqNullSafe(limits["__g"]), "left").withColumns({f"__w{i}": above(i) for i in range(len(criteria))})
    norms = placed.groupBy(F.col("__g").alias("__h")).agg(*(F.sqrt(F.sum(F.col(f"__w{i}") * F.col(f"__w{i}"))).alias(f"__n{i}") for i in range(len(criteria))))
    scored = placed.join(norms, F.col("__g").eqNullSafe(F.col("__h")), "left")
    to_ideal, to_anti = [], []
    for i, c in enumerate(criteria):
        value, ideal = F.col(f"__w{i}") / F.col(f"__n{i}"), F.col(f"__range{i}") / F.col(f"__n{i}")
        for side, gap in ((to_ideal, ideal - value), (to_anti, value)):
            side.append(F.coalesce(F.lit(c.weight) * F.col(f"__known{i}") / ideal * gap * gap, F.lit(0.0)))
    plus, minus = (F.sqrt(functools.reduce(lambda a, b: a + b, side)) for side in (to_ideal, to_anti))
    near = F.when(plus + minus > 0, minus / (plus + minus)).otherwise(0.5)
    return scored.withColumn("closeness", near).select(*df.drop("closeness").columns, "closeness")


def top_per_group(df: DataFrame, group: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each group closest to the ideal, ties by ``tie``; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col("closeness").desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def run_candidates(cards: DataFrame, neighbors: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per (run_id, path) of ``cards`` with its latest score, distance, and the track's present rating.

    Rows delivered twice count once (the latest load wins, then the larger value). A rating copied
    into the card is not used, as it may lag behind ``tracks.rating``; of several tracks rows with one path
    the highest rating counts. NaN distances are missing. Rows without run_id or path are not candidates.
    """
    a = cards.select("run_id", "path", "loaded_at", F.col("score").cast("double").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(True).alias("card"))
    b = neighbors.select("run_id", "path", "loaded_at", F.lit(None).cast("double").alias("s"), F.col("distance").cast("double").alias("d"), F.lit(False).alias("card"))
    both = a.unionByName(b).where("run_id is not null and path is not null").withColumns({"s": F.nanvl("s", F.lit(None)), "d": F.nanvl("d", F.lit(None))})
    one = both.groupBy("run_id", "path").agg(
        F.max(F.when(F.col("s").isNotNull(), F.struct("loaded_at", "s")))["s"].alias("score"),
        F.max(F.when(F.col("d").isNotNull(), F.struct("loaded_at", "d")))["d"].alias("distance"),
        F.max("card").alias("card"),
    ).where("card").drop("card")
    ratings = tracks.where("rating is not null").groupBy("path").agg(F.max("rating").cast("double").alias("rating"))
    return one.join(ratings, "path", "left")


RUN_CRITERIA = [
    Criterion("score"),
    Criterion("distance", higher_is_better=False),
    Criterion("rating", winsor=0.0),
]


def rank_runs(cards: DataFrame, neighbors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every candidate of every run with its closeness to the run's ideal point."""
    return closeness(stage(run_candidates(cards, neighbors, tracks), "run-candidates"), "run_id", RUN_CRITERIA)
