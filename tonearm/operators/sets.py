"""Ordered sets: slots, transitions between neighbours, and the report on a set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import keys


@dataclass(frozen=True)
class Thresholds:
    max_bpm_jump: float = 6.0
    max_lufs_jump: float = 5.0
    min_harmonic: float = 0.7
    max_rmse: float = 4.0
    max_repeats: int = 0
    min_gap: int = 3
    max_key_run: int = 4


def slots(cards: DataFrame) -> DataFrame:
    """(set_id, i, n, position, path, title, artist, camelot, bpm, lufs, score): each retrieval run's candidates by falling score, ties by path.

    A candidate delivered twice counts once, its latest load. Sets are as long as a run, so their windows stay small.
    """
    one = cards.groupBy(F.col("run_id").alias("set_id"), "path").agg(F.max(F.struct("loaded_at", "score", "title", "artist", "camelot", "bpm", "lufs")).alias("c"))
    order = Window.partitionBy("set_id").orderBy(F.col("score").desc(), "path")
    s = one.select("set_id", "path", "c.score", "c.title", "c.artist", "c.camelot", F.col("c.bpm").cast("double").alias("bpm"), F.col("c.lufs").cast("double").alias("lufs"))
    s = s.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("set_id")))
    return s.withColumn("position", F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0))


def transitions(s: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """(set_id, i, bpm_jump, lufs_jump, compatible, key_distance, same_artist, reasons, rough) of each pair of neighbours; an unknown key fits anything."""
    w = Window.partitionBy("set_id").orderBy("i")
    nxt = {c: F.lead(c).over(w) for c in ("bpm", "lufs", "camelot", "artist", "path")}
    t = s.select("set_id", "i", "bpm", "lufs", "camelot", "artist", *(e.alias("next_" + c) for c, e in nxt.items())).where("next_path is not null")
    a, b = F.col("camelot"), F.col("next_camelot")
    t = t.select(
        "set_id", "i", F.abs(F.col("bpm") - F.col("next_bpm")).alias("bpm_jump"), F.abs(F.col("lufs") - F.col("next_lufs")).alias("lufs_jump"),
        F.coalesce(keys.compatible(a, b), F.lit(True)).alias("compatible"), F.coalesce(keys.distance(a, b), F.lit(0)).alias("key_distance"),
        F.coalesce((F.col("artist") != "") & (F.col("artist") == F.col("next_artist")), F.lit(False)).alias("same_artist"),
    )
    reasons = F.array_compact(F.array(
        F.when(~F.col("compatible"), "key clash"), F.when(F.col("bpm_jump") > th.max_bpm_jump, "bpm jump"), F.when(F.col("lufs_jump") > th.max_lufs_jump, "energy jump"), F.when(F.col("same_artist"), "same artist"),
    ))
    return t.withColumn("reasons", reasons).withColumn("rough", F.size("reasons") > 0)


def key_runs(s: DataFrame) -> DataFrame:
    """(set_id, longest_run): the most neighbouring slots on one key."""
    order = Window.partitionBy("set_id").orderBy("i")
    island = F.sum(F.when(F.col("camelot").eqNullSafe(F.lag("camelot").over(order)) & (F.col("i") > 0), 0).otherwise(1)).over(order)
    return s.withColumn("run", island).groupBy("set_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("set_id").agg(F.max("n").alias("longest_run"))


def close_artists(s: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """(set_id, i, j): slots of one artist with at least one slot between, closer than the least gap."""
    w = Window.partitionBy("set_id").orderBy("i")
    out = None
    for gap in range(2, th.min_gap):
        part = s.withColumn("__other", F.lead("artist", gap).over(w)).where("artist <> '' and artist = __other").select("set_id", "i", (F.col("i") + gap).alias("j"))
        out = part if out is None else out.unionByName(part)
    return out


def report(s: DataFrame, target: Column, th: Thresholds = Thresholds()) -> DataFrame:
    """One row a set: jumps, share of fitting keys, distance to the target curve, repeats, rough transitions, and whether it passes.

    The pass rule looks at keys, the greatest jump, the curve and repeats alone. A set of one slot has no transitions and full harmony.
    """
    t = transitions(s, th).groupBy("set_id").agg(
        F.avg("bpm_jump").alias("avg_bpm_jump"), F.max("bpm_jump").alias("max_bpm_jump"), F.avg(F.col("compatible").cast("double")).alias("harmonic"),
        F.sum(F.col("same_artist").cast("int")).alias("repeats"), F.sum(F.col("rough").cast("int")).alias("n_rough"),
    )
    fit = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("lufs") - target, 2))).alias("arc_rmse"))
    pairs = close_artists(s, th).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_close"))
    r = fit.join(t, "set_id", "left").join(key_runs(s), "set_id", "left").join(pairs, "set_id", "left")
    r = r.na.fill(0.0, ["avg_bpm_jump", "max_bpm_jump"]).na.fill(1.0, ["harmonic"]).na.fill(0, ["repeats", "n_rough", "n_close"])
    ok = (F.col("harmonic") >= th.min_harmonic) & (F.col("max_bpm_jump") <= th.max_bpm_jump) & (F.col("arc_rmse") <= th.max_rmse) & (F.col("repeats") <= th.max_repeats)
    return r.withColumn("passed", ok)


def graded_by_genre(s: DataFrame, target: Column, genres: DataFrame) -> DataFrame:
    """``report`` with the greatest jump and least harmony of each set's genre: ``genres`` has (set_id, max_bpm_jump, min_harmonic), sets without one keep the defaults."""
    th = Thresholds()
    g = genres.select("set_id", F.col("max_bpm_jump").alias("__jump"), F.col("min_harmonic").alias("__harmonic"))
    r = report(s, target, th).join(g, "set_id", "left")
    ok = (F.col("harmonic") >= F.coalesce("__harmonic", F.lit(th.min_harmonic))) & (F.col("max_bpm_jump") <= F.coalesce("__jump", F.lit(th.max_bpm_jump))) & (F.col("arc_rmse") <= th.max_rmse) & (F.col("repeats") <= th.max_repeats)
    return r.withColumn("passed", ok).drop("__jump", "__harmonic")


def journey(s: DataFrame) -> DataFrame:
    """(set_id, n, keys, open_bpm, open_lufs, peak, peak_bpm, peak_lufs, close_bpm, close_lufs, lift): how each set goes.

    ``keys``: different keys; ``peak``: the first slot of greatest loudness; ``lift``: the first slot that the next one lifts by an energy boost, null without.
    """
    nxt = F.lead("camelot").over(Window.partitionBy("set_id").orderBy("i"))
    t = s.withColumn("__lift", F.when(keys.energy_boost(F.col("camelot"), nxt), F.col("i")))
    at = lambda f, c: f(c, "i").alias(("open_" if f is F.min_by else "close_") + c)
    top = F.max(F.struct("lufs", (-F.col("i")).alias("k"), "bpm"))
    a = t.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("camelot").alias("keys"), at(F.min_by, "bpm"), at(F.min_by, "lufs"), at(F.max_by, "bpm"), at(F.max_by, "lufs"), top.alias("__top"), F.min("__lift").alias("lift"),
    )
    return a.select("set_id", "n", "keys", "open_bpm", "open_lufs", (-F.col("__top.k")).alias("peak"), F.col("__top.bpm").alias("peak_bpm"), F.col("__top.lufs").alias("peak_lufs"), "close_bpm", "close_lufs", "lift")


def slots_for(minutes: Column, average: Column | float = 3.5, least: int = 4, most: int = 40) -> Column:
    """How many tracks fill ``minutes``, half to even, within bounds."""
    return F.least(F.greatest(F.rint(minutes / (F.lit(average) if isinstance(average, float) else average)), F.lit(float(least))), F.lit(float(most))).cast("int")


def crossfades(s: DataFrame, length: Column, target: Column, max_bars: Column, max_stretch: Column) -> DataFrame:
    """(set_id, i, bars, target_bpm, crossfade_s): how neighbours are mixed.

    Bars come from the outgoing slot's length at its own tempo, halved, capped and cut to a power of two; the tempo is the curve's at the incoming slot, held within its stretch.
    """
    w = Window.partitionBy("set_id").orderBy("i")
    t = s.withColumns({"__len": length, "__target": target, "__cap": max_bars.cast("int"), "__stretch": max_stretch.cast("double")})
    t = t.withColumns({"__nb": F.lead("bpm").over(w), "__nt": F.lead("__target").over(w), "__next": F.lead("path").over(w)}).where("__next is not null")
    bars = F.when((F.coalesce("__len", F.lit(0.0)) != 0) & (F.col("bpm") > 0), F.greatest(F.lit(1), F.rint(F.col("__len") * F.col("bpm") / 240).cast("int")))
    half = F.floor(F.col("__bars") / 2).cast("int")
    asked = F.when(F.col("__bars").isNull(), F.least("__cap", F.lit(4))).otherwise(F.least("__cap", F.when(half == 0, 1).otherwise(half)))
    out = t.withColumn("__bars", bars).withColumn("bars", F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1), asked).cast("double")))).cast("int"))
    held = F.when((F.col("__nb") <= 0) | (F.col("__nt") <= 0), F.when(F.col("__nt") > 0, F.col("__nt")).otherwise(F.col("__nb"))).otherwise(
        F.least(F.greatest("__nt", F.col("__nb") * (1 - F.col("__stretch"))), F.col("__nb") * (1 + F.col("__stretch")))
    )
    out = out.withColumn("target_bpm", held)
    return out.select("set_id", "i", "bars", "target_bpm", F.when(F.col("target_bpm") > 0, F.col("bars") * 240.0 / F.col("target_bpm")).otherwise(0.0).alias("crossfade_s"))


def duration(s: DataFrame, length: Column, fades: DataFrame, usual: float = 210.0) -> DataFrame:
    """(set_id, seconds): the slots' lengths (an absent or zero one counts ``usual``) less the crossfades, not under 0."""
    total = s.groupBy("set_id").agg(F.sum(F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(usual))).alias("t"))
    less = fades.groupBy("set_id").agg(F.sum("crossfade_s").alias("x"))
    return total.join(less, "set_id", "left").select("set_id", F.greatest(F.lit(0.0), F.col("t") - F.coalesce("x", F.lit(0.0))).alias("seconds"))
