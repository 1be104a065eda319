"""Target curves over a set, and the genre dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ord, name, keywords, bpm range, lufs range, shape, max bpm jump, least harmonic share, stretch, crossfade bars, play seconds, minutes a slot.
PROFILES = [
    (0, "afro", "afro,amapiano,afrobeats", 110, 122, -16, -8, "build", 5, 0.7, 0.05, 8, 150, 330, 3.75),
    (1, "techno", "techno,warehouse,industrial,rave,acid", 126, 135, -15, -7, "peak", 4, 0.75, 0.08, 16, 180, 360, 4),
    (2, "trance", "trance,uplifting,psytrance", 134, 140, -15, -7, "build", 4, 0.8, 0.06, 16, 180, 420, 4.5),
    (3, "house", "house,disco,deep,melodic,garage,funky", 118, 126, -18, -8, "build", 4, 0.8, 0.08, 16, 180, 360, 4),
    (4, "dnb", "dnb,drum and bass,drum & bass,jungle,liquid", 170, 178, -13, -6, "peak", 5, 0.7, 0.04, 8, 120, 270, 3),
    (5, "hiphop", "hip hop,hip-hop,hiphop,rap,trap,r&b,rnb,drill", 84, 102, -16, -8, "build", 12, 0.4, 0.03, 2, 90, 210, 2.5),
    (6, "latin", "latin,reggaeton,perreo,dembow,bachata,salsa,cumbia,merengue,urbano", 90, 112, -14, -7, "build", 10, 0.5, 0.04, 4, 120, 240, 3),
    (7, "pop", "pop,top 40,top40,wedding,party,open format,throwback,karaoke", 100, 128, -14, -7, "build", 14, 0.4, 0.04, 4, 90, 210, 2.5),
    (8, "downtempo", "downtempo,chill,lounge,ambient,sunset,dinner,background", 100, 116, -22, -12, "flat", 6, 0.7, 0.06, 8, 150, 330, 4),
    (9, "open", "", 118, 126, -18, -8, "build", 6, 0.7, 0.06, 8, 120, 330, 3.5),
]
COLUMNS = "ord int, name string, keywords string, bpm_lo double, bpm_hi double, lufs_lo double, lufs_hi double, shape string, max_bpm_jump double, min_harmonic double, max_stretch double, max_xfade_bars int, min_play_s double, max_play_s double, avg_minutes double"

# Words of a brief that choose a shape, tested in this order.
SHAPE_WORDS = [
    ("wave", "wave|ebb|peaks and valley|up and down"),
    ("down", "wind down|wind-down|cool down|descend|closing|comedown"),
    ("peak", "peak time|peak-time|banger|high energy|main room"),
    ("flat", "steady|flat|background|dinner|lounge"),
    ("build", "slow build|build up|build-up|journey|rise"),
]


def profiles(spark: SparkSession) -> DataFrame:
    """The ten genre rows; ``ord`` decides among several hits."""
    return spark.createDataFrame([tuple(float(x) if isinstance(x, (int, float)) and i not in (0, 11) else x for i, x in enumerate(r)) for r in PROFILES], COLUMNS)


def detect(text: Column) -> Column:
    """The first genre with a keyword anywhere in the text, else ``open``."""
    low, out = F.lower(text), F.lit("open")
    for _, name, words, *_ in reversed(PROFILES[:-1]):
        hit = F.lit(False)
        for w in words.split(","):
            hit |= low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def shape_of(text: Column, default: str = "build") -> Column:
    low, out = F.lower(text), F.lit(default)
    for name, words in reversed(SHAPE_WORDS):
        out = F.when(low.rlike(words), name).otherwise(out)
    return out


def intensity(shape: Column, x: Column) -> Column:
    """0 to 1 at position ``x``."""
    peak = F.when(x <= 0.7, x / 0.7).otherwise(1.0 - 0.5 * (x - 0.7) / (1 - 0.7))
    return F.when(shape == "flat", 0.5).when(shape == "down", 1.0 - x).when(shape == "peak", peak).when(shape == "wave", 0.5 - 0.5 * F.cos(2 * F.pi() * x)).otherwise(x)


def points(profile: DataFrame, n: int = 9) -> DataFrame:
    """(name, position, bpm, lufs): each genre's arc at ``n`` control points of its shape; one point stands at half intensity."""
    at = profile.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("position", F.col("i") / max(n - 1, 1) if n > 1 else F.lit(0.0))
    v = intensity(F.col("shape"), F.col("position")) if n > 1 else F.lit(0.5)
    return at.select("name", "position", (F.col("bpm_lo") + v * (F.col("bpm_hi") - F.col("bpm_lo"))).alias("bpm"), (F.col("lufs_lo") + v * (F.col("lufs_hi") - F.col("lufs_lo"))).alias("lufs"))


def targets(slots: DataFrame, arc: DataFrame, key: str = "name") -> DataFrame:
    """``slots`` with ``target_bpm`` and ``target_lufs`` at their clamped ``position``, linear between control points, flat outside.

    An arc without points gives 118 BPM and -18 LUFS. Each arc is gathered into one short array, so every slot meets one row.
    """
    curve = arc.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "bpm", "lufs"))).alias("pts"))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("position")))
    after = F.filter("pts", lambda p: p["position"] >= x)[0]
    before = F.try_element_at(F.filter("pts", lambda p: p["position"] <= x), F.lit(-1))

    def at(f: str, default: float) -> Column:
        lo, hi = F.col("__b")[f], F.col("__a")[f]
        span = F.col("__a")["position"] - F.col("__b")["position"]
        t = F.when(span > 0, (x - F.col("__b")["position"]) / span).otherwise(0.0)
        return F.coalesce(F.when(F.col("__a").isNull(), lo).when(F.col("__b").isNull(), hi).otherwise(lo + t * (hi - lo)), F.lit(default))

    joined = slots.join(curve, key, "left").withColumns({"__a": F.get(F.filter("pts", lambda p: p["position"] >= x), F.lit(0)), "__b": before})
    return joined.withColumns({"target_bpm": at("bpm", 118.0), "target_lufs": at("lufs", -18.0)}).drop("__a", "__b", "pts")


def bpm_band(arc: DataFrame, key: str = "name", margin: float = 4.0) -> DataFrame:
    return arc.groupBy(key).agg((F.min("bpm") - margin).alias("bpm_lo"), (F.max("bpm") + margin).alias("bpm_hi"))
