import math

import numpy as np
from pyspark.sql import functions as F

from tonearm.functions import replies, signal
from tonearm.sources import provider


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_levels_and_curves(spark):
    r = one(spark, signal.rms_dbfs(arr([0.5, -0.5])).alias("a"), signal.rms_dbfs(arr([0.0])).alias("b"), signal.display_curve(arr(range(15))).alias("c"), signal.display_curve(arr([2.0] * 9)).alias("d"))
    assert math.isclose(r.a, 20 * math.log10(0.5)) and r.b == -70.0
    assert np.allclose(r.c, np.linspace(0, 1, 8)) and r.d == [0.5] * 8


def test_key_of_shifted_profiles(spark):
    for pc, mode, profile in ((0, "major", signal.MAJOR), (7, "major", signal.MAJOR), (9, "minor", signal.MINOR)):
        r = one(spark, signal.key_of(arr(np.roll(profile, pc))).alias("k")).k
        assert (r.pitch_class, r["mode"]) == (pc, mode)


def test_windows(spark):
    df = spark.createDataFrame([(35.0,), (4.0,)], "s double")
    got = [r.w for r in df.select(signal.windows("s", F.lit(10.0), F.lit(12)).alias("w")).collect()]
    assert [len(w) for w in got] == [3, 1] and got[0][-1] == [25.0, 35.0]


def test_replies(spark):
    texts = {"I pick [2, 1, 9, 2, {\"n\": 3}, \"x\"] now": [1, 0, 2], "none": [], "[broken": []}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", replies.picks(F.col("t"), F.lit(3)).alias("p"))
    assert {r.t: r.p for r in df.collect()} == texts
    ok = '{"points": [{"position": 2, "bpm": 124, "lufs": -9}, {"position": 0, "bpm": 120, "lufs": -16}, {"position": 0.5}]}'
    r = one(spark, replies.curve(F.lit("here " + ok)).alias("a"), replies.curve(F.lit('{"points": [{"position": 1, "bpm": 1, "lufs": 1}]}')).alias("b"))
    assert [(p.position, p.bpm) for p in r.a] == [(0.0, 120.0), (1.0, 124.0)] and r.b is None
    m = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "user", "u"), (1, 2, "system", "b"), (2, 0, "user", "x")], "k long, i int, role string, content string")
    got = {x.k: (x.system, [tuple(t) for t in x.turns]) for x in replies.split_messages(m, "k", "i").collect()}
    assert got == {1: ("a\n\nb", [("user", "u")]), 2: (None, [("user", "x")])}
    r = one(spark, replies.shown(F.lit("A"), F.lit("T"), F.lit(65.5)).alias("a"), replies.shown(F.lit(""), F.lit("T"), F.lit(None).cast("double")).alias("b"))
    assert tuple(r) == ("A — T (1:06)", "T")


def test_provider(spark):
    class Two(provider.TrackSource):
        @classmethod
        def name(cls):
            return "two_tracks"

        @staticmethod
        def parts(options):
            return ["a", "b"]

        @staticmethod
        def tracks(options, part):
            yield (f"/{part}", "two", False, part.upper(), None)

    provider.register(spark, Two)
    assert sorted(r.path for r in spark.read.format("two_tracks").load().collect()) == ["/a", "/b"]
