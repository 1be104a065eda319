import math

from tonearm.llm.ranking import Criterion, closeness, rank_runs, top_per_group


def test_no_scale_decides(spark):
    rows = [("r", i, float(i), 1e6 * ((i * 7) % 10)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, id long, a double, b double")
    big = {r.id: r.closeness for r in closeness(df, "g", [Criterion("a"), Criterion("b")]).collect()}
    small = {r.id: r.closeness for r in closeness(df.withColumn("b", df.b / 1e9), "g", [Criterion("a"), Criterion("b")]).collect()}
    assert all(math.isclose(big[i], small[i], abs_tol=1e-9) for i in big)
    assert max(big, key=big.get) in (7, 9)


def test_missing_is_neutral_and_edges(spark):
    rows = [("g", 1, 1.0, 5.0), ("g", 2, None, 5.0), ("g", 3, 0.0, float("nan")), (None, 4, 1.0, None), ("h", 5, 2.0, 2.0), ("h", 5, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, id long, a double, closeness double")
    out = closeness(df.withColumnRenamed("closeness", "b"), "g", [Criterion("a", winsor=0.0), Criterion("b", winsor=0.0)]).collect()
    got = {(r.g, r.id): r.closeness for r in out}
    assert len(out) == 6
    assert got["g", 1] == 1 and got["g", 2] == 0.5 and got["g", 3] == 0  # b is constant in g
    assert got[None, 4] == 0.5 and got["h", 5] == 0.5
    assert closeness(df.limit(0), "g", [Criterion("a")]).count() == 0


def test_runs(spark):
    cards = spark.createDataFrame(
        [(1, "a", 1, 5.0), (1, "a", 1, 5.0), (1, "b", 1, 900.0), (1, "c", 1, 1.0), (1, "d", 1, 4.0), (None, "a", 1, 1.0)],
        "run_id long, path string, loaded_at long, score double",
    )
    near = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 1, 0.9), (1, "x", 1, 0.0), (1, "d", 1, float("nan"))], "run_id long, path string, loaded_at long, distance double")
    tracks = spark.createDataFrame([("a", 5), ("b", 1), ("c", 3)], "path string, rating int")
    ranked = rank_runs(cards, near, tracks)
    assert ranked.count() == 4
    assert [r.path for r in top_per_group(ranked, "run_id", "path", 1).collect()] == ["a"]


def test_not_the_mean_of_scaled_scores(spark):
    """Closeness by Euclidean distances on vector-normalised scores, against numpy; the order is another than by mean min-max scores."""
    import numpy as np

    a = np.array([0.0, 9.0, 9.5, 10.0, 5.0, 4.0])
    b = np.array([10.0, 0.2, 1.0, 0.0, 2.6, 3.0])
    df = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "g string, id int, a double, b double")
    got = np.array([r.closeness for r in closeness(df, "g", [Criterion("a", winsor=0.0), Criterion("b", winsor=0.0)]).orderBy("id").collect()])
    v = np.stack([a / np.linalg.norm(a), b / np.linalg.norm(b)])
    ideal = v.max(1, keepdims=True)
    plus, minus = np.sqrt(((ideal - v) ** 2 / ideal).sum(0)), np.sqrt((v**2 / ideal).sum(0))
    assert np.allclose(got, minus / (plus + minus))
    mean = (a / 10 + b / 10) / 2
    assert list(np.argsort(-got)) != list(np.argsort(-mean)) and np.abs(got - mean).max() > 0.02
