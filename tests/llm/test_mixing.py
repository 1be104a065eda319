import math
import random

from tonearm.llm.mixing import TOKENIZER, _encoding, balance, count_tokens, pieces, solve


def test_shares_limits_and_edges(spark):
    words = "one two three four five six seven eight nine ten "
    rows = [(i, ["a", "B", "c"][i % 3], words * (1 + i % 7)) for i in range(900)] + [(1000 + i, "rare", words) for i in range(5)] + [(2000, None, words), (2001, "a", None), (2002, "other", words), (2003, "A ", "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, tokens string")
    targets = spark.createDataFrame([("A", 0.5, 3), ("b", 0.2, 2), ("C", 0.1, 2), ("Rare", 0.15, 4), ("none", 0.05, 4)], "source string, target_share double, max_uses int")
    mix, report = balance(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert {s for s, r in got.items() if not r.reachable} == {"Rare", "none"}
    for s in ("A", "b", "C"):
        assert abs(got[s].mixed_tokens / got[s].target_tokens - 1) < 0.1
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9
    for r in got.values():  # what the solver says against the capacity
        assert r.reachable == (r.tokens * r.max_uses >= r.target_tokens)
        assert abs(r.share_of_wanted - r.mixed_tokens / (r.target_tokens / r.target_share)) < 1e-9
    copies = {r.doc_id: (r.copies, r.rate) for r in mix.collect()}
    assert all(copies[1000 + i][0] == 4 for i in range(5)) and 2000 not in copies and copies[2001][0] == 0
    assert max(c for c, _ in copies.values()) <= 4
    want = {s: sum(r.rate * r.tokens for r in mix.where(f"source = '{s.lower()}'").collect()) for s in ("A", "b", "C")}
    assert all(abs(want[s] / got[s].target_tokens - 1) < 1e-6 for s in want)
    _, none = balance(docs.limit(0), targets)
    assert {r.source: r.mixed_tokens for r in none.collect()} == dict.fromkeys(("A", "b", "C", "Rare", "none"), 0)


def test_cuts_change_no_count(spark):
    rng = random.Random(3)
    enc = _encoding(open(TOKENIZER, "rb").read())
    text = "".join(rng.choice([" ", "  ", "\n", "a", "Bc", "é", "7", "!", "'s", "日本", " x", "\t "]) for _ in range(20000))
    for size in (1, 7, 50, 1000):
        parts = list(pieces(text, size))
        assert "".join(parts) == text and len(parts) > 1
        assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
    long = "some words about music 12 " * 80_000
    df = spark.createDataFrame([(1, "a", long), (2, "a", None)], "doc_id long, source string, text string")
    assert {r.doc_id: r.tokens for r in count_tokens(df).collect()} == {1: len(enc.encode_ordinary(long)), 2: 0}


def test_bounds_of_the_dual(spark):
    counts = spark.createDataFrame([("a", 10, 5), ("b", 10, 5), ("c", 10, 5), ("d", 7, 3), ("z", 0, 4)], "source string, tokens long, n long")
    got = solve(counts, [("a", 0.5, 1), ("b", 0.5, 2), ("c", 1.5, 2), ("d", 0.0, 2), ("z", 0.1, 2)], 100.0, 10.0)
    assert got["a"][1] and got["a"][0] == 0  # exactly all of it
    assert got["b"] == (0.0, True) and got["c"] == (math.inf, False) and got["d"][0] == -math.inf and got["z"] == (math.inf, False)
