import math

import pytest

from tonearm.llm.names import abbreviates, edits, entity_pairs, letter_model, linked, parse


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Halofax, Janis", "Janis Halofax"), ("Janis M. Halofax", "janis halofax"), ("Raul Falimdal", "Raúl Falimdal"), ("The Velalski Unit", "Velalski Unit, The"), ("The-Velalski Unit", "Velalski-Unit"),
        ("Musinwick Orch.", "Musinwick Orchestra"), ("Borabsén & Walendquist", "Walendquist and Borabsén"), ("Ludanlund-& Nemoda", "Ludanlund + Nemoda"), ("Semara Eskava", "Eskava Semara"),
    ],
)
def test_same_class(a, b):
    assert parse(a).key == parse(b).key


def test_edits():
    assert [edits(*x) for x in (("abc", "abc"), ("abcd", "abdc"), ("abcd", "abxx"), ("abcdef", "xyzdef"))] == [0, 1, 2, 3]


def test_entities_and_edges(spark):
    groups = [
        ["Katherine Nemibsen", "Kate Nemibsen", "Nemibsen, K.", "Katherine Nembisen", "KATHERINE NEMIBSEN"],
        ["Towyn Halofax"], ["Tadan Halofax"], ["Janis Halofax", "Janis Haoeax"],
        ["Kalevpard Orchestra", "The Kalevpard Orch.", "Kalevprad Orchestra"], ["Kalevpard Collective"],
        ["Ingomda & Skaoby", "Skaoby + Ingomda", "Ingmda & Skaoby"],
    ]
    filler = [f"{a}{b} {c}{d}" for a in ("Zu", "Mi", "Ol") for b in ("keo", "vek") for c in ("Nemib", "Halo", "Walen", "Kalev", "Skao") for d in ("sen", "fax", "quist")]
    rows, truth, i = [], {}, 0
    for e, g in enumerate(groups + [[f] for f in filler]):
        for k, s in enumerate(g):
            i += 1
            rows.append((i, s, 20 if k == 0 else 2, 0))
            truth[i] = e
    rows += [rows[0], (1000, None, 1, 0), (1001, "", None, 0), (1002, "?!", 1, 0), (1003, "ab " * 3000, 1, 0)]
    df = spark.createDataFrame(rows, "credit_id long, credit string, n_rows int, entity int")
    out = linked(df).cache()
    assert out.count() == i + 4
    got = {(r.credit_a, r.credit_b) for r in entity_pairs(out).collect()}
    assert got == {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert all(0 < r.posterior <= 1 for r in out.collect())
    assert linked(df.limit(0)).count() == 0


@pytest.mark.parametrize(("short", "full"), [("gabe", "gabriel"), ("gab", "gabriel"), ("gabby", "gabriel"), ("abby", "abigail"), ("philh", "philharmonic"), ("phlh", "philharmonic"), ("chrs", "charles")])
def test_abbreviations(short, full):
    assert abbreviates(short, full) is not None


def test_no_abbreviations():
    assert all(abbreviates(*x) is None for x in (("gabriel", "gabe"), ("mabe", "gabriel"), ("g", "gabriel"), ("gabi", "george"), ("jon", "john")))


def test_abbreviations_linked_without_a_list(spark):
    pairs = [("Gabriel Halofax", "Gabe Halofax"), ("Gabriel Nemibsen", "Gab. Nemibsen"), ("Abigail Falimdal", "Abby Falimdal"), ("Kalev Philharmonic", "Kalev Philh.")]
    others = [f"{a} {b}{c}" for a in ("Towyn", "Tadan", "Raul", "Semara", "Ingo") for b in ("Walen", "Skao", "Veal", "Boro") for c in ("quist", "bysk", "dorn")]
    rows = [(2 * k + j, x, 20 if j == 0 else 2) for k, p in enumerate(pairs) for j, x in enumerate(p)] + [(100 + k, x, 5) for k, x in enumerate(others)]
    out = linked(spark.createDataFrame(rows, "credit_id long, credit string, n_rows int"))
    assert sorted((r.credit_a, r.credit_b) for r in entity_pairs(out).collect()) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert all(0 < r.posterior <= 1 for r in out.collect())


def test_letter_model_against_counts(spark):
    """Every quadruple counts, against the same sums in plain Python."""
    from collections import Counter

    words = ["anna", "annabel", "hanna", "ab", "日本語の歌", "annann"]
    quads = {w: [("^^^" + w + "$")[i : i + 4] for i in range(len(w) + 1)] for w in words}
    four = Counter(g for q in quads.values() for g in q)
    part = lambda a, b: Counter({k: n for k in {g[a:b] for g in four} for n in [sum(n for g, n in four.items() if g[a:b] == k)]})
    s4, c3, s3, c2, s2 = part(0, 3), part(1, 4), part(1, 3), part(2, 4), part(2, 3)
    want = {}
    for w, q in quads.items():
        want[w] = 0.0
        for g in q:
            p2 = (c2[g[2:]] - 1 + 0.3) / (s2[g[2:3]] - 1 + 9)
            p3 = (c3[g[1:]] - 1 + 3 * p2) / (s3[g[1:3]] - 1 + 3)
            want[w] += math.log((four[g] - 1 + 3 * p3) / (s4[g[:3]] - 1 + 3))
    got = {r.w: r.own for r in letter_model(spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)


def test_typos_that_recur_in_many_names_stay_typos(spark):
    """The same misspelling of a frequent word turns up under many names in a large table; a word of its own does so too, but without the frequent word in its place."""
    family = [a + b for a in ("Walen", "Skao", "Vealo", "Boro", "Nemi", "Kalev", "Musin", "Trio") for b in ("quist", "bysk", "dorn", "fax", "mund")]
    rows, truth = [], {}

    def add(text, n, entity):
        rows.append((len(rows) + 1, text, n))
        truth[len(rows)] = entity

    for k, w in enumerate(family):
        add(f"Giuseppe {w}", 5, f"giuseppe {w}")
        if k % 6 == 0:
            add(f"Guiseppe {w}", 2, f"giuseppe {w}")
    for k, w in enumerate(family):
        add(f"Tavelo {w}", 4, f"tavelo {w}")
        if k % 4 == 0:
            add(f"Tabelo {w}", 3, f"tabelo {w}")
    for w in ("Ingomda", "Ludanlund", "Halorsen", "Ostevner", "Umbessel", "Cresholt", "Dulirlas", "Hrouner", "Jasodwick", "Loronquist", "Pelamund", "Rudalby", "Sabivro", "Voramdal", "Xanobzek"):
        add(f"Tabelo {w}", 3, f"tabelo {w}")
    out = linked(spark.createDataFrame(rows, "credit_id long, credit string, n_rows int"))
    got = {(r.credit_a, r.credit_b) for r in entity_pairs(out).collect()}
    assert got == {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
