import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonearm.llm.lookalike import ConflictError, build_doubles, build_mapping, canonical, irregular_cells, unify  # noqa: F401


@pytest.mark.parametrize(
    ("shown", "plain"),
    [
        ("Ｇｏｌｄｅｎ （Ｄｕｂ）", "Golden (Dub)"),
        ("Café", "Café"),
        ("Fro​zen Tem­ple", "Frozen Temple"),
        ("Sсаrlеt", "Scarlet"),
        ("CEВЕР зима", "СЕВЕР зима"),
        ("Oﬃcial", "Official"),
        ("Север", "Север"),
        ("Θάλασσα", "Θάλασσα"),
        ("夜の海", "夜の海"),
        ("👩‍🚀 trip", "👩‍🚀 trip"),
        ("Smørrebrød", "Smørrebrød"),
        ("ɡood", "good"),
        ("ɑbc", "abc"),
        ("Ꮪong", "Song"),
        ("ոame", "name"),
        ("ꓢong and ꓢolo", "Song and Solo"),
        ("ɡʊd", "ɡʊd"),
        ("ᎠᏗᎳ", "ᎠᏗᎳ"),
        ("նոր երգ", "նոր երգ"),
        ("\U0002f800", "\u4e3d"),
        ("𝐁𝐨𝐥𝐝 🄰", "Bold 🄰"),
        ("", ""),
        (None, None),
    ],
)
def test_forms(shown, plain):
    assert canonical(shown) == plain


def test_mapping_has_no_conflicts():
    table = build_mapping()
    assert len(table) > 2000
    doubles = build_doubles(table)
    assert all(canonical(f"wd{v}w") == f"wd{v}w" and canonical(f"wd{k}w") == f"wd{v}w" for t in doubles.values() for k, v in t.items())
    with pytest.raises(ConflictError):
        build_doubles({"А": "A"})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeopcxABCИжЯωΔнշոաᎠᏗꓢꓘɡʊd' \u0301\u200b"), max_size=12))
def test_idempotent_on_mixed_scripts(text):
    once = canonical(text)
    assert canonical(once) == once


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=30))
def test_idempotent(text):
    once = canonical(text)
    assert canonical(once) == once


def test_frames(spark):
    df = spark.createDataFrame([(1, "a​b", "x"), (2, None, "y"), (3, "ab", "z"), (3, "ab", "z"), (4, "аb" * 5000, "w")], "id long, t string, t_canonical string")
    assert {r.id: r.t_canonical for r in unify(df, ["t"]).collect()} == {1: "ab", 2: None, 3: "ab", 4: "ab" * 5000}
    assert sorted(r.id for r in irregular_cells(df, "t").collect()) == [1, 4]
    assert irregular_cells(df.limit(0), "t").count() == 0
