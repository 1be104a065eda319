import random

import pytest

from tonearm.llm.recordings import _near, credits_of, isrc_of, matched, one_word_off, work_of


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Glass Letter (Original Mix)", ("glass letter", "", "")), ("Glass Letter - Radio Edit [feat. Ann Other]", ("glass letter", "radio edit", "")), ("GLASS LETTER (2019 Remaster)", ("glass letter", "", "")),
        ("Glass Letter ft. Ann Other", ("glass letter", "", "")), ("Glass Letter [Live at Velka]", ("glass letter", "live", "velka")), ("夜の海 (Dub)", ("夜の海", "dub", "")), (None, ("", "", "")),
    ],
)
def test_work(title, want):
    assert work_of(title) == want


def test_parts():
    assert work_of("A (Ann Other Remix)") == ("a", "remix", "Ann Other") and work_of("A - Other, Ann rework") == ("a", "remix", "Other, Ann")
    assert credits_of("A & B & C & D") == ["A & B", "C & D"] and credits_of("The A & B") == ["The A & B"]
    assert credits_of("Kilorbach Choir, Margaret Dulirlas") == ["Kilorbach Choir", "Margaret Dulirlas"]
    assert credits_of("Halofax, Janis; Ann Other") == ["Halofax, Janis", "Ann Other"]
    assert credits_of("A Bee x C Dee feat. E Eff") == ["A Bee", "C Dee", "E Eff"]
    assert isrc_of("ISRC zz-000-19-00441") == "ZZ0001900441" and isrc_of("ZZXXX0000000") is None and isrc_of("") is None
    assert one_word_off("empty crystla silhouette", "empty crystal silhouette") and not one_word_off("diary 35", "diary 36") and not one_word_off("red one", "red two")


def test_cascade_and_edges(spark):
    tracks = [
        (1, "/1", "Janis Halofax", "Glass Letter", 200.0, "ZZ0001900441"), (2, "/2", "Halofax, Janis", "Glass Letter (Extended Mix)", 320.0, None), (3, "/3", "JANIS HALOFAX feat. Ann Other", "Glass Letter (Original Mix)", 202.0, ""),
        (30, "/30", "Janis Halofax", "Glass Letter (Jennifer Other Remix)", 280.0, None), (4, "/4", None, "Glass Letter", 200.0, None), (5, "/5", None, None, 200.0, "zz 000 19 00441"), (6, "/6", "Ann Other", "Empty Silhouette", 240.0, None), (7, "/7", "Ann Other", "Glass Letter", 200.0, "ZZXXX0000000"), (8, "/8", "Some One", None, None, "ZZXXX0000000"), (1, "/1", "Janis Halofax", "Glass Letter", 200.0, "ZZ0001900441"),
    ]
    reviews = [
        (10, "Janis Halofax", "glass letter", 201000.0, None, "/1"), (11, "Janis Halofax", "Glass Letter [Extended Mix]", None, None, None), (12, "x", "y", None, "ZZ-000-19-00441", None), (13, "Ann Other", "Empty Silhuoette", 241.0, None, None),
        (31, "Janis Halofax", "glass letter [Other, Jenny rework]", 281.0, None, None), (14, "Janis Halofax", "Glass Letter (Demo)", 200.0, None, None), (15, "Other Name", "Glass Letter", 200.0, None, None), (16, None, None, None, None, None), (17, "Janis Halofax", "Glass Letter", 321.0, None, None), (18, "Ann Other", "Glass Letter", None, "ZZXXX0000000", None),
    ]
    t = spark.createDataFrame(tracks, "id long, path string, artist string, title string, duration_s double, isrc string").selectExpr("*", "1 as rule", "2 as work")
    r = spark.createDataFrame(reviews, "id long, artist string, title string, duration_s double, isrc string, matched_path string")
    got = matched(r, t).collect()
    assert len(got) == len({(x.pending_id, x.track_id) for x in got})
    pairs = {(x.pending_id, x.track_id) for x in got}
    assert {(10, 1), (10, 3), (11, 2), (12, 5), (13, 6), (31, 30), (17, 2), (18, 7)} <= pairs
    assert not {p for p in pairs if p[0] in (15, 16) or p[1] in (4, 8)}
    assert all(0 < x.confidence < 1 for x in got)
    assert matched(r.limit(0), t).count() == 0 and matched(r, t.limit(0)).count() == 0


def test_keys_of_long_and_single_words():
    long = " ".join(f"word{k}" for k in range(60))
    assert set(_near(long)) & set(_near(long.replace("word55", "wrod55"))) and not set(_near(long)) & set(_near(long + " more"))
    assert set(_near("glass letter")) & set(_near("glassletter"))
    r = random.Random(2)
    for n in (3, 5, 15, 16, 17, 18, 19, 40, 300):
        for _ in range(30):
            w = "".join(r.choices("abcdefgh", k=n))
            v = w
            for _ in range(1 if n < 4 else 2):
                k = r.randrange(len(v) - 1)
                v = r.choice([v[:k] + v[k + 1 :], v[:k] + "x" + v[k:], v[:k] + "x" + v[k + 1 :], v[:k] + v[k + 1] + v[k] + v[k + 2 :]])
            if len(v) >= 3:
                assert set(_near(w)) & set(_near(v)), (w, v)
    assert len(_near("a" * 100_000)) < 200


def test_long_titles_and_missing_blanks(spark):
    long = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    tracks = [(1, "/1", "Ann Other", long, 200.0, None), (2, "/2", "Ann Other", "Glass Letter", 200.0, None), (3, "/3", "Ann Other", "x" * 25 + "silhouette" + "y" * 25, 200.0, None)]
    reviews = [(10, "Ann Other", long.replace("wordbx", "wrodbx"), 200.0, None, None), (11, "Ann Other", "Glassletter", 201.0, None, None), (12, "Ann Other", "x" * 25 + "silhuoette" + "y" * 25, 200.0, None, None)]
    t = spark.createDataFrame(tracks, "id long, path string, artist string, title string, duration_s double, isrc string")
    r = spark.createDataFrame(reviews, "id long, artist string, title string, duration_s double, isrc string, matched_path string")
    assert {(x.pending_id, x.track_id) for x in matched(r, t).collect()} == {(10, 1), (11, 2), (12, 3)}
