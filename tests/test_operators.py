import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.functions import keys, text, vectors
from tonearm.operators import arcs, identity, labels, merge, retrieval, sequencing, sets, structure
from tonearm.sources import exports, readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_blend_values(spark):
    b = lambda a, t, r, s, c: retrieval.blend(F.lit(a), F.lit(t).cast("double"), F.lit(r).cast("int"), F.lit(s).cast("string"), F.lit(c).cast("double"))
    r = one(spark, b(0.8, None, None, None, None).alias("a"), b(0.0, 1.0, None, "propagated", None).alias("b"), b(0.0, 1.0, 5, "manual", None).alias("c"), b(0.0, 1.0, None, "propagated", 0.25).alias("d"))
    assert [round(x, 9) for x in r] == [0.4, 0.2, 0.5, 0.1]


@pytest.mark.parametrize(("a", "b", "fits", "far", "tier"), [("8A", "9A", True, 1, 0), ("12B", "1B", True, 1, 0), ("8A", "11B", False, 4, 3), ("8A", "3A", False, 2, 1), ("8A", "8B", True, 1, 0), ("8A", "10A", False, 2, 2), ("8A", "9B", False, 2, 1), ("zz", "9B", None, None, None)])
def test_keys(spark, a, b, fits, far, tier):
    x, y = F.lit(a), F.lit(b)
    assert tuple(one(spark, keys.compatible(x, y).alias("c"), keys.distance(x, y).alias("d"), keys.grade(x, y).alias("g"))) == (fits, far, tier)


def test_arc_between_points(spark):
    arc = spark.createDataFrame([("a", 0.0, 120.0, -18.0), ("a", 0.5, 124.0, -12.0), ("a", 1.0, 122.0, -16.0)], "name string, position double, bpm double, lufs double")
    slots = spark.createDataFrame([("a", 0.25), ("a", 7.0), ("b", 0.5)], "name string, position double")
    got = {(r.name, r.position): (r.target_bpm, r.target_lufs) for r in arcs.targets(slots, arc).collect()}
    assert got == {("a", 0.25): (122.0, -15.0), ("a", 7.0): (122.0, -16.0), ("b", 0.5): (118.0, -18.0)}
    r = one(spark, arcs.detect(F.lit("a TRAVEL mix")).alias("a"), arcs.detect(F.lit("nothing")).alias("b"), arcs.shape_of(F.lit("slow journey"), "peak").alias("c"), arcs.shape_of(F.lit("x"), "peak").alias("d"))
    assert tuple(r) == ("techno", "open", "build", "peak")


def test_nearest_ties_and_blocks(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(9, [0.0, 1.0]), (10, None)], "id long, v array<double>")
    got = vectors.nearest_rows(rows, rows.where("id < 2"), 3, block=1).collect()
    assert sorted((r.qid, r.id) for r in got) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3)]
    assert vectors.nearest_rows(rows, rows.limit(0), 3).count() == 0


def test_propagation(spark):
    t = spark.createDataFrame(
        [(1, "/1", [1.0, 0.0, 0.0], [1.0, 0.0], 5, "manual"), (2, "/2", [0.0, 1.0, 0.0], [0.0, 1.0], 1, "manual"), (3, "/3", [1.0, 0.0, 0.0], None, None, None), (4, "/4", [1.0, 1.0, 0.0], None, None, "propagated")],
        "id long, path string, embedding array<double>, taste_vec array<double>, rating int, taste_source string",
    )
    got = {r.id: r for r in labels.propagate(t, 2).collect()}
    assert got[3].rating == 5 and math.isclose(got[3].confidence, 1.0) and np.allclose(got[3].taste_vec, [1, 0])
    assert math.isclose(got[4].raw_rating, 3.0)
    u = {r.id: r.uncertainty for r in labels.uncertainty(t, 2).collect()}
    assert math.isclose(u[3], 1 - 0.5 + 0.5)
    assert {r.uncertainty for r in labels.uncertainty(t.where("id > 2"), 2).collect()} == {1.0}


def test_text_keys(spark):
    r = one(spark, text.title_key(F.lit("Strobé (Radio Edit) feat. X")).alias("a"), text.title_key(F.lit("Strobe - 2011 Remaster")).alias("b"), text.artist_key(F.lit("Above & Beyond")).alias("c"), text.artist_key(F.lit("Daft Punk")).alias("d"), text.artist_key(F.lit("A Bee, C Dee")).alias("e"), text.artist_key(F.lit(None).cast("string")).alias("f"))
    assert tuple(r) == ("strobe", "strobe", "above and beyond", "da", "a bee", "")
    links = {"spotify:TRACK:Ab": ("spotify", "track", "Ab"), "open.spotify.com/intl-pt/album/x?si=1": ("spotify", "album", "x"), "https://www.youtube.com/watch?v=q&list=l": ("youtube", "video", "q"), "https://youtube.com/shorts/z": ("youtube", "video", "z"), "music.youtube.com/playlist?list=p": ("youtube", "playlist", "p"), "https://youtu.be/k": ("youtube", "video", "k"), "https://x.example": (None, None, None), "": (None, None, None)}
    df = spark.createDataFrame([(u,) for u in links], "u string").select("u", text.link(F.col("u")).alias("l"))
    assert {x.u: tuple(x.l) for x in df.collect()} == links
    a, t = text.split_title(F.lit("A | B - C [Official Video]"), F.lit("u"))
    assert tuple(one(spark, a.alias("a"), t.alias("t"))) == ("A", "B - C")
    a, t = text.split_title(F.lit("Song (Live) [4K]"), F.lit("Band - Topic"))
    assert tuple(one(spark, a.alias("a"), t.alias("t"))) == ("Band", "Song (Live)")


def test_structure(spark):
    r = one(spark, *(structure.octave_correct(F.lit(x)).alias(f"c{i}") for i, x in enumerate((42.0, 84.0, 168.0, 200.0, 0.0, 128.0))))
    assert tuple(r) == (84.0, 84.0, 84.0, 100.0, 0.0, 128.0)
    df = spark.createDataFrame([([0.0, 5.0, 30.0, 33.0], [5.0, 30.0, 33.0, 60.0], [0.0, 4.0, 29.5, 61.0])], "s array<double>, e array<double>, g array<double>")
    m = df.select(structure.merge_short("s", "e", F.lit(8.0)).alias("x")).first().x
    assert [(p.start, p.end) for p in m] == [(0.0, 33.0), (33.0, 60.0)]
    m = df.select(structure.snap("s", "e", "g", F.lit(1.0)).alias("x")).first().x
    assert [(p.start, p.end) for p in m] == [(0.0, 4.0), (4.0, 29.5), (29.5, 33.0), (33.0, 60.0)]
    assert one(spark, structure.downbeat_phase(F.array(*(F.lit(float(x)) for x in (1, 0, 5, 0, 1, 0, 5, 0)))).alias("p")).p == 2
    s = spark.createDataFrame([(1, i, e, 0.0) for i, e in enumerate((0.0, 5.0, 10.0, 2.0, 4.0, 1.0))] + [(2, 0, 1.0, 0.0)], "track_id long, idx int, energy double, recurrence double")
    assert [x.label for x in structure.label_sections(s).orderBy("track_id", "idx").collect()] == ["intro", "build", "drop", "break", "bridge", "outro", "drop"]


def test_crossfades(spark):
    s = spark.createDataFrame([(1, 0, "/a", 124.0, 31.0), (1, 1, "/b", 124.0, 0.0), (1, 2, "/c", 200.0, None)], "set_id long, i int, path string, bpm double, len double")
    f = sets.crossfades(s, F.col("len"), F.lit(120.0), F.lit(8), F.lit(0.05)).orderBy("i").collect()
    assert [(x.bars, round(x.target_bpm, 3)) for x in f] == [(8, 120.0), (4, 190.0)] and f[0].crossfade_s == 16.0
    assert sets.duration(s, F.col("len"), sets.crossfades(s, F.col("len"), F.lit(120.0), F.lit(8), F.lit(0.05))).first().seconds == pytest.approx(31 + 210 + 210 - 16 - 4 * 240 / 190)


def test_spans_and_greedy(spark):
    sec = spark.createDataFrame([(1, 1, 0, "intro", 0.0, 30.0, -20.0, True, False), (2, 1, 1, "drop", 30.0, 150.0, -8.0, False, False), (3, 1, 2, "outro", 150.0, 200.0, None, False, True)], "id long, track_id long, idx int, label string, start_s double, end_s double, energy_lufs double, is_mixin boolean, is_mixout boolean")
    r = sequencing.play_spans(sec, spark.createDataFrame([(7, 1, -9.0)], "slot_id long, track_id long, target_lufs double")).first()
    assert (r.section_idx, r.cue_start_s, r.cue_end_s, r.core_start_s, r.mixin_label, r.mixout_label) == (1, 0.0, 200.0, 30.0, "intro", "outro")
    cards = spark.createDataFrame([(1, i, f"/{i}", a, "8A", b, -10.0, 0.0, [0.0, 1.0], [120.0, 124.0], [-10.0, -10.0]) for i, (a, b) in enumerate([("x", 124.0), ("y", 120.0), ("x", 122.0)])], "set_id long, i int, path string, artist string, camelot string, bpm double, lufs double, score double, xs array<double>, bpms array<double>, lufss array<double>")
    assert [x.path for x in sequencing.greedy(cards).orderBy("i").collect()] == ["/1", "/2", "/0"]


def test_merges(spark):
    old = spark.createDataFrame([(1, "/a", "T", "I1", True, 4), (2, "/b", "U", None, False, None)], "id long, path string, title string, isrc string, is_favorite boolean, rating int")
    new = spark.createDataFrame([("/a", None, "", False, 1.0), ("/c", "V", "I3", None, 2.0)], "path string, title string, isrc string, is_favorite boolean, duration_s double")
    got = {r.path: (r.id, r.title, r.isrc, r.is_favorite, r.rating) for r in merge.upsert_tracks(old, new).collect()}
    assert got == {"/a": (1, None, "I1", True, 4), "/b": (2, "U", None, False, None), "/c": (3, "V", "I3", False, None)}


def test_find_match(spark):
    t = spark.createDataFrame([(1, "A", "S", 200.0, None), (2, "B", "S", 200.0, "i1"), (3, "C", "S", 100.0, None)], "id long, artist string, title string, duration_s double, isrc string")
    r = spark.createDataFrame([(10, "a", "S (x)", 204.0, None), (11, "zz", "y", None, " I1 "), (12, "c", "s", 200.0, None), (13, None, None, None, None)], "id long, artist string, title string, duration_s double, isrc string")
    got = {x.track_id: (x.review_id, x.confident, x.reason) for x in identity.find_match(r, t).collect()}
    assert got == {1: (10, True, "name+duration"), 2: (11, True, "isrc"), 3: (12, False, "duration-mismatch")}


def test_sources_and_exports(spark, tmp_path):
    for p in ("a/x.FLAC", "Favorites/y.mp3", "n.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"0")
    got = [(r.path.rsplit("/", 1)[1], r.is_favorite) for r in readers.audio_folder(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("x.FLAC", False), ("y.mp3", True)]
    log = tmp_path / "h.jsonl"
    log.write_text("\n".join([json.dumps({"brief": "b", "approved": i != 2, "captured_at": float(i), "paths": [f"/{i}", "/all"]}) for i in range(5)]) + "\n\n{broken\n")
    h = readers.history(spark, str(log))
    assert {r.path for r in readers.recent_paths(h, 2).collect()} == {"/3", "/4", "/all"}
    d = readers.detected(spark.createDataFrame([(json.dumps({"bpm": 0, "downbeats": [0.0, 2.0, 4.0, 6.5]}),)], "json string")).first()
    assert d.bpm == 120.0
    pl = spark.createDataFrame([(json.dumps({"entries": [None, {"id": "1", "title": "[Private video]"}, {"id": "2", "title": "T", "channel": "C", "duration": 0}]}),)], "json string")
    assert [(r.id, r.uploader, r.duration_s) for r in readers.playlist_entries(pl).collect()] == [("2", "C", None)]
    rows = [{"i": 0, "track_no": 1, "first": True, "path": "/a b.flac", "title": "T&", "artist": None, "bpm": 120.0, "camelot": "8A", "first_downbeat_s": 0.5, "cue_start_s": 1.0, "core_start_s": None, "cue_end_s": 9.0}, {"i": 1, "track_no": 1, "first": False, "path": "/a b.flac", "title": "T&", "artist": None, "bpm": 120.0, "camelot": "8A", "first_downbeat_s": 0.5, "cue_start_s": 1.0, "core_start_s": None, "cue_end_s": 9.0}]
    import xml.etree.ElementTree as ET

    root = ET.fromstring(exports.collection_xml(rows, "set", {"8A": "Am"}).encode())
    assert len(root.findall(".//COLLECTION/TRACK")) == 1 and len(root.findall(".//NODE/TRACK")) == 2 and len(root.findall(".//POSITION_MARK")) == 4
    assert root.find(".//COLLECTION/TRACK").get("Location") == "file://localhost/a%20b.flac"


def test_streaming_ingest(spark, tmp_path):
    from tonearm.streaming.ingest import current, ingest

    schema = "id long, path string, title string, isrc string, is_favorite boolean, duration_s double"
    spark.createDataFrame([(1, "/a", "T", "I1", True, 1.0)], schema).write.parquet(str(tmp_path / "lib/v=0"))
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(None, "/a", "T2", None, False, 2.0), (None, "/b", "U", None, False, 2.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.path: (r.id, r.title, r.isrc, r.is_favorite) for r in current(spark, str(tmp_path / "lib")).collect()}
    assert got == {"/a": (1, "T2", "I1", True), "/b": (2, "U", None, False)}


def test_ids_of_many_new_paths_are_distinct(spark):
    """More new rows than a range partitioning samples in full."""
    old = spark.createDataFrame([(7, "/a", 1.0)], "id long, path string, duration_s double")
    new = spark.range(300_000).selectExpr("concat('/n', id) as path", "cast(id as double) as duration_s", "'t' as title")
    out = merge.upsert_tracks(old.selectExpr("*", "'t' as title"), new)
    r = out.selectExpr("count(*) as n", "count(distinct id) as ids", "min(id) as lo", "max(id) as hi").first()
    assert (r.n, r.ids, r.lo, r.hi) == (300_001, 300_001, 7, 300_007)
    first = out.where("path in ('/n0', '/n1', '/n10')").orderBy("path").collect()
    assert [x.id for x in first] == [8, 9, 10]


def test_a_fresh_checkpoint_goes_on_from_the_newest_version(spark, tmp_path):
    from tonearm.streaming.ingest import current, ingest, versions

    schema = "id long, path string, title string, isrc string, is_favorite boolean, duration_s double"
    lib = str(tmp_path / "lib")
    for v in (0, 1, 5):
        spark.createDataFrame([(1, "/a", f"T{v}", "I1", True, 1.0)], schema).write.parquet(f"{lib}/v={v}")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(None, "/b", "U", None, False, 2.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for cp in ("one", "one", "two"):
        ingest(spark, str(tmp_path / "in"), lib, str(tmp_path / cp)).awaitTermination(120)
    assert versions(spark, lib) == [0, 1, 5, 6, 7]
    assert spark.read.parquet(f"{lib}/v=1").first().title == "T1" and {r.path for r in current(spark, lib).collect()} == {"/a", "/b"}


def test_few_rows_to_many_queries_in_parts(spark):
    import numpy as np

    from tonearm.functions.vectors import nearest_of, nearest_rows

    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(90, 6)))] + [(500, None)], "id long, v array<double>")
    want = sorted(map(tuple, nearest_rows(rows, rows, 4).collect()))
    assert want == sorted(map(tuple, nearest_of(rows, rows, 4).collect())) == sorted(map(tuple, nearest_of(rows, rows, 4, block=20, most=2000).collect()))
    assert nearest_of(rows.limit(0), rows, 4).count() == 0


def test_review_life_cycle(spark):
    kind = "id long, isrc string, spotify_id string, artist string, title string, album string, duration_s double, note string, rating int, role string, source string, status string, matched_path string, captured_at long"
    row = lambda i, isrc, a, t, note, at, rating=None, s="pending", d=None: (i, isrc, None, a, t, None, d, note, rating, None, "chat", s, None, at)
    stored = spark.createDataFrame([row(1, "i1", "A", "S", "old", 1, 3), row(2, None, "B", "T", "old", 2), row(3, None, "C", "U", "used", 3, s="applied")], kind)
    new = spark.createDataFrame([row(1, "I1", "other", "name", "by code", 10), row(2, "i9", "b", "T (x)", "by name", 11, 5), row(3, None, "C", "U", "again", 12), row(4, None, "c", "u", "newer", 13)], kind)
    got = {r.id: (r.note, r.rating, r.isrc, r.status) for r in identity.add_reviews(stored, new).collect()}
    assert got[1] == ("by code", 3, "I1", "pending") and got[2] == ("by name", 5, "i9", "pending") and got[3] == ("used", None, None, "applied") and got[4][0] == "newer" and len(got) == 4
    tracks = spark.createDataFrame([(1, "/a", "A", "S", 200.0, None, None, None, None, None, None), (2, "/a2", "A", "S", 200.0, None, None, None, None, None, None), (3, "/b", "B", "T", 100.0, None, "mine", "manual", 1, None, None), (4, "/z", "Z", "Z", 100.0, None, None, None, None, None, None)], "id long, path string, artist string, title string, duration_s double, isrc string, taste_note string, taste_source string, rating int, role string, taste_vec array<float>")
    after, reviews = identity.drain(tracks, stored, tracks)
    assert {r.path: (r.taste_note, r.taste_source) for r in after.collect()} == {"/a": ("old", "manual"), "/a2": (None, None), "/b": ("mine", "manual"), "/z": (None, None)}
    assert {r.id: (r.status, r.matched_path) for r in reviews.collect()} == {1: ("applied", "/a"), 2: ("pending", None), 3: ("applied", None)}


def test_genre_thresholds_and_plan_json(spark):
    from tonearm.functions import replies

    s = spark.createDataFrame([(k, i, 2, i / 1.0, f"/{k}{i}", "", f"x{i}", "8A", b, -10.0, 0.0) for k in (1, 2) for i, b in ((0, 100.0), (1, 110.0))], "set_id long, i int, n long, position double, path string, title string, artist string, camelot string, bpm double, lufs double, score double")
    g = spark.createDataFrame([(1, 12.0, 0.4)], "set_id long, max_bpm_jump double, min_harmonic double")
    assert {r.set_id: r.passed for r in sets.graded_by_genre(s, F.lit(-10.0), g).collect()} == {1: True, 2: False}
    text = '{"brief": "b", "arc": {"name": "build", "minutes": 60, "points": [{"position": 0, "bpm": 120, "lufs": -9, "x": 1}]}, "slots": [{"path": "/a", "bpm": 120.5, "unknown": 3}], "more": {}}'
    df = spark.createDataFrame([(text,), ("{broken",), (None,)], "j string").select(replies.plan_of(F.col("j")).alias("p"))
    p, broken, none = (r.p for r in df.collect())
    assert broken is None and none is None and p.slots[0].path == "/a" and p.slots[0].title is None and p.arc.points[0].lufs == -9.0
    again = df.select(replies.plan_of(replies.plan_text(F.col("p"))).alias("p")).first().p
    assert again == p
