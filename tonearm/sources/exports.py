"""Sets written for players: collection XML, m3u8 lists, set sheets. A set is short, so its text is built from its ordered rows."""

from __future__ import annotations

from urllib.parse import quote
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collection(slots: DataFrame) -> DataFrame:
    """``slots`` with ``track_no``, the number of each path by first appearance in its set, and ``first``, whether this slot is it."""
    first = F.min("i").over(Window.partitionBy("set_id", "path"))
    s = slots.withColumn("__f", first)
    return s.withColumn("track_no", F.dense_rank().over(Window.partitionBy("set_id").orderBy("__f"))).withColumn("first", F.col("i") == F.col("__f")).drop("__f")


def seconds(duration: Column, cue_end: Column, missing: int) -> Column:
    return F.coalesce(F.rint(F.when(duration > 0, duration)), F.rint(F.when(cue_end > 0, cue_end)), F.lit(float(missing))).cast("int")


def m3u8(slots: DataFrame) -> DataFrame:
    """(set_id, text): an extended playlist of each set, absolute paths in order."""
    line = F.concat(F.lit("#EXTINF:"), seconds(F.col("duration_s"), F.col("cue_end_s"), -1).cast("string"), F.lit(","), F.coalesce("artist", F.lit("")), F.lit(" - "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("path"))
    rows = slots.select("set_id", F.struct("i", line.alias("line")).alias("r"))
    return rows.groupBy("set_id").agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def mix_style(bars: Column) -> Column:
    return F.when(bars >= 8, "long blend").when(bars >= 4, "blend").when(bars >= 2, "short blend").otherwise("cut")


def sheet(slots: DataFrame, fades: DataFrame) -> DataFrame:
    """(set_id, text): a table of each set with how every slot is mixed into the next."""
    j = slots.join(fades.select("set_id", "i", "bars"), ["set_id", "i"], "left")
    row = F.concat(F.lit("| "), (F.col("i") + 1).cast("string"), F.lit(" | "), F.coalesce("artist", F.lit("")), F.lit(" – "), F.coalesce("title", F.lit("")), F.lit(" | "), F.format_number("bpm", 1), F.lit(" | "), F.coalesce("camelot", F.lit("")), F.lit(" | "), F.when(F.col("bars").isNull(), "").otherwise(mix_style(F.col("bars"))), F.lit(" |"))
    head = "| # | track | bpm | key | into next |\n|---|---|---|---|---|\n"
    return j.select("set_id", F.struct("i", row.alias("line")).alias("r")).groupBy("set_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")).alias("text"))


def collection_xml(rows: list, name: str, key_names: dict[str, str]) -> str:
    """Player collection of one set from its collected slot rows (``collection``): each file once, the playlist every slot, cues as hot and memory cues."""
    tracks, listed = [], []
    for r in sorted(rows, key=lambda r: r["i"]):
        listed.append(f'      <TRACK Key="{r["track_no"]}"/>')
        if not r["first"]:
            continue
        where = "file://localhost" + quote(r["path"])
        head = f'    <TRACK TrackID="{r["track_no"]}" Name={quoteattr(r["title"] or "")} Artist={quoteattr(r["artist"] or "")} Location={quoteattr(where)} AverageBpm="{r["bpm"]:.2f}" Tonality={quoteattr(key_names.get(r["camelot"], r["camelot"] or ""))}>'
        marks = []
        if r["first_downbeat_s"] is not None and r["bpm"] > 0:
            marks.append(f'      <TEMPO Inizio="{r["first_downbeat_s"]:.3f}" Bpm="{r["bpm"]:.2f}" Metro="4/4" Battito="1"/>')
        for num, (label, at) in enumerate((("IN", r["cue_start_s"]), ("CORE", r["core_start_s"]), ("OUT", r["cue_end_s"]))):
            if at is not None:
                marks += [f'      <POSITION_MARK Name="{label}" Type="0" Start="{at:.3f}" Num="{n}"/>' for n in (num, -1)]
        tracks.append("\n".join([head, *marks, "    </TRACK>"]))
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<DJ_PLAYLISTS Version="1.0.0">', f'  <COLLECTION Entries="{len(tracks)}">', *tracks, "  </COLLECTION>", "  <PLAYLISTS>", f'    <NODE Type="1" Name={quoteattr(name)} Entries="{len(listed)}" KeyType="0">', *listed, "    </NODE>", "  </PLAYLISTS>", "</DJ_PLAYLISTS>", ""])
