"""What a model's free text holds: picked candidates, target curves, split message lists. The model itself is a column of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def picks(reply: Column, n: Column) -> Column:
    """Zero-based candidates named in a reply's JSON list (numbers from 1, or objects with n, index or number), in order, in range, once each; empty for anything else."""
    body = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    items = F.from_json(body, "array<string>")

    def number(x: Column) -> Column:
        plain = F.regexp_extract(x, r"^-?\d+$", 0)
        inner = F.coalesce(*(F.when(F.get_json_object(x, f"$.{k}").rlike(r"^\d+$"), F.get_json_object(x, f"$.{k}")) for k in ("n", "index", "number")))
        return F.coalesce(F.nullif(plain, F.lit("")), inner).try_cast("int") - 1

    found = F.transform(F.coalesce(items, F.array().cast("array<string>")), number)
    return F.array_distinct(F.filter(found, lambda i: i.isNotNull() & (i >= 0) & (i < n)))


def curve(reply: Column) -> Column:
    """Control points (position clamped to 0..1, bpm, lufs) of a reply's JSON object, by position; null under two usable points or where all share one position."""
    data = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "struct<name:string,points:array<struct<position:double,bpm:double,lufs:double>>>")
    ok = F.filter(data["points"], lambda p: p["position"].isNotNull() & p["bpm"].isNotNull() & p["lufs"].isNotNull())
    pts = F.array_sort(F.transform(ok, lambda p: F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["position"])).alias("position"), p["bpm"].alias("bpm"), p["lufs"].alias("lufs"))))
    return F.when((F.size(pts) >= 2) & (F.element_at(pts, -1)["position"] > F.element_at(pts, 1)["position"]), pts)


def split_messages(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, system, turns): each conversation's system texts joined by a blank line, and its other turns in order. A conversation is short."""
    rows = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "content"))).alias("m"))
    system = F.filter("m", lambda x: x["role"] == "system")
    turns = F.filter("m", lambda x: x["role"] != "system")
    return rows.select(key, F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda x: x["content"]), "\n\n")).alias("system"), F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))


def shown(artist: Column, title: Column, seconds: Column) -> Column:
    """``Artist — Title (m:ss)`` with what is known of it."""
    s = F.rint(seconds).cast("int")
    name = F.concat_ws(" — ", F.nullif(artist, F.lit("")), F.nullif(title, F.lit("")))
    return F.when(s > 0, F.concat(name, F.lit(" ("), F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(")"))).otherwise(name)


PLAN = "brief string, genre string, arc struct<name:string,minutes:int,points:array<struct<position:double,bpm:double,lufs:double>>>, slots array<struct<position:double,path:string,title:string,artist:string,camelot:string,bpm:double,lufs:double,cue_start_s:double,cue_end_s:double,core_start_s:double,section_label:string>>"


def plan_of(json: Column) -> Column:
    """A set plan from its JSON; keys unknown to the plan are dropped, missing ones are null, a broken text is null."""
    plan = F.from_json(json, PLAN, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(json).isNotNull(), plan)


def plan_text(plan: Column) -> Column:
    """A set plan as JSON, null fields written too, so that it reads back the same."""
    return F.to_json(plan, {"ignoreNullFields": "false"})
