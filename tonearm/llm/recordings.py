"""Reviews brought together with the files of the same recording, without a common key.

A cascade of exact joins, the strongest attributes first: ISRC; artist, work, version and length; the
same with the version named on one side only; without a length; with one mistyped word of the title; without length and version, where
only one version is there; by a further credited artist. Reviews resolved by a rule are taken out (anti-join) before the next. Then every file that
carries the resolved recording's artist, work, version and length is added. A rule's confidence is its precision on reviews whose matched file is known,
smoothed by two pseudo-observations.

Artists are compared by entity (spellings linked as in ``names``), texts in the one form of ``lookalike``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import names
from tonearm.llm.lookalike import canonical
from tonearm.plans.staging import spread, stage

# Qualifiers that do not make another version.
SAME = regex.compile(r"(?:\d{4} )?(?:digital )?remaster(?:ed)?(?: version)?(?: \d{4})?|album version|single version|lp version|original(?: mix| version)?|official (?:audio|video|music video|visualizer)|audio|lyric(?:s)? video|explicit|clean|hq|hd|mono|stereo|full version|main mix|free download")
_FEAT = regex.compile(r"\s*[(\[]\s*(?:feat\.?|ft\.?|featuring|with)\s[^)\]]*[)\]]|\s+(?:feat\.?|ft\.?|featuring)\s+.*$", regex.I)
_BRACKET = regex.compile(r"[(\[]([^()\[\]]*)[)\]]")
_CREDITS = regex.compile(r"\s+(?:feat\.?|ft\.?|featuring|with|vs\.?|x|pres\.?)\s+|\s*[;/]\s*", regex.I)
_REMIX = regex.compile(r"^(.*\S)\s+(?:remix|rework|rmx|re-?edit|refix|bootleg|flip|mix by)$")


def credits_of(artist: str | None) -> list[str]:
    """The names credited in an artist field, the first one first."""
    text = (canonical(artist) or "").strip()
    out: list[str] = []
    for part in _CREDITS.split(text):
        pieces = [part]
        comma = [p.strip() for p in part.split(",")]
        if len(comma) >= 2 and comma[-1].lower() != "the" and all(len(p.split()) >= 2 or "&" in p for p in comma):
            pieces = comma
        for p in pieces:
            sides = [s.strip() for s in regex.split(r"\s+[&+]\s+", p)]
            if len(sides) > 1 and any(len(s.split()) > 1 for s in sides if not s.lower().startswith("the ")):
                out += sides
            elif len(sides) > 2 and len(sides) % 2 == 0:  # several duos
                out += [f"{a} & {b}" for a, b in zip(sides[::2], sides[1::2])]
            else:
                out.append(p)
    return [o for o in out if names.parse(o).last]


def work_of(title: str | None) -> tuple[str, str, str]:
    """The work's comparison key, the kind of version ('' when none is named) and what more is said of it."""
    text = _FEAT.sub(" ", regex.sub(r"\s+", " ", canonical(title) or ""))
    said = [m.strip() for m in _BRACKET.findall(text)]
    base, *rest = regex.split(r"\s+[-–—]\s+", _BRACKET.sub(" ", text).strip())
    kind = detail = ""
    for q in [*said, *(r.strip() for r in rest)]:
        low = regex.sub(r"\s+", " ", names.plain(q)).strip()
        if not low or SAME.fullmatch(low) or regex.match(r"(?:feat|ft|featuring)\b", low):
            continue
        if m := _REMIX.match(low):
            kind, detail = "remix", regex.sub(r"\s+", " ", q[: m.end(1)] if names.plain(q[: m.end(1)]).strip() == m[1] else m[1]).strip()
        elif m := regex.match(r"(live)\b(?: (?:at|in|from|@) )?(.*)$", low):
            kind, detail = "live", m[2]
        else:
            kind = low
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", names.plain(base))), kind, detail


def isrc_of(text: str | None) -> str | None:
    """Twelve letters and digits in upper case, or None for anything else and for placeholders."""
    s = regex.sub(r"[^A-Z0-9]", "", (text or "").upper())
    s = s[4:] if s.startswith("ISRC") and len(s) == 16 else s
    return s if regex.fullmatch(r"[A-Z]{2}[A-Z0-9]{3}\d{7}", s) and not s.endswith("0000000") else None


PARSED = "id long, path string, credits array<string>, work string, kind string, detail string, seconds double, isrc string, near array<string>"
PARSED_COLUMNS = [c.split(" ")[0] for c in PARSED.split(", ")[1:]]


_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


def _near(work: str) -> list[str]:
    """Keys that two works share if one word of theirs differs, whichever it is; for a single word those of two edits; and the work without its blanks.

    A key for each word left out is a hash of all the others, made from one sum, so a long work costs no more than its words.
    """
    words = work.split()
    if not words:
        return []
    out = {"=" + "".join(words)}
    if len(words) == 1:
        return sorted(out | (names.near_keys(words[0], 2 if len(words[0]) >= 4 else 1) if len(words[0]) >= 3 else set()))
    n, power, terms = len(words), 1, []
    for w in words:
        terms.append(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) * power % _MODULUS)
        power = power * _BASE % _MODULUS
    total = sum(terms)
    return sorted(out | {f"{n}:{i}:{(total - t) % _MODULUS}" for i, t in enumerate(terms)})


def one_word_off(a: str, b: str) -> bool:
    """Whether two works differ in one word by at most two edits, digits unchanged; also in one missing word break."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return a.replace(" ", "") == b.replace(" ", "")
    off = [(p, q) for p, q in zip(x, y) if p != q]
    if len(off) != 1:
        return not off
    p, q = off[0]
    return not any(c.isdigit() for c in p + q) and min(len(p), len(q)) >= 3 and names.edits(p, q) <= (2 if max(len(p), len(q)) >= 5 else 1)


@F.pandas_udf(T.BooleanType())
def _off(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_word_off(x, y) for x, y in zip(a, b)], dtype=bool)


def read(df: DataFrame, path: str) -> DataFrame:
    """``PARSED`` columns from (id, artist, title, duration_s, isrc). Lengths over 3,600 are taken for milliseconds, under 1 for missing."""
    rows = df.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col(path).alias("path"), "artist", "title", F.col("duration_s").cast("double").alias("s"), "isrc")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            works = [work_of(t) for t in b["title"]]
            s = b["s"].where(b["s"] >= 1).where(b["s"] < 1e8)
            yield pd.DataFrame({
                "id": b["id"], "path": b["path"], "credits": [credits_of(a) for a in b["artist"]], "work": [w or None for w, _, _ in works], "kind": [k for _, k, _ in works], "detail": [d for _, _, d in works],
                "seconds": s.where(~(s > 3600), s / 1000), "isrc": [isrc_of(x) for x in b["isrc"]], "near": [_near(w) for w, _, _ in works],
            })

    return spread(rows).mapInPandas(parse, PARSED)


def _length(tolerance: float) -> tuple[Column, Column]:
    known = F.col("r_seconds").isNotNull() & F.col("t_seconds").isNotNull()
    return known & (F.abs(F.col("r_seconds") - F.col("t_seconds")) <= tolerance), ~known


def matched(reviews: DataFrame, tracks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(pending_id, track_id, rule, confidence): each review with every file of its recording, once each.

    ``reviews``: (id, artist, title, duration_s, isrc, matched_path); ``tracks``: (id, path, artist, title, duration_s, isrc); further columns are ignored.

    Defined cases: a file without title or artist is matched by ISRC only, and an ISRC found on files that differ in both work and artist, or
    a placeholder, settles nothing; of different rows under one id the greatest counts; a version named on both sides must be the same, named on one side the lengths must
    agree; without a length on one side the version must be the same, or none named in the review and only one in the library; rows given twice count once; nulls anywhere are allowed; empty tables give
    an empty frame.
    """
    r, t = (stage(read(df, path), name).groupBy("id").agg(F.max(F.struct(*PARSED_COLUMNS)).alias("x")).select("id", "x.*") for df, path, name in ((reviews, "matched_path", "reviews"), (tracks, "path", "files")))
    r, t = stage(r, "reviews"), stage(t, "files")
    named_in = [x.select(F.explode(F.when(F.col("kind") == "remix", F.array_append("credits", F.col("detail"))).otherwise(F.col("credits"))).alias("credit")) for x in (r, t)]
    spelled = named_in[0].unionByName(named_in[1]).where("credit is not null").groupBy("credit").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("credit_id", F.xxhash64("credit"))
    spelled = stage(spelled, "credits")
    entity = spelled.join(names.linked(spelled).withColumnRenamed("id", "credit_id"), "credit_id").select("credit", "entity")
    entity = stage(entity, "entities")

    def placed(df: DataFrame, prefix: str) -> DataFrame:
        e = df.select("id", F.posexplode("credits").alias("pos", "credit")).join(entity, "credit").groupBy("id").agg(F.min(F.struct("pos", "entity"))["entity"].alias("artist"), F.sort_array(F.collect_set("entity")).alias("all"))
        out = df.drop("credits").join(e, "id", "left")
        remixer = entity.select(F.col("credit").alias("detail"), F.col("entity").cast("string").alias("who"), F.lit("remix").alias("kind"))
        out = out.join(remixer, ["kind", "detail"], "left").withColumn("detail", F.coalesce("who", "detail")).drop("who")
        return stage(out.select(*(F.col(c).alias(prefix + c) for c in out.columns)), "placed")

    r, t = placed(r, "r_"), placed(t, "t_")
    near, unknown = _length(tolerance)
    same_version = (F.col("r_kind") == F.col("t_kind")) & ((F.col("r_detail") == F.col("t_detail")) | ((F.col("r_kind") == "live") & near & ((F.col("r_detail") == "") | (F.col("t_detail") == ""))))
    one_sided = (F.col("r_kind") == "") != (F.col("t_kind") == "")
    # an ISRC that stands on files of other works by other artists settles nothing
    contested = t.where("t_isrc is not null").groupBy("t_isrc").agg(F.min("t_work").alias("w1"), F.max("t_work").alias("w2"), F.min("t_artist").alias("a1"), F.max("t_artist").alias("a2")).where("w1 <> w2 and a1 <> a2").select("t_isrc")
    sure = t.where("t_isrc is not null").join(contested, "t_isrc", "left_anti")
    agree = F.coalesce(F.col("r_work") == F.col("t_work"), F.lit(True)) | F.coalesce(F.col("r_artist") == F.col("t_artist"), F.lit(True))
    slim = lambda df, p: df.drop(p + "near")
    t_names, named = slim(t, "t_").where("t_artist is not null and t_work is not null"), lambda x: slim(x, "r_").where("r_artist is not null and r_work is not null")
    by_name = lambda x: named(x).join(t_names, (F.col("r_artist") == F.col("t_artist")) & (F.col("r_work") == F.col("t_work")))

    def mistyped(x: DataFrame) -> DataFrame:
        a = x.where("r_artist is not null").withColumn("key", F.explode("r_near")).drop("r_near")
        b = t.where("t_artist is not null").withColumn("key", F.explode("t_near")).drop("t_near")
        return a.join(b, (F.col("r_artist") == F.col("t_artist")) & (F.col("r_all").isNotNull()) & (a["key"] == b["key"]) & (F.col("r_work") != F.col("t_work"))).drop("key").where((near & (same_version | one_sided)) | (unknown & same_version)).where(_off("r_work", "t_work"))

    def further(x: DataFrame) -> DataFrame:
        a = named(x).withColumn("entity", F.explode("r_all"))
        b = t_names.withColumn("e", F.explode("t_all"))
        return a.join(b, (F.col("entity") == F.col("e")) & (F.col("r_work") == F.col("t_work"))).where(near & (same_version | one_sided))

    single = t_names.groupBy("t_artist", "t_work").agg(F.min(F.struct("t_kind", "t_detail")).alias("a"), F.max(F.struct("t_kind", "t_detail")).alias("b")).where("a = b")
    rules = [
        ("isrc", lambda x: slim(x, "r_").where("r_isrc is not null").join(slim(sure, "t_"), F.col("r_isrc") == F.col("t_isrc")).where(agree & (near | unknown | same_version))),
        ("artist, work, version, length", lambda x: by_name(x).where(near & same_version)),
        ("artist, work, length", lambda x: by_name(x).where(near & one_sided)),
        ("artist, work, version", lambda x: by_name(x).where(unknown & same_version)),
        ("artist, mistyped work, version", mistyped),
        ("artist, work, only version", lambda x: by_name(x).where(unknown & (F.col("r_kind") == "")).join(single, ["t_artist", "t_work"], "left_semi")),
        ("further artist, work, length", further),
    ]
    left, found = r, []
    for name, rule in rules:
        hits = stage(rule(left).select(F.col("r_id").alias("pending_id"), F.col("t_id").alias("track_id"), F.lit(name).alias("rule")).distinct(), "hits")
        found.append(hits)
        left = left.join(hits.select(F.col("pending_id").alias("r_id")).distinct(), "r_id", "left_anti")
    resolved = found[0]
    for f in found[1:]:
        resolved = resolved.unionByName(f)
    # every further file with the names, version and length of a file found
    known = resolved.join(t_names.select(F.col("t_id").alias("track_id"), F.col("t_artist").alias("artist"), F.col("t_work").alias("work"), F.col("t_kind").alias("r_kind"), F.col("t_detail").alias("r_detail")), "track_id")
    known = known.join(slim(r, "r_").select(F.col("r_id").alias("pending_id"), "r_seconds", F.col("r_kind").alias("asked")), "pending_id").select("pending_id", "rule", "artist", "work", "r_kind", "r_detail", "r_seconds", "asked").distinct()
    more = known.join(t_names, (F.col("artist") == F.col("t_artist")) & (F.col("work") == F.col("t_work"))).where((near & (same_version | (one_sided & ((F.col("asked") == "") | (F.col("asked") == F.col("t_kind")))))) | (unknown & same_version))
    everything = resolved.unionByName(more.select("pending_id", F.col("t_id").alias("track_id"), "rule")).groupBy("pending_id", "track_id").agg(F.min("rule").alias("rule"))
    everything = stage(everything, "matches")
    # precision by rule, on reviews with a known file
    files = t.select(F.col("t_id").alias("track_id"), F.col("t_path").alias("path"))
    labelled = everything.join(files, "track_id").join(r.where("r_path is not null").select(F.col("r_id").alias("pending_id"), "r_path"), "pending_id")
    judged = labelled.groupBy("pending_id", "rule").agg(F.max((F.col("path") == F.col("r_path")).cast("int")).alias("right"))
    precision = judged.groupBy("rule").agg(((F.sum("right") + 1) / (F.count(F.lit(1)) + 2)).alias("confidence"))
    return everything.join(F.broadcast(precision), "rule", "left").select("pending_id", "track_id", "rule", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))  # a row per rule
