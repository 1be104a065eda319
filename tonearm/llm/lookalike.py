"""One form for text that shows alike but is made of different characters.

A transducer walks each text once from left to right, grapheme cluster by
grapheme cluster, taking at each place the longest source in its mapping. The
mapping is built from the Unicode data of Python (widths, ligatures, styled
letters, composed accents, spaces, invisible characters, in all planes) and a fixed list of
letters that look alike across scripts. It is compiled by first character into the lengths to try, and checked when built: a source
must have one target, and every target must be left as it is.

Look-alike letters are only replaced within a word that mixes scripts, so a word is held back until it ends. It
is brought to the script of its letters without a double in another
script of the word; real words wholly in another script stay.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that show like Latin letters, by a sign for the script.
LOOK_ALIKES = {
    "C": ("АВЕЅІЈКМНОРСТУХҺԌԚԜаеорсухѕіјһԁԛԝү", "ABESIJKMHOPCTYXhGQWaeopcyxsijhdqwy"),
    "G": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιραυκ", "ABEZHIKMNOPTYXovipauk"),
    "A": ("ՍՕԼոօսհցզյ", "UOLnouhgqj"),
    "H": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "S": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    "I": ("ɡɑɩ", "gai"),
}
# The letters of Cyrillic and Greek that stand for a Latin one in a word of theirs.
TO_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyxij", "АВЕКМНОРСТУХаеорсухіј"))
TO_GREEK = dict(zip("ABEZHIKMNOPTYXovipauk", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιραυκ"))
# The scripts' ranges. I is phonetic writing, whose letters Unicode counts as Latin.
RANGES = {"L": "A-Za-z\u00c0-\u024f\u1e00-\u1eff", "G": "\u0370-\u03ff\u1f00-\u1fff", "C": "\u0400-\u052f", "A": "\u0530-\u058f", "H": "\u13a0-\u13ff", "S": "\ua4d0-\ua4ff", "I": "\u0250-\u02af"}

# Characters without a width of their own.
INVISIBLE = [*"\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f", *map(chr, range(0x202A, 0x202F)), *map(chr, range(0x2060, 0x2065)), *map(chr, range(0x2066, 0x206A)), "\ufeff"]
SELECTORS = {chr(c) for c in range(0xFE00, 0xFE10)}

_CLUSTER = regex.compile(r"\X")
_JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Khmer}\p{Mongolian}\p{Myanmar}]")
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}]")


class ConflictError(ValueError):
    """Two rules of the mapping disagree."""


def _shown_as(ch: str) -> str | None:
    """The ordinary typing of one styled, wide, narrow or joined character."""
    form = unicodedata.decomposition(ch)
    kind, _, _ = form.partition("> ")
    name = unicodedata.name(ch, "")
    if kind in ("<wide", "<narrow", "<font") or kind == "<compat" and ("LIGATURE" in name or "ROMAN NUMERAL" in name) and "ARABIC" not in name and "HEBREW" not in name:
        return unicodedata.normalize("NFKC", ch)
    return None


def build_mapping() -> dict[str, str]:
    """Source to target for widths, styles, accents and spaces, checked for conflicts."""
    table: dict[str, str] = {}

    def rule(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ConflictError(f"{source!r} goes to {table[source]!r} and {target!r}")

    for code in (*range(0x80, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(code)
        if unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
            rule(ch, " ")
        elif not unicodedata.decomposition(ch):
            continue
        elif (plain := _shown_as(ch)) is not None:
            rule(ch, plain)
        elif (composed := unicodedata.normalize("NFC", ch)) != ch:
            rule(ch, composed)
        elif (parts := unicodedata.normalize("NFD", ch)) != ch:
            rule(parts, ch)
            if len(parts) > 2 and (partly := unicodedata.normalize("NFC", parts[:-1]) + parts[-1]) != ch:
                rule(partly, ch)
    for ch in INVISIBLE:
        rule(ch, "")
    for source, target in table.items():
        if target and table.get(target, target) != target:
            raise ConflictError(f"{source!r} goes to {target!r}, which goes on to {table[target]!r}")
    return table


def build_doubles(table: dict[str, str]) -> dict[str, dict[str, str]]:
    """By script, its letters with the Latin ones they show like, checked for conflicts with each other and with the mapping."""
    out: dict[str, dict[str, str]] = {}
    known: dict[str, str] = {}
    for script, (letters, latin) in LOOK_ALIKES.items():
        for source, target in zip(letters, latin, strict=True):
            if known.setdefault(source, target) != target or source in table or target in table or _script(source) != script or _script(target) != "L":
                raise ConflictError(f"{source!r} goes to {target!r} and {known[source]!r}, or is in the mapping or of another script")
        out[script] = dict(zip(letters, latin))
    return out


def _script(ch: str) -> str:
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "L"
    if c < 0x2B0:
        return "I"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "G"
    if 0x400 <= c < 0x530:
        return "C"
    if 0x530 <= c < 0x590:
        return "A"
    if 0x13A0 <= c < 0x1400:
        return "H"
    if 0xA4D0 <= c < 0xA500:
        return "S"
    return "-"


@functools.cache
def _compiled() -> tuple[dict[str, str], dict[str, tuple[int, ...]], frozenset[str], frozenset[str], re.Pattern]:
    """The mapping, by first character the lengths of its sources from the longest, and what a text must hold for the walk to change anything:
    a character that is a source or a mark; or, where there are letters with doubles at all, one beside a letter of another script."""
    table = build_mapping()
    lengths: dict[str, set[int]] = {}
    for source in table:
        lengths.setdefault(source[0], set()).add(len(source))
    marks = [chr(c) for c in (*range(0x300, 0xAC00), *range(0x1100, 0x1200), *range(0xFE00, 0xFE30), *range(0x10000, 0x20000)) if unicodedata.category(chr(c))[0] == "M" or 0x1100 <= c < 0x1200]
    pairs = "|".join(f"[{x}][{y}]" for x in RANGES.values() for y in RANGES.values() if x != y)
    others = frozenset(chr(c) for c in (*range(0x250, 0x2B0), *range(0x370, 0x590), *range(0x13A0, 0x1400), *range(0x1F00, 0x2000), *range(0xA4D0, 0xA500)))
    return table, {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}, frozenset({c for c in table if len(c) == 1} | set(marks)), others, re.compile(pairs)


@functools.cache
def _doubles() -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]]]:
    """By script, to Latin and from Latin."""
    to = build_doubles(_compiled()[0])
    return to, {s: {v: k for k, v in t.items()} for s, t in to.items()} | {"C": TO_CYRILLIC, "G": TO_GREEK}


def _sure(word: list[str]) -> dict[str, int]:
    """By script, the letters of ``word`` that no other script has a double of; Latin ones are held against Cyrillic, Greek and the word's own further scripts."""
    to, back = _doubles()
    scripts = [_script(unicodedata.normalize("NFD", w)[0]) for w in word]
    against = [back[s] for s in {"C", "G", *scripts} - {"L", "-"}]
    counts: dict[str, int] = {}
    for w, s in zip(word, scripts):
        counts[s] = counts.get(s, 0) + (not any(w in x for x in against) if s == "L" else w not in to.get(s, ()))
    return counts


def _settle(word: list[str], home: str, alone: bool) -> tuple[str, bool]:
    """The word in one script, and whether it mixed scripts.

    ``home``: the script of the text around it, for words wholly of look-alikes. ``alone``: leave such a word if it keeps to one script.
    """
    text = "".join(word)
    scripts = [_script(unicodedata.normalize("NFD", w)[0]) for w in word]
    seen = set(scripts) - {"-"}
    if not seen - {"L"}:
        return text, False
    sure = _sure(word)
    if len(seen) == 1 and (alone or not seen & {"G", "C"} or any(sure[s] for s in seen)):
        return text, False
    if any(sure[s] for s in seen):
        home = max(seen, key=lambda s: (sure[s], scripts.count(s), s == "L"))
    to, back = _doubles()
    out = []
    for w, s in zip(word, scripts):
        if s in (home, "-"):
            out.append(w)
            continue
        latin = w if s == "L" else to[s].get(w, w)
        out.append(latin if home == "L" else back[home].get(latin, w))
    return "".join(out), len(seen) > 1


def canonical(text: str | None) -> str | None:
    """``text`` in its one form; null stays null, pure ASCII is returned as it is."""
    if text is None or text.isascii():
        return text
    table, lengths, sources, others, mixed_pair = _compiled()
    if sources.isdisjoint(text) and (others.isdisjoint(text) or not mixed_pair.search(text)):
        return text
    pieces: list[list[str] | str] = []
    word: list[str] = []

    def put(part: str) -> None:
        for ch in _CLUSTER.findall(part) if len(part) > 1 else [part]:
            if unicodedata.category(ch[0])[0] in "LM":
                word.append(ch)
            else:
                if word:
                    pieces.append(list(word))
                    word.clear()
                pieces.append(ch)

    for cluster in _CLUSTER.findall(text):
        if len(cluster) == 1:
            if (new := table.get(cluster, cluster)):
                put(new)
            continue
        if _EMOJI.search(cluster):  # joiners and selectors belong to emoji
            put(cluster.rstrip("\u200d\u200c"))
            continue
        if _JOINING.search(cluster):
            put(unicodedata.normalize("NFC", cluster))
            continue
        at, out = 0, ""
        while at < len(cluster):
            source = next((x for n in lengths.get(cluster[at], ()) if (x := cluster[at : at + n]) in table), cluster[at])
            out += "" if source in SELECTORS else table.get(source, source)
            at += len(source)
        if out and out != cluster:
            out = unicodedata.normalize("NFC", out)  # a mark may follow what was removed before it
        if out:
            put(out)
    if word:
        pieces.append(word)
    total = dict.fromkeys(RANGES, 0)
    for p in pieces:
        if not isinstance(p, str):
            for s, n in _sure(p).items():
                total[s] = total.get(s, 0) + n
    home = max("LCG", key=lambda s: total[s])
    mixed = any(_settle(p, home, True)[1] for p in pieces if not isinstance(p, str))
    # beside a mixed word, one wholly of look-alikes is taken for the text's script too
    settled = [p if isinstance(p, str) else _settle(p, home, not mixed)[0] for p in pieces]
    return unicodedata.normalize("NFC", "".join(settled))


@F.pandas_udf(T.StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def unify(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """``df`` with each text column's one form in ``<column><suffix>``.

    Defined cases: null gives null, empty gives empty, ASCII is unchanged, texts of any length are taken whole,
    applying it twice changes nothing, other columns stay, and a column that has the new name already is replaced.
    """
    return df.withColumns({c + suffix: canonical_udf(F.col(c)) for c in columns})


def irregular_cells(cells: DataFrame, text: str) -> DataFrame:
    """Rows of ``cells`` whose ``text`` differs from its one form. Pure ASCII never does, so it stays in the JVM."""
    return cells.where(F.col(text).rlike(r"[^\x00-\x7F]")).withColumn("__form", canonical_udf(F.col(text))).where(F.col("__form") != F.col(text)).drop("__form")


def key_form(text: Column) -> Column:
    """A comparison key: the one form in lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(canonical_udf(text)), r"\s+", " "))
