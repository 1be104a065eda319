"""Spellings of one person or group, linked by a noisy channel.

A spelling is taken apart into a person's given and family name, a group's core and kind, or
two partners; forms that differ in case, accents, order, articles, joiners, middle initials or
known abbreviations alone fall into one class. Frequent classes are the candidate canonical forms. A
rarer class is a variant of the candidate ``c`` with the greatest posterior: the frequency prior of ``c`` times the likelihood of
its typos, abbreviation, nickname or initial, against the chance that the spelling is a name of its own, which a letter model
of all names gives (leaving the spelling itself out), or other names with the same word. A typo of a frequent word recurs in a large table, under as many names as there
is room for; so only those names show a word to be one in whose place there is no like name with a far more common word. Posteriors are normalised over all candidates and the name of its own. Candidates come from equal
deletion keys, stems of abbreviations, nicknames and initials, so no two spellings are compared that share no key.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.lookalike import canonical
from tonearm.plans.staging import spread, stage

# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha xander sandy", "alexandra": "alex sasha sandra", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck chas", "christopher": "chris kit topher",
    "daniel": "dan danny", "deborah": "deb debbie debby", "dmitri": "dima mitya", "edward": "ed eddie ted ned", "ekaterina": "katya katia", "elizabeth": "liz lizzie beth betty eliza lisa", "francisco": "paco pancho curro", "francoise": "fanny",
    "frederick": "fred freddie freddy", "friedrich": "fritz fred", "giuseppe": "beppe pino peppe", "gregory": "greg", "guadalupe": "lupe lupita", "helene": "leni", "jennifer": "jen jenny jenn", "johannes": "hannes hans jo", "jose": "pepe", "joseph": "joe joey jo",
    "jurgen": "jorg", "katherine": "kate katie kathy kat kitty", "margaret": "maggie meg peggy greta", "matthew": "matt", "michael": "mike mick mickey micky", "mikhail": "misha", "nicholas": "nick nicky", "patricia": "pat patty trish tricia",
    "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie", "samuel": "sam sammy", "stephanie": "steph steffi stevie", "susanna": "sue susie suzy susi", "theodore": "ted theo teddy", "thomas": "tom tommy", "victoria": "vicky tori vicki", "william": "bill will billy willy liam",
}
FULL: dict[str, list[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _s in _shorts.split():
        FULL.setdefault(_s, []).append(_full)

# Words for kinds of groups, with abbreviations.
KINDS = {
    "assembly": "assy", "band": "bnd", "brothers": "bros", "choir": "chr", "collective": "coll collect", "company": "co", "department": "dept", "ensemble": "ens", "foundation": "fdn found", "machine": "mach", "orchestra": "orch",
    "project": "proj prj", "quartet": "4tet qt qrt", "quintet": "5tet", "sisters": "sis", "society": "soc", "soundsystem": "ss sndsys", "trio": "3o", "unit": "unt", "workshop": "wkshp wksp", "duo": "2o", "group": "grp", "sextet": "6tet", "singers": "sgrs",
}
# How many times as common as a word the one is that it may be a typo or an abbreviation of, in all the names that have it.
COMMONER_MEANT, COMMONER_FULL = 5, 2
KIND = {a: k for k, v in KINDS.items() for a in (k, *v.split())}

_WORD = regex.compile(r"[^\s,.&+\-]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    text = (canonical(text) or "").casefold().replace("ø", "o").replace("æ", "ae").replace("ß", "ss").replace("ł", "l")
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, up to ``most``."""
    if abs(len(a) - len(b)) >= most:
        return most
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        before = prev
        if min(row) >= most:
            return most
    return min(row[-1], most)


def kind_of(word: str) -> str | None:
    """The kind of group a word names, two typos allowed in a long one, one in a short one."""
    if word in KIND:
        return KIND[word]
    if len(word) >= 4:
        d, k = min((edits(word, k), k) for k in KINDS if len(k) >= (6 if len(word) >= 6 else 4))
        if d <= (2 if len(word) >= 6 else 1):
            return k
    return None


@dataclass(frozen=True)
class Name:
    """``form``: p(erson), g(roup), d(uo) or o(ther); ``first`` and ``last``: given and family, kind and core, or the partners in order."""

    form: str
    first: str
    last: str

    @property
    def key(self) -> str:
        a, b = self.first, self.last
        return f"{self.form}|{min(a, b)}|{max(a, b)}" if self.form in "pd" else f"{self.form}|{a}|{b}"


def parse(text: str | None) -> Name:
    """A spelling taken apart; an empty or null one has empty parts."""
    low = regex.sub(r"\s+", " ", plain(text or "")).strip()
    low = regex.sub(r"[’'`\"]", "", low).replace("sound system", "soundsystem")
    parts = [p.strip(" -,.") for p in regex.split(r"\s*[-\s]*(?:&|\+)[-\s]*|[\s-]+and[\s-]+", low) if p.strip(" -,.")]
    if len(parts) == 2 and all(len(_WORD.findall(p)) <= 2 for p in parts):
        a, b = sorted(" ".join(_WORD.findall(p)).removeprefix("the ") for p in parts)
        return Name("d", a, b)
    comma = [p.strip() for p in low.split(",") if p.strip()]
    words = _WORD.findall(low)
    if words and words[0] == "the":
        words = words[1:]
    if len(comma) == 2 and comma[1] == "the":
        words = words[:-1]
    if len(words) >= 2 and (k := kind_of(words[-1])):
        return Name("g", k, " ".join(words[:-1]))
    if len(words) >= 2:
        if len(comma) == 2 and len(_WORD.findall(comma[1])) <= 2:
            words = _WORD.findall(comma[1]) + _WORD.findall(comma[0])
        if len(words) > 2:
            words = [words[0], *(w for w in words[1:-1] if len(w) > 1), words[-1]]
        if len(words) == 2:
            if len(words[1]) == 1:
                words = words[::-1]
            return Name("p", words[0], words[1])
    return Name("o", "", " ".join(words))


def deletions(word: str, most: int) -> set[str]:
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def near_keys(word: str, most: int) -> set[str]:
    """Keys that two words share if at most ``most`` edits part them.

    Deletions for words of up to 18 letters; for longer ones pieces, more than the edits can touch (a swap may touch two), at the places they can have moved to
    in a word of each possible length. Both kinds in between, so words on either side of the border meet.
    """
    n, out = len(word), set()
    if n <= 16 + most:
        out |= deletions(word, most)
    if n >= 16:
        for m in range(n - most, n + most + 1):
            cuts = [m * i // (2 * most + 1) for i in range(2 * most + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                out |= {f"{m}:{i}:{word[a + d : b + d]}" for d in range(-most, most + 1) if 0 <= a + d and b + d <= n}
    return out


def folded(first: str, last: str) -> str:
    """The name with letters that transliterations exchange made one."""
    both = f"{first}|{last}".replace("kh", "k").replace("ch", "k").replace("ph", "f").replace("th", "t")
    return both.translate(str.maketrans("wycj", "viki"))


def typo_keys(n: Name) -> list[str]:
    """Keys that two names share if at most two edits in all part them."""
    if n.form == "o" or len(n.first) < 2 and n.form == "p":
        return ["o|" + d for d in near_keys(n.last, 1)] if n.form == "o" and len(n.last) >= 5 else []
    f = n.form
    # a typo changes words of four letters and more only, so shorter ones need no key beyond the name's own
    out = {f"{f}t|" + folded(n.first, n.last)}
    if len(n.last) >= 4:
        out |= {f"{f}a|{n.first}|{d}" for d in near_keys(n.last, 2)}
    if f != "g" and len(n.first) >= 4:
        out |= {f"{f}b|{d}|{n.last}" for d in near_keys(n.first, 2)}
        if len(n.last) >= 4:
            out |= {f"{f}c|{d}|{e}" for d in near_keys(n.first, 1) for e in near_keys(n.last, 1)}
    return sorted(out)


def _consonants(word: str) -> str:
    return word[:1] + regex.sub("[aeiouy]", "", word[1:])


def _stem(word: str) -> str:
    """``word`` without a pet form's ending and its doubled consonant: gabe, gabby: gab."""
    bare = regex.sub("(?:ie|ey|y|e|i|o)$", "", word)
    return bare[:-1] if len(bare) > 2 and bare[-1] == bare[-2] else bare


def short_keys(n: Name) -> list[str]:
    """Keys of a name whose given or family part may be an abbreviation: what it stands for begins like this."""
    out = set()
    for k, w, rest in ((0, n.first, n.last), (1, n.last, n.first)):
        for x in {w, _stem(w), w[:-1]} if n.form == "p" and rest else ():
            if len(x) >= 2:
                out.add(f"{k}|{rest}|{len(x)}|{zlib.crc32(x.encode())}")
    return sorted(out)


def full_keys(n: Name) -> list[str]:
    """Keys of a name for all that its given or family part can be abbreviated to: beginnings of the word and of its consonants."""
    out = set()
    for k, w, rest in ((0, n.first, n.last), (1, n.last, n.first)):
        for x in {w, _consonants(w)} if n.form == "p" and rest else ():
            crc = 0
            for i, ch in enumerate(x, 1):
                crc = zlib.crc32(ch.encode(), crc)
                if i >= 2:
                    out.add(f"{k}|{rest}|{i}|{crc}")
    return sorted(out)


def abbreviates(short: str, full: str) -> float | None:
    """How many letters of doubt there are that ``short`` stands for ``full``: None if it cannot.

    The beginning of the word, a pet form of its beginning, or its consonants or the beginning of these.
    """
    if not 2 <= len(short) < len(full) or short[0] != full[0]:
        return None
    if full.startswith(short):
        return 0.0
    stem = _stem(short)
    if len(stem) >= 2 and full.startswith(stem):
        return 0.5
    bare = _consonants(short)
    if bare == short and len(bare) >= 3 and _consonants(full).startswith(bare):
        return 0.5
    return 1.0 if len(short) >= 3 and short == _consonants(full)[: len(short) - 1] + full[-1] else None


@dataclass(frozen=True)
class Channel:
    """Costs in nats: of a typo, an abbreviation (``doubt`` more for each half letter's doubt), a nickname, an initial, another transliteration; ``own``: log-odds a spelling is a name of its own beyond what the letter model says."""

    typo: float = 5.0
    abbreviation: float = 3.0
    doubt: float = 1.0
    nickname: float = 1.5
    initial: float = 1.5
    transliteration: float = 1.5
    own: float = 1.0


def letter_model(words: DataFrame) -> DataFrame:
    """(w, own): the log-probability of each distinct word from counts of letter quadruples over all words, backing off to triples and pairs, the word itself left out.

    Counts are joined by quadruple, so the table of counts stays on the executors, whole, however many names there are.
    """
    p = words.withColumn("p", F.concat(F.lit("^^^"), "w", F.lit("$")))
    quads = stage(p.select("w", F.explode(F.expr("transform(sequence(1, length(p) - 3), i -> substring(p, i, 4))")).alias("g")), "quadruples")
    four = quads.groupBy("g").agg(F.count(F.lit(1)).alias("n4"))

    def sums(at: int, size: int, name: str) -> DataFrame:
        return four.groupBy(F.substring("g", at, size).alias(name + "_g")).agg(F.sum("n4").alias(name))

    seen = four
    for at, size, name in ((1, 3, "s4"), (2, 3, "c3"), (2, 2, "s3"), (3, 2, "c2"), (3, 1, "s2")):
        seen = seen.withColumn(name + "_g", F.substring("g", at, size)).join(sums(at, size, name), name + "_g").drop(name + "_g")
    others = lambda c: F.col(c) - 1
    p2 = (others("c2") + 0.3) / (others("s2") + 9)
    p3 = (others("c3") + 3 * p2) / (others("s3") + 3)
    chance = seen.select("g", F.log((others("n4") + 3 * p3) / (others("s4") + 3)).alias("x"))
    return quads.join(chance, "g").groupBy("w").agg(F.sum("x").alias("own"))


def linked(credits: DataFrame, id_col: str = "credit_id", text: str = "credit", weight: str = "n_rows", channel: Channel = Channel()) -> DataFrame:
    """(id, entity, posterior): every spelling with the entity it belongs to (the lowest id in it).

    Defined cases: null, empty and wordless spellings are entities of their own; repeated rows count once, with their greatest weight; a null weight counts 1;
    texts of any length are read, but only names of two parts are linked by typos; an empty frame gives an empty frame; extra columns are ignored.
    """
    spark = credits.sparkSession
    base = credits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(text)).alias("text"), F.max(F.coalesce(F.col(weight).cast("double"), F.lit(1.0))).alias("n"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [parse(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n": b["n"], "form": [x.form for x in names], "first": [x.first for x in names], "last": [x.last for x in names], "key": [x.key if x.last else f"id|{i}" for x, i in zip(names, b["id"])]})

    parsed = stage(base.mapInPandas(read, "id long, n double, form string, first string, last string, key string"), "names")
    classes = stage(
        parsed.groupBy("key").agg(F.min("id").alias("cid"), F.sum("n").alias("n"), F.max(F.struct("n", F.struct("form", "first", "last").alias("name")))["name"].alias("name")).select("cid", "n", "key", "name.*"),
        "classes",
    )
    words = classes.where("form <> 'o'").select(F.explode(F.array("first", "last")).alias("w")).where("length(w) > 1").groupBy("w").agg(F.count(F.lit(1)).alias("support"))
    words = stage(words, "words")
    words = stage(words.join(letter_model(words.select("w")), "w"), "scored-words")
    def keyed(of: Callable[[Name], list[str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(r.cid, k) for r in b.itertuples() for k in of(Name(r.form, r.first, r.last))]
                yield pd.DataFrame(out, columns=["cid", "k"])

        return stage(spread(classes.select("cid", "form", "first", "last")).mapInPandas(run, "cid long, k string").withColumn("k", F.xxhash64("k")), "keys")

    keys = keyed(typo_keys)
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    keys = stage(keys.join(shared, "k", "left_semi"), "shared-keys")
    # of two classes the lower in rank is the variant; only that way round they are compared. A key that many names share is split by the joins' skew handling
    ranked = classes.select("cid", F.struct(_fullness().alias("full"), "n", (-F.col("cid")).alias("age")).alias("rank"))
    keys = keys.join(ranked, "cid")
    pairs = keys.join(keys.select("k", F.col("cid").alias("other"), F.col("rank").alias("above")), "k").where("above > rank").select("cid", "other").distinct()
    shortened = keyed(short_keys).join(keyed(full_keys).withColumnRenamed("cid", "other"), "k").where("cid <> other")
    pairs = pairs.unionByName(shortened.select("cid", "other")).unionByName(shortened.select(F.col("other").alias("cid"), F.col("cid").alias("other")))
    person = classes.where("form = 'p'")
    short = person.select("cid", "first", "last").join(spark.createDataFrame([(s, f) for s, fs in FULL.items() for f in fs], "first string, full string"), "first").select("cid", F.col("full").alias("first"), "last")
    by_nickname = short.join(person.select(F.col("cid").alias("other"), "first", "last"), ["first", "last"]).select("cid", "other")
    best = Window.partitionBy("i", "last").orderBy(F.col("n").desc(), "other")
    fuller = person.where("length(first) > 1").select(F.col("cid").alias("other"), F.substring("first", 1, 1).alias("i"), "last", "n").withColumn("r", F.row_number().over(best)).where("r = 1").select("other", "i", "last")
    by_initial = person.where("length(first) = 1").select("cid", F.col("first").alias("i"), "last").join(fuller, ["i", "last"]).select("cid", "other")
    candidates = pairs.unionByName(by_nickname).unionByName(by_initial).distinct()
    side = classes
    for c, k in (("first", "1"), ("last", "2")):
        side = side.join(words.select(F.col("w").alias(c), F.col("support").alias("s" + k), F.col("own").alias("o" + k)), c, "left")
    side = stage(side.na.fill(0, ["s1", "s2", "o1", "o2"]), "side")
    both_sides = ("n", "form", "first", "last", "s1", "s2", "o1", "o2")
    left = side.select("cid", *(F.col(c).alias("v_" + c) for c in both_sides))
    right = side.select(F.col("cid").alias("other"), *(F.col(c).alias("c_" + c) for c in both_sides))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["differ"] = [differing(r) for r in b.itertuples()]
            yield b[b["differ"] >= 0]

    compared = candidates.join(left, "cid").join(right, "other")
    compared = stage(compared.mapInPandas(compare, T.StructType([*compared.schema.fields, T.StructField("differ", T.LongType())])), "compared")
    # names with a word in whose place a like name has a far more common one: those of a mistyped word nearly all are such, those of a word of its own only by chance
    commoner = lambda differ, k, a, b, times: (F.col("differ") == differ) & (F.col(f"{b}_s{k}") >= times * F.col(f"{a}_s{k}"))
    like = [
        compared.where(commoner(k, k, a, b, COMMONER_MEANT) | commoner(k + 2, k, a, b, COMMONER_FULL)).select(F.col(i).alias("cid"), F.lit(k).alias("slot"), F.col(f"{a}_{c}").alias("w"))
        for k, c in ((1, "first"), (2, "last"))
        for i, a, b in (("cid", "v", "c"), ("other", "c", "v"))
    ]
    like = stage(reduce(DataFrame.unionByName, like).distinct(), "like")
    uses = stage(like.groupBy("w").agg(F.count(F.lit(1)).alias("k")), "uses")
    used = side.select("cid", "first", "last").join(like.groupBy("cid").agg(*(F.max((F.col("slot") == k).cast("long")).alias(f"e{k}") for k in (1, 2))), "cid", "left")
    for c, k in (("first", "1"), ("last", "2")):
        used = used.join(uses.select(F.col("w").alias(c), F.col("k").alias("k" + k)), c, "left")
    used = used.na.fill(0, ["k1", "k2", "e1", "e2"]).select("cid", *((F.col(f"k{k}") - F.col(f"e{k}")).alias(f"k{k}") for k in (1, 2)))
    used = stage(used.where("k1 > 0 or k2 > 0"), "used")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                up, down = log_odds(r, channel)
                out += [(x, y, g, k) for x, y, g, k in ((r.cid, r.other, up, True), (r.other, r.cid, down, False)) if g is not None and g > -20]
            yield pd.DataFrame([(x, y, min(g, 200.0), k) for x, y, g, k in out], columns=["cid", "other", "gain", "up"])

    of = lambda i, a: used.select(F.col("cid").alias(i), F.col("k1").alias(a + "_k1"), F.col("k2").alias(a + "_k2"))
    weighed = compared.join(of("cid", "v"), "cid", "left").join(of("other", "c"), "other", "left").na.fill(0, ["v_k1", "v_k2", "c_k1", "c_k2"])
    weighed = stage(weighed.mapInPandas(weigh, "cid long, other long, gain double, up boolean"), "weighed")
    # the best name meant, and its share of the posterior beside all others and a name of its own, whose log-odds are 0
    best_of = lambda only: F.max(F.when(only, F.struct("gain", (-F.col("other")).alias("o"), "up")))
    top = stage(weighed.groupBy("cid").agg(best_of(F.lit(True)).alias("top"), best_of(F.col("up")).alias("above"), F.sum(F.exp("gain")).alias("all"), F.coalesce(F.sum(F.when(F.col("up"), F.exp("gain"))), F.lit(0.0)).alias("all_above")), "top")
    # a mistyped name that ranks above the one meant points down to it, but only if that one points nowhere; else to the best above it
    down = top.where("top.gain > 0 and not top.up").select("cid", (-F.col("top.o")).alias("meant"))
    fixed = down.join(top.where("top.gain > 0").select(F.col("cid").alias("meant")), "meant", "left_anti").select("cid", F.lit(True).alias("down"))
    top = top.join(fixed, "cid", "left").withColumn("top", F.when(F.col("down"), F.col("top")).otherwise(F.col("above"))).withColumn("all", F.when(F.col("down"), F.col("all")).otherwise(F.col("all_above")))
    share = (F.when(F.col("top.gain") > 0, F.exp("top.gain")).otherwise(1.0) / (1 + F.col("all"))).alias("posterior")
    chosen = stage(top.select("cid", F.when(F.col("top.gain") > 0, -F.col("top.o")).otherwise(F.col("cid")).alias("other"), share), "chosen")
    # each class points to one that ranks above it or to one that points nowhere, so following the pointers ends
    roots = classes.select("cid").join(chosen, "cid", "left").select("cid", F.coalesce("other", "cid").alias("root"), F.coalesce("posterior", F.lit(1.0)).alias("posterior"))
    roots = stage(roots, "roots")
    for _ in range(20):
        hop = roots.select(F.col("cid").alias("root"), F.col("root").alias("next"))
        moved = stage(roots.join(hop, "root").select("cid", F.col("next").alias("to"), "root", "posterior"), "roots")
        roots = moved.select("cid", F.col("to").alias("root"), "posterior")
        if moved.where("`to` <> root").isEmpty():
            break
    ends = parsed.select("id", "key").join(classes.select("key", "cid"), "key").join(roots, "cid")
    entity = ends.groupBy("root").agg(F.min("id").alias("entity"))
    return ends.join(entity, "root").select("id", "entity", "posterior")


def _fullness() -> Column:
    """Canonical forms rank by fullness, then frequency, then age."""
    person = F.col("form") == "p"
    return F.when(person & (F.length("first") == 1), 0).when(person & F.col("first").isin(*FULL), 1).otherwise(2)


def rank_of(n: float, form: str, first: str, cid: int) -> tuple:
    full = 0 if form == "p" and len(first) == 1 else 1 if form == "p" and first in FULL else 2
    return full, n, -cid


def log_odds(r, ch: Channel) -> tuple[float | None, float | None]:
    """Log-odds that the spelling of ``r.cid`` is a variant of ``r.other``, which ranks above it, and that ``r.other`` is the mistyped or shortened one of the two; None if it cannot be."""
    prior = math.log(r.c_n + 1)
    v, c = (r.v_first, r.v_last), (r.c_first, r.c_last)
    if v[1] == c[1] and r.v_form == "p":
        if len(v[0]) == 1:
            return prior + 4 - ch.initial if c[0].startswith(v[0]) else None, None
        if c[0] in FULL.get(v[0], ()):
            return prior + 4 - ch.nickname, None
    if folded(*v) == folded(*c):
        return prior + 4 - ch.transliteration, None
    sides = ((v, c, (_others(r.v_s1, r.v_k1), _others(r.v_s2, r.v_k2)), (r.v_o1, r.v_o2), r.c_n), (c, v, (_others(r.c_s1, r.c_k1), _others(r.c_s2, r.c_k2)), (r.c_o1, r.c_o2), r.v_n))
    gains = [max((g for f in (_typo, _abbreviation if r.v_form == "p" else _typo) if (g := f(*x, ch)) is not None), default=None) for x in sides]
    return gains[0], gains[1]


def differing(r) -> int:
    """Which part of two names alone differs (0 where both do), and how: 1 and 2 by one typo, 3 and 4 by an abbreviation, 5 and 6 otherwise; -1 if they can't be one name or the second ranks lower."""
    v, c = (r.v_first, r.v_last), (r.c_first, r.c_last)
    if r.v_form != r.c_form or rank_of(r.c_n, r.c_form, r.c_first, r.other) <= rank_of(r.v_n, r.v_form, r.v_first, r.cid):
        return -1
    same = folded(*v) == folded(*c)
    off = [k for k in (0, 1) if v[k] != c[k]]
    if len(off) != 1:
        return 0 if same or all(min(len(a), len(b)) >= 4 for a, b in zip(v, c)) and sum(edits(a, b) for a, b in zip(v, c)) <= 2 else -1
    k, (a, b) = off[0] + 1, (v[off[0]], c[off[0]])
    e = edits(a, b) if min(len(a), len(b)) >= 4 else 3
    if e == 1 or same:
        return k
    if r.v_form == "p" and (abbreviates(a, b) is not None or abbreviates(b, a) is not None):
        return k + 2
    return k + 4 if e == 2 or r.v_form == "p" and k == 1 else -1


def _others(support: int, like: int) -> float:
    """How many other names show that a word is one: those without a like name that has a far more common word in its place, less a third of those with one."""
    return support - 1 - like - like / 3


def _own(others: float, letters: float) -> float:
    """Chance of a word as a name of its own: how many other names show it, or what its letters make likely."""
    return max(math.log(others) - 3.0 if others > 0 else -99.0, letters)


def _typo(v: tuple[str, str], c: tuple[str, str], others: tuple[float, float], letters: tuple[float, float], n: float, ch: Channel) -> float | None:
    """Log-odds that ``v`` is ``c`` mistyped, against ``v`` as a name of its own."""
    gain, changed = math.log(n + 1) - ch.own, 0
    for a, b, s, own in zip(v, c, others, letters):
        if a == b:
            continue
        e = edits(a, b)
        changed += e
        if e > 2 or changed > 2 or min(len(a), len(b)) < 4:
            return None
        gain += -ch.typo * e - _own(s, own) - 4.0
    return gain if changed else None


def _abbreviation(v: tuple[str, str], c: tuple[str, str], others: tuple[float, float], letters: tuple[float, float], n: float, ch: Channel) -> float | None:
    """Log-odds that ``v`` is ``c`` with one part abbreviated, against ``v`` as a name of its own."""
    off = [k for k in (0, 1) if v[k] != c[k]]
    if len(off) != 1 or (doubt := abbreviates(v[off[0]], c[off[0]])) is None:
        return None
    return math.log(n + 1) - ch.own - ch.abbreviation - 2 * doubt * ch.doubt - _own(others[off[0]], letters[off[0]]) - 4.0


def entity_pairs(links: DataFrame) -> DataFrame:
    """(credit_a, credit_b), a < b: every pair of spellings within an entity, as the query asks for."""
    a, b = links.select("entity", F.col("id").alias("credit_a")), links.select("entity", F.col("id").alias("credit_b"))
    return a.join(b, "entity").where("credit_a < credit_b").select("credit_a", "credit_b")
