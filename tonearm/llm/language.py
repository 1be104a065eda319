"""The language of each document and of each stretch of it.

Every sentence is compared with Nyström landmarks by a blended-spectrum
presence kernel: the share of distinct character n-grams (lengths 1 to 5) two
texts have in common, ``|G(x) & G(z)| / sqrt(|G(x)| |G(z)|)``. One-versus-rest kernel
ridge regression on the landmark features gives a score per language. As the kernel is linear in n-gram
presence, landmarks, whitening and regression weights multiply into one matrix
with a row per landmark n-gram, and a batch of sentences is scored by a single product with it.

The model is fitted on a bounded sample of labelled documents; a second fit leaves out the
sentences the first one contradicts, as labels may be wrong and documents mixed.
Everything else reads every sentence of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.plans.staging import spread

# Two-letter code, then other ways to write the language. A label outside this list stands for itself.
LANGUAGES = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german", "deutsch"],
    "fr": ["fra", "fre", "french", "français", "francais"],
    "es": ["spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["por", "portuguese", "português", "portugues"],
    "it": ["ita", "italian", "italiano"],
    "nl": ["nld", "dut", "dutch", "nederlands"],
    "ru": ["rus", "russian", "русский"],
    "pl": ["pol", "polish", "polski"],
    "sv": ["swe", "swedish", "svenska"],
    "da": ["dan", "danish", "dansk"],
    "no": ["nor", "nob", "norwegian", "norsk"],
    "fi": ["fin", "finnish", "suomi"],
    "cs": ["ces", "cze", "czech", "čeština"],
    "hu": ["hun", "hungarian", "magyar"],
    "tr": ["tur", "turkish", "türkçe"],
    "el": ["ell", "gre", "greek", "ελληνικά"],
    "uk": ["ukr", "ukrainian", "українська"],
    "ja": ["jpn", "japanese", "日本語"],
    "zh": ["zho", "chi", "chinese", "中文"],
    "ko": ["kor", "korean", "한국어"],
    "ar": ["ara", "arabic", "العربية"],
    "hi": ["hin", "hindi", "हिन्दी"],
}
# Labels that name no language.
UNKNOWN = ["und", "unknown", "none", "null", "n", "na", "nan", "mul", "mis", "zxx", "xx", "zz"]


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample and the model. ``documents``: labelled documents read at most per language, ``per_document``: sentences of each, evenly spaced.

    ``least``: labelled sentences a language must have to be learned. ``strange``: a stretch whose mean score is under this share of what its language's own
    sentences score in the median is of no language the model has.
    """

    documents: int = 400
    per_document: int = 3
    landmarks: int = 60
    ridge: float = 1e-3
    longest: int = 5
    least: int = 20
    strange: float = 0.2
    languages: dict[str, list[str]] = field(default_factory=lambda: LANGUAGES)


def label_code(label: Column, languages: dict[str, list[str]] = LANGUAGES) -> Column:
    """The two-letter code a label means in any notation (``en_US``, ``eng``, ``English``), the label's own first word for others, null if it names none."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}\p{M}]+)", 1)
    out = F.when((head != "") & ~head.isin(*UNKNOWN), head)
    for code, names in languages.items():
        out = F.when(head.isin(code, *names), code).otherwise(out)
    return out


_NOISE = regex.compile(r"https?://\S+|www\.\S+|</?\w[^>]*>|(?m:^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?|@[\w.-]+:?|\d+[.)]|[-*•])\s+)")
_WRAP = regex.compile(r"\s*\n>[ \t]*")
_QUOTE = regex.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|„[^“”\n]{1,80}[“”]|«[^»\n]{1,80}»|‘[^’\n]{1,60}’")
_END = re.compile(r"[.!?…؟][\"”»)’]?(\s+)|[。！？।॥][\"”』」）]?(\s*)|(\n+)")
_ENDING = ".!?…؟。！？।॥\"”»)’』」）"
_DIGITS = regex.compile(r"\d+")
_LOWER = regex.compile(r"\b\p{Ll}{2,}|\b\p{Ll}\b|[\p{Lo}]")
_CASELESS = regex.compile(r"\p{Lo}")


def sentences(text: str) -> Iterator[tuple[str, str]]:
    """The whole sentences of ``text``: as they stand, and what the classifier reads of them.

    Left out are headings, list entries, and lines without an ending mark; markup, links, time codes, speaker tags and digits
    are blanked, as are words in quotation marks and capitalised words after the first (cited titles and names). A sentence wholly in
    capitals is read in small letters. Scripts without small letters or blanks end their sentences by their own marks.
    """
    text = _WRAP.sub(" ", text)
    text = _NOISE.sub(lambda m: "\n" if m.group().startswith("<") else " ", text)
    cuts = [m.span(m.lastindex) for m in _END.finditer(text)]
    for start, end in zip([0, *(e for _, e in cuts)], [*(a for a, _ in cuts), len(text)]):
        s = text[start:end].strip()
        if not s or s[-1] not in _ENDING:
            continue
        plain = _DIGITS.sub(" ", _QUOTE.sub(" ", s))
        if plain.isupper() and len(plain.split()) >= 6:
            plain = plain.lower()
        first, _, rest = plain.partition(" ")
        words = [w for w in rest.split() if not w[:1].isupper()]
        if (len(words) < 3 or len(_LOWER.findall(plain)) < 3) and len(_CASELESS.findall(plain)) < 6:
            continue
        yield s, " " + " ".join([first, *words]).lower() + " "


def longest_line(text: str) -> tuple[str, str] | None:
    """For a text without a whole sentence, its line of most letters, and what the classifier reads of it; None without letters."""
    lines = [_DIGITS.sub(" ", x).strip() for x in _NOISE.sub(" ", text).split("\n")]
    best = max(lines, key=lambda x: sum(map(str.isalpha, x)), default="")
    return (best, " " + best.lower() + " ") if any(map(str.isalpha, best)) else None


def grams(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs: text numbers in rising order, and hashes of the n-grams."""
    codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    flat = np.concatenate(codes).astype(np.uint64) if len(codes) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    owners, hashes = [], []
    h = np.zeros(len(flat), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            size = len(flat) - n + 1
            if size <= 0:
                break
            h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :] + np.uint64(n)
            same = owner[:size] == owner[n - 1 :]
            owners.append(owner[:size][same])
            hashes.append((h ^ (h >> np.uint64(29)))[same] >> np.uint64(20))
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    pairs = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(44)) | np.concatenate(hashes))
    return (pairs >> np.uint64(44)).astype(np.int64), pairs & np.uint64((1 << 44) - 1)


class SpectrumModel:
    """Nyström kernel ridge regression folded into ``weights``: a row per landmark n-gram, a column per language."""

    def __init__(self, codes: list[str], keys: np.ndarray, weights: np.ndarray, longest: int) -> None:
        self.codes, self.keys, self.weights, self.longest = codes, keys, weights, longest

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], rule: Fit) -> SpectrumModel | None:
        """From (language, text); None without two languages."""
        model, kept = None, rows
        for again in range(3):
            if again:  # repeats are needed first, so that contradicting sentences stay a minority
                kept = sorted(set(kept))
            by: dict[str, list[str]] = {}
            for c, t in kept:
                by.setdefault(c, []).append(t)
            by = {c: by[c] for c in sorted(by) if len(by[c]) >= rule.least}
            kept, codes = [r for r in kept if r[0] in by], list(by)
            if len(codes) < 2:
                return model
            marks = [t for c in codes for t in by[c][:: max(1, len(by[c]) // rule.landmarks)][: rule.landmarks]]
            owner, keys = grams(marks, rule.longest)
            vocabulary, place = np.unique(keys, return_inverse=True)
            z = np.zeros((len(marks), len(vocabulary)), dtype=np.float32)
            z[owner, place] = 1
            z /= np.sqrt(np.bincount(owner, minlength=len(marks)).clip(1))[:, None]
            values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
            keep = values > 1e-6 * values[-1]
            whiten = vectors[:, keep] / np.sqrt(values[keep])
            base = (z.T @ whiten).astype(np.float32)
            features = cls(codes, vocabulary, base, rule.longest).score([t for _, t in kept])
            bias = np.hstack([features, np.ones((len(features), 1))]).astype(np.float64)
            # at first unweighted: a language that only wrong labels name then loses its sentences to their true one
            share = {c: len(kept) / (len(codes) * len(by[c])) if again else 1.0 for c in codes}
            weight = np.array([share[c] for c, _ in kept])[:, None]
            target = np.array([[1.0 if c == k else -1.0 for k in codes] for c, _ in kept])
            gram = bias.T @ (weight * bias) + rule.ridge * len(kept) * np.eye(bias.shape[1])
            solved = np.linalg.solve(gram, bias.T @ (weight * target))
            model = cls(codes, vocabulary, (base @ solved[:-1]).astype(np.float32), rule.longest)
            model.offset = solved[-1]
            guess, _, level = model.classify([t for _, t in kept])
            right = np.array([r[0] == codes[g] for r, g in zip(kept, guess)], dtype=bool)
            model.typical = np.array([np.median(level[right & (guess == k)]) if (right & (guess == k)).any() else 0.0 for k in range(len(codes))])
            share_right = {c: np.mean([o for r, o in zip(kept, right) if r[0] == c]) for c in codes}
            kept = [r for r, o in zip(kept, right) if o and share_right[r[0]] >= 0.5]
        return model

    offset: np.ndarray | float = 0.0
    typical: np.ndarray | float = 0.0

    def score(self, texts: list[str], batch: int = 500) -> np.ndarray:
        return self._score(texts, batch)[0]

    def _score(self, texts: list[str], batch: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Kernel scores, and the share of each text's n-grams that the landmarks have."""
        out, share = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for start in range(0, len(texts), batch):
            part = texts[start : start + batch]
            owner, keys = grams(part, self.longest)
            total = np.bincount(owner, minlength=len(part)).clip(1)
            at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
            known = self.keys[at] == keys
            owner, at = owner[known], at[known]
            share[start : start + len(part)] = np.bincount(owner, minlength=len(part)) / total
            if len(owner):  # sums of the rows of each text's known n-grams
                starts = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
                out[start + owner[starts]] = np.add.reduceat(self.weights[at], starts, axis=0)
            out[start : start + len(part)] /= np.sqrt(total)[:, None]
        return out, share

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each text, its share of a softmax over the ridge scores, and how like the language it is: the score, brought to 0 to 1, times the share of known n-grams."""
        if not texts:
            return np.zeros(0, dtype=int), np.zeros(0), np.zeros(0)
        s, share = self._score(texts)
        s = 4 * (s + self.offset)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return s.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1), share * (s.max(axis=1) / 4 + 1) / 2


def train(documents: DataFrame, rule: Fit = Fit(), doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> SpectrumModel | None:
    """A model from at most ``rule.documents`` labelled documents per language, those of lowest hashed id."""
    coded = documents.select(label_code(F.col(label), rule.languages).alias("code"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("h")).where("code is not null and text is not null")
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("h")
    sample = coded.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rule.documents).orderBy("code", "h").select("code", "text").toPandas()
    rows: list[tuple[str, str]] = []
    for code, part in sample.groupby("code", sort=True):
        for t in part["text"]:
            own = [s for _, s in sentences(t)]
            rows += [(code, s) for s in own[:: max(1, len(own) // rule.per_document)][: rule.per_document]]
    return SpectrumModel.fit(rows, rule)


SEGMENTS = "doc_id long, segment int, lang string, confidence double, n_sentences int, text string"


def stretches(documents: DataFrame, model: SpectrumModel, doc_id: str = "doc_id", text: str = "text", smooth: float = 0.6, strange: float = Fit().strange) -> DataFrame:
    """(doc_id, segment, lang, confidence, n_sentences, text): each document cut where its language changes.

    A sentence decided with less than ``smooth`` joins the stretch before it (the first one the stretch after it). A document without a
    whole sentence gives its longest line as one stretch of 0 sentences at half the confidence. A stretch unlike every language the
    model has gets a null language and no confidence. Null texts and texts without letters give no row; a document of any length is read whole; repeated rows come out repeatedly.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((model.codes, model.keys, model.weights, model.offset, model.longest, strange * model.typical))  # bounded by the landmarks

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, keys, weights, offset, longest, floor = sent.value
        own = SpectrumModel(codes, keys, weights, longest)
        own.offset = offset
        for b in batches:
            owner: list[int] = []
            shown: list[str] = []
            read: list[str] = []
            whole: list[bool] = []
            starts: list[int] = []
            for i, t in zip(b["doc_id"], b["text"]):
                own_sentences = list(sentences(t))
                found = own_sentences or [x for x in [longest_line(t)] if x]
                starts += [len(owner)] if found else []
                owner += [i] * len(found)
                whole += [bool(own_sentences)] * len(found)
                shown += [x for x, _ in found]
                read += [x for _, x in found]
            distinct = {r: k for k, r in enumerate(dict.fromkeys(read))}
            best, sure, level = own.classify(list(distinct))
            rows = []
            for k, end in zip(starts, [*starts[1:], len(owner)]):
                part = [(best[distinct[r]], sure[distinct[r]], level[distinct[r]], s) for r, s in zip(read[k:end], shown[k:end])]
                lang = next((g for g, p, _, _ in part if p >= smooth), part[0][0])
                runs: list[list] = []
                for g, p, x, s in part:
                    lang = g if p >= smooth else lang
                    if not runs or runs[-1][0] != lang:
                        runs.append([lang, [], [], []])
                    for into, value in zip(runs[-1][1:], (p if g == lang else 1 - p, x, s)):
                        into.append(value)
                for n, (g, p, x, s) in enumerate(runs):
                    known = np.mean(x) >= floor[g]
                    rows.append((owner[k], n, codes[g] if known else None, float(np.mean(p)) * (1.0 if whole[k] else 0.5) if known else 0.0, len(s) if whole[k] else 0, " ".join(s)))
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "lang", "confidence", "n_sentences", "text"])

    docs = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(docs).mapInPandas(cut, SEGMENTS)


def corrected(documents: DataFrame, segments: DataFrame, doc_id: str = "doc_id", label: str = "lang") -> DataFrame:
    """(doc_id, lang, confidence) of documents whose label is missing or names a language not in them, and of all in several languages.

    Only languages recognised in whole sentences count, so a document of a language the model does not have keeps its label.
    """
    per = segments.where("lang is not null and n_sentences > 0").groupBy("doc_id", "lang").agg(F.sum(F.col("confidence") * F.col("n_sentences")).alias("c"), F.sum("n_sentences").alias("n"))
    per = per.groupBy("doc_id").agg(F.collect_list(F.struct("lang", (F.col("c") / F.col("n")).alias("confidence"))).alias("found"))
    labels = documents.select(F.col(doc_id).cast("long").alias("doc_id"), label_code(F.col(label)).alias("code"))
    joined = labels.join(per, "doc_id")
    wrong = F.col("code").isNull() | (F.size("found") > 1) | ~F.exists("found", lambda x: x["lang"] == F.col("code"))
    return joined.where(wrong).select("doc_id", F.explode("found").alias("f")).select("doc_id", F.col("f.lang").alias("lang"), F.col("f.confidence").alias("confidence")).distinct()
