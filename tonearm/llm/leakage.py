"""Held-out passages inside training documents.

The held-out passages form a BM25 inverted index with block maxima. Every
document, whole, is a query against it, evaluated by block-max WAND over blocks of passages: the pivot test, whether
the maxima of the document's terms add up to the threshold, is made for all blocks in one sum, and only postings in blocks that pass
are scored. The threshold is each passage's own: the least that any words of it which the verification
accepts can score, wherever in the document they stand, so nothing the verification accepts is lost. Each document and
passage found that way is verified: first the longest common subsequence of their words, in bit-parallel form for many passages together,
then an alignment of the passage's words, in their order, with the whole document.

Words of a document that are no passage word but one edit away from one (a typo) are read as
that word, before both the search and the alignment.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.lookalike import canonical
from tonearm.plans.staging import spread, stage

_WORD = regex.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Overlap:
    """When a document gives a passage away.

    ``retrieve``: the number to which BM25 is scaled so that it is every passage's own limit. ``block``: passages in a block.
    ``words``: least aligned words (a shorter passage must be there wholly), ``score``: least alignment score. The number of words decides; the gaps cost
    so little that 20 words with 8 more changed, or in 5 pieces, reach the score, and only reject words scattered over much more of the passage.
    """

    retrieve: float = 1.0
    words: int = 17
    score: float = 14.0
    k1: float = 1.2
    b: float = 0.5
    block: int = 4
    passage_gap: float = 0.6
    document_gap: float = 0.1
    jump: float = 1.5
    shard: int = 20000


def words_of(text: str) -> list[str]:
    return _WORD.findall((canonical(text) or "").lower())


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


class PassageIndex:
    """BM25 over passages: postings by term in passage order, cut into blocks with the block's greatest impact."""

    def __init__(self, passages: list[tuple[int, str]], rule: Overlap, corpus: tuple[int, float, dict[str, int]] | None = None) -> None:
        """``corpus``: number, mean length and word counts of all passages, where these are only some of them."""
        self.rule = rule
        self.ids = [i for i, _ in passages]
        self.tokens = [words_of(p) for _, p in passages]
        lengths = [len(t) for t in self.tokens]
        n, mean, counts = corpus or (len(passages), sum(lengths) / max(1, len(lengths)), Counter(w for t in self.tokens for w in set(t)))
        mean = max(1.0, mean)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in self.tokens for w in t}))}
        self.words = [np.array([self.vocabulary[w] for w in t], dtype=np.int32) for t in self.tokens]
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for p, t in enumerate(self.tokens):
            weight = {}
            for w, tf in Counter(t).items():
                idf = math.log(1 + (n - counts[w] + 0.5) / (counts[w] + 0.5))
                weight[self.vocabulary[w]] = idf * tf * (rule.k1 + 1) / (tf + rule.k1 * (1 - rule.b + rule.b * lengths[p] / mean))
            scale = rule.retrieve / self._least(p, weight) if t else 0.0
            for w, x in weight.items():
                postings[w].append((p, x * scale))
        self.postings = postings
        self.at = [np.array([p for p, _ in pl], dtype=np.int32) for pl in postings]
        self.impact = [np.array([x for _, x in pl]) for pl in postings]
        self.block_at, self.block_max = [], []  # of each term, the blocks it occurs in and its greatest impact there
        for p, x in zip(self.at, self.impact):
            starts = np.flatnonzero(np.r_[True, np.diff(p // rule.block) > 0])
            self.block_at.append(p[starts] // rule.block)
            self.block_max.append(np.maximum.reduceat(x, starts))
        self.first = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, dtype=np.int32)
        self.masks: dict[int, dict[int, int]] = {}
        self.near: dict[str, set[str]] = {}
        for w in self.vocabulary:
            if len(w) >= 4:
                for v in (w, *_deletes(w)):
                    self.near.setdefault(v, set()).add(w)
        self.known: dict[str, int] = {}

    def _least(self, p: int, weight: dict[int, float]) -> float:
        """The least BM25 of words of passage ``p`` that the verification can accept, a little lowered for rounding.

        Every aligned word beyond the score pays for some words left out, so ``n`` words lie in a stretch of known length; the cheapest
        ``n`` of each such stretch are summed. A repeated word counts with its share, as a query counts it once.
        """
        words, r = self.words[p], self.rule
        whole, tf = len(words), Counter(words.tolist())
        x = np.array([weight[t] / tf[t] for t in words.tolist()])
        need, least = min(r.score, 0.75 * whole), float("inf")
        for n in range(min(r.words, whole), whole + 1):
            length = min(whole, n + int(max(0.0, n - need) / r.passage_gap + 1e-9))
            stretches = np.sort(np.lib.stride_tricks.sliding_window_view(x, length), axis=1)
            least = min(least, float(stretches[:, :n].sum(1).min()))
            if length == whole:
                break
        return least * (1 - 1e-6)

    def read(self, word: str) -> int:
        """The number of ``word`` in the vocabulary, of the word it is a typo of, or -1."""
        if (k := self.vocabulary.get(word)) is not None:
            return k
        if (k := self.known.get(word)) is not None:
            return k
        found = -1
        if 4 <= len(word) <= 40:
            near = {w for v in (word, *_deletes(word)) for w in self.near.get(v, ()) if one_edit(word, w)}
            if near:
                found = self.vocabulary[min(near)]
        if len(self.known) < 200_000:
            self.known[word] = found
        return found

    def search(self, terms: list[int] | np.ndarray) -> np.ndarray:
        """The passages whose BM25 with the distinct ``terms`` is at least the threshold, by block-max WAND."""
        if not len(terms):
            return np.zeros(0, dtype=np.int64)
        full, block = self.rule.retrieve * (1 - 1e-9), self.rule.block
        bound = np.bincount(np.concatenate([self.block_at[t] for t in terms]), np.concatenate([self.block_max[t] for t in terms]), minlength=len(self.ids) // block + 1)
        pivots = bound >= full
        if not pivots.any():
            return np.zeros(0, dtype=np.int64)
        at, impact = np.concatenate([self.at[t] for t in terms]), np.concatenate([self.impact[t] for t in terms])
        inside = pivots[at // block]
        return np.flatnonzero(np.bincount(at[inside], impact[inside], minlength=len(self.ids)) >= full)

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        terms = np.unique(doc)
        return self.search(terms[terms >= 0])

    def dense(self, ps: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Those of the passages ``ps`` whose best stretch could reach the score if all its words that the document has stood there in order."""
        if not len(ps):
            return ps
        there = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        there[doc[doc >= 0]] = True
        begin, length = self.first[ps], self.first[ps + 1] - self.first[ps]
        starts = np.cumsum(length) - length
        words = self.flat[np.arange(length.sum()) + np.repeat(begin - starts, length)]
        gain = np.where(there[words], 1.0, -self.rule.passage_gap)
        total = np.cumsum(gain) - np.repeat(length.max() * np.arange(1, len(ps) + 1) * 4.0, length)  # each passage begins below all before it
        low = np.minimum.accumulate(total - gain)
        top = np.maximum.reduceat(total - low, starts)
        return ps[top >= np.minimum(self.rule.score, 0.75 * length) - 1e-6]

    def possible(self, ps: np.ndarray, doc: np.ndarray) -> list[int]:
        """The passages of which enough words stand in the document in order: their longest common subsequence with it, in whole numbers of one bit a word.

        Fields of many passages lie side by side in one number, each with a spare bit on top that takes its carry.
        """
        out = []
        doc = doc[doc >= 0].tolist()
        for start in range(0, len(ps), 64):
            some = ps[start : start + 64].tolist()
            there: dict[int, int] = {}
            shift, shifts = 0, []
            for p in some:
                if p not in self.masks:
                    own: dict[int, int] = {}
                    for k, w in enumerate(self.words[p].tolist()):
                        own[w] = own.get(w, 0) | 1 << k
                    self.masks[p] = own
                for w, m in self.masks[p].items():
                    there[w] = there.get(w, 0) | m << shift
                shifts.append(shift)
                shift += len(self.words[p]) + 1
            fields = sum(((1 << len(self.words[p])) - 1) << at for p, at in zip(some, shifts))
            v = fields
            for w in doc:
                if (m := there.get(w)) is not None:
                    u = v & m
                    v = ((v + u) | (v - u)) & fields
            for p, at in zip(some, shifts):
                whole = len(self.words[p])
                if whole - (v >> at & (1 << whole) - 1).bit_count() >= min(self.rule.words, whole):
                    out.append(p)
        return out

    def align(self, ps: list[int], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each passage, score and aligned words of the best chain of its words in their order.

        An aligned word gives 1; a passage word left out costs ``passage_gap``, a document word in between
        ``document_gap`` up to ``jump``, so a passage may be broken up by other text. Costs are whole tenths, so the number of
        aligned words is carried in the digits after them.
        """
        r, one = self.rule, 1 + 1e-5
        places = []
        for p in ps:
            wanted = np.zeros(len(self.vocabulary) + 1, dtype=bool)
            wanted[self.words[p]] = True
            places.append(np.flatnonzero(wanted[doc]))  # -1, no passage word, reads the last place, which is False
        n = max(map(len, places), default=0)
        if not n:
            return np.zeros(len(ps)), np.zeros(len(ps), dtype=int)
        rows = np.full((len(ps), max(len(self.words[p]) for p in ps)), -2, dtype=np.int32)
        place, text = np.zeros((len(ps), n)), np.full((len(ps), n), -3, dtype=np.int32)
        for k, (p, x) in enumerate(zip(ps, places)):
            rows[k, : len(self.words[p])] = self.words[p]
            place[k, : len(x)], text[k, : len(x)] = x, doc[x]
        gap = r.document_gap * place
        best, top = np.full((len(ps), n), -1e9), np.zeros(len(ps))
        through, jumped = np.full((len(ps), n), -1e9), np.full((len(ps), n), -1e9)
        for w in rows.T:
            hit = text == w[:, None]
            if not hit.any():
                best -= r.passage_gap
                continue
            through[:, 1:] = np.maximum.accumulate(best + gap, axis=1)[:, :-1]
            jumped[:, 1:] = np.maximum.accumulate(best, axis=1)[:, :-1]
            new = one + np.maximum(np.maximum(through - gap + r.document_gap, jumped - r.jump), 0)
            best -= r.passage_gap
            np.copyto(best, np.maximum(best, new), where=hit)
            top = np.maximum(top, np.where(hit, new, 0).max(1))
        units = np.rint(top * 1e5).astype(np.int64)
        return top, (units % 10_000).astype(int)

    def leaks(self, text: str) -> Iterator[tuple[int, int, float]]:
        doc = np.array([self.read(w) for w in words_of(text)], dtype=np.int32)
        found = self.possible(self.dense(self.candidates(doc), doc), doc) if len(doc) else []
        step = max(1, min(32, 1_000_000 // max(1, len(doc))))  # bounds the alignment's arrays in long documents
        for start in range(0, len(found), step):
            some = found[start : start + step]
            for p, score, words in zip(some, *self.align(some, doc)):
                whole = len(self.words[p])
                if words >= min(self.rule.words, whole) and score >= min(self.rule.score, 0.75 * whole):
                    yield self.ids[p], int(words), round(float(score), 3)


_INDEXES: dict[str, PassageIndex] = {}


def _index(key: str, held, rule: Overlap) -> PassageIndex:
    """The index of a shard, kept by the worker for its further tasks; of earlier shards none is kept."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = PassageIndex(held.value[0], rule, held.value[1])
    return _INDEXES[key]


def leaked(documents: DataFrame, items: DataFrame, rule: Overlap = Overlap(), *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, words, score): every document with every passage it gives away, once each.

    The passages are held-out material of limited size; an index is built from about ``rule.shard`` of them at a time, with the word counts of all,
    and sent to the executors, where each worker builds it once; further passages go through the same search in further shards. Documents are
    searched whole, row by row; only where their files are fewer than the cores are they spread over more tasks first.

    Defined cases: null and empty documents or passages match nothing; a passage given twice under one id counts once;
    copies of a document each come out under their own id; extra columns are ignored; empty inputs give an empty frame.
    """
    spark = documents.sparkSession
    kept = items.where(F.col(passage).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [words_of(p) for p in b["passage"]]
            yield pd.DataFrame({"item_id": b["item_id"], "passage": b["passage"], "length": [len(w) for w in words], "words": [sorted(set(w)) for w in words]})

    kept = stage(kept.mapInPandas(read, "item_id long, passage string, length int, words array<string>").where("length > 0"), "passages")
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    shards = max(1, -(-size.n // rule.shard))
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    counts = stage(kept.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "passage-words")
    docs = spread(documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    parts = []
    for s in range(shards):
        own = kept.where(F.col("shard") == s)
        rows = own.select("item_id", "passage").orderBy("item_id").collect()  # about rule.shard
        known = counts.join(own.select(F.explode("words").alias("w")).distinct(), "w").collect()  # the words of a shard
        held = spark.sparkContext.broadcast(([(r.item_id, r.passage) for r in rows], (size.n, size.mean or 0.0, {r.w: r.n for r in known})))

        def find(batches: Iterator[pd.DataFrame], held=held, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            index = _index(key, held, rule)
            for b in batches:
                out = [(d, *hit) for d, t in zip(b["doc_id"], b["text"]) for hit in index.leaks(t)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "score"])

        parts.append(docs.mapInPandas(find, "doc_id long, item_id long, words int, score double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("score").alias("score"))
