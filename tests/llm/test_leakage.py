import random

import numpy as np

from tonearm.llm.leakage import Overlap, PassageIndex, leaked, one_edit

WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "ru", "se") for b in ("lin", "dor", "vak", "pez", "gum") for c in ("a", "o", "ix", "ung")]


def passages(n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, k=40))) for i in range(n)]


def test_wand_finds_all_that_a_full_scan_finds():
    items = passages(60)
    index = PassageIndex(items, Overlap(retrieve=9.0, block=4))
    dense = np.zeros((len(index.vocabulary), len(items)))
    for t, pl in enumerate(index.postings):
        for p, x in pl:
            dense[t, p] = x
    r = random.Random(2)
    for _ in range(200):
        terms = sorted(set(r.choices(range(len(index.vocabulary)), k=25)))
        assert set(index.search(terms)) == set(np.flatnonzero(dense[terms].sum(0) >= 9.0).tolist())


def test_one_edit():
    assert all(one_edit(*x) for x in (("word", "wrod"), ("word", "wod"), ("word", "worrd"), ("word", "ward"), ("word", "word")))
    assert not any(one_edit(*x) for x in (("word", "wdor"), ("word", "wo"), ("word", "wxyd")))


def test_altered_passages_and_edges(spark):
    items = passages(30)
    text = items[3][1].split()
    typo = [w[:2] + w[3:] if i % 9 == 4 else w for i, w in enumerate(text)]
    filler = "nothing here is about that at all and the room was warm "
    rows = [
        (1, filler + " ".join(text) + filler),
        (2, filler + " ".join(typo).upper().replace(" ", "\n> ", 6)),
        (3, " ".join(text[:20]) + " " + filler * 2 + " ".join(text[20:])),
        (4, " ".join(text[:7]) + " " + filler),
        (5, filler * 5000 + " ".join(text)),
        (6, None),
        (7, ""),
        (8, " ".join(sorted(text))),
        (1, filler + " ".join(text) + filler),
    ]
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, item_id int")
    held = spark.createDataFrame([*items, items[3], (99, None), (98, "")], "item_id long, passage string")
    got = sorted((r.doc_id, r.item_id) for r in leaked(docs, held).collect())
    assert got == [(1, 3), (2, 3), (3, 3), (5, 3)]
    assert leaked(docs.limit(0), held).count() == 0
    assert leaked(docs, held.limit(0)).count() == 0


def altered(text, kept, changed, pieces, seed):
    """``kept`` words of ``text`` in order, ``changed`` more replaced, in ``pieces`` with 40 other words between."""
    r = random.Random(seed)
    part = text.split()[: kept + changed]
    for k in r.sample(range(1, len(part) - 1), changed):
        part[k] = f"zq{k}xw"
    cuts = [round(len(part) * k / pieces) for k in range(pieces + 1)]
    other = " ".join(f"filler{k}" for k in range(40))
    return f" {other} ".join(" ".join(part[a:b]) for a, b in zip(cuts, cuts[1:]))


def test_changed_words_and_pieces():
    items = passages(30)
    index = PassageIndex(items, Overlap(retrieve=1.0))
    for kept, changed, pieces in ((20, 4, 1), (20, 5, 1), (20, 8, 1), (28, 12, 1), (30, 10, 1), (20, 0, 4), (20, 0, 5), (24, 6, 3), (30, 10, 5)):
        for p in range(10):
            assert [p for p, _, _ in index.leaks(altered(items[p][1], kept, changed, pieces, p))] == [p], (kept, changed, pieces)
    scattered = " filler filler ".join(items[0][1].split()[::2])  # 20 words in order, every other one of the passage
    for text in (altered(items[0][1], 12, 0, 1, 0), altered(items[0][1], 14, 4, 2, 0), scattered):
        assert not list(index.leaks(text))


def test_retrieval_loses_nothing_the_verification_accepts():
    common = WORDS[:12]  # cheap words, in most passages
    r = random.Random(4)
    items = [(i, " ".join(r.choice(common) if r.random() < 0.7 else r.choice(WORDS) for _ in range(50))) for i in range(40)]
    for held in (items, items[:1], items[:3]):
        index, every = PassageIndex(held, Overlap()), list(range(len(held)))
        for p in range(len(held)):
            for kept, changed, pieces in ((20, 0, 1), (17, 0, 2), (20, 8, 1), (24, 0, 3), (30, 0, 5), (24, 6, 3)):
                text = altered(held[p][1], kept, changed, pieces, p).replace("filler39", "filler39 " + "other words here " * 60)
                doc = np.array([index.read(w) for w in text.split()])
                want = {q for q, score, words in zip(every, *index.align(every, doc)) if words >= 17 and score >= 14}
                assert p in want and {q for q, _, _ in index.leaks(text)} == want


def test_few_and_many_items(spark):
    """One or two items are found like many; beyond a shard the counts of all items hold."""
    r = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    big = ["".join(r.choices(syllables, k=r.randint(2, 4))) for _ in range(6000)]
    texts = [" ".join(r.choices(big, k=30)) for _ in range(30_000)]
    for n in (1, 2, 300):
        index = PassageIndex(list(enumerate(texts[:n])), Overlap())
        assert all([p for p, _, _ in index.leaks("before it " + texts[k] + " after it")] == [k] for k in range(min(n, 20)))
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, passage string")
    docs = spark.createDataFrame([(k, "some other words " * 20 + texts[k] + " end") for k in range(0, 30_000, 3000)] + [(1, "nothing of it")], "doc_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in leaked(docs, items).collect()) == [(k, k) for k in range(0, 30_000, 3000)]


def test_order_test_in_bits_against_a_table():
    items = passages(70, seed=11) + [(100, "ka ka ka ka"), (101, WORDS[0])]
    index = PassageIndex(items, Overlap(words=11))
    r = random.Random(12)
    for _ in range(20):
        doc = np.array([r.randrange(-1, len(index.vocabulary)) for _ in range(120)], dtype=np.int32)
        want = []
        for p, words in enumerate(index.words):
            row = [0] * (len(doc) + 1)
            for w in words.tolist():
                new = [0]
                for j, x in enumerate(doc.tolist(), 1):
                    new.append(max(row[j], new[-1], row[j - 1] + (w == x)))
                row = new
            if row[-1] >= min(11, len(words)):
                want.append(p)
        assert index.possible(np.arange(len(items)), doc) == want
