import random

from pyspark.sql import functions as F

from tonearm.llm.language import corrected, label_code, sentences, stretches, train

PARTS = {
    "en": ("the quick river, a silent garden, this old record, every good song, that long evening".split(", "), "was played before the people left the room, sounded better than we thought, should never have been forgotten".split(", ")),
    "de": ("der schnelle Fluss, ein stiller Garten, diese alte Platte, jedes gute Lied, der lange Abend".split(", "), "wurde gespielt bevor die Leute gingen, klang besser als wir dachten, sollte nicht vergessen werden".split(", ")),
    "fr": ("la rivière rapide, un jardin silencieux, ce vieux disque, chaque bonne chanson, cette longue soirée".split(", "), "a été jouée avant que les gens partent, sonnait mieux que nous pensions, ne devait jamais être oublié".split(", ")),
}


def say(lang, r, n=6):
    a, b = PARTS[lang]
    return " ".join((x := f"{r.choice(a)} {r.choice(b)} {r.choice(a)}.")[0].upper() + x[1:] for _ in range(n))


def test_sentences():
    text = 'Artist – Some Title\n[12:30] This one was really good. See "Der lange Weg" there and then again. https://x.example/1\n> a line that was\n> wrapped goes on here.\nNo end of this'
    assert [s for s, _ in sentences(text)] == ["This one was really good.", 'See "Der lange Weg" there and then again.', "a line that was wrapped goes on here."]


def test_found_and_edges(spark):
    r = random.Random(4)
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, say(lang, r), {"en": "en_US", "de": "deu", "fr": "French"}[lang]))
    rows += [(1000, say("de", r), "en"), (1001, say("fr", r), None), (1002, say("en", r, 3) + "\n\n" + say("fr", r, 3), "en"), (1003, None, "en"), (1004, "", None), (1005, "Just a Title", "xx"), (1006, say("de", r, 3000), "unknown"), (1006, "", "unknown")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, segment int")
    model = train(docs)
    segments = stretches(docs, model)
    got = sorted((x.doc_id, x.lang) for x in corrected(docs, segments).collect())
    assert got == [(1000, "de"), (1001, "fr"), (1002, "en"), (1002, "fr"), (1006, "de")]
    assert [x.lang for x in segments.where("doc_id = 1002").orderBy("segment").collect()] == ["en", "fr"]
    assert all(0 < x.confidence <= 1 for x in segments.collect())
    assert stretches(docs.limit(0), model).count() == 0
    assert train(docs.limit(0)) is None
    codes = spark.createDataFrame([("pt-BR",), ("Russian",), ("und",), ("",), (None,), ("NL",)], "l string").select(label_code(F.col("l")).alias("c")).collect()
    assert [x.c for x in codes] == ["pt", "ru", None, None, None, "nl"]


def test_sentences_of_other_scripts_and_capitals():
    assert [s for s, _ in sentences("これは音楽についての文章です。とても良い曲だと思います。")] == ["これは音楽についての文章です。", "とても良い曲だと思います。"]
    assert len(list(sentences("यह संगीत के बारे में एक वाक्य है। यह बहुत अच्छा गीत है।"))) == 2
    assert [r for _, r in sentences("THIS RECORD WAS REALLY VERY GOOD.")] == [" this record was really very good. "]
    assert [s for s, _ in sentences('He said "stop." Then all of us went home again. (It was late then.) We slept at once!')] == ["Then all of us went home again.", "(It was late then.)", "We slept at once!"]


def test_languages_not_learned_and_texts_without_sentences(spark):
    r = random.Random(5)
    rows = [(i, say(c, r), c) for i in range(180) for c in [["en", "de", "fr"][i % 3]]]
    polish = "Ta płyta jest naprawdę bardzo dobra i chciałbym ją usłyszeć jeszcze raz. Nie wiem jednak, czy ktoś ją ma."
    rows += [(2000, polish, "pl"), (2001, polish, "Polish"), (2002, say("de", r), "pl"), (2003, say("de", r).replace(".", ""), None), (2004, "123 !!", None), (2005, say("fr", r), "sv-SE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    assert model.codes == ["de", "en", "fr"]
    segments = stretches(docs, model)
    assert sorted((x.doc_id, x.lang) for x in corrected(docs, segments).collect()) == [(2002, "de"), (2005, "fr")]
    by = {x.doc_id: x for x in segments.where("doc_id >= 2000").collect()}
    assert by[2000].lang is None and by[2001].lang is None and by[2003].lang == "de" and by[2003].n_sentences == 0 and by[2003].confidence <= 0.5 and 2004 not in by


def test_a_language_learned_from_its_labels(spark):
    r = random.Random(6)
    a, b = "ta szybka rzeka, cichy ogród, ten stary album, każda dobra piosenka, długi wieczór".split(", "), "została zagrana zanim ludzie wyszli, brzmiała lepiej niż myśleliśmy, nigdy nie powinna być zapomniana".split(", ")
    pl = lambda: " ".join(f"{r.choice(a).capitalize()} {r.choice(b)} {r.choice(a)}." for _ in range(6))
    rows = [(i, say(c, r), c) for i in range(300) for c in [["en", "de", "fr"][i % 3]]] + [(1000 + i, pl(), "pl") for i in range(40)] + [(1500 + i, say("en", r), "sv") for i in range(12)] + [(2000, pl(), None), (2001, pl(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    assert model.codes == ["de", "en", "fr", "pl"]
    got = sorted((x.doc_id, x.lang) for x in corrected(docs, stretches(docs, model)).collect())
    assert got == [(1500 + i, "en") for i in range(12)] + [(2000, "pl"), (2001, "pl")]
