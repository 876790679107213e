import random
import time

import numpy as np
from talweg.llm.keyword_pages import AGAIN, NEW, NUMBER, SIGN, START, Lexicon, Texts, _Codes, encode, keyword_pages, language, normal, page_scores, raw_tokens


def corpus():
    rnd = random.Random(1)
    subj, verb, obj, place = ["the gauge", "a reviewer", "the field crew", "our team"], ["checked", "moved", "dropped", "found"], ["the record", "the flow", "a storm", "the window"], [f"P{chr(97 + i % 26)}{chr(97 + i // 26)}ville" for i in range(400)]
    sent = lambda: f"In {rnd.choice(place)} {rnd.choice(subj)} {rnd.choice(verb)} {rnd.choice(obj)} and it was {rnd.choice(['good', 'bad', 'late'])} by {rnd.randrange(90)} days."
    rows = []
    for i in range(600):
        text = " ".join(sent() for _ in range(rnd.randrange(2, 12)))
        if i % 12 == 0:
            text += "\n" + "\n".join(f"0{rnd.randrange(9)}:1{rnd.randrange(9)} INFO epoch={rnd.randrange(40)} loss=0.{rnd.randrange(99)} the record" for _ in range(15))
        if i % 12 == 1:
            text += "\n\nStations kept: " + ", ".join(str(rnd.randrange(10**8)) for _ in range(40))
        rows.append((i, text, rnd.choice(["en", "EN", "eng", None, "und"])))
    bad = {
        900: " ".join(["cheap pump", "kayak hire"] * 40),
        901: "\n".join(f"* {rnd.choice(place)} http://x{i}.test/pump" for i in range(30)),
        902: " ".join(f'<a href="http://x{i}.test/q">pump offers</a>' for i in range(30)),
        903: "\n".join("Home > Login > Sale > Offers" for _ in range(20)) + "\n" + sent(),
        904: sent() + "\n" + "\n".join(f"Pump {rnd.choice('AB')}-{rnd.randrange(99)} | SKU {rnd.randrange(10**6)} | now {rnd.randrange(99)}.99 | buy" for _ in range(25)),
        905: " ".join(f"#Pump{rnd.randrange(9)} #KayakHire #SaleNow" for _ in range(25)),
        906: " ".join(f"Looking for cheap pump? Our cheap pump is a cheap pump for {rnd.choice(place)}." for _ in range(20)),
    }
    rows += [(k, v, "en") for k, v in bad.items()] + [(1000, None, "en"), (1001, "", "en"), (1002, "n/a", "en"), (1003, "12 34", None), (None, "the gauge", "en"), (5, rows[5][1], "en")]
    return rows, set(bad)


def test_pages_are_found_and_records_are_not(spark):
    rows, bad = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, perplexity string")
    scores = page_scores(df, "doc_id", "text", "lang")
    assert {r.doc_id for r in keyword_pages(scores).collect()} == bad
    assert scores.filter("doc_id = 5").count() == 2
    assert {r.doc_id for r in scores.collect()} == {r[0] for r in rows} - {None, 1000, 1001, 1003}


def test_the_vocabulary_does_not_depend_on_how_often_spam_occurs(spark):
    rows, bad = corpus()
    rnd = random.Random(2)
    spam = {2000 + i: " - ".join(rnd.choice(["CHEAP SENSOR", "pump promo", "river level"]) for _ in range(90)) for i in range(30)}
    spam |= {3000 + i: "\n".join(["* spillway tour"] * 3 + ["* kayak deal", "* weir shop"] * 8) for i in range(30)}
    df = spark.createDataFrame([*rows, *[(k, v, "en") for k, v in spam.items()]], "doc_id long, text string, lang string")
    assert {r.doc_id for r in keyword_pages(page_scores(df, "doc_id", "text", "lang")).collect()} == bad | set(spam)


def test_pages_of_own_words_and_low_perplexity(spark):
    rows, bad = corpus()
    own = {4000: " ".join(["the gauge checked the record"] * 60), 4003: "a reviewer moved a storm and it was good. " * 40}
    df = spark.createDataFrame([*rows, *[(k, v, "en") for k, v in own.items()]], "doc_id long, text string, lang string")
    assert {r.doc_id for r in keyword_pages(page_scores(df, "doc_id", "text", "lang")).collect()} == bad | set(own)
    low = spark.createDataFrame([(1, 0.0, 0.9, -1.5), (2, 0.0, 0.3, -1.5), (3, 0.0, 0.9, -0.5)], "doc_id long, again_share double, few_share double, excess double")
    assert [r.doc_id for r in keyword_pages(low).collect()] == [1]


def test_empty(spark):
    assert page_scores(spark.createDataFrame([], "d long, t string, l string"), "d", "t", "l").count() == 0


def test_classes():
    assert [normal(t) for t in raw_tokens('<b>The</b> **flow** <a href="u">x</a>\n\n3.5 m')] == ["the", "flow", "@", "x", "\n", "#", "m"]
    table = _Codes()
    code = lambda text: int(encode(text, table)[0])
    lex = Lexicon({"en": [code("the"), code(",")], "de": [code("der"), code(";")]}, "en")
    texts = Texts([encode(x, table).tobytes() for x in ("The pump, Pump; 7 der", "", "der der the", "pump")])
    ids = lex.ids(texts)
    assert texts.sizes.tolist() == [7, 0, 3, 1]
    assert lex.languages(texts, ids).tolist() == [0, 0, lex.langs.index("de"), 0]
    own = {w: START + 1 + int(np.searchsorted(lex.codes, code(w))) for w in ("the", ",", "der")}
    en = [own["the"], NEW, own[","], AGAIN, SIGN, NUMBER, NEW]
    assert lex.classes(texts, ids, lex.languages(texts, ids)).tolist() == [*en, own["der"], own["der"], NEW, NEW]
    assert code("the") < 1 << 30 <= code(",") < 2 << 30 <= code("7")


def test_more_than_fifty_languages_have_models_of_their_own(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        name = f"{chr(97 + k // 26)}{chr(97 + k % 26)}"
        words = [f"{name}{chr(97 + w)}x" for w in range(26)]
        rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(40)), name) for i in range(3 + (k == 0))]
    got = page_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    assert {(r.doc_id, r.lang) for r in got} == {(r[0], r[2]) for r in rows}


def test_many_copies_get_their_scores_in_parts(spark, monkeypatch):
    from talweg.llm import keyword_pages as kp

    rows, _ = corpus()
    df = spark.createDataFrame(rows + [(5000 + i, rows[7][1], "en") for i in range(50)], "doc_id long, text string, lang string")
    want = sorted(map(tuple, page_scores(df, "doc_id", "text", "lang").collect()))
    monkeypatch.setattr(kp, "HOT_COPIES", 7)
    assert sorted(map(tuple, page_scores(df, "doc_id", "text", "lang").collect())) == want


def test_language(spark):
    df = spark.createDataFrame([("EN",), ("eng",), ("und",), (None,), ("de-DE",), ("",), ("zz9",)], "l string")
    assert [r[0] for r in df.select(language("l")).collect()] == ["en", "en", None, None, "de", None, None]


def test_hostile_and_very_long_texts_take_linear_time():
    began = time.time()
    for piece in ("<a ", "](", "<", "*", "a*", "`_~", "http://", "1.", "\n", "<b"):
        raw_tokens(piece * (600_000 // len(piece)))
    assert len(raw_tokens("a" * 3_000_000)) == 1
    assert time.time() - began < 30
