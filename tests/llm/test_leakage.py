import random
import time

import pytest
from talweg.llm.leakage import leaks, words_of

RND = random.Random(1)
VOC = [f"w{i}x" for i in range(300)]
PASSAGE = [" ".join(RND.choice(VOC) for _ in range(40)) for _ in range(6)]


def brute(passage, text, run=10):
    p, t = [w for w, _, _ in words_of(passage)], [w for w, _, _ in words_of(text)]
    got = set()
    for i in range(len(p) - run + 1):
        for j in range(len(t) - run + 1):
            if p[i : i + run] == t[j : j + run]:
                got.update(range(i, i + run))
    return len(got) / max(len(p), 1)


def noisy(words):
    marks = ["<b>{}</b>", "**{}**", "{}&nbsp;", "{},", "\n> {}", "{}​", "<p>{}", "[{}](http://a.b/c(d)e)", "{}­"]
    return " ".join(RND.choice(marks).format(w.upper() if RND.random() < 0.3 else w) for w in words)


def test_against_brute_force(spark):
    docs = [(0, None), (1, ""), (2, "only a few words"), (3, " ".join(PASSAGE)), (3, PASSAGE[0]), (None, PASSAGE[0])]
    for k in range(60):
        p = PASSAGE[k % 6].split()
        a, b = sorted(RND.sample(range(41), 2))
        docs.append((10 + k, "before it " + noisy(p[a:b]) + " after it " + (noisy(p[:12]) if k % 3 == 0 else "") + " x" * RND.randrange(50)))
    docs.append((99, PASSAGE[1] + " filler" * 200_000))
    items = [(i, p, "q") for i, p in enumerate(PASSAGE)] + [(0, PASSAGE[0], "q"), (50, None, "q"), (51, "", "q"), (52, "too short to leak", "q"), (None, PASSAGE[0], "q")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, passage string, question string")
    want = sorted((a, k, round(s, 9)) for a, t in docs if t and a is not None for k, p in enumerate(PASSAGE) for s in [brute(p, t)] if s >= 0.5)
    assert len(want) > 15
    for block, hold in ((2000, 1 << 25), (2, 1 << 25), (1, 500)):
        got = sorted((r.doc_id, r.item_id, round(r.share, 9)) for r in leaks(d, "doc_id", "text", i, "item_id", "passage", block_items=block, hold_chars=hold).collect())
        assert got == want
    assert leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0
    assert leaks(d, "doc_id", "text", i.limit(0), "item_id", "passage").count() == 0


def test_short_items_leak_whole(spark):
    d = spark.createDataFrame([(1, "so Where did it, occur? there"), (2, "where did it"), (3, PASSAGE[0])], "doc_id long, text string")
    i = spark.createDataFrame([(1, "Where did it occur?"), (2, ""), (3, PASSAGE[0])], "item_id long, question string")
    for block in (10, 1):
        got = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "question", short=True, block_items=block).collect()}
        assert got == {(1, 1), (3, 3)}
    assert {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "question").collect()} == {(3, 3)}


def test_offsets_point_into_the_original(spark):
    text = "Intro <i>here</i>.\n> " + PASSAGE[0].upper().replace(" ", "\n>> ", 3) + "! End"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    i = spark.createDataFrame([(1, PASSAGE[0])], "item_id long, passage string")
    (r,) = leaks(d, "doc_id", "text", i, "item_id", "passage").collect()
    assert r.share == 1.0
    part = text[r["first"] : r["last"]]
    assert part.startswith(PASSAGE[0].split()[0].upper()) and part.endswith(PASSAGE[0].split()[-1].upper())


@pytest.mark.parametrize(
    "text, words",
    [
        ("Café café CAFE", ["cafe"] * 3),
        ("hy­dro hy<b>dro</b> &amp; a&shy;b &eacute;t", ["hydro", "hydro", "ab", "et"]),
        ("one<br/>two [three](http://x.y/z) _four_", ["one", "two", "three", "four"]),
        ("ＡＢ \x00 0.48", ["ab", "0", "48"]),
        ("İ <!-- hidden words here --> seen", ["i", "seen"]),
        (f'a <img src="{"x " * 900}"> b', ["a", "b"]),
        (f"a](http://{'x' * 900}) b", ["a", "b"]),
        ("a <!-- b > c --> d <SCRIPT x>e</script > f <style>g <!-- h", ["a", "d", "f", "g", "h"]),
    ],
)
def test_words(text, words):
    assert [w for w, _, _ in words_of(text)] == words


def test_hostile_texts_take_linear_time():
    began = time.time()
    for piece in ("<!-- ", "<script ", "](", "](a(", "<a ", "&a", "<", "​", "a​", "[x](", "<b"):
        words_of(piece * (600_000 // len(piece)))
    assert len(words_of("a" * 3_000_000)) == 1
    assert time.time() - began < 30
