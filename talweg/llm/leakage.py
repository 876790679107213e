"""Evaluation passages inside training text."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.session import Scratch

#: Items per automaton: 150 words each make about 10 MB. More items make further automata, for the same words of the texts.
BLOCK_ITEMS = 2000
#: Characters of normalised text that a task holds at a time to scan them with one automaton after the other.
HOLD_CHARS = 32_000_000

#: Soft hyphens, zero-width and direction marks, variation selectors and combining accents.
_INVISIBLE_RANGES = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2069), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0x300, 0x36F)]
_INVISIBLE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _INVISIBLE_RANGES)
_INLINE = r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|var)(?:\s[^<>]*+)?/?>"
#: A tag of any length if it has attributes, else up to 500 characters, as "<" may stand for "less than".
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,500}+>|<[A-Za-z][\w:-]*+\s++[\w:-]++\s*+=[^<>]*+>")
_HIDDEN = re.compile(r"<!--|<(?:script|style)\b", re.I | re.A)
_INLINE_TAG = re.compile(_INLINE, re.I)
_CLOSE = {k: re.compile(re.escape(k), re.I | re.A) for k in ("-->", "</script", "</style")}
_LINK = re.compile(r"\]\((?:[^()\s]|\([^()\s]*+\))++\)")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_WORD = re.compile(rf"[^\W_](?:[{_INVISIBLE}\x00]*[^\W_])*[{_INVISIBLE}]*")
_DROP = re.compile(rf"[{_INVISIBLE}\x00]")
_PLAIN = re.compile(r"[a-z0-9]+")


def _blank_tag(m: re.Match) -> str:
    """Tags inside a line vanish (a word goes on behind them), others part words; the length stays."""
    return ("\x00" if _INLINE_TAG.fullmatch(m[0]) else " ") * len(m[0])


def _blank_hidden(text: str) -> str:
    """Comments, scripts and styles become blanks; one that never ends stays. Each part of the text is looked at once."""
    parts, at = [], 0
    lost: set[str] = set()
    for m in _HIDDEN.finditer(text):
        if m.start() < at:
            continue
        close = "-->" if m[0] == "<!--" else f"</{m[0][1:].lower()}"
        if close in lost:
            continue
        found = _CLOSE[close].search(text, m.end())
        if not found:
            lost.add(close)
            continue
        end = found.end() if close == "-->" else text.find(">", found.end()) + 1 or len(text)
        parts += [text[at : m.start()], " " * (end - m.start())]
        at = end
    return "".join([*parts, text[at:]])


def _entity(m: re.Match) -> str:
    c = html.unescape(m[0])
    if len(c) == 1 and (c.isalnum() or _DROP.match(c)):
        return c + "\x00" * (len(m[0]) - 1)
    return " " * len(m[0])


def words_of(text: str) -> list[tuple[str, int, int]]:
    """The words of a text, normalised, each with its offsets in the original text.

    Case, punctuation, spacing, marks before lines, invisible characters, accents and markup (tags, entities, link targets)
    do not count. Nothing is cut out of the text, so offsets hold.
    """
    t = text.replace("\x00", " ")
    if "<" in t:
        t = _TAG.sub(_blank_tag, _blank_hidden(t))
    if "](" in t:
        t = _LINK.sub(lambda m: " " * len(m[0]), t)
    if "&" in t:
        t = _ENTITY.sub(_entity, t)
    out = []
    for m in _WORD.finditer(t):
        w = m[0].lower()
        if not _PLAIN.fullmatch(w):
            w = unicodedata.normalize("NFKD", _DROP.sub("", m[0])).casefold()
            w = _DROP.sub("", w)
        if w:
            out.append((w, m.start(), m.end()))
    return out


class Passages:
    """One Aho-Corasick automaton over every window of ``run`` words of the passages; a word is one letter of its alphabet.

    A passage under ``run`` words has one window, all of it, if ``short`` says so, and none otherwise.
    """

    def __init__(self, items: list[tuple[int, str]], run: int, short: bool = False):
        import ahocorasick

        self.alphabet: dict[str, str] = {}
        self.lengths: dict[int, int] = {}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, passage in items:
            letters = [self._letter(w) for w, _, _ in words_of(passage)]
            self.lengths[item] = len(letters)
            width = min(run, len(letters)) if short and letters else run
            for i in range(len(letters) - width + 1):
                at["".join(letters[i : i + width])].append((item, i))
        self.automaton = ahocorasick.Automaton()
        for key, places in at.items():
            self.automaton.add_word(key, (len(key), places))
        self.empty, self.least = not at, min(map(len, at), default=0)
        if at:
            self.automaton.make_automaton()

    def _letter(self, word: str) -> str:
        if word not in self.alphabet:
            n = len(self.alphabet) + 1
            self.alphabet[word] = chr(n + 0x800 * (n >= 0xD800))
        return self.alphabet[word]

    def scan(self, words: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(item, words of it that stand in the text in long enough runs, first offset, last offset), from ``words_of`` a text."""
        if self.empty or len(words) < self.least:
            return
        get = self.alphabet.get
        line = "".join([get(w, "\x00") for w, _, _ in words])
        seen: dict[int, set[int]] = defaultdict(set)
        span: dict[int, list[int]] = {}
        for end, (width, places) in self.automaton.iter(line):
            for item, i in places:
                seen[item].update(range(i, i + width))
                lo, hi = words[end - width + 1][1], words[end][2]
                s = span.setdefault(item, [lo, hi])
                s[0], s[1] = min(s[0], lo), max(s[1], hi)
        for item, got in seen.items():
            yield item, len(got), *span[item]


def _held(batches: Iterator[pd.DataFrame], most: int) -> Iterator[list[tuple]]:
    """The texts as (id, words in one string, offsets), so many at a time that their words stay under ``most`` characters or there is one text."""
    held, size = [], 0
    for b in batches:
        for d, t in zip(b["doc_id"], b["text"]):
            words = words_of(t)
            held.append((d, "\x00".join([w for w, _, _ in words]), np.array([s for _, s, _ in words], "i4"), np.array([e for _, _, e in words], "i4")))
            size += len(held[-1][1])
            if size > most:
                yield held
                held, size = [], 0
    yield held


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, run: int = 10, share: float = 0.5, block_items: int = BLOCK_ITEMS, short: bool = False, hold_chars: int = HOLD_CHARS) -> DataFrame:
    """(doc_id, item_id, share, first, last): the texts that hold at least ``share`` of a passage's words in runs of ``run`` words or more.

    Every text is read and cut into words once and whole. Up to ``block_items`` items make one automaton, which each worker
    builds. More items make several: a task holds the words of ``hold_chars`` characters of text and scans them with one
    automaton after the other, so what it holds is bounded whatever the number of items, and no text is read again.
    ``first`` and ``last`` are offsets of the leaked runs in the original text. Null texts and passages and null ids give
    nothing, repeated documents each come out, repeated items once; passages under ``run`` words cannot leak, unless ``short``
    says that one that stands whole in a text has leaked; a text may hold many items.
    """
    spark = documents.sparkSession
    ids = dict(items.dtypes)[item_id], dict(documents.dtypes)[doc_id]
    listed = items.select(F.col(item_id).alias("i"), F.col(passage).alias("p")).filter("i is not null and p is not null").dropDuplicates(["i"])
    listed = Scratch(spark).save(listed, "items")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    count = max(1, -(-listed.count() // block_items))
    of_block = lambda k: [(r["i"], r["p"]) for r in listed.filter(F.pmod(F.xxhash64("i"), F.lit(count)) == k).collect()]
    blocks = [spark.sparkContext.broadcast(of_block(k)) for k in range(count)]

    def found(known: Passages, texts: Iterable[tuple]) -> pd.DataFrame:
        out = []
        for d, words in texts:
            for item, n, lo, hi in known.scan(words):
                if n >= share * known.lengths[item]:
                    out.append((d, item, n / known.lengths[item], lo, hi))
        return pd.DataFrame(out, columns=["doc_id", "item_id", "share", "first", "last"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if len(blocks) == 1:
            only = Passages(blocks[0].value, run, short)
            for b in batches:
                yield found(only, ((d, words_of(t)) for d, t in zip(b["doc_id"], b["text"])))
            return
        for texts in _held(batches, hold_chars):
            for b in blocks:
                yield found(Passages(b.value, run, short), ((d, list(zip(line.split("\x00"), starts.tolist(), ends.tolist())) if line else []) for d, line, starts, ends in texts))

    return docs.mapInPandas(scan, f"doc_id {ids[1]}, item_id {ids[0]}, share double, first int, last int")
