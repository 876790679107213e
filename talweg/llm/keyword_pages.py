"""Keyword-stuffed pages, link lists, menus and product tags, by the perplexity of word classes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.session import Scratch

#: A word is one of the corpus's own (function words and the words of its records) if at least this share of the texts of a language has it.
WORD_SHARE = 0.03
#: An n-gram is kept if at least this share of the texts of a language has it; texts have a few hundred, so the table is bounded.
GRAM_SHARE = 0.001
#: The model is trained on the texts whose words are least unusual; this share of each language stays out.
TRIMMED = 0.08

#: A context weighs as much as the shorter one once this share of the texts has it, so what a few pages repeat is not learned from them.
PRIOR_SHARE = 0.15
#: A page on which the FEW commonest words, said again, are more than this share of the words, numbers and links is likely spam: the corpus's words and n-grams are not counted on it.
FEW, FEW_SHARE = 8, 0.5
#: Every text also has so many tokens of the middling text, so that a few words prove nothing.
PRIOR_TOKENS = 20
#: Nats per token above the middle text: perplexity eight times as high.
ABNORMAL = 2.1
#: Where at least this share of the words are other words said again, perplexity sinks with each repetition, and this excess is enough.
REPEATED, ABNORMAL_REPEATED = 0.4, 1.0

_ANCHOR = re.compile(r"<a\s[^<>]{0,2000}>|\]\([^()\s]{1,2000}\)", re.I)
_MARKUP = re.compile(r"<[^<>]{1,2000}>|(?<=[\w.,;:!?)])[*_~`]++|(?<![*_~`])[*_~`]++(?=\w)")
_MARKS = re.compile(r"[<*_~`]")
_TOKEN = re.compile(r"(?:https?://|www\.)\S+|[^\W\d_]+|\d[\d.,:]*|\n+|[^\w\s]", re.I)


def language(c: Column | str) -> Column:
    """The language code of a record: two letters in lower case; unknown codes are null."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    three = {"eng": "en", "spa": "es", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr"}  # fixed values
    mapped = F.coalesce(*[F.when(t == k, v) for k, v in three.items()], F.regexp_extract(t, "^([a-z]{2})(?:[-_].*)?$", 1))
    return F.when(F.length(mapped) == 2, mapped)


def raw_tokens(text: str) -> list[str]:
    """Words, numbers, links, line ends and punctuation; tags and emphasis vanish, an anchor leaves its link."""
    if "<" in text or "](" in text:
        text = _ANCHOR.sub(" http://a ", text)
    if _MARKS.search(text):
        text = _MARKUP.sub(" ", text)
    return _TOKEN.findall(text)


def normal(t: str) -> str:
    """Words in lower case; # for a number, @ for a link, one line end for several."""
    c = t[0]
    if c == "\n":
        return "\n"
    if c.isdigit():
        return "#"
    if "://" in t or t[:4].lower() == "www.":
        return "@"
    return t.lower()


#: Ids of the classes that are no words: line end, number, link, rare sign, new word, word said before, start of text.
LINE, NUMBER, LINK, SIGN, NEW, AGAIN, START = range(7)
_FIXED = {"\n": LINE, "#": NUMBER, "@": LINK}
#: A token is written as 30 bits of a checksum; two more tell words, signs and the fixed classes apart. ``TEXTS`` counts the texts of a language among its words.
_SIGN, _CLASS, TEXTS = 1 << 30, 2 << 30, -1
#: A text that so many documents have as it is gets its scores to them in parts.
HOT_COPIES = 200_000


class _Codes(dict):
    """Token as written -> code, worked out when first met; the same on every worker."""

    def __missing__(self, token: str) -> int:
        n = normal(token)
        code = _CLASS | _FIXED[n] if n in _FIXED else zlib.crc32(n.encode("utf-8", "surrogatepass")) & (_SIGN - 1) | (0 if n[0].isalpha() else _SIGN)
        self[token] = code
        return code


def encode(text: str, table: _Codes) -> np.ndarray:
    """One code per token."""
    if len(table) > 1_000_000:
        table.clear()
    return np.array(list(map(table.__getitem__, raw_tokens(text))), "<u4")


class Texts:
    """The codes of several texts, one behind the other."""

    def __init__(self, codes: Iterable[bytes]):
        parts = [np.frombuffer(c, "<u4") for c in codes]
        self.sizes = np.array([len(p) for p in parts], int)
        self.flat = np.concatenate(parts).astype("i8") if parts else np.empty(0, "i8")
        self.ends = np.cumsum(self.sizes)
        self.of = np.repeat(np.arange(len(parts)), self.sizes)

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[mask], minlength=len(self.sizes))


class Lexicon:
    """The corpus's own words of every language, by their codes, and texts as classes."""

    def __init__(self, words: dict[str, list[int]], common: str):
        self.langs = sorted(words, key=lambda k: (k != common, k))
        vocab = np.array(sorted(set().union(*words.values())) if words else [], "i8")
        self.codes, self.base = vocab, START + 1 + len(vocab)
        self.own = np.zeros((max(len(self.langs), 1), self.base), bool)
        self.own[:, : START + 1] = True
        for k, lang in enumerate(self.langs):
            self.own[k, START + 1 + np.searchsorted(vocab, np.array(words[lang], "i8"))] = True
        self.word = np.r_[np.zeros(START + 1, bool), vocab < _SIGN]
        self.dtype = np.dtype("<i2") if self.base < 1 << 15 else np.dtype("<i4")

    def ids(self, texts: Texts) -> np.ndarray:
        """Classes and the corpus's own words below ``base``, other words from it on."""
        flat = texts.flat
        out = np.where(flat >= _CLASS, flat - _CLASS, np.where(flat >= _SIGN, SIGN, self.base + flat))
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
            hit = self.codes[at] == flat
            out[hit] = START + 1 + at[hit]
        return out

    def languages(self, texts: Texts, ids: np.ndarray) -> np.ndarray:
        """Of each text the language whose own words it uses most; the commonest language if none."""
        known = np.flatnonzero(ids < self.base)
        known = known[self.word[ids[known]]]
        best, most = np.zeros(len(texts.sizes), int), np.zeros(len(texts.sizes))
        for k in range(len(self.langs)):
            n = np.bincount(texts.of[known], weights=self.own[k, ids[known]], minlength=len(best))
            best, most = np.where(n > most, k, best), np.maximum(n, most)
        return best

    def classes(self, texts: Texts, ids: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """Own words as they are, others by class: new in this text, or said before; other signs as one class."""
        inside = np.flatnonzero(ids < self.base)
        out, foreign = ids.copy(), np.ones(len(ids), bool)
        foreign[inside] = ~self.own[languages[texts.of[inside]], ids[inside]]
        sign = inside[foreign[inside] & ~self.word[ids[inside]]]
        out[sign] = SIGN
        foreign[sign] = False
        other = np.flatnonzero(foreign)
        out[other] = AGAIN
        out[other[np.unique(texts.of[other] << 40 | ids[other], return_index=True)[1]]] = NEW
        return out


def few_share(words: np.ndarray, tokens: int) -> float:
    """Share of the FEW commonest words, their first time left out, in the ``tokens`` words, numbers and links; ``words`` has how often each word is said."""
    n = np.asarray(words)
    if len(n) > FEW:
        n = np.partition(n, len(n) - FEW)[-FEW:]
    return float(n.sum() - len(n)) / max(tokens, 1)


def _grams(cls: np.ndarray, size: int) -> list[np.ndarray]:
    """The n-grams of order 1 to 3 that end at each token, as numbers; ``size`` is the number of classes."""
    line = np.concatenate([[START, START], cls]).astype("i8")
    two = line[1:-1] * size + line[2:]
    return [line[2:], two, line[:-2] * size * size + two]


class ClassModel:
    """Interpolated trigram model over word classes of one language, from shares of texts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], floor: float, size: int):
        self.grams, self.floor, self.size = grams, floor, size
        self.total = grams[0][1].sum() or 1.0
        self.after = []
        for keys, shares in grams[1:]:
            context, at = np.unique(keys // size, return_inverse=True)
            self.after.append((context, np.bincount(at, weights=shares, minlength=len(context))))

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        known, value = table
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, value[at], 0.0)

    def surprise(self, three: np.ndarray) -> np.ndarray:
        """Negative log probability of the last token of each trigram; equal trigrams are looked up once."""
        three, back = np.unique(three, return_inverse=True)
        grams = [three % self.size, three % self.size**2, three]
        shares = [self._look(t, g) for t, g in zip(self.grams, grams)]
        p = (shares[0] + self.floor) / (self.total + 1000 * self.floor)
        for share, keys, after in zip(shares[1:], grams[1:], self.after):
            p = (share + PRIOR_SHARE * p) / (self._look(after, keys // self.size) + PRIOR_SHARE)
        return -np.log(np.maximum(p, 1e-12))[back]


def page_scores(documents: DataFrame, doc_id: str, text: str, lang: str, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE, trimmed: float = TRIMMED) -> DataFrame:
    """(doc_id, lang, tokens, own_share, again_share, few_share, perplexity, excess) of every text that has a word.

    The first pass counts in how many texts of a language each word stands: words of at least ``word_share`` of them are
    function words and the vocabulary of its records. The second hears each text's language from the words it uses and
    writes it as word classes, with how unusual its other words are. From those, the n-grams of the prose and records of
    each language are counted, leaving out the share ``trimmed`` of its texts with the most unusual words, and each text is
    scored under the trigram model of its language. Words and n-grams are counted over distinct texts, and not on pages
    that few words fill (``FEW_SHARE``), so neither depends on how often spam is copied. ``perplexity`` is the exponent of the mean
    surprise of a token, ``excess`` how far that mean is above the middle text's, ``own_share`` the share of words that are
    the corpus's own, ``again_share`` that of other words said again, ``few_share`` that of the commonest words said again,
    own ones or not, in the words, numbers and links.

    Texts of an unknown language are counted with the commonest one. Null and empty texts and null ids do not come out;
    repeated texts come out each.

    A text is cut into tokens once, into codes of four bytes; equal texts are brought together by two 64-bit hashes, counted
    and scored once, and their scores go back to their documents at the end. What goes to every worker are words and n-grams
    that a share of a language's texts have, which bounds their number.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), language(lang).alias("lang")).filter("doc_id is not null and text is not null and text <> ''")
    same = [F.xxhash64("text").alias("s1"), F.xxhash64(F.lit(1), "text").alias("s2")]
    sizes = own.groupBy("lang").agg(F.count("*").alias("n")).collect()  # two-letter codes, 677 at most
    listed = sorted((-r["n"], r["lang"]) for r in sizes if r["lang"])
    common = listed[0][1] if listed else "en"

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _Codes()
        for b in batches:
            codes = [encode(t, table) for t in b["text"]]
            few = []
            for c in codes:
                said = np.unique(c[c < _SIGN], return_counts=True)[1]
                few.append(few_share(said, int(said.sum() + ((c == _CLASS | NUMBER) | (c == _CLASS | LINK)).sum())))
            out = pd.DataFrame({"s1": b["s1"], "s2": b["s2"], "lang": b["lang"], "few": few, "codes": [c.tobytes() for c in codes]})
            yield out[[len(c) > 0 for c in codes]]

    coded = own.select(*same, F.coalesce("lang", F.lit(common)).alias("lang"), "text").mapInPandas(code, "s1 long, s2 long, lang string, few double, codes binary")
    texts = scratch.save(coded.groupBy("s1", "s2").agg(F.first("few").alias("few"), F.first("codes").alias("codes"), F.collect_set("lang").alias("langs"), F.count("*").alias("copies")), "texts")

    def words_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = Texts(b["codes"])
            pairs = np.unique(t.of << 32 | t.flat)
            of, words = pairs >> 32, pairs & 0xFFFFFFFF
            lists = [set(x) for x in b["langs"]]
            for k in set().union(*lists):
                mine = np.array([k in x for x in lists])
                w = words[mine[of]]
                w, n = np.unique(w[w < _CLASS], return_counts=True)
                yield pd.DataFrame({"lang": k, "word": np.r_[TEXTS, w], "n": np.r_[mine.sum(), n]})

    def of_lang(values: dict[str, float], missing: float) -> Column:
        known = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
        return F.coalesce(F.try_element_at(F.create_map(*known), F.col("lang")), F.lit(missing)) if known else F.lit(missing)

    learned = texts.filter(F.col("few") <= FEW_SHARE)
    counted = scratch.save(learned.select("langs", "codes").mapInPandas(words_in, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    docs = {r["lang"]: r["n"] for r in counted.filter(F.col("word") == TEXTS).collect()}
    words: dict[str, list[int]] = {k: [] for k in {common, *docs}}
    for r in counted.filter((F.col("word") != TEXTS) & (F.col("n") / of_lang(docs, 1.0) >= word_share)).collect():  # at most (distinct words per text) / word_share for each language
        words[r["lang"]].append(r["word"])
    size = Lexicon(words, common).base
    dtype = Lexicon(words, common).dtype

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(words, common)
        for b in batches:
            t = Texts(b["codes"])
            ids = lex.ids(t)
            langs = lex.languages(t, ids)
            cls = lex.classes(t, ids, langs)
            new, again, odd = (t.count(m) for m in (cls == NEW, cls == AGAIN, (cls == SIGN) | (cls == LINK)))
            raw, width = cls.astype(dtype).tobytes(), dtype.itemsize
            parts = [raw[(e - n) * width : e * width] for e, n in zip(t.ends.tolist(), t.sizes.tolist())]
            yield pd.DataFrame({
                "s1": b["s1"], "s2": b["s2"], "copies": b["copies"], "lang": np.array(lex.langs, dtype=object)[langs], "cls": parts, "tokens": t.sizes, "alpha": new + again + t.count(lex.word[cls]),
                "again": again, "other": new + again, "odd": (2 * again + new + odd) / np.maximum(t.sizes, 1), "few": b["few"],
            })

    rated = scratch.save(texts.select("s1", "s2", "copies", "codes", "few").mapInPandas(classify, "s1 long, s2 long, copies long, lang string, cls binary, tokens long, alpha long, again long, other long, odd double, few double"), "rated")
    scratch.drop("words", "texts")
    learned = rated.filter(F.col("few") <= FEW_SHARE)
    limits, docs = {}, {}
    for r in learned.groupBy("lang").agg(F.percentile_approx("odd", 1 - trimmed, 1000).alias("q"), F.count("*").alias("n")).collect():
        limits[r["lang"]], docs[r["lang"]] = r["q"], r["n"]

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, part in b.groupby("lang"):
                each = [[np.unique(g) for g in _grams(np.frombuffer(c, dtype), size)] for c in part["cls"]]
                for order in range(3):
                    keys, n = np.unique(np.concatenate([e[order] for e in each]), return_counts=True)
                    yield pd.DataFrame({"lang": k, "gram_order": order, "gram": keys, "n": n})

    kept = learned.filter(F.col("odd") <= of_lang(limits, 0.0)).select("lang", "cls")
    grams = kept.mapInPandas(count_grams, "lang string, gram_order int, gram long, n long").groupBy("lang", "gram_order", "gram").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("share", F.col("n") / of_lang(docs, 1.0)).filter(F.col("share") >= gram_share)
    tables: dict[str, list] = {k: [([], []) for _ in range(3)] for k in [*words, *docs]}
    for r in grams.orderBy("gram").collect():  # at most (distinct n-grams per text) / gram_share for each language
        tables[r["lang"]][r["gram_order"]][0].append(r["gram"])
        tables[r["lang"]][r["gram_order"]][1].append(r["share"])
    packed = {k: [(np.array(g, "i8"), np.array(s, "f8")) for g, s in t] for k, t in tables.items()}
    shared = spark.sparkContext.broadcast(packed)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {k: ClassModel(t, gram_share, size) for k, t in shared.value.items()}
        for b in batches:
            for k, part in b.groupby("lang"):
                each = [_grams(np.frombuffer(c, dtype), size)[2] for c in part["cls"]]
                s = models[k].surprise(np.concatenate(each))
                ends = np.cumsum([len(e) for e in each])
                total = np.diff(np.concatenate([[0.0], np.cumsum(s)[ends - 1]]))
                yield part.drop(columns="cls").assign(surprise=total)

    columns = ["s1", "s2", "copies", "lang", "tokens", "alpha", "again", "other", "few"]
    scored = rated.filter("alpha > 0").select(*columns, "cls").mapInPandas(score, "s1 long, s2 long, copies long, lang string, tokens long, alpha long, again long, other long, few double, surprise double")
    scored = scratch.save(scored, "scored")
    scratch.drop("rated")
    middle = scored.agg(F.percentile_approx(F.col("surprise") / F.col("tokens"), 0.5, 1000).alias("_m"))
    mean = (F.col("surprise") + PRIOR_TOKENS * F.coalesce("_m", F.lit(0.0))) / (F.col("tokens") + PRIOR_TOKENS)
    parts = F.ceil(F.col("copies") / HOT_COPIES).cast("int")
    hot = scored.filter(F.col("copies") > HOT_COPIES).select("s1", "s2", parts.alias("_parts"))  # one in HOT_COPIES of the documents at most
    told = scored.crossJoin(middle).withColumn("_mean", mean).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    asking = own.select("doc_id", *same).join(F.broadcast(hot), ["s1", "s2"], "left").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    out = asking.join(told, ["s1", "s2", "_part"])
    return out.select("doc_id", "lang", "tokens", (1 - F.col("other") / F.col("alpha")).alias("own_share"), (F.col("again") / F.col("alpha")).alias("again_share"), F.col("few").alias("few_share"), F.exp("_mean").alias("perplexity"), (F.col("_mean") - F.col("_m")).alias("excess"))


def keyword_pages(scores: DataFrame, abnormal: float = ABNORMAL, repeated: float = REPEATED, abnormal_repeated: float = ABNORMAL_REPEATED, few: float = FEW_SHARE) -> DataFrame:
    """The scores of the pages whose perplexity is abnormally high, for a page of repeated words less so, or abnormally low.

    High: a mean surprise more than ``abnormal`` nats above the middle text's. A page that says the same few keywords over
    and over grows predictable again; where the share of other words said again is above ``repeated``, or that of the
    commonest words, own ones or not, above ``few``, ``abnormal_repeated`` nats above it are enough. Low: as many nats below
    it, on pages that few words fill; logs and tables are as predictable, but their numbers keep ``few_share`` down.
    """
    filled = (F.col("few_share") > few) & (F.abs("excess") > abnormal_repeated)
    again = (F.col("again_share") > repeated) & (F.col("excess") > abnormal_repeated)
    return scores.filter((F.col("excess") > abnormal) | again | filled)
