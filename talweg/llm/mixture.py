"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.common import safe_div, sized_join
from talweg.functions.prefix import running_total
from talweg.session import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, text: str, out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of ``text`` under a public byte-level vocabulary; 0 for null and empty texts. Whole texts, and strings of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.withColumn(out, count(F.col(text)))


def source_name(c: str):
    """One spelling of a source: lower case without blanks around it."""
    return F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, of_corpus: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, size, demand): how many tokens the mixture takes of each source.

    ``total`` is the size of the mixture, or ``of_corpus`` its share in the tokens of all sources that have a target; by default
    it is the largest at which every source that has any tokens reaches its share exactly within its repeats. Given a larger
    one, a source gives no more than its repeats allow and falls short. A source without tokens has demand 0 and the others
    keep their shares of the whole among themselves.
    """
    t = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    own = t.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    live = own.filter("size > 0")
    goal = live.agg(F.sum("target_share").alias("_live"), F.min(F.col("size") * F.col("max_repeats") / F.col("target_share")).alias("_most"), F.sum("size").alias("_corpus"))
    given = F.lit(float(total)) if total else F.col("_corpus") * of_corpus if of_corpus else None
    whole = F.col("_most") if given is None else safe_div(given, F.col("_live"))
    most = F.col("size") * F.col("max_repeats")
    return own.crossJoin(goal).withColumn("demand", F.coalesce(F.least(F.floor(whole * F.col("target_share") + 1e-6), most), F.lit(0)).cast("long")).drop("_live", "_most", "_corpus")


class Timetable:
    """When the tokens of each source fall due, from the weights of its schedule over time.

    A schedule is a list of (time in [0, 1], weight); between them the weight is linear, before and after it stays as it is. It
    is integrated, which is quadratic in pieces, and scaled so that all of the source's demand is met at time 1. Time itself
    is then read as the share of all tokens due by then, whatever the weights of the sources add up to.
    """

    def __init__(self, demand: dict[str, int], schedule: dict[str, list[tuple[float, float]]]):
        self.of: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for source in demand:
            points = sorted(schedule.get(source) or [(0.0, 1.0)])
            t, w = np.array([p[0] for p in points]), np.array([p[1] for p in points], "f8")
            if not (np.isfinite(w) & (w >= 0)).all() or not ((t >= 0) & (t <= 1)).all():
                raise ValueError(f"the schedule of {source} has a negative weight or a time outside 0 to 1")
            at = np.unique(np.r_[0.0, t, 1.0])
            w = np.interp(at, t, w)
            area = np.r_[0.0, np.cumsum(np.diff(at) * (w[1:] + w[:-1]) / 2)]
            self.of[source] = (at, w / area[-1], area / area[-1]) if area[-1] > 0 else (np.array([0.0, 1.0]), np.ones(2), np.array([0.0, 1.0]))
        total = sum(demand.values()) or 1
        self.knots = np.unique(np.concatenate([np.array([0.0, 1.0]), *[k for k, _, _ in self.of.values()]]))
        self.due = sum((self._integral(s, self.knots) * (d / total) for s, d in demand.items()), np.zeros(len(self.knots)))
        self.rate = sum((np.interp(self.knots, *self.of[s][:2]) * (d / total) for s, d in demand.items()), np.zeros(len(self.knots)))

    def _integral(self, source: str, x: np.ndarray) -> np.ndarray:
        t, w, area = self.of[source]
        k = np.clip(np.searchsorted(t, x, "right") - 1, 0, len(t) - 2)
        d = x - t[k]
        return area[k] + w[k] * d + (w[k + 1] - w[k]) / (t[k + 1] - t[k]) * d * d / 2

    def when(self, source: str, share: np.ndarray) -> np.ndarray:
        """The inverse of the integral: the time at which that share of the source's demand is due."""
        t, w, area = self.of[source]
        k = np.clip(np.searchsorted(area, share, "right") - 1, 0, len(t) - 2)
        rest, slope = np.maximum(share - area[k], 0.0), (w[k + 1] - w[k]) / (t[k + 1] - t[k])
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 2 * rest / (w[k] + np.sqrt(np.maximum(w[k] * w[k] + 2 * slope * rest, 0)))
        return np.clip(t[k] + np.where(rest > 0, d, 0.0), 0, 1)

    def position(self, source: str, share: np.ndarray) -> np.ndarray:
        """The share of all tokens due before it."""
        x = self.when(source, share)
        k = np.clip(np.searchsorted(self.knots, x, "right") - 1, 0, len(self.knots) - 2)
        d = x - self.knots[k]
        slope = (self.rate[k + 1] - self.rate[k]) / (self.knots[k + 1] - self.knots[k])
        return np.clip(self.due[k] + self.rate[k] * d + slope * d * d / 2, 0, 1)


def mixture(documents: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame, total: int | None = None, schedule: DataFrame | None = None, seed: int = 42, vocabulary: str = VOCABULARY, of_corpus: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (position, doc_id, source, copy, tokens), range-sorted by position, and its report per source.

    A time-varying curriculum: ``schedule`` (source, time, weight) gives the weight of a source over time in linear pieces; a
    source without one keeps its weight. The weight is integrated to the cumulative demand of tokens and inverted
    (``Timetable``), which gives each copy of a document the time at which its middle token falls due, counted in the share of
    all tokens due before; position order is the order of training. The lists of sources and times are small and written by
    hand, so they go to the driver and to every worker.

    Each pass over a source takes its documents in another seeded order; the last pass ends where the demand is met, the
    document that straddles the end is taken if the larger part of it lies before. So a source is at most half a document
    off its demand, and no document is used more than ``max_repeats`` times. Documents without tokens, of a null source or
    of one without a target are left out. A source with a third of all rows is summed in ranges, not by one task.
    """
    scratch = Scratch(documents.sparkSession)
    named = documents.select(F.col(doc_id).alias("doc_id"), source_name(source).alias("source"), F.col(text).alias("_text"))
    sized = scratch.save(token_counts(named, "_text", "tokens", vocabulary).drop("_text").filter("tokens > 0 and source is not null"), "sized")
    sizes = scratch.save(sized.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("docs")), "sizes")
    goals = scratch.save(plan(sizes, targets, total, of_corpus), "goals")
    use = goals.filter("demand > 0").select("source", "size", "demand")
    times: dict[str, list[tuple[float, float]]] = {}
    if schedule is not None:
        for r in schedule.select(source_name("source").alias("s"), F.col("time").cast("double").alias("t"), F.col("weight").cast("double").alias("w")).dropna().groupBy("s", "t").agg(F.avg("w").alias("w")).collect():
            times.setdefault(r["s"], []).append((r["t"], r["w"]))
    table = Timetable({r["source"]: r["demand"] for r in use.collect()}, times)
    passes = F.least(F.ceil(F.col("demand") / F.col("size")), F.col("demand")).cast("int")
    copies = sized_join(sized, use, ["source"]).withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1)))
    order = F.xxhash64(F.lit(seed), "copy", "doc_id", "tokens")
    run = running_total(copies, ["source", "copy"], order, ["doc_id", "tokens"], "tokens", "_run")
    middle = F.col("copy") * F.col("size") + F.col("_run") + F.col("tokens") / 2.0
    taken = run.withColumn("_mid", middle).filter(F.col("_mid") < F.col("demand")).withColumn("_c", F.col("_mid") / F.col("demand"))

    @F.pandas_udf("double")
    def when(source: pd.Series, c: pd.Series) -> pd.Series:
        out = np.zeros(len(c))
        for s, rows in source.groupby(source).indices.items():
            out[rows] = table.position(s, c.to_numpy("f8")[rows])
        return pd.Series(out)

    mix = taken.select(when("source", "_c").alias("position"), "doc_id", "source", "copy", "tokens")
    mix = scratch.save(mix, "mix")
    w = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copy").alias("_last"))
    whole = w.agg(F.sum("tokens").alias("_whole"))
    report = goals.select("source", "target_share", "max_repeats", F.col("size").alias("source_tokens")).join(w, "source", "left").crossJoin(whole)
    report = report.select(
        "source", "target_share", "max_repeats", "source_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce(F.col("_last") + 1, F.lit(0)).alias("repeats"), F.coalesce(safe_div(F.col("tokens"), F.col("_whole")), F.lit(0.0)).alias("share"),
    )
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return mix.repartitionByRange(parts, "position").sortWithinPartitions("position", "source", "doc_id", "copy"), report
