"""Splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.common import sized_join
from talweg.session import Scratch

#: Rows (group, label) that one task places, one group after the other.
BATCH_ROWS = 100_000


def components(links: DataFrame, a: str, b: str, limit_rows: int = 200_000) -> DataFrame:
    """(entity, label): every entity that a link names, with the smallest entity it is joined to, directly or through others.

    Minimum-label propagation over the bipartite graph of records (links) and entities: a record takes the smallest label
    of its entities, an entity the smallest of its records; the entity that lent its name as a label takes part too, and
    after each round a label is replaced by the label of the entity it names. That doubles the distance a label travels,
    so a chain of n entities takes about log(n) rounds instead of n. Links with a null end name the other end only,
    repeated links and self-links do nothing, an empty table gives an empty one. An entity in a third of all links is
    looked up by broadcast (up to ``limit_rows`` entities) or salted join and its messages are reduced before they are shuffled.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.save(links.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    names = edges.select(F.explode(F.array("a", "b")).alias("entity")).filter(F.col("entity").isNotNull()).distinct()
    pairs = edges.filter("a is not null and b is not null and a <> b")
    labels = scratch.save(names.withColumn("label", F.col("entity")), "labels0")
    n, rounds = labels.count(), 0
    while True:
        rounds += 1
        la = labels.select(F.col("entity").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("entity").alias("b"), F.col("label").alias("lb"))
        met = sized_join(sized_join(pairs, la, ["a"], rows=n, limit_rows=limit_rows), lb, ["b"], rows=n, limit_rows=limit_rows).filter(F.col("la") != F.col("lb")).withColumn("m", F.least("la", "lb"))
        said = met.select(F.explode(F.array(*[F.struct(F.col(c).alias("entity"), F.col("m").alias("label")) for c in ("a", "b", "la", "lb")])).alias("s")).select("s.*")
        heard = said.groupBy("entity").agg(F.min("label").alias("heard"))
        low = labels.join(heard, "entity", "left").select("entity", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        low = scratch.save(low, f"low{rounds}")
        jump = low.select(F.col("entity").alias("label"), F.col("label").alias("_far"))
        new = sized_join(low, jump, ["label"], rows=n, limit_rows=limit_rows).select("entity", "old", F.least("label", "_far").alias("label"))
        new = scratch.save(new, f"labels{rounds}")
        scratch.drop(f"labels{rounds - 1}", f"low{rounds}")
        labels = new.select("entity", "label")
        if new.filter(F.col("old") != F.col("label")).limit(1).count() == 0:
            scratch.drop("edges")
            return labels


def with_entity(records: DataFrame, member: str, labels: DataFrame, out: str = "entity") -> DataFrame:
    """Adds the entity of ``member``: its label, or itself where no link names it."""
    known = labels.select(F.col("entity").alias(member), F.col("label").alias(out))
    return sized_join(records, known, [member], "left").withColumn(out, F.coalesce(out, member))


def divided(records: DataFrame, entity: str, split: str, by: list[str]) -> DataFrame:
    """(by, entity): entities whose records a manifest puts into more than one split. Null splits and entities do not count."""
    return records.filter(F.col(split).isNotNull() & F.col(entity).isNotNull()).groupBy(*by, entity).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).filter("_a <> _b").drop("_a", "_b")


def split_name(c: Column | str) -> Column:
    """train, val or test from its spellings (training, valid, validation, testing in any case); null for anything else."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t.isin("train", "training"), "train").when(t.isin("val", "valid", "validation"), "val").when(t.isin("test", "testing"), "test")


def _place(rows: pd.DataFrame, names: list[str], shares: np.ndarray) -> pd.DataFrame:
    """Greedy placement of the groups of one batch, the largest first, each where the squared deviation of the label counts grows least."""
    label, l = np.unique(rows["l"].to_numpy(), return_inverse=True)
    group, g = np.unique(rows["g"].to_numpy(), return_inverse=True)
    n = rows["n"].to_numpy("f8")
    total = np.bincount(l, weights=n, minlength=len(label))
    over = np.zeros((len(shares), len(label)))
    over[:, l] = np.stack(rows["over"].to_numpy()).T
    want = (shares[:, None] - over) * total
    unit = np.maximum(shares[:, None] * total, 1e-9)
    size = np.bincount(g, weights=n, minlength=len(group))
    tie = np.zeros(len(group), "i8")
    tie[g] = rows["tie"].to_numpy()
    at = np.argsort(g, kind="stable")
    start = np.searchsorted(g[at], np.arange(len(group) + 1))
    placed, chosen = -want, np.zeros(len(group), int)
    for k in np.lexsort((tie, -size)):
        own = at[start[k] : start[k + 1]]
        m, c = n[own], l[own]
        s = int((m * (2 * placed[:, c] + m) / unit[:, c]).sum(axis=1).argmin())
        placed[s, c] += m
        chosen[k] = s
    return pd.DataFrame({"g": rows["g"], "l": rows["l"], "n": rows["n"], "first": ~rows["g"].duplicated(), "split": np.array(names, dtype=object)[chosen[g]]})


def assign_splits(records: DataFrame, group: str, label: str, shares: dict[str, float], seed: int = 42, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(group, split): every group in one split, so that each split holds its share of the records of every label.

    All groups are placed one by one, where the squared deviation of the label counts from their shares, relative to those
    shares, grows least. They are taken by size, in classes a factor of four wide, largest class first; inside a class a
    seeded hash cuts them into batches of about ``batch_rows`` rows (group, label), placed side by side, each for its part of
    the class's records and of what the classes before have placed too many or too few. So a batch is off by about one of
    its smallest groups, and what it is off is made up for by the next class. Nothing but the classes that occur (32 at
    most) reaches the driver; the labels of one group must fit in a task. Records with a null group are left out, a null label
    is a label of its own, repeated records count each. The same seed gives the same split.
    """
    scratch = Scratch(records.sparkSession)
    names = list(shares)
    own = records.select(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("l")).filter(F.col("g").isNotNull())
    counts = scratch.save(own.groupBy("g", "l").agg(F.count("*").alias("n")), "counts")
    size = counts.groupBy("g").agg(F.floor(F.log2(F.sum("n")) / 2).cast("int").alias("class"))
    sized = scratch.save(counts.join(size, "g").withColumn("tie", F.xxhash64(F.lit(seed), "g")), "sized")
    kind = dict(counts.dtypes)["g"]
    schema = f"g {kind}, l string, n long, first boolean, split string"
    none = F.array(*[F.lit(0.0) for _ in names])
    over: DataFrame | None = None
    done: list[str] = []
    vector = np.array([shares[s] for s in names])
    fn = lambda rows: _place(rows, names, vector)
    for row in sized.groupBy("class").agg(F.count("*").alias("rows")).orderBy(F.desc("class")).collect():
        here = sized.filter(F.col("class") == row["class"])
        batches = max(1, -(-row["rows"] // batch_rows))
        total = here.groupBy("l").agg(F.sum("n").alias("_t"))
        share = total.join(over, "l", "left").select("l", F.coalesce(F.transform("off", lambda x: x / F.col("_t")), none).alias("over")) if over is not None else total.select("l", none.alias("over"))
        ready = sized_join(here, scratch.save(share, f"share{row['class']}"), ["l"]).withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed + 1), "g"), F.lit(batches)))
        name = f"placed{row['class']}"
        got = scratch.save(ready.select("_batch", "g", "l", "n", "tie", "over").groupBy("_batch").applyInPandas(fn, schema), name)
        done.append(name)
        off = got.groupBy("l").agg(F.array(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)) - shares[s] * F.sum("n") for s in names]).alias("_new"))
        over = off.withColumnRenamed("_new", "off") if over is None else over.join(off, "l", "full").select("l", F.when(F.col("off").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("off")).otherwise(F.zip_with("off", "_new", lambda a, b: a + b)).alias("off"))
        over = scratch.save(over, f"over{row['class']}")
    if not done:
        return own.select(F.col("g").alias(group), F.lit(None).cast("string").alias("split")).limit(0)
    return scratch.read(*done, schema=schema).filter("first").select(F.col("g").alias(group), "split")


def balance(records: DataFrame, label: str, split: str) -> DataFrame:
    """(split, label, n, share): records of each label in each split and their share of the label."""
    w = Window.partitionBy(label)
    return records.groupBy(split, label).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(w))
