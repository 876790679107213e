"""Parent-child links to full hierarchies by leaf peeling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.session import Scratch

#: A remainder of at most so many nodes (about 100 bytes each and 30 for every sum) is peeled in one task.
FINISH_NODES = 1 << 16
#: Paths leave that task in pieces of about so many ids.
PIECE_IDS = 1 << 20


@dataclass(frozen=True)
class _Carried:
    """What is sent up while peeling, besides the number of children: heights and sums, each sum with a coefficient or 1."""

    paths: bool = False
    heights: bool = False
    sums: tuple[str, ...] = ()
    scaled: frozenset[str] = field(default_factory=frozenset)

    @property
    def up(self) -> bool:
        return self.heights or bool(self.sums)

    def schema(self) -> str:
        """Of what is known of a node in the end."""
        cols = ["id long", "root long", "hops long"] + ["path array<long>"] * self.paths + ["height long"] * self.heights
        for s in self.sums:
            cols.append(f"`{s}` double")
            if s in self.scaled:
                cols += [f"`{s}_gain` double", f"`c_{s}` double"]
        return ", ".join(cols)


def _levels(par: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The leaves of each round of peeling, and what cannot be peeled: nodes on loops."""
    n = len(par)
    kids = np.bincount(par[par >= 0], minlength=n)
    order: list[np.ndarray] = []
    left = np.ones(n, bool)
    leaves = np.flatnonzero(kids == 0)
    while len(leaves):
        order.append(leaves)
        left[leaves] = False
        ps = par[leaves]
        ps = ps[ps >= 0]
        np.subtract.at(kids, ps, 1)
        ps = np.unique(ps)
        leaves = ps[(kids[ps] == 0) & left[ps]]
    return order, left


def _paths(ids: np.ndarray, par: np.ndarray, hops: np.ndarray, via: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Nodes and their paths, in pieces. One buffer holds the path at hand: the walk is in preorder, so that of the parent is its tail."""
    good = np.flatnonzero(hops >= 0)
    width = int(hops[good].max(initial=-1)) + 1
    buffer = np.empty(width, "i8")
    child = good[par[good] >= 0]
    child = child[np.argsort(par[child], kind="stable")]
    start = np.searchsorted(par[child], np.arange(len(ids) + 1))
    stack = list(good[par[good] < 0])
    nodes: list[int] = []
    out: list[np.ndarray] = []
    held = 0
    while stack:
        v = stack.pop()
        stack.extend(child[start[v] : start[v + 1]])
        at = width - int(hops[v]) - 1
        own = via.iat[v]
        buffer[at] = ids[v]
        buffer[at + 1 : at + 1 + len(own)] = own
        nodes.append(v)
        out.append(buffer[at:].copy())
        held += width - at
        if held > PIECE_IDS:
            yield nodes, out
            nodes, out, held = [], [], 0
    yield nodes, out


def _peel_rest(batches: Iterator[pd.DataFrame], carried: _Carried) -> Iterator[pd.DataFrame]:
    """Leaf peeling of a remainder that fits one task; what cannot be peeled is on a loop."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    ids, n = rows["id"].to_numpy(), len(rows)
    at = pd.Series(np.arange(n), index=ids)
    up = rows["parent"]
    par = np.where(up.isna(), -1, at.reindex(up.fillna(-1).astype("int64")).fillna(-1)).astype("int64")
    w, low = rows["w"].to_numpy(), rows["low"].to_numpy()
    order, left = _levels(par)
    root, hops = ids.copy(), np.zeros(n, "int64")
    for v in np.flatnonzero(left):
        if hops[v] == -1:
            continue
        ring, u = [], v
        while hops[u] != -1:
            ring.append(u)
            hops[u] = -1
            u = par[u]
        root[ring] = min(int(low[ring].min()), int(ids[ring].min()))
    out = pd.DataFrame({"id": ids})
    if carried.heights:
        h, side = rows["h"].to_numpy().copy(), rows["lh"].to_numpy()
        for leaves in order:
            a = leaves[par[leaves] >= 0]
            np.maximum.at(h, par[a], np.maximum(h[a] + w[a], side[a]))
        out["height"] = h
    for s in carried.sums:
        total, add = rows[f"b_{s}"].to_numpy("f8").copy(), rows[f"lb_{s}"].to_numpy("f8")
        scaled = s in carried.scaled
        c, la = (rows[f"c_{s}"].to_numpy("f8"), rows[f"la_{s}"].to_numpy("f8")) if scaled else (np.ones(n), np.ones(n))
        for leaves in order:
            a = leaves[par[leaves] >= 0]
            np.add.at(total, par[a], c[par[a]] * (la[a] * total[a] + add[a]))
        out[s] = total
        if scaled:
            gain = np.ones(n)
            for leaves in reversed(order):
                a = leaves[par[leaves] >= 0]
                gain[a] = la[a] * c[par[a]] * gain[par[a]]
            out[f"{s}_gain"], out[f"c_{s}"] = gain, c
    for leaves in reversed(order):
        a = leaves[par[leaves] >= 0]
        b = par[a]
        root[a] = root[b]
        hops[a] = np.where(hops[b] < 0, -1, hops[b] + w[a])
    out.insert(1, "root", root)
    out.insert(2, "hops", hops)
    if not carried.paths:
        yield out
        return
    for nodes, paths in _paths(ids, par, hops, rows["via"]):
        piece = out.iloc[nodes].copy()
        piece.insert(3, "path", pd.Series(paths, index=piece.index, dtype=object))
        yield piece
    looped = out[hops < 0].copy()
    looped.insert(3, "path", None)
    yield looped


def hierarchy(links: DataFrame, id_col: str, parent_col: str, with_paths: bool = False, finish_nodes: int = FINISH_NODES, sizes: bool = False,
              sums: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """(id, root, hops) of every node: the last node of its path and the steps to it; and, as asked for, ``path``, the path itself,
    ``size``, the nodes above it and itself, ``height``, the steps to the farthest of them, and sums over them.

    ``sums`` names a value and a coefficient column of ``links`` (None for 1): the sum of a node is its own value plus its
    coefficient times the sums of its children; ``<name>_gain`` is the product of the coefficients below a node, the weight
    that its value has at the root. A null value counts 0, a null coefficient 1.

    Nodes on a loop or above one get the smallest id of that loop as root, hops -1 and null for all else. A null parent, or one
    that is no node, ends the path. Of several parents (and values) of one id the smallest counts; repeated rows do nothing;
    rows without an id are left out; an empty table gives an empty one. Ids are long.

    Bottom-up peeling in rounds. A round takes every leaf off, which sends its subtree's size, height and sums to its parent.
    As a tree may be thousands of nodes deep, it also lifts an independent set of nodes with a single child out of their
    chains: node v goes if its coin of this round shows heads and its parent's shows tails, so no two neighbours go at once;
    the child takes over v's parent, the length of both links and what v would have added on the way. The coins come from
    the ids, so a rerun of a lost task tosses the same. Every round removes all leaves and a quarter of the chain nodes,
    hence rounds grow with log(nodes), not with depth. Loops shrink to a node that is its own parent. What the rounds took
    off is then answered in reverse order, from the parent and the child it had when it went.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    wanted = dict(sums or {})
    named = list(wanted)
    got = _Carried(with_paths, sizes, (*(["size"] if sizes else []), *named), frozenset(s for s, (_, c) in wanted.items() if c))
    values = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"b_{s}") for s, (v, _) in wanted.items()]
    values += [F.coalesce(F.col(c).cast("double"), F.lit(1.0)).alias(f"c_{s}") for s, (_, c) in wanted.items() if c]
    given = [f"b_{s}" for s in named] + [f"c_{s}" for s in named if s in got.scaled]
    raw = links.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"), *values).filter(F.col("id").isNotNull())
    nodes = raw.groupBy("id").agg(F.min("parent").alias("parent"), *[F.min(c).alias(c) for c in given])
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k"))
    start = {"w": F.lit(1).cast("long"), "low": F.col("id"), "k": F.coalesce("k", F.lit(0)).cast("long")}
    if with_paths:
        start["via"] = F.array().cast("array<bigint>")
    if got.heights:
        start |= {"h": F.lit(0).cast("long"), "lh": F.lit(0).cast("long"), "b_size": F.lit(1.0)}
    for s in got.sums:
        start |= {f"lb_{s}": F.lit(0.0)} | ({f"la_{s}": F.lit(1.0)} if s in got.scaled else {})
    left = nodes.join(known, "parent", "left").join(kids, "id", "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known").withColumns(start)
    left = scratch.save(left.select("id", "parent", *given, *start), "left0")
    last, count, rounds = "left0", left.count(), 0
    while count > finish_nodes:
        rounds += 1
        linked, lifted = _round(left, rounds, got)
        if got.up:
            scratch.save(lifted, f"lifted{rounds}")
        linked = scratch.save(linked, f"round{rounds}")
        if rounds == 1:
            scratch.drop(last)
        left = linked.filter("kind = 'kept'").drop("kind")
        count = left.count()
    scratch.save(left.coalesce(1).mapInPandas(lambda rows: _peel_rest(rows, got), got.schema()), "done_rest")
    done = ["done_rest"]
    for r in range(rounds, 0, -1):
        own = scratch.read(f"round{r}").filter("kind <> 'kept'")
        scratch.save(_answer(own, scratch.read(*done, schema=got.schema()), scratch.read(f"lifted{r}") if got.up else None, got), f"done{r}")
        scratch.drop(f"round{r}", *([f"lifted{r}"] if got.up else []))
        done.append(f"done{r}")
    out = scratch.read(*done, schema=got.schema())
    fine = lambda c: F.when(F.col("hops") >= 0, F.col(c))
    extra = [fine("size").cast("long").alias("size"), fine("height").alias("height")] if sizes else []
    for s in named:
        extra += [fine(s).alias(s)] + ([fine(f"{s}_gain").alias(f"{s}_gain")] if s in got.scaled else [])
    return out.select("id", "root", "hops", *(["path"] if with_paths else []), *extra)


def _round(left: DataFrame, number: int, got: _Carried) -> tuple[DataFrame, DataFrame]:
    """One round: all nodes with what becomes of them, and of the lifted ones the child from which they will learn their sums."""
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(number)), F.lit(2))
    alone = (F.col("parent") == F.col("id")) & (F.col("k") == 1)
    chained = (F.col("k") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("id")) & (coin("id") == 1) & (coin("parent") == 0)
    seen = left.withColumn("kind", F.when(F.col("k") == 0, "leaf").when(alone, "loop").when(chained, "lifted").otherwise("kept"))
    carried = [c for c in left.columns if c not in ("id", "parent", "k")]
    gone = seen.filter("kind = 'lifted'").select(F.col("id").alias("parent"), F.col("parent").alias("_parent"), *[F.col(c).alias(f"_{c}") for c in carried])
    met = seen.join(gone, "parent", "left")
    hit = F.col("_w").isNotNull()
    c = lambda name, scaled: F.col(name) if scaled else F.lit(1.0)
    new: dict[str, Column] = {"parent": F.col("_parent"), "w": F.col("w") + F.col("_w"), "low": F.least("low", "_low")}
    if got.paths:
        new["via"] = F.concat("via", F.array("parent"), "_via")
    if got.heights:
        new["lh"] = F.greatest(F.col("lh") + F.col("_w"), F.col("_h") + F.col("_w"), F.col("_lh"))
    for s in got.sums:
        k = s in got.scaled
        new[f"lb_{s}"] = c(f"_la_{s}", k) * (F.col(f"_b_{s}") + c(f"_c_{s}", k) * F.col(f"lb_{s}")) + F.col(f"_lb_{s}")
        if k:
            new[f"la_{s}"] = F.col(f"_la_{s}") * F.col(f"_c_{s}") * F.col(f"la_{s}")
    moved = met.select(*[F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in seen.columns])
    said = [F.count("*").alias("_n")]
    if got.heights:
        said.append(F.max(F.greatest(F.col("h") + F.col("w"), F.col("lh"))).alias("_sh"))
    said += [F.sum(c(f"la_{s}", s in got.scaled) * F.col(f"b_{s}") + F.col(f"lb_{s}")).alias(f"_s_{s}") for s in got.sums]
    heard = moved.filter("kind = 'leaf' and parent is not null").groupBy(F.col("parent").alias("id")).agg(*said)
    sums = {"k": F.col("k") - F.coalesce("_n", F.lit(0))}
    if got.heights:
        sums["h"] = F.greatest("h", "_sh")
    sums |= {f"b_{s}": F.col(f"b_{s}") + c(f"c_{s}", s in got.scaled) * F.coalesce(f"_s_{s}", F.lit(0.0)) for s in got.sums}
    linked = moved.join(heard, "id", "left").select(*[sums.get(x, F.col(x)).alias(x) for x in seen.columns])
    child = [F.col("parent").alias("id"), F.col("id").alias("child")]
    if got.heights:
        child += [F.col("w").alias("cw"), F.col("lh").alias("clh"), F.col("_h").alias("h")]
    for s in got.sums:
        child += [F.col(f"lb_{s}").alias(f"clb_{s}"), F.col(f"_b_{s}").alias(f"b_{s}")]
        child += [F.col(f"la_{s}").alias(f"cla_{s}"), F.col(f"_c_{s}").alias(f"c_{s}")] if s in got.scaled else []
    return linked, met.filter(hit).select(*child)


def _answer(own: DataFrame, done: DataFrame, lifted: DataFrame | None, got: _Carried) -> DataFrame:
    """What is known of the nodes that one round took off, from what is known of their parents and children."""
    below = ["root", "hops"] + ["path"] * got.paths + [x for s in got.sums if s in got.scaled for x in (f"{s}_gain", f"c_{s}")]
    parents = done.select(F.col("id").alias("parent"), *[F.col(x).alias(f"_{x}") for x in below])
    loop, ends = F.col("kind") == "loop", F.col("parent").isNull()
    met = own.join(parents, "parent", "left")
    out = {
        "root": F.when(ends, F.col("id")).when(loop, F.least("low", "id")).otherwise(F.col("_root")),
        "hops": F.when(ends, F.lit(0)).when(loop | (F.col("_hops") < 0), F.lit(-1)).otherwise(F.col("_hops") + F.col("w")).cast("long"),
    }
    if got.paths:
        out["path"] = F.when(ends, F.array("id")).when(~loop & (F.col("_hops") >= 0), F.concat(F.array("id"), "via", "_path"))
    for s in got.scaled:
        out |= {f"{s}_gain": F.when(ends, F.lit(1.0)).otherwise(F.col(f"la_{s}") * F.col(f"_c_{s}") * F.col(f"_{s}_gain")), f"c_{s}": F.col(f"c_{s}")}
    if not got.up:
        return met.select("id", *[x.alias(k) for k, x in out.items()])
    totals = ["height"] * got.heights + list(got.sums)
    rename = lambda df: df.select("id", *([F.col("h").alias("height")] if got.heights else []), *[F.col(f"b_{s}").alias(s) for s in got.sums])
    leaves = rename(own.filter("kind <> 'lifted'"))
    children = done.select("id", *totals).unionByName(leaves).select(F.col("id").alias("child"), *[F.col(x).alias(f"_{x}") for x in totals])
    above = [F.greatest("h", F.col("_height") + F.col("cw"), "clh").alias("height")] if got.heights else []
    for s in got.sums:
        a, c = (F.col(f"cla_{s}"), F.col(f"c_{s}")) if s in got.scaled else (F.lit(1.0), F.lit(1.0))
        above.append((F.col(f"b_{s}") + c * (a * F.col(f"_{s}") + F.col(f"clb_{s}"))).alias(s))
    up = leaves.unionByName(lifted.join(children, "child").select("id", *above))
    order = [x.split()[0].strip("`") for x in got.schema().split(", ")]
    return met.select("id", *[x.alias(k) for k, x in out.items()]).join(up, "id").select(*order)


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, id, hops) for every node and each node above it, from ``hierarchy(..., with_paths=True)``; loops have none."""
    return paths.filter(F.col("path").isNotNull()).select(F.posexplode("path").alias("hops", "ancestor"), "id").filter(F.col("hops") > 0).select("ancestor", "id", "hops")
