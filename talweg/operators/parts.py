"""Routing of basins of any size in sub-basins of bounded size: inflow is made, variants are run and flows are folded in the task that routes a sub-basin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from talweg.functions.recurrence import route
from talweg.functions.tape import Var
from talweg.operators.hierarchy import hierarchy
from talweg.operators.routing import _arrays, bands
from talweg.session import Scratch

#: A sub-basin has at most so many reaches; small ones are routed together, about ``TOGETHER`` reaches at a time.
PART_REACHES = 20_000
TOGETHER = 10_000
OUT = "comid long, to_part long, q array<double>, r array<double>, last double"
#: (reaches, first, end) to lateral inflow, hours by reaches; the reaches are the rows of a sub-basin.
Inflow = Callable[[pa.Table, int, int], np.ndarray]
#: (hydrographs of each variant, hours by reaches; their first hour) to what is kept, values by reaches.
Fold = Callable[[list[np.ndarray], int], np.ndarray]


def rows_of(table: pa.Table, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix, a row each."""
    c = table[name].combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _lists(values: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """The rows wanted as arrays, null the others."""
    offsets = np.concatenate([[0], np.cumsum(np.where(wanted, values.shape[1], 0))]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values[wanted]).ravel()), mask=pa.array(~wanted))


def _spread(df: DataFrame, part: str, groups: int) -> DataFrame:
    """Whole sub-basins together in groups, the groups in a number of tasks that grows with the reaches and not with the bytes, which are few."""
    return df.withColumn("_group", F.pmod(F.xxhash64(part), F.lit(groups))).repartition(min(groups, max(48, groups // 8)), "_group")


def _height(paths: DataFrame, most: int) -> int:
    """The height of a band, halved from the depth of the forest until no sub-basin has more than ``most`` reaches."""
    depth = paths.agg(F.max("hops")).first()[0]
    height = 1 if depth is None else depth + 1
    while height > 1 and bands(paths, height).groupBy("band", "part").count().filter(F.col("count") > most).limit(1).count():
        height = -(-height // 2)
    return height


def edges_of(table: pa.Table | None, ids: pd.Index, variants: int, hours: int) -> np.ndarray:
    """(variants, hours, reaches): what enters from the sub-basins above; ``table`` has the flows of their mouths and the reach each enters."""
    edge = np.zeros((variants, hours, len(ids)))
    if table is not None and len(table):
        np.add.at(edge.transpose(2, 0, 1), ids.get_indexer(table["into"].to_numpy()), rows_of(table, "q").reshape(-1, variants, hours))
    return edge


class Parts:
    """A network cut into bands of sub-basins, as ``routing.bands`` does, of a height at which each sub-basin fits a task; whole basins if they do.

    ``reaches``: comid, parent, length_m, slope and any of n, q_spatial, p_spatial, pieces; arrays n_factors and p_factors that
    scale n and p_spatial variant by variant; a boolean keep: whose flow comes out; and what the inflow is made of. ``paths``:
    their hierarchy with paths, if it is at hand. A loop is an error.
    """

    def __init__(self, reaches: DataFrame, paths: DataFrame | None = None, most: int | None = None, height: int | None = None):
        most = most or PART_REACHES
        self.groups = lambda band: max(1, -(-self.sizes[band] // min(most, TOGETHER)))
        self.spark, self.scratch, self.runs = reaches.sparkSession, Scratch(reaches.sparkSession), 0
        paths = hierarchy(reaches, "comid", "parent", with_paths=True) if paths is None else paths
        if paths.filter("hops < 0").limit(1).count():
            raise ValueError("the network has a loop")
        self.height = _height(paths, most) if height is None else height
        mouth = (F.col("hops") > 0) & (F.col("hops") % self.height == 0)
        to = paths.select(F.col("id").alias("comid"), F.when(mouth, F.get("path", F.lit(self.height))).alias("to_part"))
        drop = [c for c in ("basin", "band", "part", "to_part") if c in reaches.columns]
        self.reaches = self.scratch.save(reaches.drop(*drop).join(bands(paths, self.height), "comid").join(to, "comid"), "reaches")
        self.sizes = {r["band"]: r["count"] for r in self.reaches.groupBy("band").count().collect()}
        names = ("n_factors", "p_factors")
        self.variants = max([1, *(self.reaches.agg(F.max(F.size(c))).first()[0] or 1 for c in names if c in reaches.columns)])

    def keep(self, outlets: DataFrame) -> Parts:
        """Only the flow of these reaches (comid) comes out."""
        wanted = outlets.select("comid").distinct().withColumn("keep", F.lit(True))
        self.reaches = self.scratch.save(self.reaches.drop("keep").join(wanted, "comid", "left").fillna({"keep": False}), "marked")
        return self

    def _band(self, band: int, more: DataFrame | None, how: str = "inner") -> GroupedData:
        here = self.reaches.filter(F.col("band") == band)
        here = here if more is None else here.join(more, "comid", how)
        return _spread(here, "part", self.groups(band)).groupBy("_group")

    def _entering(self, band: int, above: str) -> GroupedData:
        """(comid, into, q) of the mouths in the band above, by the groups of the reaches they enter."""
        flow = self.scratch.read(above, schema=OUT).filter("to_part is not null").select("comid", "to_part", F.coalesce("q", "r").alias("q"))
        into = self.reaches.filter((F.col("band") == band + 1) & F.col("to_part").isNotNull()).select("comid", F.col("parent").alias("into"))
        return _spread(flow.join(into, "comid"), "to_part", self.groups(band)).groupBy("_group")

    def route(self, inflow: Inflow, first: int, end: int, fold: Fold | None = None, state: DataFrame | None = None, keep_state: bool = False, **options) -> tuple[DataFrame, DataFrame]:
        """(comid, r) and (comid, last): the hydrographs of the hours from ``first`` on and before ``end`` of the reaches to keep, or what ``fold`` makes of them, and the last flow of all (if ``keep_state``).

        ``state`` (comid and any of last and what the inflow is made of): last is the flow of the hour before ``first``, and then the
        inflow of that hour is asked for as well. Bands are routed from the headwaters down; of a band only
        the hydrographs at the mouths of its sub-basins go on. Variants stand behind one another.
        """
        if keep_state and self.variants > 1:
            raise ValueError("the state of one variant only")
        count, names = self.variants, []
        goes_on = state is not None and "last" in state.columns
        begin = first - 1 if goes_on else first
        self.runs += 1

        def run(key, own: pa.Table, above: pa.Table | None = None) -> pa.Table:
            if not len(own):
                return pa.table({"comid": pa.array([], "i8"), "to_part": pa.array([], "i8"), "q": pa.array([], pa.list_(pa.float64())), "r": pa.array([], pa.list_(pa.float64())), "last": pa.array([], "f8")})
            own = own.sort_by("comid")
            flat = own.select([c for c, t in zip(own.column_names, own.schema.types) if not pa.types.is_nested(t)]).to_pandas()
            ids, net, a = _arrays(flat)
            lateral = np.nan_to_num(inflow(own, begin, end))
            edge = edges_of(above, ids, count, end - begin)
            scale = {p: rows_of(own, c) for c, p in (("n_factors", "n"), ("p_factors", "p_spatial")) if c in own.column_names}
            start = flat["last"].to_numpy("f8") if goes_on else None
            qs = []
            for k in range(count):
                params = a["params"] | {p: a["params"][p] * f[:, k] for p, f in scale.items()}
                qs.append(np.stack([x.value for x in route(net, lateral, params, a["length"], a["slope"], start=start, pieces=a["pieces"], boundary=edge[k], **options)]))
            new = [q[first - begin :] for q in qs]
            r = (np.concatenate(new) if fold is None else fold(new, first)).T
            kept = flat["keep"].to_numpy(bool) if "keep" in flat else np.ones(len(ids), bool)
            mouth = flat["to_part"].notna().to_numpy()
            again = mouth & ~kept if fold is None and begin == first else mouth
            last = pa.array(qs[0][-1] if keep_state else np.zeros(len(ids)), mask=np.full(len(ids), not keep_state))
            return pa.table({"comid": own["comid"], "to_part": own["to_part"], "q": _lists(np.concatenate(qs).T, again), "r": _lists(r, kept), "last": last})

        for b in sorted(self.sizes, reverse=True):
            here = self._band(b, state)
            if names:
                got = here.cogroup(self._entering(b, names[-1])).applyInArrow(run, OUT)
            else:
                got = here.applyInArrow(lambda key, own: run(key, own), OUT)
            self.scratch.save(got, f"run{self.runs}band{b}")
            names.append(f"run{self.runs}band{b}")
        every = self.scratch.read(*names, schema=OUT) if names else self.spark.createDataFrame([], OUT)
        return every.filter("r is not null").select("comid", "r"), every.select("comid", "last")

    def chunks(self, inflow: Inflow, steps: int, chunk: int, fold: Fold | None = None, **options) -> list[tuple[int, DataFrame]]:
        """The first hour of each chunk of hours and (comid, r) of it; the state at the end of a chunk starts the next, so a run of years needs the memory of a chunk."""
        out, state = [], None
        for first in range(0, steps, chunk):
            r, state = self.route(inflow, first, min(first + chunk, steps), fold, state, True, **options)
            out.append((first, r))
        return out

    def roughness_gradient(self, inflow: Inflow, hours: int) -> DataFrame:
        """(comid, gradient): how the mean outflow of each basin from hour 1 on answers to the roughness of each reach, by the reverse mode.

        Flows are routed once from the headwaters down; then each sub-basin is routed again with its tape, from the outlets up, and
        what its outflow answers to the flows that enter it is the weight of these flows in the sub-basins above.
        """
        self.reaches = self.reaches.withColumn("keep", F.lit(False))
        self.route(inflow, 0, hours)
        runs, weights, names = self.runs, None, []

        def run(key, own: pa.Table, above: pa.Table | None = None) -> pa.Table:
            if not len(own):
                return pa.table({"comid": pa.array([], "i8"), "gradient": pa.array([], "f8"), "weight": pa.array([], pa.list_(pa.float64()))})
            own = own.sort_by("comid")
            flat = own.select([c for c, t in zip(own.column_names, own.schema.types) if not pa.types.is_nested(t)]).to_pandas()
            ids, net, a = _arrays(flat)
            edge = [Var(x) for x in edges_of(above, ids, 1, hours)[0]]
            rough = Var(a["params"]["n"])
            qs = route(net, np.nan_to_num(inflow(own, 0, hours)), a["params"] | {"n": rough}, a["length"], a["slope"], pieces=a["pieces"], boundary=edge)
            mouth = flat["to_part"].notna().to_numpy()
            weight = np.zeros((hours, len(ids)))
            weight[1:, (net.parent < 0) & ~mouth] = 1.0 / (hours - 1)
            if "weight" in own.column_names:
                weight[:, mouth] = rows_of(own.filter(pa.array(mouth)), "weight").T
            total = Var(0.0)
            for q, w in zip(qs[1:], weight[1:]):
                total = total + (q * w).sum()
            total.backward()
            entering = np.stack([np.zeros(len(ids)) if e.grad is None else e.grad for e in edge])
            n = 0 if above is None else len(above)
            at = ids.get_indexer(above["into"].to_numpy()) if n else np.zeros(0, int)
            none = np.zeros((len(ids), hours))
            return pa.table({
                "comid": pa.array(np.concatenate([ids.to_numpy(), above["comid"].to_numpy() if n else np.zeros(0, "i8")]).astype("i8")),
                "gradient": pa.array(np.concatenate([rough.grad, np.zeros(n)]), mask=np.arange(len(ids) + n) >= len(ids)),
                "weight": _lists(np.concatenate([none, entering.T[at]]), np.arange(len(ids) + n) >= len(ids)),
            })

        kind = "comid long, gradient double, weight array<double>"
        for b in sorted(self.sizes):
            here = self._band(b, weights, "left")
            if b + 1 in self.sizes:
                got = here.cogroup(self._entering(b, f"run{runs}band{b + 1}")).applyInArrow(run, kind)
            else:
                got = here.applyInArrow(lambda key, own: run(key, own), kind)
            names.append(f"gradient{b}")
            weights = self.scratch.save(got, names[-1]).filter("weight is not null").select("comid", "weight")
        every = self.scratch.read(*names, schema=kind) if names else self.spark.createDataFrame([], kind)
        return every.filter("gradient is not null").select("comid", "gradient")


def by_hour(flow: DataFrame, *keep: str) -> DataFrame:
    """(comid, t, q) of hydrographs from hour 0 on."""
    return flow.select("comid", *keep, F.posexplode("r").alias("t", "q"))


def same_series(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(n, differ): values of the arrays r of either table, and those that only one has or that differ."""
    j = a.select(*keys, F.col("r").alias("_x")).join(b.select(*keys, F.col("r").alias("_y")), keys, "full")
    none = F.array().cast("array<double>")
    ok = lambda x, y: F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1e-12)), F.lit(False))
    both = F.zip_with(F.coalesce("_x", none), F.coalesce("_y", none), ok)
    return j.agg(F.coalesce(F.sum(F.size(both)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size(F.filter(both, lambda x: ~x))), F.lit(0)).alias("differ"))
