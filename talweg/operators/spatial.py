"""Points near other points, and the region that contains a point."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.session import Scratch

EARTH_RADIUS_M = 6371008.8
#: More points than this in a slab, or in a cube, are spread over several tasks.
GROUP_ROWS = 50_000
HOT_CELL_ROWS = 2_000
#: Edge of the cubes in radii: larger cubes repeat fewer points, smaller ones compare fewer pairs.
CUBE_RADII = 2
#: Boundaries kept inside a slab; they are vertex abscissae.
MAX_SLABS = 512


def usable_positions(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Rows with a usable position as ``_lat``, ``_lng``: latitude in [-90, 90], longitude in [-180, 360) (above 180 minus 360), not both 0, no null or NaN."""
    a, o = F.col(lat).cast("double"), F.col(lng).cast("double")
    ok = (a >= -90) & (a <= 90) & (o >= -180) & (o < 360) & ~((a == 0) & (o == 0))
    return df.filter(ok).withColumns({"_lat": a, "_lng": F.when(o > 180, o - 360).otherwise(o)})


def great_circle_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance on a sphere of radius 6371008.8 m."""
    p, q = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def near(points: DataFrame, id_col: str, lat: str, lng: str, radius_m: float, hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """(id_a, id_b, distance_m) for every two usable points with id_a < id_b at most ``radius_m`` apart.

    Points fall into cubes of the unit sphere whose edge is ``CUBE_RADII`` chords of the radius, so there is no seam at the poles or
    at 180 degrees. Each point also goes into those of the 13 forward neighbour cubes that its own circle can reach, which
    finds each pair of cubes once. Cubes with more than ``hot_rows`` points are split on one side and repeated on the
    other. Repeated rows (same id and position) count once, rows without an id are left out, an id never pairs with itself.
    """
    chord = 2 * math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2)
    width = max(chord * (1 + 1e-9) * CUBE_RADII, 2.0**-20)
    far = (chord / width) ** 2
    span = 1 << 21
    la, lo = F.radians("_lat"), F.radians("_lng")
    xyz = {"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)}
    pts = usable_positions(points.select(F.col(id_col).alias("_id"), F.col(lat).alias("_a"), F.col(lng).alias("_o")), "_a", "_o")
    pts = pts.filter(F.col("_id").isNotNull()).select("_id", "_lat", "_lng").dropDuplicates().withColumns(xyz)
    scaled = {f"_s{k}": (F.col(f"_{k}") + 1) / width for k in "xyz"}
    pts = pts.withColumns(scaled).withColumns({f"_i{k}": F.floor(f"_s{k}") for k in "xyz"})
    key = lambda dx, dy, dz: ((F.col("_ix") + dx) * span + F.col("_iy") + dy) * span + F.col("_iz") + dz
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]

    def gap(axis: str, d: int) -> Column:
        frac = F.col(f"_s{axis}") - F.col(f"_i{axis}")
        return F.lit(0.0) if d == 0 else (1 - frac if d > 0 else frac)

    reach = [F.when(F.pow(gap("x", a), 2) + F.pow(gap("y", b), 2) + F.pow(gap("z", c), 2) <= far * (1 + 1e-6), key(a, b, c)) for a, b, c in offsets]
    own = pts.select(key(0, 0, 0).alias("_cell"), F.col("_id").alias("_ia"), F.col("_lat").alias("_la"), F.col("_lng").alias("_oa"))
    there = pts.select(F.explode(F.filter(F.array(key(0, 0, 0), *reach), lambda c: c.isNotNull())).alias("_cell"), key(0, 0, 0).alias("_home"), F.col("_id").alias("_ib"), F.col("_lat").alias("_lb"), F.col("_lng").alias("_ob"))
    hot = own.groupBy("_cell").count().filter(F.col("count") > hot_rows).select("_cell", F.ceil(F.col("count") / hot_rows).cast("int").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    own = own.join(hot, "_cell", "left").withColumn("_salt", F.pmod(F.xxhash64("_ia", "_la", "_oa"), n)).drop("_n")
    there = there.join(hot, "_cell", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")))).drop("_n")
    d = great_circle_m(F.col("_la"), F.col("_oa"), F.col("_lb"), F.col("_ob"))
    once = (F.col("_home") != F.col("_cell")) & (F.col("_ia") != F.col("_ib")) | (F.col("_ia") < F.col("_ib"))
    rough = F.abs(F.col("_la") - F.col("_lb")) <= math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    pairs = own.join(there, ["_cell", "_salt"]).filter(once & rough).withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)
    return pairs.select(F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b"), "distance_m")


def wkb_rings(blob: bytes) -> list[np.ndarray]:
    """The rings of a WKB polygon or multipolygon, either byte order, with or without a GeoPackage header; [] for anything else."""
    at = 0
    try:
        if blob[:2] == b"GP":
            at = 8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
        rings: list[np.ndarray] = []

        def polygon(at: int) -> int:
            order = "<" if blob[at] == 1 else ">"
            kind, n = struct.unpack_from(order + "II", blob, at + 1)
            dims = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3) + bool(kind & 0x80000000) + bool(kind & 0x40000000)
            at += 9
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", blob, at)
                rings.append(np.frombuffer(blob, order + "f8", m * dims, at + 4).reshape(m, dims)[:, :2].astype("f8"))
                at += 4 + 8 * m * dims
            return at

        order = "<" if blob[at] == 1 else ">"
        kind, n = struct.unpack_from(order + "II", blob, at + 1)
        if kind & 0x20000000:
            blob = blob[: at + 5] + blob[at + 9 :]
            kind, n = struct.unpack_from(order + "II", blob, at + 1)
        base = (kind & 0xFFFF) % 1000
        if base == 3:
            polygon(at)
        elif base == 6:
            at += 9
            for _ in range(n):
                at = polygon(at)
        return [r for r in rings if len(r) >= 3 and np.isfinite(r).all()]
    except (struct.error, ValueError, IndexError, TypeError):
        return []


def trapezoids(regions: list[list[np.ndarray]], low: float = -math.inf, high: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Trapezoidal decomposition of regions, given by their rings, under the even-odd rule: trapezoids and the index of the region of each; only what lies between ``low`` and ``high``.

    A trapezoid is x_left, x_right, lower edge, upper edge, an edge x1, y1, x2, y2 with x1 < x2. The slabs of a region are
    those between its neighbouring vertex abscissae; inside one its edges are ordered and pair up.
    """
    rings = [(k, r) for k, rs in enumerate(regions) for r in rs]
    if not rings:
        return np.empty((0, 10)), np.empty(0, int)
    start = np.vstack([r for _, r in rings])
    end = np.vstack([x for _, r in rings for x in (r[1:], r[:1])])
    of = np.repeat([k for k, _ in rings], [len(r) for _, r in rings])
    slanted = (start[:, 0] != end[:, 0]) & (np.maximum(start[:, 0], end[:, 0]) > low) & (np.minimum(start[:, 0], end[:, 0]) < high)
    start, end, of = start[slanted], end[slanted], of[slanted]
    e = np.where((start[:, 0] < end[:, 0])[:, None], np.hstack([start, end]), np.hstack([end, start]))
    if not len(e):
        return np.empty((0, 10)), np.empty(0, int)
    x, region = np.clip(np.concatenate([e[:, 0], e[:, 2]]), low, high), np.concatenate([of, of])
    o = np.lexsort((x, region))
    fresh = np.r_[True, (x[o][1:] != x[o][:-1]) | (region[o][1:] != region[o][:-1])]
    at = np.empty(len(o), int)
    at[o] = np.cumsum(fresh) - 1
    xs, first, last = x[o][fresh], at[: len(e)], at[len(e) :]
    count = last - first
    which = np.repeat(np.arange(len(e)), count)
    slab = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    s, mid = e[which], (xs[slab] + xs[slab + 1]) / 2
    y = s[:, 1] + (mid - s[:, 0]) * (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
    o = np.lexsort((y, slab))
    under, over, slab = which[o][0::2], which[o][1::2], slab[o][0::2]
    return np.hstack([xs[slab][:, None], xs[slab + 1][:, None], e[under], e[over]]), of[under]


def locate(xs: np.ndarray, ys: np.ndarray, traps: np.ndarray, max_slabs: int = MAX_SLABS) -> tuple[np.ndarray, np.ndarray]:
    """(point index, trapezoid index) of every trapezoid that contains a point.

    The trapezoids are cut at slab boundaries and ordered inside each slab by the lowest point of their lower edge; a
    binary search per point finds the last that can start below it, and a running maximum of the upper edges tells how far
    down others can still reach it. Where regions do not overlap that is one or two trapezoids.
    """
    none = np.empty(0, int), np.empty(0, int)
    if not len(traps) or not len(xs):
        return none
    bounds = np.unique(traps[:, :2])
    if len(bounds) > max_slabs + 1:
        bounds = bounds[np.unique(np.linspace(0, len(bounds) - 1, max_slabs + 1).astype(int))]
    first = np.clip(np.searchsorted(bounds, traps[:, 0], "right") - 1, 0, len(bounds) - 2)
    last = np.clip(np.searchsorted(bounds, traps[:, 1], "left") - 1, first, len(bounds) - 2)
    count = last - first + 1
    of = np.repeat(np.arange(len(traps)), count)
    slab = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    left, right = np.maximum(bounds[slab], traps[of, 0]), np.minimum(bounds[slab + 1], traps[of, 1])

    def height(edge: np.ndarray, x: np.ndarray) -> np.ndarray:
        return edge[:, 1] + (x - edge[:, 0]) * (edge[:, 3] - edge[:, 1]) / (edge[:, 2] - edge[:, 0])

    low, high = traps[of, 2:6], traps[of, 6:10]
    pad = 1e-9
    lowest = np.minimum(height(low, left), height(low, right)) - pad
    highest = np.maximum(height(high, left), height(high, right)) + pad
    o = np.lexsort((lowest, slab))
    of, slab, lowest, highest = of[o], slab[o], lowest[o], highest[o]
    start = np.searchsorted(slab, np.arange(len(bounds)))
    reach = highest.copy()
    # a running maximum inside each slab: lift the slabs apart, accumulate, lower them again
    lift = slab * (highest.max() - min(highest.min(), lowest.min()) + 1)
    reach = np.maximum.accumulate(reach + lift) - lift + pad
    inside = np.flatnonzero((xs >= bounds[0]) & (xs <= bounds[-1]))
    at = np.clip(np.searchsorted(bounds, xs[inside], "right") - 1, 0, len(bounds) - 2)
    lo, hi, y = start[at].copy(), start[at + 1].copy(), ys[inside]
    while (go := lo < hi).any():
        m = (lo + hi) // 2
        up = go & (lowest[np.minimum(m, len(lowest) - 1)] <= y)
        lo, hi = np.where(up, m + 1, lo), np.where(go & ~up, m, hi)
    k, begin, p = lo - 1, start[at], inside
    found_p, found_t = [], []
    while len(k):
        keep = k >= begin
        keep[keep] = reach[k[keep]] >= ys[p[keep]]
        k, begin, p = k[keep], begin[keep], p[keep]
        t = of[k]
        x, yy = xs[p], ys[p]
        hit = (traps[t, 0] <= x) & (x < traps[t, 1]) & (height(traps[t, 2:6], x) <= yy) & (yy < height(traps[t, 6:10], x))
        found_p.append(p[hit])
        found_t.append(t[hit])
        k = k - 1
    return (np.concatenate(found_p), np.concatenate(found_t)) if found_p else none


_CUT = "slab int, region_id long, n int, traps binary"
#: Slabs begin at multiples of 1 / CELLS degrees, so there are 92,161 at most.
CELLS = 256
#: A slab that has more trapezoids than so many times ``group_rows`` is split by region.
TRAPS_PER_ROW = 8
#: A region with more vertices is cut in strips of a quarter as many, so that a task never holds all of its trapezoids.
LARGE_VERTICES = 20_000


def slabs_of(cells: list[tuple[int, int]], rows: int) -> list[tuple[int, int, int]]:
    """(cell, slab, parts) of every cell that has points: neighbouring cells make a slab of up to ``rows`` points, a fuller cell is one by itself, in parts."""
    out: list[tuple[int, int, int]] = []
    slab, held = -1, rows
    for cell, n in sorted(cells):
        if held + n > rows:
            slab, held = slab + 1, 0
        held += n
        out.append((cell, slab, -(-n // rows)))
    return out


def _locate_slab(points: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
    if not len(points) or not len(regions):
        return pd.DataFrame({"id": [], "region_id": []}).astype("int64")
    traps = np.frombuffer(b"".join(map(bytes, regions["traps"])), "f8").reshape(-1, 10)
    owner = np.repeat(regions["region_id"].to_numpy(), regions["n"])
    p, t = locate(points["x"].to_numpy(), points["y"].to_numpy(), traps)
    return pd.DataFrame({"id": points["id"].to_numpy()[p], "region_id": owner[t]}).drop_duplicates()


def within(points: DataFrame, id_col: str, lat: str, lng: str, regions: DataFrame, region_col: str, geom_col: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, region_id): the regions that contain each usable point; holes do not belong to a region.

    Regions are WKB polygons or multipolygons in longitude, latitude; one of more than ``LARGE_VERTICES`` vertices is cut into
    trapezoids strip by strip. Longitude is cut into slabs of up to ``group_rows``
    points. Every region is parsed and cut into trapezoids once; its trapezoids, cut at the slab boundaries, go to the slabs
    they lie in, and so does each point to its one slab, where its trapezoids are found by binary search (``locate``). A slab
    that is too full is split: its points where a narrow slab still has more than ``group_rows``, its trapezoids by region. The
    counts that make the slabs are of 92,161 cells at most, whatever the size of the data.

    Repeated regions count once, null, empty or unreadable geometries and null ids are left out; points on an edge belong
    to the region above it or to its right, so regions that share an edge never both contain a point.
    """
    spark = points.sparkSession
    pts = usable_positions(points.select(F.col(id_col).cast("long").alias("id"), F.col(lat).alias("_a"), F.col(lng).alias("_o")), "_a", "_o")
    pts = pts.filter(F.col("id").isNotNull()).select("id", F.col("_lng").alias("x"), F.col("_lat").alias("y")).dropDuplicates().withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    cells = [(r["cell"], r["count"]) for r in pts.groupBy("cell").count().collect()]
    if not cells:
        return pts.select("id", F.lit(None).cast("long").alias("region_id"))
    whole = sum(n for _, n in cells)
    listed = slabs_of(cells, max(1, min(group_rows, max(2000, whole // (2 * spark.sparkContext.defaultParallelism)))))
    first: dict[int, int] = {}
    parts: dict[int, int] = {}
    for cell, slab, n in listed:
        first.setdefault(slab, cell)
        parts[slab] = max(n, parts.get(slab, 1))
    starts = np.array(list(first.values())) / CELLS
    starts[0] = -np.inf
    ends = np.r_[starts[1:], np.inf]

    def strips(ids: np.ndarray, rings: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Trapezoids of regions that are cut together, and then of each large one a strip at a time: an edge of a long coast crosses very many of its slabs."""
        large = [sum(map(len, r)) > LARGE_VERTICES for r in rings]
        yield (ids, *trapezoids([[] if big else r for big, r in zip(large, rings)]))
        for k in np.flatnonzero(large):
            x = np.unique(np.concatenate([r[:, 0] for r in rings[k]]))
            cuts = [-math.inf, *x[LARGE_VERTICES // 4 :: max(1, LARGE_VERTICES // 4)], math.inf]
            for low, high in zip(cuts[:-1], cuts[1:]):
                yield (ids[k : k + 1], *trapezoids([rings[k]], low, high))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = ((ids, traps, of) for rows in batches for ids, traps, of in strips(rows["region_id"].to_numpy(), [wkb_rings(bytes(g)) for g in rows["geom"]]))
        for ids, traps, of in whole:
            a = np.searchsorted(starts, traps[:, 0], "right") - 1
            count = np.searchsorted(starts, traps[:, 1], "left") - a
            t = np.repeat(np.arange(len(traps)), count)
            slab = np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            o = np.lexsort((slab, of[t]))
            t, slab = t[o], slab[o]
            piece = traps[t]
            piece[:, 0], piece[:, 1] = np.maximum(piece[:, 0], starts[slab]), np.minimum(piece[:, 1], ends[slab])
            at = np.flatnonzero(np.r_[True, (of[t][1:] != of[t][:-1]) | (slab[1:] != slab[:-1])]) if len(t) else np.empty(0, int)
            n = np.diff(np.r_[at, len(t)])
            raw, size = piece.tobytes(), 80
            packed = [raw[i * size : (i + k) * size] for i, k in zip(at.tolist(), n.tolist())]
            yield pd.DataFrame({"slab": slab[at], "region_id": ids[of[t][at]], "n": n, "traps": packed})

    reg = regions.select(F.col(region_col).cast("long").alias("region_id"), F.col(geom_col).alias("geom")).filter("region_id is not null and geom is not null").dropDuplicates()
    pieces = Scratch(spark).save(reg.mapInPandas(cut, _CUT), "pieces")
    many = {r["slab"]: -(-r["n"] // (group_rows * TRAPS_PER_ROW)) for r in pieces.groupBy("slab").agg(F.sum("n").alias("n")).collect()}
    of_slab = F.broadcast(spark.createDataFrame([(s, p, many[s]) for s, p in parts.items() if s in many], "slab int, np int, nr int"))
    of_cell = F.broadcast(spark.createDataFrame([(c, s) for c, s, _ in listed], "cell int, slab int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = pts.join(of_cell, "cell").join(of_slab, "slab").select("slab", "id", "x", "y", F.pmod(F.xxhash64("id"), F.col("np")).cast("int").alias("sp"), each("nr").alias("sr"))
    b = pieces.join(of_slab, "slab").select("slab", "region_id", "n", "traps", F.pmod(F.xxhash64("region_id"), F.col("nr")).cast("int").alias("sr"), each("np").alias("sp"))
    fn = lambda left, right: _locate_slab(left, right)
    return a.groupBy("slab", "sp", "sr").cogroup(b.groupBy("slab", "sp", "sr")).applyInPandas(fn, "id long, region_id long").distinct()
