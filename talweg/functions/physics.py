"""Channel physics as columns: geometry, celerity, Muskingum-Cunge coefficients, leakance, unit conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DT_SECONDS = 3600.0
#: Margin of the stability bounds.
DELTA = 0.01
#: Floors (SI units) and parameter ranges: fixed values.
MINIMUMS = {"discharge": 1e-4, "slope": 1e-3, "velocity": 0.01, "depth": 0.01, "bottom_width": 0.01}
RANGES = {"n": (0.015, 0.25), "q_spatial": (0.0, 1.0), "p_spatial": (1.0, 200.0), "x_storage": (0.0, 0.5), "k_d": (1e-8, 1e-6), "d_gw": (-2.0, 2.0), "leakance_factor": (0.0, 1.0)}
FROZEN = {"n": 0.05, "q_spatial": 0.5, "p_spatial": 21.0}


def denormalize(v: Column, lo: float, hi: float, log_space: bool = False) -> Column:
    """A share in [0, 1] to its physical range, linearly or between logarithms (with 1e-6 under the lower one)."""
    if not log_space:
        return v * (hi - lo) + lo
    low = F.log(F.lit(lo + 1e-6))
    return F.exp(v * (F.log(F.lit(float(hi))) - low) + low)


def normalize(v: Column, lo: float, hi: float, log_space: bool = False) -> Column:
    """The inverse of ``denormalize``."""
    if not log_space:
        return (v - lo) / (hi - lo)
    low = F.log(F.lit(lo + 1e-6))
    return (F.log(v) - low) / (F.log(F.lit(float(hi))) - low)


def with_geometry(df: DataFrame, q: str = "q", n: str = "n", p: str = "p_spatial", qs: str = "q_spatial", slope: str = "slope") -> DataFrame:
    """Adds depth, top_width, side_slope, bottom_width, area, wetted_perimeter, hydraulic_radius and velocity of a trapezoidal section.

    Depth inverts Manning's equation under the power law width = p * depth ** q; the side slope stays in [0.5, 50].
    """
    e = F.col(qs) + 1e-6
    ratio = F.col(q) * F.col(n) * (e + 1) / (F.col(p) * F.sqrt(F.col(slope)) + 1e-8)
    out = df.withColumn("depth", F.greatest(F.pow(ratio, F.lit(3.0) / (e * 3 + 5)), F.lit(MINIMUMS["depth"])))
    out = out.withColumn("top_width", F.col(p) * F.pow("depth", e))
    out = out.withColumn("side_slope", F.greatest(F.lit(0.5), F.least(F.lit(50.0), F.col("top_width") * e / (F.col("depth") * 2))))
    out = out.withColumn("bottom_width", F.greatest(F.col("top_width") - F.col("side_slope") * F.col("depth") * 2, F.lit(MINIMUMS["bottom_width"])))
    out = out.withColumns({
        "area": (F.col("top_width") + F.col("bottom_width")) * F.col("depth") / 2,
        "wetted_perimeter": F.col("bottom_width") + F.col("depth") * F.sqrt(F.col("side_slope") * F.col("side_slope") + 1) * 2,
    })
    out = out.withColumn("hydraulic_radius", F.col("area") / F.col("wetted_perimeter"))
    return out.withColumn("velocity", F.pow("hydraulic_radius", F.lit(2.0 / 3.0)) * F.sqrt(F.col(slope)) / F.col(n))


def with_celerity(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Adds celerity: the clamped velocity times the exact kinematic ratio of the trapezoid, or times 5/3 (legacy)."""
    v = F.greatest(F.lit(MINIMUMS["velocity"]), F.least(F.lit(15.0), F.col("velocity")))
    if legacy:
        return df.withColumn("celerity", v * (5.0 / 3.0))
    root = F.sqrt(F.col("side_slope") * F.col("side_slope") + 1)
    return df.withColumn("celerity", v * (F.lit(5.0 / 3.0) - F.col("area") * root / (F.col("top_width") * F.col("wetted_perimeter")) * (4.0 / 3.0)))


def with_muskingum(df: DataFrame, q: str = "q", slope: str = "slope", length: str = "length_m", dt: float = DT_SECONDS, positive: bool = True, x: float | None = None) -> DataFrame:
    """Adds k, x and the coefficients c1..c4; c1 + c2 + c3 = 1.

    x is ``x`` if given, else Cunge's value in [0, 0.5]. With ``positive``, k gets a floor at half a step and x a cap, so
    that c1 and c3 cannot become negative.
    """
    k = F.col(length) / F.col("celerity")
    out = df.withColumn("k", F.greatest(k, F.lit(dt * (1 + DELTA) / 2)) if positive else k)
    if x is not None:
        out = out.withColumn("x", F.lit(float(x)))
    else:
        w = F.col(q) / (F.col("top_width") * F.col(slope) * F.col("celerity") * F.col(length) + 1e-12)
        cunge = F.greatest(F.lit(0.0), F.least(F.lit(0.5), (1 - w) * 0.5))
        cr = F.lit(dt) / F.col("k")
        out = out.withColumn("x", F.least(cunge, cr * (0.5 * (1 - DELTA)), (1 - cr * 0.5) * (1 - DELTA)) if positive else cunge)
    kx, rest = F.col("k") * 2 * F.col("x"), F.col("k") * 2 * (1 - F.col("x"))
    den = rest + dt
    return out.withColumns({"c1": (dt - kx) / den, "c2": (kx + dt) / den, "c3": (rest - dt) / den, "c4": F.lit(2 * dt) / den})


def leakance(depth: Column, p: Column, qs: Column, length: Column, k_d: Column, d_gw: Column, factor: Column, losing_only: bool = True, mask: Column | None = None) -> Column:
    """Exchange with groundwater in m3/s: factor * (p depth) ** q * length * k_d * head; only losses if ``losing_only``."""
    head = depth - d_gw
    head = F.greatest(head, F.lit(0.0)) if losing_only else head
    z = factor * F.pow(p * depth, qs + 1e-6) * length * k_d * head
    return z if mask is None else z * mask


def impervious_mask(x: Column, threshold: float) -> Column:
    """0 where x is above the threshold, else 1; 1 for null and NaN."""
    return F.when(~F.isnan(x) & (x > threshold), 0.0).otherwise(1.0)


def flow_scale(drain: Column, comid_drain: Column, unit_area: Column) -> Column:
    """The share of a reach's own area that lies above its gauge, 1 wherever that cannot be told."""
    diff = drain - comid_drain
    known = drain.isNotNull() & comid_drain.isNotNull() & unit_area.isNotNull() & ~F.isnan(drain) & ~F.isnan(comid_drain) & ~F.isnan(unit_area)
    return F.when(known & (unit_area > 0) & (diff < 0) & (F.abs(diff) < unit_area), (unit_area - F.abs(diff)) / unit_area).otherwise(1.0)


def mm_per_hour_to_m3s(q: Column, area_km2: Column) -> Column:
    return q * area_km2 / 3.6


def reference_celerity(uparea_km2: Column, slope: Column, coefficient: float = 0.01, exponent: float = 0.9, n: float = 0.05) -> Column:
    """A flood-wave speed in [0.05, 5] m/s from upstream area and slope."""
    s = F.greatest(slope, F.lit(1e-3))
    q = F.lit(coefficient) * F.pow(F.greatest(uparea_km2, F.lit(0.0)), F.lit(exponent))
    r = F.greatest(F.pow(F.greatest(q, F.lit(1e-3)), F.lit(0.4)), F.lit(0.01))
    return F.greatest(F.lit(0.05), F.least(F.lit(5.0), F.lit(1 / n) * F.pow(r, F.lit(2.0 / 3.0)) * F.sqrt(s) * (5.0 / 3.0)))


def scale_by_log2(v: Column, k: Column | float) -> Column:
    return v * F.pow(F.lit(2.0), k if isinstance(k, Column) else F.lit(float(k)))


def log_interp(a: Column, b: Column, t: float) -> Column:
    """Geometric interpolation; exactly a at 0 and b at 1."""
    if t in (0, 1):
        return b if t else a
    return F.exp((1 - t) * F.log(a) + t * F.log(b))


def mean_of_two(a: Column, b: Column, log_space: bool = False) -> Column:
    return F.exp((F.log(a) + F.log(b)) / 2) if log_space else (a + b) / 2
