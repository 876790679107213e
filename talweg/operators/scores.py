"""Scores, losses, summaries and correlations of predicted against observed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.common import safe_div
from talweg.functions.ranks import value_ranks
from talweg.session import Scratch


def finite_pairs(rows: DataFrame, pred: str = "pred", obs: str = "obs") -> DataFrame:
    """Rows whose both sides are finite."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (pred, obs)]
    return rows.filter(ok[0] & ok[1])


def moments(rows: DataFrame, by: list[str], pred: str = "pred", obs: str = "obs") -> DataFrame:
    """(by, n, mp, mo, vp, vo, cov, mse): population moments of finite pairs."""
    p, o = F.col(pred), F.col(obs)
    return finite_pairs(rows, pred, obs).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(o).alias("mo"), F.var_pop(p).alias("vp"), F.var_pop(o).alias("vo"), F.covar_pop(p, o).alias("cov"), F.avg((p - o) * (p - o)).alias("mse")
    )


def nse(eps: float = 0.0) -> Column:
    """1 - mse / var(obs), from ``moments``; null for constant observations."""
    return 1 - safe_div(F.col("mse"), F.col("vo") + eps)


def kge(eps: float = 0.0) -> Column:
    sp, so = F.sqrt("vp"), F.sqrt("vo")
    r = safe_div(F.col("cov"), sp * so)
    a, b = safe_div(sp, so + eps), safe_div(F.col("mp"), F.col("mo") + eps)
    return 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(a - 1, 2) + F.pow(b - 1, 2))


def flow_duration_biases(rows: DataFrame, by: str, pred: str = "pred", obs: str = "obs") -> DataFrame:
    """(by, fhv, flv): percent volume bias of the top 2 % and the bottom 30 % of the two series, each sorted on its own."""
    w = Window.partitionBy(by)
    r = finite_pairs(rows, pred, obs).select(by, F.col(pred).alias("p"), F.col(obs).alias("o"), F.row_number().over(w.orderBy(pred)).alias("rp"), F.row_number().over(w.orderBy(obs)).alias("ro"), F.count("*").over(w).alias("n"))
    low, high = F.round(F.col("n") * F.lit(0.3)), F.round(F.col("n") * F.lit(0.98))
    part = lambda v, k, cond: F.sum(F.when(cond(F.col(k)), F.col(v)))
    top, bottom = (lambda k: k > high), (lambda k: k <= low)
    s = r.groupBy(by).agg(part("p", "rp", top).alias("ph"), part("o", "ro", top).alias("oh"), part("p", "rp", bottom).alias("pl"), part("o", "ro", bottom).alias("ol"))
    bias = lambda p, o: safe_div(100 * (F.col(p) - F.col(o)), F.col(o))
    return s.select(by, bias("ph", "oh").alias("fhv"), bias("pl", "ol").alias("flv"))


def scores(rows: DataFrame, by: str, pred: str = "pred", obs: str = "obs") -> DataFrame:
    """(by, nse, rmse, kge, bias, fhv, flv) of every group in ``rows``; null where a score has no value, a group without a finite pair has only nulls."""
    m = moments(rows, [by], pred, obs).select(by, nse().alias("nse"), F.sqrt("mse").alias("rmse"), kge().alias("kge"), (F.col("mp") - F.col("mo")).alias("bias"))
    return rows.select(by).distinct().join(m, by, "left").join(flow_duration_biases(rows, by, pred, obs), by, "left")


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks for ties, per group."""
    w = Window.partitionBy(*by)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0
    return rows.select(*by, rank(a).alias("_a"), rank(b).alias("_b")).groupBy(*by).agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))


def spearman_of_all(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n) over the whole table, with average ranks for ties: ranks come by ranges of the values, so no task holds all rows. Rows with a null do not count."""
    scratch = Scratch(rows.sparkSession)
    own = scratch.save(rows.select(F.col(a).alias("_va"), F.col(b).alias("_vb")).filter("_va is not null and _vb is not null"), "pairs")
    for c in ("_va", "_vb"):
        r = value_ranks(own.select(c), [], c).select(c, (F.col("before") + (F.col("count") + 1) / 2).alias(f"{c}_rank"))
        own = own.join(r, c)
    return own.agg(F.corr("_va_rank", "_vb_rank").alias("rho"), F.count("*").alias("n"))


def hydrograph_loss(eps: float = 0.1, nnse_weight: float = 1.0, kge_weight: float = 1.0) -> Column:
    """Weighted 1 - NNSE and 1 - KGE of one group, from ``moments``, with ``eps`` in the denominators."""
    sp, so = F.sqrt(F.col("vp") + eps), F.sqrt(F.col("vo") + eps)
    d = F.sqrt(F.pow(F.col("cov") / (sp * so) - 1, 2) + F.pow(sp / so - 1, 2) + F.pow(F.col("mp") / (F.col("mo") + eps) - 1, 2))
    e = F.col("mse") * F.col("n") / (F.col("vo") * F.col("n") + eps)
    return nnse_weight * (1 - 1 / (1 + e)) + kge_weight * d


def component_loss(weights: tuple[float, float, float] = (1.0, 1.0, 1.0), clamp: float = 10.0, eps: float = 0.1) -> Column:
    """Weighted squared deviations of correlation, variance ratio and mean ratio of one group, clamped."""
    sp, so = F.sqrt(F.col("vp") + eps), F.sqrt(F.col("vo") + eps)
    parts = (F.col("cov") / (sp * so), sp / so, F.col("mp") / (F.col("mo") + eps))
    return F.least(sum((w * F.pow(c - 1, 2) for w, c in zip(weights, parts)), F.lit(0.0)), F.lit(float(clamp)))
