"""Implausible spikes, stuck values and impossible readings, per source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.common import sized_join
from talweg.session import Scratch

#: Fixed values of the flags.
IMPOSSIBLE, SPIKE, STUCK, MEAN_OFF = "impossible", "spike", "stuck", "mean_off"
#: The standard score that 99 % of normal values stay under in size.
NORMAL_99 = 2.5758
#: Days of a source that one filter goes through, and those it goes through before, to find the level.
SEGMENT, WARM_UP = 64, 2
#: Width of the bins of hourly changes, in their logarithm, the size under which all changes are one, and the mark of the rows with sums.
_BIN, _LEAST, _MOMENTS = 0.02, 0.005, -99_999
#: Rows that a task takes at a time, and bins it counts in before it hands them on.
_ROWS, _KEYS = 40_000, 1_000_000



def _longest_run(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The longest run of one possible value in each row: hours in which the innovation variance of a holding level is zero."""
    best = np.zeros(len(x), int)
    run = np.zeros(len(x), int)
    for t in range(x.shape[1]):
        same = ok[:, t] & ok[:, t - 1] & (x[:, t] == x[:, t - 1]) if t else np.zeros(len(x), bool)
        run = np.where(same, run + 1, ok[:, t].astype(int))
        best = np.maximum(best, run)
    return best


class LocalLevel:
    """Local-level Kalman filters, one per row, all rows at once: a level that wanders and is read with noise.

    ``gain`` and ``deviation`` are the steady state's: the forecast variance is deviation ** 2, of which the noise of a reading
    is the share 1 - gain, and the level wanders by gain ** 2 of it an hour. An innovation of more than ``threshold`` of its
    standard deviations is withheld from the level, and the hour widens no forecast. After ``longest`` withheld hours in a row
    on one side the level has moved and the filter starts again from the reading: of those hours only what stands out from
    the new level as well, still on that side, was an excursion.
    """

    def __init__(self, gain: np.ndarray, deviation: np.ndarray, threshold: float, longest: int):
        self.noise, self.wander = (1 - gain) * deviation**2, (gain * deviation) ** 2
        self.deviation, self.threshold, self.longest = deviation, threshold, longest

    def run(self, y: np.ndarray, rows: np.ndarray, level: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hours of ``rows`` from their levels on: the sign of every withheld innovation of an excursion, the size of what each innovation adds to the one before, the levels and variances at the end.

        NaN hours are passed over. The first reading of a day that the forecast does not hold opens a level of its own.
        """
        n, hours = y.shape
        sign, news = np.zeros((n, hours), "i1"), np.full((n, hours), np.nan)
        noise, wander, scale = self.noise[rows], self.wander[rows], self.deviation[rows]
        level, variance = level.copy(), variance.copy()
        run, since, side, begun = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool)
        kept = np.full(n, np.nan)  # (1 - gain) times the last innovation: what the next one will repeat of it
        hour = np.arange(hours)[None, :]
        for t in range(hours):
            v = y[:, t]
            seen = ~np.isnan(v)
            new = seen & np.isnan(level)
            ahead = variance + wander
            spread = ahead + noise
            limit = self.threshold * np.sqrt(spread)
            innovation = np.where(new, 0.0, v - level)
            out = seen & (np.abs(innovation) > limit)
            way = np.sign(np.nan_to_num(innovation)).astype(int)
            run = np.where(out & (way != side), 0, run)
            moved = out & ((run >= self.longest) | ~begun)
            held = out & ~moved
            news[:, t] = (innovation - kept) / scale
            sign[:, t] = np.where(held, np.sign(innovation), 0)
            void = np.flatnonzero(moved & (run > 0))
            if len(void):
                part = (hour >= since[void][:, None]) & ((y[void] - v[void][:, None]) * way[void][:, None] <= limit[void][:, None])
                sign[void] = np.where(part, 0, sign[void])
            since = np.where(held & (run == 0), t, since)
            gain = np.where(new | moved, 1.0, np.where(held | ~seen, 0.0, ahead / spread))
            level = np.where(new | moved, v, np.where(gain > 0, level + gain * innovation, level))
            variance = np.where(new | moved, noise, np.where(held, variance, (1 - gain) * ahead))
            run = np.where(held, run + 1, np.where(seen, 0, run))
            side = np.where(held, way, np.where(seen, 0, side))
            kept = np.where(seen, (1 - gain) * innovation, kept)
            begun |= seen
        return sign, news, level, variance


def _stands_out(y: np.ndarray, out: np.ndarray, limit: np.ndarray, longest: int) -> np.ndarray:
    """The exact check of the hours ``out`` that the filters withheld: rows in which up to ``longest`` hours, one of them withheld, lie beyond both the reading before and the reading after them by more than ``limit``."""
    found = np.zeros(len(y), bool)
    rows = np.flatnonzero(out.any(axis=1))
    x, held, most = y[rows], out[rows], limit[rows]
    for w in range(1, longest + 1):
        for i in range(1, y.shape[1] - w):
            a, b, part = x[:, i - 1], x[:, i + w], x[:, i : i + w]
            beyond = np.maximum(part.min(axis=1) - np.maximum(a, b), np.minimum(a, b) - part.max(axis=1))
            found[rows] |= held[:, i : i + w].any(axis=1) & (beyond > most)
    return found


def _quiet(news: np.ndarray, hours: int) -> np.ndarray:
    """Rows in which the variance of the innovations vanishes: nothing new in ``hours`` - 1 of them in a row."""
    run, best = np.zeros(len(news), int), np.zeros(len(news), int)
    for t in range(news.shape[1]):
        run = np.where(np.abs(news[:, t]) < 1e-6, run + 1, 0)
        best = np.maximum(best, run)
    return best >= hours - 1


class _Days:
    """The filters of sources over their days in order, fed in batches; what a batch cuts off goes on in the next."""

    def __init__(self, threshold: float, longest: int):
        self.threshold, self.longest = threshold, longest
        self.key: tuple | None = None
        #: Level, variance and day before the day at hand, of which more rows may follow, and those at its end.
        self.opened: tuple[float, float, float] = (np.nan,) * 3
        self.closed: tuple[float, float, float] = (np.nan,) * 3

    def judge(self, source: np.ndarray, segment: np.ndarray, day: np.ndarray, y: np.ndarray, gain: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(excursions, what is new in each innovation) of rows in the order of source, segment, day.

        Rows of one day start from the same level, that at the end of the day before; the last of them hands on. Excursions are
        the hours that both the filter forwards and one backwards from the end of the day withhold, with one sign.
        """
        n = len(y)
        change = np.r_[True, (source[1:] != source[:-1]) | (segment[1:] != segment[:-1])]
        seq = np.cumsum(change) - 1
        fresh = change | np.r_[True, day[1:] != day[:-1]]
        starts = np.flatnonzero(change)
        number = np.cumsum(fresh)
        rank = number - number[starts][seq]
        filters = LocalLevel(gain, deviation, self.threshold, self.longest)
        level, variance, at = np.full(len(starts), np.nan), np.zeros(len(starts)), np.full(len(starts), np.nan)
        if (source[0], segment[0]) == self.key:
            level[0], variance[0], at[0] = self.opened if day[0] == self.closed[2] else self.closed
        sign, news = np.zeros(y.shape, "i1"), np.full(y.shape, np.nan)
        begin = np.full((3, len(starts)), np.nan)
        for r in range(int(rank.max(initial=-1)) + 1):
            rows = np.flatnonzero(rank == r)
            s = seq[rows]
            gap = np.nan_to_num(day[rows] - at[s] - 1, nan=0.0)
            end = np.r_[s[1:] != s[:-1], True]
            begin[:, s] = level[s], variance[s], at[s]
            sign[rows], news[rows], m, p = filters.run(y[rows], rows, level[s], variance[s] + filters.wander[rows] * 24 * np.maximum(gap, 0))
            level[s[end]], variance[s[end]], at[s[end]] = m[end], p[end], day[rows][end]
        self.key, self.opened, self.closed = (source[-1], segment[-1]), tuple(begin[:, -1]), (level[-1], variance[-1], at[-1])
        back = filters.run(y[:, ::-1], np.arange(n), np.full(n, np.nan), np.zeros(n))[0][:, ::-1]
        return (sign != 0) & (sign == back), news


def _matrix(series: pd.Series) -> np.ndarray:
    """Hour arrays of any length as one matrix, NaN behind short ones."""
    if not len(series):
        return np.empty((0, 0))
    arrays = [np.empty(0) if a is None else np.asarray(a, "f8") for a in series]
    width = max(map(len, arrays))
    if all(len(a) == width for a in arrays):
        return np.stack(arrays) if width else np.empty((len(arrays), 0))
    out = np.full((len(arrays), width), np.nan)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Several batches as one, as each call of NumPy costs about the same for few rows."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if len(b):
            held.append(b)
        if sum(map(len, held)) >= _ROWS:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def source_norms(rows: DataFrame, ceiling: float, stuck_hours: int) -> tuple[DataFrame, DataFrame]:
    """Per source what is normal: (level offset and share of days with a long repeat), (usual innovation, gain, changes seen).

    All of it by aggregates that combine map-side, so a source with a third of the rows needs no task of its own.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["hours"])
            ok = np.isfinite(x) & (x >= 0) & (x < ceiling)
            run = _longest_run(x, ok)
            y = np.sort(np.where(ok, x, np.inf), axis=1)
            k = ok.sum(axis=1)
            med = np.full(len(b), np.nan)
            some = k > 0
            r = np.flatnonzero(some)
            med[some] = (y[r, (k[r] - 1) // 2] + y[r, k[r] // 2]) / 2
            yield pd.DataFrame({"source": b["source"], "med": med, "long": (run >= stuck_hours).astype("f8")})

    daily = rows.select("source", "hours").filter(F.col("source").isNotNull()).mapInPandas(features, "source string, med double, long double")
    med = F.when(~F.isnan("med"), F.col("med"))
    levels = daily.groupBy("source").agg(F.percentile_approx(med, [0.5, 0.9], 1000).alias("q"), F.avg("long").alias("long_share"))
    offset = F.greatest(F.col("q")[0] * 0.02, F.col("q")[1] * 0.05, F.lit(1e-4))
    levels = Scratch(rows.sparkSession).save(levels.select("source", F.coalesce(offset, F.lit(1e-4)).alias("offset"), "long_share"), "levels")

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        keys, counts, sums = np.empty(0, "i8"), np.empty(0, "i8"), np.empty((3, 0))

        def told() -> Iterator[pd.DataFrame]:
            names = np.array(list(known), dtype=object)
            yield pd.DataFrame({"source": names[keys // 100_000], "bin": keys % 100_000 - 50_000, "n": counts, "var": 0.0, "cov": 0.0})
            yield pd.DataFrame({"source": names, "bin": _MOMENTS, "n": sums[0].astype("i8"), "var": sums[1], "cov": sums[2]})

        for b in _gathered(batches):
            x = _matrix(b["hours"])
            ok = np.isfinite(x) & (x >= 0) & (x < ceiling)
            with np.errstate(invalid="ignore", divide="ignore"):
                step = np.diff(np.log(np.where(ok, x, np.nan) + b["offset"].to_numpy("f8")[:, None]), axis=1)
            one, two = step[:, :-1], step[:, 1:]
            both = (np.abs(one) < 0.5) & (np.abs(two) < 0.5)
            names, code = np.unique(b["source"].to_numpy(), return_inverse=True)
            code = np.array([known.setdefault(x, len(known)) for x in names], "i8")[code]
            row, col = np.nonzero(~np.isnan(two))
            bins = np.floor(np.log(np.maximum(np.abs(two[row, col]), _LEAST)) / _BIN).astype("i8")
            new, n = np.unique(code[row] * 100_000 + (bins + 50_000), return_counts=True)
            keys, at = np.unique(np.r_[keys, new], return_inverse=True)
            counts = np.bincount(at, weights=np.r_[counts, n], minlength=len(keys)).astype("i8")
            part = np.stack([np.bincount(code, weights=np.where(both, y, 0.0).sum(axis=1), minlength=len(known)) for y in (both, one * one, one * two)])
            part[:, : sums.shape[1]] += sums
            sums = part
            if len(keys) > _KEYS:
                yield from told()
                known.clear()
                keys, counts, sums = np.empty(0, "i8"), np.empty(0, "i8"), np.empty((3, 0))
        yield from told()

    own = sized_join(rows.filter((F.size("hours") >= 3) & F.col("source").isNotNull()).select("source", "hours"), levels, ["source"])
    parts = own.mapInPandas(changes, "source string, bin long, n long, var double, cov double").groupBy("source", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "var", "cov")])
    is_bin = F.col("bin") != _MOMENTS
    each = parts.groupBy("source").agg(
        F.array_sort(F.collect_list(F.when(is_bin, F.struct("bin", "n")))).alias("bins"), F.coalesce(F.sum(F.when(is_bin, F.col("n"))), F.lit(0)).alias("changes"),
        *[F.sum(F.when(~is_bin, F.col(c))).alias(c) for c in ("n", "var", "cov")],
    )
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("at"))
    reached = F.aggregate("bins", start, lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.coalesce(s["at"], F.when(s["upto"] + x["n"] >= F.col("changes") * 0.99, x["bin"])).alias("at")))
    var, cov = F.coalesce(F.col("var") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("cov") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    each = each.select("source", "changes", F.exp((reached["at"] + 0.5) * _BIN).alias("usual"), F.greatest(-cov, F.lit(0.0)).alias("r"), var.alias("v"))
    q = F.greatest(F.col("v") - 2 * F.col("r"), F.lit(1e-8))
    p = (q + F.sqrt(q * q + 4 * q * F.col("r"))) / 2  # steady-state forecast variance of the local-level model
    return levels, each.select("source", "usual", "changes", (p / (p + F.col("r"))).alias("gain"))


def implausible(rows: DataFrame, source: str, row_id: str, hours: str, daily: str | None = None, day: str | None = None, ceiling: float = 400_000.0, threshold: float = 4.12,
                spike_hours: int = 3, stuck_hours: int = 10, normal_repeat_share: float = 0.15, mean_off: float = 0.01, min_changes: int = 48) -> DataFrame:
    """(row_id, flags): the rows with a reading that is implausible for their source, and why.

    * spike - one to ``spike_hours`` hours inside the day whose standardised innovations are above ``threshold`` in a local-level
      Kalman filter of their source, withheld from its level, and likewise in one run backwards from the end of the day, with
      the same sign: they leave both the level before and the level after them. On steep floods the level lags, so the readings
      themselves are checked against those before and after them (``_stands_out``). The series is the logarithm of the reading
      plus an offset of 2 % of the source's median level (5 % of its 90th percentile at least), which keeps dry spells quiet.
      The gain follows from the variance and the lag-one covariance of the source's hourly changes; their 99th percentile,
      taken for that of a normal distribution, gives the deviation of its forecasts, so floods and releases that a source is
      used to are no news. Sources with under ``min_changes`` changes have no normal.
    * stuck - the variance of what is new in the innovations vanishes for ``stuck_hours`` hours, at a source where that happens
      on no more than ``normal_repeat_share`` of the days; that they are one value is checked.
    * impossible - by rule, no filter: an hour that is not finite, negative, or at or above ``ceiling`` (400,000 m3/s: no river
      reaches it; the usual placeholders are above it or negative). A null hour is impossible too. The filter passes them over.
    * mean_off - by rule: ``daily`` is not null and ``mean_off`` or more away from the mean of the possible hours of its row; with
      no possible hour there is nothing to compare.

    The filter of a source goes on from day to day (``day``: a number of days, or a date; missing days widen its forecast). Sources are
    cut into segments of ``SEGMENT`` days; each begins with the last ``WARM_UP`` days of the one before, so a source with a third
    of all rows is filtered by many tasks. Rows of one day start from the same level and each is judged: every repeated row
    comes out. Rows without a day, or all if none is named, are filtered on their own. Rows with a null or empty array count
    for nothing; rows with a null source have no norms and only get impossible and mean_off. No rows in, no rows out.
    """
    dated = day and dict(rows.dtypes)[day] in ("date", "timestamp", "timestamp_ntz")
    when = F.lit(None).cast("long") if not day else F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") if dated else F.col(day).cast("long")
    base = rows.select(F.col(row_id).alias("row_id"), F.col(source).cast("string").alias("source"), F.col(hours).alias("hours"), (F.col(daily) if daily else F.lit(None)).cast("double").alias("daily"), when.alias("day"))
    levels, steps = source_norms(base, ceiling, stuck_hours)
    norms = Scratch(rows.sparkSession).save(levels.join(steps, "source", "left"), "norms")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        days = _Days(threshold, spike_hours)
        for b in _gathered(batches):
            x = _matrix(b["hours"])
            length = np.array([0 if a is None else len(a) for a in b["hours"]])
            there = np.arange(x.shape[1])[None, :] < length[:, None]
            ok = np.isfinite(x) & (x >= 0) & (x < ceiling)
            impossible = (there & ~ok).any(axis=1)
            known = (b["changes"].fillna(0) >= min_changes).to_numpy()
            with np.errstate(invalid="ignore", divide="ignore"):
                logs = np.log(np.where(ok, x, np.nan) + b["offset"].to_numpy("f8")[:, None])
                deviation = np.where(known, (b["usual"].to_numpy("f8") + 0.01) / NORMAL_99, 1e9)
                out, news = days.judge(b["source"].to_numpy(), b["segment"].to_numpy(), b["day"].to_numpy(), logs, np.where(known, b["gain"].to_numpy("f8"), 1.0), deviation)
                spike = known & _stands_out(logs, out, threshold * deviation, spike_hours)
                stuck = known & _quiet(news, stuck_hours) & (b["long_share"].fillna(1) <= normal_repeat_share).to_numpy()
                stuck[stuck] = _longest_run(x[stuck], ok[stuck]) >= stuck_hours
                k = ok.sum(axis=1)
                mean = np.where(ok, x, 0).sum(axis=1) / np.where(k > 0, k, 1)
                said = b["daily"].to_numpy("f8")
                given = b["daily"].notna().to_numpy() | b["is_nan"].to_numpy()
                off = given & (k > 0) & ~(np.abs(said - mean) < mean_off * np.abs(mean)) & ~(said == mean)
            flags = np.stack([impossible, spike, stuck, off], axis=1)
            hit = flags.any(axis=1) & ~b["warm"].to_numpy()
            names = np.array([IMPOSSIBLE, SPIKE, STUCK, MEAN_OFF])
            yield pd.DataFrame({"row_id": b["row_id"].to_numpy()[hit], "flags": np.array([",".join(names[f]) for f in flags[hit]], dtype=object)})

    kind = dict(base.dtypes)["row_id"]
    joined = sized_join(base.withColumn("is_nan", F.coalesce(F.isnan("daily"), F.lit(False))), norms, ["source"], "left")
    ordered = F.col("day").isNotNull() & F.col("source").isNotNull()
    segment = F.floor(F.col("day") / SEGMENT)
    again = F.when(ordered & (F.pmod("day", F.lit(SEGMENT)) >= SEGMENT - WARM_UP), F.array(F.struct(segment.alias("segment"), F.lit(False).alias("warm")), F.struct((segment + 1).alias("segment"), F.lit(True).alias("warm"))))
    alone = F.array(F.struct(F.when(ordered, segment).otherwise(F.xxhash64("row_id")).alias("segment"), F.lit(False).alias("warm")))
    placed = joined.withColumn("_s", F.explode(F.coalesce(again, alone))).withColumns({"segment": F.col("_s.segment"), "warm": F.col("_s.warm"), "day": F.coalesce("day", F.lit(0))}).drop("_s")
    placed = placed.repartition("source", "segment").sortWithinPartitions("source", "segment", "day", "row_id")
    return placed.mapInPandas(judge, f"row_id {kind}, flags string")
