"""Influence operators over a panel (iso3, period, indicators, composite).

Ranks and windows break ties by name. Standard deviations named ``std`` are sample ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.session import ship_package

from .network import _checkpointed

#: Weights of the five dimensions; reliability 1 loses nothing, each tenth less costs half a point.
DIMENSION_WEIGHTS = {"d1": 0.15, "d2": 0.25, "d3": 0.20, "d4": 0.25, "d5": 0.15}


def _series(key: str = "iso3", t: str = "period") -> Window:
    return Window.partitionBy(key).orderBy(t)


def dedupe_panel(panel: DataFrame, order: str) -> DataFrame:
    """The row with the highest ``order`` per country and period."""
    rest = [c for c in panel.columns if c not in ("iso3", "period")]
    return panel.groupBy("iso3", "period").agg(F.max_by(F.struct(*rest), order).alias("r")).select("iso3", "period", "r.*")


def impute(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values from the country's median, else the period's, else the overall one.

    All three come from the original data. The medians are small tables: one row
    per country, per period, and one.
    """
    by_country = panel.groupBy("iso3").agg(*(F.median(c).alias(f"{c}_c") for c in columns))
    by_period = panel.groupBy("period").agg(*(F.median(c).alias(f"{c}_p") for c in columns))
    overall = panel.agg(*(F.median(c).alias(f"{c}_a") for c in columns))
    joined = panel.join(by_country, "iso3").join(by_period, "period").crossJoin(F.broadcast(overall))
    filled = {c: F.coalesce(c, f"{c}_c", f"{c}_p", f"{c}_a") for c in columns}
    return joined.select(*(filled.get(c, F.col(c)).alias(c) for c in panel.columns))


def robust_scale(panel: DataFrame, columns: list[str]) -> DataFrame:
    """log1p, then centred by the median and divided by the interquartile range (1 where that is 0)."""
    logged = panel.select(*(F.log1p(c).alias(c) if c in columns else F.col(c) for c in panel.columns))
    quartiles = logged.agg(*(F.percentile(c, [0.25, 0.5, 0.75]).alias(f"{c}_q") for c in columns))

    def scaled(c: str) -> Column:
        q = F.col(f"{c}_q")
        spread = q[2] - q[0]
        return ((F.col(c) - q[1]) / F.when(spread == 0, 1.0).otherwise(spread)).alias(c)

    return logged.crossJoin(F.broadcast(quartiles)).select(
        *(scaled(c) if c in columns else F.col(c) for c in panel.columns)
    )


def gaps(panel: DataFrame) -> DataFrame:
    """Countries with missing periods between their first and last."""
    span = panel.groupBy("iso3").agg(
        (F.max("period") - F.min("period") + 1).alias("expected"), F.count_distinct("period").alias("present")
    )
    return span.withColumn("missing", F.col("expected") - F.col("present"))


def composite(scores: DataFrame, weights: dict[str, float] = DIMENSION_WEIGHTS, reliability: float = 0.75) -> DataFrame:
    """Weighted mean of the dimensions present, and the same less (1 - reliability) * 5."""
    total = reduce(
        lambda a, b: a + b, (F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in weights.items())
    )
    present = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()))
    raw = F.when(present > 0, total / present)
    return scores.withColumn("composite_raw", raw).withColumn(
        "composite_adjusted", F.col("composite_raw") - (1 - reliability) * 5
    )


def lag_features(panel: DataFrame, value: str) -> DataFrame:
    """Lags 1 and 2, the next value, differences over 1 and 3 rows, rolling mean and deviation of 3 rows.

    Rolling values need two rows at least.
    """
    w = _series()
    three = w.rowsBetween(-2, 0)
    enough = F.count(value).over(three) >= 2
    return panel.select(
        "iso3",
        "period",
        F.col(value),
        F.lag(value, 1).over(w).alias("lag1"),
        F.lag(value, 2).over(w).alias("lag2"),
        F.lead(value, 1).over(w).alias("target"),
        (F.col(value) - F.lag(value, 1).over(w)).alias("delta1"),
        (F.col(value) - F.lag(value, 3).over(w)).alias("delta3"),
        F.when(enough, F.avg(value).over(three)).alias("rolling_mean"),
        F.when(enough, F.stddev_samp(value).over(three)).alias("rolling_std"),
    )


def momentum(panel: DataFrame, value: str) -> DataFrame:
    """Mean of the last five values less that of the five before (of the first five below ten); from 8 values on."""
    up = F.row_number().over(Window.partitionBy("iso3").orderBy("period"))
    down = F.row_number().over(Window.partitionBy("iso3").orderBy(F.desc("period")))
    n = F.count("*").over(Window.partitionBy("iso3"))
    known = panel.where(F.col(value).isNotNull()).withColumns({"up": up, "down": down, "n": n})
    before = F.when(F.col("n") >= 10, F.col("down").between(6, 10)).otherwise(F.col("up") <= 5)
    return known.groupBy("iso3").agg(
        F.when(
            F.max("n") >= 8,
            F.avg(F.when(F.col("down") <= 5, F.col(value))) - F.avg(F.when(before, F.col(value))),
        ).alias("momentum"),
        F.max("n").alias("n"),
    )


def ranks(panel: DataFrame, value: str) -> DataFrame:
    """Per period: rank with equal ranks for ties, and position with ties by name; nulls are left out."""
    order = Window.partitionBy("period").orderBy(F.desc(value))
    named = Window.partitionBy("period").orderBy(F.desc(value), "iso3")
    return panel.where(F.col(value).isNotNull()).select(
        "iso3", "period", F.rank().over(order).alias("rank"), F.row_number().over(named).alias("position")
    )


def latest(panel: DataFrame) -> DataFrame:
    """Last known value of every indicator per country, column by column."""
    values = [c for c in panel.columns if c not in ("iso3", "period")]
    return panel.groupBy("iso3").agg(
        F.max("period").alias("period"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period"))).alias(c) for c in values),
    )


def autocorrelation(panel: DataFrame, value: str) -> DataFrame:
    """Lag-1 autocorrelation per country, from five values on."""
    pairs = panel.where(F.col(value).isNotNull()).withColumn("before", F.lag(value).over(_series()))
    r = pairs.groupBy("iso3").agg(F.corr(value, "before").alias("lag1"), F.count("*").alias("n")).where("n >= 5")
    return r.select("iso3", "lag1", (F.col("lag1") > 0.3).alias("high"))


def static_columns(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Mean within-country deviation of each indicator, and if it hardly moves."""
    within = panel.groupBy("iso3").agg(*(F.stddev_samp(c).alias(c) for c in columns))
    mean = within.unpivot(["iso3"], columns, "indicator", "std").groupBy("indicator").agg(F.avg("std").alias("mean_std"))
    return mean.withColumn("static", F.coalesce(F.col("mean_std") < 0.001, F.lit(True)))


def nearest_deltas(panel: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """Change between the known values nearest to two periods; earlier periods win ties."""

    def near(period: int) -> Column:
        return F.min_by(F.struct("period", value), F.struct(F.abs(F.col("period") - period), "period"))

    known = panel.where(F.col(value).isNotNull())
    at = known.groupBy("iso3").agg(near(first).alias("a"), near(last).alias("b"))
    return at.select(
        "iso3",
        F.col("a.period").alias("from_period"),
        F.col("b.period").alias("to_period"),
        (F.col(f"b.{value}") - F.col(f"a.{value}")).alias("delta"),
    )


def trend_features(panel: DataFrame, value: str) -> DataFrame:
    """Slope, relative growth and R2 per country, from four values on."""
    fit = panel.where(F.col(value).isNotNull()).groupBy("iso3").agg(
        F.regr_slope(value, "period").alias("slope"),
        F.regr_r2(value, "period").alias("r2"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.count("*").alias("n"),
    )
    return fit.where("n >= 4").withColumn("growth", F.col("slope") / (F.col("mean") + 1e-6))


def volatility_tier(std: Column) -> Column:
    return F.when(std >= 2.5, "High").when(std >= 1.25, "Medium").otherwise("Low")


def regimes(panel: DataFrame, value: str) -> DataFrame:
    """Slope, R2, volatility (population deviation of residuals) and regime, from five values on.

    Rising or declining needs a slope beyond 0.4 and an R2 above 0.25.
    """
    fit = panel.where(F.col(value).isNotNull()).groupBy("iso3").agg(
        F.regr_slope(value, "period").alias("slope"),
        F.regr_r2(value, "period").alias("r2"),
        F.sqrt(
            F.greatest(F.lit(0.0), F.regr_syy(value, "period") * (1 - F.regr_r2(value, "period")) / F.count("*"))
        ).alias("volatility"),
        F.count("*").alias("n"),
    )
    clear = F.col("r2") > 0.25
    label = (
        F.when((F.col("slope") > 0.4) & clear, "rising").when((F.col("slope") < -0.4) & clear, "declining").otherwise("stable")
    )
    return fit.where("n >= 5").select(
        "iso3", "slope", "r2", "volatility", label.alias("regime"), volatility_tier(F.col("volatility")).alias("volatility_tier")
    )


def kalman_regimes(filtered: DataFrame) -> DataFrame:
    """Six regimes of smoothed series, by where slope, volatility and latest score stand among all countries.

    The cuts are the 33rd and 66th percentiles of slopes, the median of
    innovation deviations and the 66th percentile of latest scores.
    """
    s = filtered.groupBy("iso3").agg(
        F.regr_slope("kalman_score", "period").alias("slope"),
        F.coalesce(F.stddev_samp(F.nanvl("innovation", F.lit(None).cast("double"))), F.lit(0.0)).alias("volatility"),
        F.max_by("kalman_score", "period").alias("latest_score"),
    )
    cuts = s.agg(
        F.percentile("slope", 0.33).alias("low"),
        F.percentile("slope", 0.66).alias("high"),
        F.median("volatility").alias("vol"),
        F.percentile("latest_score", 0.66).alias("top"),
    )
    rising, falling, volatile = F.col("slope") > F.col("high"), F.col("slope") < F.col("low"), F.col("volatility") > F.col("vol")
    label = (
        F.when(rising & ~volatile, "Ascendant")
        .when(rising, "Volatile Riser")
        .when(falling & volatile, "Fragile")
        .when(falling, "Declining")
        .when(F.col("latest_score") >= F.col("top"), "Stable Power")
        .otherwise("Coasting")
    )
    return s.crossJoin(F.broadcast(cuts)).select("iso3", "slope", "volatility", "latest_score", label.alias("regime"))


def spearman(panel: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two indicators per period, ties with average ranks."""

    def average_rank(c: str) -> Column:
        same = F.count("*").over(Window.partitionBy("period", c))
        return F.rank().over(Window.partitionBy("period").orderBy(c)) + (same - 1) / 2

    known = panel.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = known.select("period", average_rank(a).alias("ra"), average_rank(b).alias("rb"))
    return ranked.groupBy("period").agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def _inversions(rank: np.ndarray) -> int:
    """Pairs of a permutation of 0..n-1 that stand in falling order: by bits, ones that stand before zeros of their group."""
    total, values = 0, rank.astype(np.int64)
    for k in reversed(range(int(len(values)).bit_length())):
        group, bit = values >> (k + 1), values >> k & 1
        before = np.cumsum(bit) - bit
        first = np.searchsorted(group, group)
        total += int(((before - before[first]) * (1 - bit)).sum())
        values = values[np.argsort(values >> k, kind="stable")]
    return total


def kendall(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """(keys, kendall, n): Kendall's rank agreement, corrected for ties (tau-b), for groups of any size.

    Rows are put into ranges by (a, b), and again by (b, a). A discordant pair is in one range of the first
    kind, or in one of the second, or in neither; the first two are counted by merging inside
    tasks, the third from the number of rows that each pair of ranges shares. No pair is made. Rows without either value are left out; a
    group without variation has null.
    """
    spark = df.sparkSession
    ship_package(spark)
    on = list(keys)
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*on, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rows = _checkpointed(known.withColumn("row", F.monotonically_increasing_id()))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _checkpointed(rows.repartitionByRange(ranges, *on, "a", "b", "row").withColumn("p", F.spark_partition_id()))
    rows = _checkpointed(rows.repartitionByRange(ranges, *on, "b", "a", "row").withColumn("q", F.spark_partition_id()))
    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + "discordant long"

    def counted(order: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["b", "a", "row"], ignore_index=True)
            found = _inversions(pdf.sort_values(order, kind="stable").index.to_numpy())
            return pdf[on].head(1).assign(discordant=found)

        return run

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = (np.unique(pdf[c], return_inverse=True)[1] for c in "pq")
        cells = np.zeros((p.max() + 1, q.max() + 1))
        cells[p, q] = pdf["n"]
        later = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1] - cells  # of one p, in later q
        earlier = np.cumsum(later, axis=0) - later
        return pdf[on].head(1).assign(discordant=int((earlier * cells).sum()))

    inside = rows.groupBy(*on, "p").applyInPandas(counted(["a", "b", "row"]), fields)
    beside = rows.groupBy(*on, "q").applyInPandas(counted(["p"]), fields)
    shared = rows.groupBy(*on, "p", "q").agg(F.count("*").alias("n"))
    shared = shared.groupBy(*on).applyInPandas(across, fields) if on else shared.groupBy(F.lit(0)).applyInPandas(across, fields)
    discordant = inside.unionByName(beside).unionByName(shared).groupBy(*on).agg(F.sum("discordant").alias("d"))

    def ties(*by: str) -> DataFrame:
        pairs = F.col("count") * (F.col("count") - 1) / 2
        return rows.groupBy(*on, *by).count().groupBy(*on).agg(F.sum(pairs).alias("t_" + "".join(by)), F.sum("count").alias("n_" + "".join(by)))

    both = discordant
    for by in (("a",), ("b",), ("a", "b")):
        both = both.join(ties(*by), on) if on else both.crossJoin(F.broadcast(ties(*by)))
    n0 = F.col("n_a") * (F.col("n_a") - 1) / 2
    agreed = n0 - F.col("t_a") - F.col("t_b") + F.col("t_ab") - 2 * F.col("d")
    spread = F.sqrt((n0 - F.col("t_a")) * (n0 - F.col("t_b")))
    return both.select(*on, F.when(spread > 0, agreed / spread).alias("kendall"), F.col("n_a").alias("n"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's deciles; shares of at least 1e-6; above 0.2 is drift."""
    cuts = reference.agg(F.percentile(column, [i / bins for i in range(1, bins)]).alias("cuts"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        known = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(cuts))
        bucket = F.size(F.filter("cuts", lambda c: c < F.col(column)))
        counts = known.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
        total = known.agg(F.count("*").alias("total"))
        return counts.crossJoin(F.broadcast(total)).select("bin", (F.col("n") / F.col("total")).alias(name))

    both = shares(reference, "p").join(shares(current, "q"), "bin", "full_outer")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in ("p", "q"))
    out = both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return out.select(F.lit(column).alias("indicator"), "psi", (F.col("psi") > 0.2).alias("drift"))


def conformal_half_width(residuals: DataFrame, column: str, coverage: float = 0.8) -> DataFrame:
    """Half-width that covers the share: the absolute residual at rank ceil((n + 1) * coverage)."""
    ranked = residuals.where(F.col(column).isNotNull()).select(F.abs(column).alias("r"))
    n = ranked.agg(F.count("*").alias("n"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * coverage) / F.col("n"))
    share = n.select(level).first()[0]
    return ranked.agg(F.percentile("r", float(share)).alias("half_width")) if share is not None else ranked.agg(
        F.max("r").alias("half_width")
    )


def peer_vectors(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and deviation of the last five periods per indicator, as z-scores over countries, long form."""
    down = F.row_number().over(Window.partitionBy("iso3").orderBy(F.desc("period")))
    recent = panel.withColumn("down", down).where("down <= 5")
    stats = recent.groupBy("iso3").agg(
        *(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.stddev_samp(c).alias(f"{c}_std") for c in columns)
    )
    names = [f"{c}_{s}" for c in columns for s in ("mean", "std")]
    long = stats.unpivot(["iso3"], names, "feature", "x")
    over = Window.partitionBy("feature")
    filled = F.coalesce("x", F.avg("x").over(over))
    long = long.withColumn("x", filled)
    mean, std = F.avg("x").over(over), F.stddev_pop("x").over(over)
    return long.select("iso3", "feature", F.when(std > 0, (F.col("x") - mean) / std).otherwise(0.0).alias("z"))


def peers(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Each country's k nearest by cosine, ties by name.

    The pairs are countries of one panel, a few hundred at most.
    """
    norm = vectors.groupBy("iso3").agg(F.sqrt(F.sum(F.col("z") ** 2)).alias("norm")).where("norm > 0")
    v = vectors.join(norm, "iso3").select("iso3", "feature", (F.col("z") / F.col("norm")).alias("u"))
    a = v.select(F.col("iso3"), "feature", F.col("u").alias("x"))
    b = v.select(F.col("iso3").alias("peer"), "feature", F.col("u").alias("y"))
    cosine = a.join(b, "feature").where("iso3 <> peer").groupBy("iso3", "peer").agg(
        F.round(F.sum(F.col("x") * F.col("y")), 9).alias("similarity")
    )
    rank = F.row_number().over(Window.partitionBy("iso3").orderBy(F.desc("similarity"), "peer"))
    return cosine.withColumn("rank", rank).where(F.col("rank") <= k)


def explain_peers(vectors: DataFrame, a: str, b: str) -> DataFrame:
    """Each feature's share in two countries' cosine, largest first."""
    x = vectors.where(F.col("iso3") == a).select("feature", F.col("z").alias("x"))
    y = vectors.where(F.col("iso3") == b).select("feature", F.col("z").alias("y"))
    both = x.join(y, "feature")
    length = both.agg((F.sqrt(F.sum(F.col("x") ** 2)) * F.sqrt(F.sum(F.col("y") ** 2))).alias("length"))
    return both.crossJoin(F.broadcast(length)).select(
        "feature", F.when(F.col("length") > 0, F.col("x") * F.col("y") / F.col("length")).otherwise(0.0).alias("contribution")
    )


def validate(panel: DataFrame, required: list[str]) -> DataFrame:
    """Counts for an update: rows, duplicate keys, missing values per required column, countries."""
    keys = panel.groupBy("iso3", "period").count().where("count > 1").agg(F.count("*").alias("duplicate_keys"))
    present = [c for c in required if c in panel.columns]
    counts = panel.agg(
        F.count("*").alias("rows"),
        F.count_distinct("iso3").alias("countries"),
        *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in present),
    )
    absent = ",".join(c for c in required if c not in panel.columns)
    return counts.crossJoin(F.broadcast(keys)).withColumn("absent_columns", F.lit(absent))


# ------------------------------------------------------------- state-space model


def kalman_filter(values: np.ndarray, q: float, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local-level filter: state, variance and innovation per value; a missing value only adds variance."""
    known = values[~np.isnan(values)]
    x, p = known[0], known.var()
    states, variances, innovations = np.empty(len(values)), np.empty(len(values)), np.full(len(values), np.nan)
    for i, value in enumerate(values):
        p += q
        if not np.isnan(value):
            gain = p / (p + r) if p + r > 0 else 0.0
            innovations[i] = value - x
            x, p = x + gain * innovations[i], (1 - gain) * p
        states[i], variances[i] = x, p
    return states, variances, innovations


def smooth(states: np.ndarray, variances: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel pass from the last state back."""
    s, v = states.copy(), variances.copy()
    for i in range(len(states) - 2, -1, -1):
        ahead = variances[i] + q
        gain = variances[i] / ahead if ahead > 0 else 0.0
        s[i] = states[i] + gain * (s[i + 1] - states[i])
        v[i] = variances[i] + gain**2 * (v[i + 1] - ahead)
    return s, v


def _misfit(values: np.ndarray, q: float, r: float) -> float:
    known = values[~np.isnan(values)]
    x, p, total = known[0], known.var(), 0.0
    for value in values:
        p += q
        if not np.isnan(value):
            spread = max(p + r, 1e-12)
            total += 0.5 * (np.log(2 * np.pi * spread) + (value - x) ** 2 / spread)
            gain = p / spread
            x, p = x + gain * (value - x), (1 - gain) * p
    return total


def fit_noise(values: np.ndarray) -> tuple[float, float]:
    """Process and measurement noise: R a tenth of the variance, Q = R * exp(theta), theta by golden section in (-6, 4)."""
    known = values[~np.isnan(values)]
    r = max(0.1 * known.var(), 1e-9)
    if len(known) < 4:
        return float(0.3 * np.var(np.diff(known))), r
    low, high, ratio = -6.0, 4.0, (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = _misfit(values, r * np.exp(a), r), _misfit(values, r * np.exp(b), r)
    while high - low > 1e-4:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = _misfit(values, r * np.exp(a), r)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = _misfit(values, r * np.exp(b), r)
    return float(r * np.exp((low + high) / 2)), r


def kalman(panel: DataFrame, value: str) -> DataFrame:
    """Smoothed series per country with 95 % bands and innovations; countries with under three values are left out.

    A series is one country's periods, a bounded group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        values = pdf[value].to_numpy(float)
        if (~np.isnan(values)).sum() < 3:
            return pd.DataFrame(columns=columns)
        q, r = fit_noise(values)
        states, variances, innovations = kalman_filter(values, q, r)
        s, v = smooth(states, variances, q)
        std = np.sqrt(np.maximum(v, 0))
        return pd.DataFrame(
            {
                "iso3": pdf["iso3"], "period": pdf["period"], "raw_score": values, "kalman_score": s, "kalman_std": std,
                "ci_lower_95": s - 1.96 * std, "ci_upper_95": s + 1.96 * std, "ci_width": 2 * 1.96 * std,
                "innovation": innovations, "q": q,
            }
        )

    columns = [
        "iso3", "period", "raw_score", "kalman_score", "kalman_std", "ci_lower_95", "ci_upper_95", "ci_width",
        "innovation", "q",
    ]
    schema = "iso3 string, period int, " + ", ".join(f"{c} double" for c in columns[2:])
    return panel.select("iso3", F.col("period").cast("int"), value).groupBy("iso3").applyInPandas(run, schema)


def kalman_forecast(filtered: DataFrame, horizon: int = 5) -> DataFrame:
    """Last state carried on by the slope of the last five smoothed values; variance grows by Q a step."""
    down = F.row_number().over(Window.partitionBy("iso3").orderBy(F.desc("period")))
    last = (
        filtered.withColumn("down", down)
        .where("down <= 5")
        .groupBy("iso3")
        .agg(
            F.max("period").alias("base_period"),
            F.max_by("kalman_score", "period").alias("state"),
            F.max_by("kalman_std", "period").alias("std"),
            F.max("q").alias("q"),
            F.coalesce(F.regr_slope("kalman_score", "period"), F.lit(0.0)).alias("trend_slope"),
        )
    )
    ahead = last.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    score = F.col("state") + F.col("trend_slope") * F.col("horizon")
    spread = F.sqrt(F.col("std") ** 2 + F.col("horizon") * F.col("q"))
    return ahead.select(
        "iso3", "base_period", "horizon", score.alias("forecast_score"), spread.alias("forecast_std"),
        (score - 1.28 * spread).alias("ci_lower_80"), (score + 1.28 * spread).alias("ci_upper_80"),
        (score - 1.96 * spread).alias("ci_lower_95"), (score + 1.96 * spread).alias("ci_upper_95"), "trend_slope",
    )


def kalman_summary(filtered: DataFrame) -> DataFrame:
    """Mean, latest value, innovation deviation, slope, and stability by terciles of the deviation."""
    s = filtered.groupBy("iso3").agg(
        F.avg("kalman_score").alias("mean_score"),
        F.max_by("kalman_score", "period").alias("latest_score"),
        F.stddev_samp("innovation").alias("innovation_std"),
        F.regr_slope("kalman_score", "period").alias("slope"),
    )
    cuts = s.agg(F.percentile("innovation_std", [0.33, 0.66]).alias("cuts"))
    label = (
        F.when(F.col("innovation_std") <= F.col("cuts")[0], "Stable")
        .when(F.col("innovation_std") <= F.col("cuts")[1], "Moderate")
        .otherwise("Volatile")
    )
    return s.crossJoin(F.broadcast(cuts)).withColumn("stability", label).drop("cuts")


def coverage(filtered: DataFrame) -> DataFrame:
    """Share of known values inside their 95 % band."""
    inside = F.col("raw_score").between(F.col("ci_lower_95"), F.col("ci_upper_95"))
    return filtered.where("raw_score IS NOT NULL AND NOT isnan(raw_score)").agg(
        F.avg(inside.cast("int")).alias("coverage"), F.count("*").alias("n")
    )


def vif(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each indicator: the diagonal of the inverse correlation matrix.

    One aggregation gives all pairwise correlations over complete rows; the
    matrix has a row per indicator.
    """
    complete = panel.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    row = complete.agg(F.count("*"), *(F.corr(columns[i], columns[j]) for i, j in pairs)).first()
    matrix = np.eye(len(columns))
    for (i, j), r in zip(pairs, row[1:], strict=True):
        matrix[i, j] = matrix[j, i] = r if r is not None else 0.0
    inverse = np.linalg.pinv(matrix).diagonal()
    found = [(c, float(v) if v < 1000 else float("inf")) for c, v in zip(columns, inverse, strict=True)]
    return panel.sparkSession.createDataFrame(found, "indicator string, vif double")


def short_forecast(panel: DataFrame, value: str, residual_std: float, horizon: int = 3) -> DataFrame:
    """Line through the last eight known values carried on, within 0 to 100, with an 80 % interval.

    The half-width joins the model's residual deviation with the slope's standard
    error, which grows with the step. From four values on.
    """
    down = F.row_number().over(Window.partitionBy("iso3").orderBy(F.desc("period")))
    recent = panel.where(F.col(value).isNotNull()).withColumn("down", down).where("down <= 8").withColumn("x", -F.col("down"))
    fit = (
        recent.groupBy("iso3")
        .agg(
            F.regr_slope(value, "x").alias("slope"),
            F.regr_intercept(value, "x").alias("level"),
            F.sqrt(
                F.greatest(F.lit(0.0), F.regr_syy(value, "x") * (1 - F.regr_r2(value, "x")))
                / (F.count("*") - 2)
                / F.regr_sxx(value, "x")
            ).alias("se"),
            F.count("*").alias("n"),
        )
        .where("n >= 4")
        .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    )
    mean = F.col("level") + F.col("slope") * (F.col("horizon") - 1)
    half = 1.28 * F.sqrt(residual_std**2 + (F.col("se") * F.col("horizon")) ** 2)

    def bounded(c: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 2)

    return fit.select(
        "iso3", "horizon", bounded(mean).alias("forecast_mean"), bounded(mean - half).alias("forecast_ci_lo"),
        bounded(mean + half).alias("forecast_ci_hi"),
    )


def partial_spearman(panel: DataFrame, a: str, b: str, control: str) -> DataFrame:
    """Rank correlation of what a line on the control leaves of two indicators, per period."""
    known = panel.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(control).isNotNull())
    over = Window.partitionBy("period")

    def rest(c: str) -> Column:
        slope = F.regr_slope(c, control).over(over)
        return F.round(F.col(c) - F.regr_intercept(c, control).over(over) - slope * F.col(control), 9)

    left = known.select("period", rest(a).alias("left_a"), rest(b).alias("left_b"))
    return spearman(left, "left_a", "left_b").withColumnRenamed("spearman", "partial")


def lagged_pairs(panel: DataFrame, value: str, gap: int = 2) -> DataFrame:
    """Each value with the one exactly ``gap`` periods later, and the change between them."""
    w = _series()
    ahead = panel.withColumns({"later": F.lead(value, gap).over(w), "at": F.lead("period", gap).over(w)})
    exact = ahead.where((F.col("at") - F.col("period") == gap) & F.col("later").isNotNull() & F.col(value).isNotNull())
    return exact.select("iso3", "period", value, "later", (F.col("later") - F.col(value)).alias("change"))


def preferred_score(panel: DataFrame, filtered: DataFrame, value: str) -> DataFrame:
    """The smoothed score where there is one other than 0, else the panel's."""
    smooth = filtered.select("iso3", "period", "kalman_score")
    chosen = F.coalesce(F.nullif(F.col("kalman_score"), F.lit(0.0)), F.col(value))
    return panel.join(smooth, ["iso3", "period"], "left").select("iso3", "period", chosen.alias("score"))


def benchmark_agreement(scores: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rank correlation of scores (iso3, score) with an outside ranking (iso3, rank; 1 is best), over common countries."""
    both = scores.join(benchmark, "iso3").select(
        F.lit(0).alias("period"), F.col("score"), (-F.col("rank")).cast("double").alias("outside")
    )
    return spearman(both, "score", "outside").select("spearman", "n")
