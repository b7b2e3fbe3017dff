"""Influence queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import influence
from geolith.sources.views import PANEL_SQL, panel

from .trade import _rounded

INDICATORS = ["price", "discount", "volume", "wealth"]


def influence_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.impute(panel(spark, sf_dir), ["price", "volume"]))


INFLUENCE_IMPUTE_SQL = f"""
WITH {PANEL_SQL}, c AS (SELECT iso3, median(price) AS p, median(volume) AS v FROM panel GROUP BY 1),
t AS (SELECT period, median(price) AS p, median(volume) AS v FROM panel GROUP BY 1),
a AS (SELECT median(price) AS p, median(volume) AS v FROM panel)
SELECT iso3, period, round(coalesce(price, c.p, t.p, a.p), 6) AS price, round(discount, 6) AS discount,
       round(coalesce(volume, c.v, t.v, a.v), 6) AS volume, round(wealth, 6) AS wealth, round(composite, 6) AS composite
FROM panel JOIN c USING (iso3) JOIN t USING (period) CROSS JOIN a
"""


def influence_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.robust_scale(panel(spark, sf_dir), ["price", "volume"]).select("iso3", "period", "price", "volume"))


INFLUENCE_SCALED_SQL = f"""
WITH {PANEL_SQL}, l AS (SELECT iso3, period, ln(1 + price) AS p, ln(1 + volume) AS v FROM panel),
q AS (SELECT quantile_cont(p, [0.25, 0.5, 0.75]) AS qp, quantile_cont(v, [0.25, 0.5, 0.75]) AS qv FROM l)
SELECT iso3, period, round((p - qp[2]) / (qp[3] - qp[1]), 6) AS price, round((v - qv[2]) / (qv[3] - qv[1]), 6) AS volume
FROM l CROSS JOIN q
"""


def influence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = panel(spark, sf_dir).where("price IS NOT NULL")
    return influence.gaps(known).select("iso3", F.col("expected").cast("long"), "present", F.col("missing").cast("long"))


INFLUENCE_GAPS_SQL = f"""
WITH {PANEL_SQL}
SELECT iso3, (max(period) - min(period) + 1)::BIGINT AS expected, count(DISTINCT period) AS present,
       (max(period) - min(period) + 1 - count(DISTINCT period))::BIGINT AS missing
FROM panel WHERE price IS NOT NULL GROUP BY 1
"""


def influence_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.lag_features(panel(spark, sf_dir), "composite"))


INFLUENCE_LAGS_SQL = f"""
WITH {PANEL_SQL}, w AS (
    SELECT iso3, period, composite, lag(composite) OVER s AS lag1, lag(composite, 2) OVER s AS lag2,
           lead(composite) OVER s AS target, composite - lag(composite) OVER s AS delta1,
           composite - lag(composite, 3) OVER s AS delta3, count(composite) OVER r AS n,
           avg(composite) OVER r AS rm, stddev_samp(composite) OVER r AS rs
    FROM panel WINDOW s AS (PARTITION BY iso3 ORDER BY period),
    r AS (PARTITION BY iso3 ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
)
SELECT iso3, period, round(composite, 6) AS composite, round(lag1, 6) AS lag1, round(lag2, 6) AS lag2,
       round(target, 6) AS target, round(delta1, 6) AS delta1, round(delta3, 6) AS delta3,
       CASE WHEN n >= 2 THEN round(rm, 6) END AS rolling_mean, CASE WHEN n >= 2 THEN round(rs, 6) END AS rolling_std
FROM w
"""


def influence_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.momentum(panel(spark, sf_dir), "composite"))


INFLUENCE_MOMENTUM_SQL = f"""
WITH {PANEL_SQL}, k AS (
    SELECT iso3, composite, row_number() OVER (PARTITION BY iso3 ORDER BY period) AS up,
           row_number() OVER (PARTITION BY iso3 ORDER BY period DESC) AS down, count(*) OVER (PARTITION BY iso3) AS n
    FROM panel WHERE composite IS NOT NULL
)
SELECT iso3, CASE WHEN max(n) >= 8 THEN round(avg(composite) FILTER (WHERE down <= 5)
           - avg(composite) FILTER (WHERE CASE WHEN n >= 10 THEN down BETWEEN 6 AND 10 ELSE up <= 5 END), 6) END AS momentum,
       max(n) AS n
FROM k GROUP BY 1
"""


def influence_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.ranks(panel(spark, sf_dir), "composite")


INFLUENCE_RANKS_SQL = f"""
WITH {PANEL_SQL}
SELECT iso3, period, (rank() OVER (PARTITION BY period ORDER BY composite DESC))::INTEGER AS rank,
       (row_number() OVER (PARTITION BY period ORDER BY composite DESC, iso3))::INTEGER AS position
FROM panel WHERE composite IS NOT NULL
"""


def influence_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.latest(panel(spark, sf_dir)))


INFLUENCE_LATEST_SQL = f"""
WITH {PANEL_SQL}
SELECT iso3, max(period) AS period, round(max_by(price, period) FILTER (WHERE price IS NOT NULL), 6) AS price,
       round(max_by(discount, period) FILTER (WHERE discount IS NOT NULL), 6) AS discount,
       round(max_by(volume, period) FILTER (WHERE volume IS NOT NULL), 6) AS volume,
       round(max_by(wealth, period) FILTER (WHERE wealth IS NOT NULL), 6) AS wealth,
       round(max_by(composite, period) FILTER (WHERE composite IS NOT NULL), 6) AS composite
FROM panel GROUP BY 1
"""


def influence_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.autocorrelation(panel(spark, sf_dir), "composite"))


INFLUENCE_AUTOCORRELATION_SQL = f"""
WITH {PANEL_SQL}, p AS (
    SELECT iso3, composite, lag(composite) OVER (PARTITION BY iso3 ORDER BY period) AS b FROM panel WHERE composite IS NOT NULL
), c AS (SELECT iso3, corr(composite, b) AS r FROM p GROUP BY 1 HAVING count(*) >= 5)
SELECT iso3, round(r, 6) AS lag1, r > 0.3 AS high FROM c
"""


def influence_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.static_columns(panel(spark, sf_dir), INDICATORS))


INFLUENCE_STATIC_SQL = (
    f"WITH {PANEL_SQL}, w AS (SELECT iso3, "
    + ", ".join(f"stddev_samp({c}) AS {c}" for c in INDICATORS)
    + " FROM panel GROUP BY 1), u AS (UNPIVOT w ON "
    + ", ".join(INDICATORS)
    + " INTO NAME indicator VALUE s) SELECT indicator, round(avg(s), 6) AS mean_std, avg(s) < 0.001 AS static FROM u GROUP BY 1"
)


def influence_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.nearest_deltas(panel(spark, sf_dir), "price", 7985, 8001))


INFLUENCE_DELTAS_SQL = f"""
WITH {PANEL_SQL}, k AS (
    SELECT iso3, period, price, row_number() OVER (PARTITION BY iso3 ORDER BY abs(period - 7985), period) AS a,
           row_number() OVER (PARTITION BY iso3 ORDER BY abs(period - 8001), period) AS b
    FROM panel WHERE price IS NOT NULL
)
SELECT iso3, max(period) FILTER (WHERE a = 1) AS from_period, max(period) FILTER (WHERE b = 1) AS to_period,
       round(max(price) FILTER (WHERE b = 1) - max(price) FILTER (WHERE a = 1), 6) AS delta
FROM k GROUP BY 1
"""


def influence_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.regimes(panel(spark, sf_dir), "composite"))


INFLUENCE_REGIMES_SQL = f"""
WITH {PANEL_SQL}, t AS (
    SELECT iso3, regr_slope(composite, period) AS slope, regr_r2(composite, period) AS r2,
           sqrt(greatest(0, regr_syy(composite, period) * (1 - regr_r2(composite, period)) / count(*))) AS vol
    FROM panel WHERE composite IS NOT NULL GROUP BY 1 HAVING count(*) >= 5
)
SELECT iso3, round(slope, 6) AS slope, round(r2, 6) AS r2, round(vol, 6) AS volatility,
       CASE WHEN slope > 0.4 AND r2 > 0.25 THEN 'rising' WHEN slope < -0.4 AND r2 > 0.25 THEN 'declining' ELSE 'stable' END
           AS regime,
       CASE WHEN vol >= 2.5 THEN 'High' WHEN vol >= 1.25 THEN 'Medium' ELSE 'Low' END AS volatility_tier
FROM t
"""


def influence_kalman_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.kalman_regimes(influence.kalman(panel(spark, sf_dir), "composite")))


def influence_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.spearman(panel(spark, sf_dir), "price", "wealth"))


INFLUENCE_SPEARMAN_SQL = f"""
WITH {PANEL_SQL}, k AS (SELECT period, price, wealth FROM panel WHERE price IS NOT NULL AND wealth IS NOT NULL),
r AS (
    SELECT period, rank() OVER (PARTITION BY period ORDER BY price) + (count(*) OVER (PARTITION BY period, price) - 1) / 2 AS a,
           rank() OVER (PARTITION BY period ORDER BY wealth) + (count(*) OVER (PARTITION BY period, wealth) - 1) / 2 AS b
    FROM k
)
SELECT period, round(corr(a, b), 6) AS spearman, count(*) AS n FROM r GROUP BY 1
"""


def influence_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.kendall(panel(spark, sf_dir), "price", "wealth", "period"))


INFLUENCE_KENDALL_SQL = f"""
WITH {PANEL_SQL}, k AS (
    SELECT period, price AS a, wealth AS b, row_number() OVER () AS row FROM panel WHERE price IS NOT NULL AND wealth IS NOT NULL
), pairs AS (
    SELECT x.period, sign(x.a - y.a) AS da, sign(x.b - y.b) AS db FROM k x JOIN k y ON x.period = y.period AND x.row < y.row
), s AS (SELECT period, sum(da * db) AS c, sum(da * da) AS va, sum(db * db) AS vb FROM pairs GROUP BY 1)
SELECT period, round(CASE WHEN va * vb > 0 THEN c / sqrt(va * vb) END, 6) AS kendall, (SELECT count(*) FROM k WHERE k.period = s.period) AS n FROM s
"""


def influence_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return _rounded(influence.psi(p.where("period < 7995"), p.where("period >= 7995"), "wealth"))


INFLUENCE_PSI_SQL = f"""
WITH {PANEL_SQL}, cuts AS (
    SELECT quantile_cont(wealth, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM panel WHERE period < 7995
), b AS (
    SELECT period < 7995 AS ref, len(list_filter(c, lambda x: x < wealth)) AS bin FROM panel, cuts WHERE wealth IS NOT NULL
), s AS (
    SELECT bin, greatest(count(*) FILTER (WHERE ref) / (SELECT count(*) FROM b WHERE ref), 1e-6) AS p,
           greatest(count(*) FILTER (WHERE NOT ref) / (SELECT count(*) FROM b WHERE NOT ref), 1e-6) AS q
    FROM b GROUP BY 1
)
SELECT 'wealth' AS indicator, round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) > 0.2 AS drift FROM s
"""


def influence_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.peers(influence.peer_vectors(panel(spark, sf_dir), ["discount", "wealth", "composite"])))


_PEER_COLUMNS = ("discount", "wealth", "composite")
INFLUENCE_PEERS_SQL = (
    f"WITH {PANEL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY iso3 ORDER BY period DESC) AS rn FROM panel), s AS ("
    + " UNION ALL ".join(
        f"SELECT iso3, '{c}_{n}' AS feature, {f}({c}) AS x FROM r WHERE rn <= 5 GROUP BY 1"
        for c in _PEER_COLUMNS
        for n, f in (("mean", "avg"), ("std", "stddev_samp"))
    )
    + """), f AS (SELECT iso3, feature, coalesce(x, avg(x) OVER (PARTITION BY feature)) AS x FROM s),
z AS (SELECT iso3, feature, CASE WHEN stddev_pop(x) OVER p > 0 THEN (x - avg(x) OVER p) / stddev_pop(x) OVER p ELSE 0 END AS z
      FROM f WINDOW p AS (PARTITION BY feature)),
u AS (SELECT iso3, feature, z / sqrt(sum(z * z) OVER (PARTITION BY iso3)) AS u FROM z),
c AS (SELECT a.iso3, b.iso3 AS peer, round(sum(a.u * b.u), 9) AS similarity FROM u a JOIN u b USING (feature)
      WHERE a.iso3 <> b.iso3 GROUP BY 1, 2)
SELECT iso3, peer, round(similarity, 6) AS similarity,
       (row_number() OVER (PARTITION BY iso3 ORDER BY similarity DESC, peer))::INTEGER AS rank
FROM c QUALIFY row_number() OVER (PARTITION BY iso3 ORDER BY similarity DESC, peer) <= 5"""
)


def influence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.validate(panel(spark, sf_dir), ["price", "volume", "literacy"])


INFLUENCE_VALIDATION_SQL = f"""
WITH {PANEL_SQL}
SELECT count(*) AS rows, count(DISTINCT iso3) AS countries, count(*) FILTER (WHERE price IS NULL) AS missing_price,
       count(*) FILTER (WHERE volume IS NULL) AS missing_volume,
       (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY iso3, period HAVING count(*) > 1)) AS duplicate_keys,
       'literacy' AS absent_columns
FROM panel
"""


def influence_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.kalman(panel(spark, sf_dir), "composite"))


def influence_kalman_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.kalman_forecast(influence.kalman(panel(spark, sf_dir), "composite")))


def influence_kalman_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.kalman_summary(influence.kalman(panel(spark, sf_dir), "composite")))


def influence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.coverage(influence.kalman(panel(spark, sf_dir), "composite")))


def influence_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.vif(panel(spark, sf_dir), INDICATORS), 4)


def influence_short_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.short_forecast(panel(spark, sf_dir), "composite", 1.5)


INFLUENCE_SHORT_FORECAST_SQL = f"""
WITH {PANEL_SQL}, r AS (
    SELECT iso3, composite AS y, -row_number() OVER (PARTITION BY iso3 ORDER BY period DESC) AS x FROM panel WHERE composite IS NOT NULL
), f AS (
    SELECT iso3, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic,
           sqrt(greatest(0, regr_syy(y, x) * (1 - regr_r2(y, x))) / (count(*) - 2) / regr_sxx(y, x)) AS se
    FROM r WHERE x >= -8 GROUP BY 1 HAVING count(*) >= 4
), g AS (SELECT iso3, h::INTEGER AS horizon, ic + sl * (h - 1) AS m, 1.28 * sqrt(2.25 + (se * h) * (se * h)) AS w FROM f, range(1, 4) t(h))
SELECT iso3, horizon, round(greatest(0, least(100, m)), 2) AS forecast_mean,
       round(greatest(0, least(100, m - w)), 2) AS forecast_ci_lo, round(greatest(0, least(100, m + w)), 2) AS forecast_ci_hi
FROM g
"""


def influence_lagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.lagged_pairs(panel(spark, sf_dir).where("price IS NOT NULL"), "price"))


INFLUENCE_LAGGED_PAIRS_SQL = f"""
WITH {PANEL_SQL}, w AS (
    SELECT iso3, period, price, lead(price, 2) OVER s AS later, lead(period, 2) OVER s AS nxt FROM panel WHERE price IS NOT NULL
    WINDOW s AS (PARTITION BY iso3 ORDER BY period)
)
SELECT iso3, period, round(price, 6) AS price, round(later, 6) AS later, round(later - price, 6) AS change FROM w WHERE nxt - period = 2
"""


def influence_partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(influence.partial_spearman(panel(spark, sf_dir), "composite", "volume", "price"))


INFLUENCE_PARTIAL_CORRELATION_SQL = f"""
WITH {PANEL_SQL}, k AS (SELECT * FROM panel WHERE composite IS NOT NULL AND volume IS NOT NULL AND price IS NOT NULL),
l AS (
    SELECT period, regr_slope(composite, price) AS s1, regr_intercept(composite, price) AS i1,
           regr_slope(volume, price) AS s2, regr_intercept(volume, price) AS i2 FROM k GROUP BY 1
), e AS (
    SELECT period, round(composite - i1 - s1 * price, 9) AS a, round(volume - i2 - s2 * price, 9) AS b FROM k JOIN l USING (period)
), r AS (
    SELECT period, rank() OVER (PARTITION BY period ORDER BY a) + (count(*) OVER (PARTITION BY period, a) - 1) / 2 AS ra,
           rank() OVER (PARTITION BY period ORDER BY b) + (count(*) OVER (PARTITION BY period, b) - 1) / 2 AS rb FROM e
)
SELECT period, round(corr(ra, rb), 6) AS partial, count(*) AS n FROM r GROUP BY 1
"""


QUERIES = {
    f.__name__: f
    for f in (
        influence_impute, influence_scaled, influence_gaps, influence_lags, influence_momentum, influence_ranks,
        influence_latest, influence_autocorrelation, influence_static, influence_deltas, influence_regimes,
        influence_spearman, influence_kendall, influence_psi, influence_peers, influence_validation, influence_kalman,
        influence_kalman_forecast, influence_kalman_summary, influence_coverage, influence_vif, influence_kalman_regimes,
        influence_short_forecast, influence_lagged_pairs, influence_partial_correlation,
    )
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
