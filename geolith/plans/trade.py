"""Trade queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import graph, trade
from geolith.sources.views import RAW_FLOWS_SQL, TRADE_FLOWS_SQL, raw_flows, trade_flows

#: Year of the fixed-year queries, and the shock's origin.
YEAR, ORIGIN = 2000, "NATION_3"

_EDGES_SQL = f"""{TRADE_FLOWS_SQL}, edges AS (
    SELECT exporter, importer, sum(trade_value) AS weight FROM trade_flows WHERE year = {YEAR} GROUP BY 1, 2
), sides AS (
    SELECT exporter AS country, importer AS partner, weight FROM edges
    UNION ALL SELECT importer, exporter, weight FROM edges
), partner_totals AS (
    SELECT country, partner, sum(weight) AS pt FROM sides GROUP BY 1, 2
), totals AS (SELECT country, sum(pt) AS total FROM partner_totals GROUP BY 1)"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.edges(trade_flows(spark, sf_dir).where(F.col("year") == YEAR))


def trade_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.concentration(trade.edges(trade_flows(spark, sf_dir), "year"), "year"))


TRADE_CONCENTRATION_SQL = f"""
WITH {TRADE_FLOWS_SQL}, sides AS (
    SELECT year, exporter AS country, importer AS partner, trade_value FROM trade_flows
    UNION ALL SELECT year, importer, exporter, trade_value FROM trade_flows
), pt AS (SELECT year, country, partner, sum(trade_value) AS v FROM sides GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY year, country ORDER BY v DESC, partner) AS rn FROM pt)
SELECT year, country, round(sum(v) FILTER (WHERE rn <= 3) / sum(v), 6) AS trade_concentration,
       round(sum(v * v) / (sum(v) * sum(v)), 6) AS hhi, count(*) AS partner_count,
       string_agg(partner, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS top_partners
FROM ranked GROUP BY 1, 2
"""


def trade_sector_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.sector_rollup(trade_flows(spark, sf_dir)), 4)


TRADE_SECTOR_ROLLUP_SQL = f"""
WITH {TRADE_FLOWS_SQL}, labelled AS (
    SELECT exporter, importer, year, sector, trade_value FROM trade_flows WHERE sector <> 'other'
    UNION ALL SELECT exporter, importer, year, 'all', trade_value FROM trade_flows
)
SELECT exporter, importer, year, sector, round(sum(trade_value), 4) AS trade_value, count(*) AS n_flows
FROM labelled GROUP BY 1, 2, 3, 4
"""


def trade_country_year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.country_year_totals(trade_flows(spark, sf_dir)), 4)


TRADE_COUNTRY_YEAR_TOTALS_SQL = f"""
WITH {TRADE_FLOWS_SQL}, x AS (
    SELECT exporter AS country, year, sector, sum(trade_value) AS exports, count(DISTINCT importer) AS export_partners
    FROM trade_flows GROUP BY 1, 2, 3
), m AS (
    SELECT importer AS country, year, sector, sum(trade_value) AS imports, count(DISTINCT exporter) AS import_partners
    FROM trade_flows GROUP BY 1, 2, 3
), b AS (
    SELECT country, year, sector, coalesce(exports, 0) AS exports, coalesce(export_partners, 0) AS export_partners,
           coalesce(imports, 0) AS imports, coalesce(import_partners, 0) AS import_partners
    FROM x FULL OUTER JOIN m USING (country, year, sector)
)
SELECT country, year, sector, round(exports, 4) AS exports, export_partners, round(imports, 4) AS imports,
       import_partners, round(exports + imports, 4) AS trade_total,
       CASE WHEN exports + imports > 0 THEN round(imports / (exports + imports), 4) ELSE 0 END AS import_dependency_ratio,
       CASE WHEN exports + imports > 0 THEN round(exports / (exports + imports), 4) ELSE 0 END AS export_dependency_ratio
FROM b
"""


def trade_country_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.country_features(_edges(spark, sf_dir)), 4)


TRADE_COUNTRY_FEATURES_SQL = f"""
WITH {_EDGES_SQL}, f AS (
    SELECT country, sum(x) AS exports, sum(m) AS imports FROM (
        SELECT exporter AS country, weight AS x, 0 AS m FROM edges UNION ALL SELECT importer, 0, weight FROM edges)
    GROUP BY 1
)
SELECT country, round(exports, 4) AS exports, round(imports, 4) AS imports, round(exports + imports, 4) AS trade_total,
       round(CASE WHEN exports + imports > 0 THEN imports / (exports + imports) ELSE 0 END, 4) AS import_dependency_ratio
FROM f
"""


def trade_data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.data_quality(raw_flows(spark, sf_dir)))


TRADE_DATA_QUALITY_SQL = f"""
WITH {RAW_FLOWS_SQL}
SELECT year, sector,
       round(avg(CASE WHEN exporter IS NOT NULL AND importer IS NOT NULL AND trade_value IS NOT NULL THEN 1 ELSE 0 END), 6)
           AS required_ratio,
       round(avg(CASE WHEN trade_value IS NOT NULL THEN 1 ELSE 0 END), 6) AS value_ratio,
       round(avg(CASE WHEN quantity > 0 THEN 1 WHEN quantity IS NOT NULL THEN 0 END), 6) AS quantity_ratio,
       count(*) AS row_count
FROM raw_flows GROUP BY 1, 2
"""


def trade_quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.quality_overall(trade.data_quality(raw_flows(spark, sf_dir))))


TRADE_QUALITY_OVERALL_SQL = f"""
WITH {RAW_FLOWS_SQL}
SELECT sector, round(avg(CASE WHEN trade_value IS NOT NULL THEN 1 ELSE 0 END), 6) AS required_ratio,
       round(avg(CASE WHEN trade_value IS NOT NULL THEN 1 ELSE 0 END), 6) AS value_ratio,
       round(avg(CASE WHEN quantity > 0 THEN 1 ELSE 0 END), 6) AS quantity_ratio, count(*) AS row_count
FROM raw_flows GROUP BY 1
"""


def trade_leverage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.leverage_pairs(_edges(spark, sf_dir)))


_PAIRS_SQL = f"""{_EDGES_SQL}, bil AS (
    SELECT least(exporter, importer) AS a, greatest(exporter, importer) AS b, sum(weight) AS bt FROM edges GROUP BY 1, 2
), dep AS (
    SELECT a, b, bt, bt / ta.total AS da, bt / tb.total AS db FROM bil
    JOIN totals ta ON ta.country = a JOIN totals tb ON tb.country = b
    WHERE greatest(bt / ta.total, bt / tb.total) >= 0.005
), pairs AS (
    SELECT CASE WHEN da <= db THEN a ELSE b END AS holder, CASE WHEN da <= db THEN b ELSE a END AS exposed,
           bt AS bilateral_trade, least(da, db) AS holder_dependence, greatest(da, db) AS exposed_dependence
    FROM dep
)"""
TRADE_LEVERAGE_PAIRS_SQL = f"""
WITH {_PAIRS_SQL}
SELECT holder, exposed, round(bilateral_trade, 6) AS bilateral_trade, round(holder_dependence, 6) AS holder_dependence,
       round(exposed_dependence, 6) AS exposed_dependence,
       round(exposed_dependence - holder_dependence, 6) AS asymmetry,
       CASE WHEN holder_dependence > 0 THEN round(exposed_dependence / holder_dependence, 6) ELSE 'infinity'::DOUBLE END
           AS exposure_ratio
FROM pairs
"""


def trade_country_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.country_leverage(_edges(spark, sf_dir)))


TRADE_COUNTRY_LEVERAGE_SQL = f"""
WITH {_PAIRS_SQL}, held AS (
    SELECT holder AS country, sum(exposed_dependence - holder_dependence) AS s, count(*) AS n FROM pairs GROUP BY 1
), exposed AS (
    SELECT exposed AS country, sum(exposed_dependence - holder_dependence) AS s, count(*) AS n FROM pairs GROUP BY 1
), crit AS (
    SELECT p.country, p.partner AS critical_partner, p.pt / t.total AS critical_dependence FROM (
        SELECT *, row_number() OVER (PARTITION BY country ORDER BY pt DESC, partner) AS rn FROM partner_totals) p
    JOIN totals t ON t.country = p.country WHERE rn = 1
)
SELECT c.country, critical_partner, round(critical_dependence, 6) AS critical_dependence,
       round(coalesce(h.s, 0), 6) AS leverage_held, round(coalesce(e.s, 0), 6) AS leverage_exposed,
       coalesce(h.n, 0) AS holds_over, coalesce(e.n, 0) AS exposed_to,
       round(coalesce(h.s, 0) - coalesce(e.s, 0), 6) AS net_leverage
FROM crit c LEFT JOIN held h ON h.country = c.country LEFT JOIN exposed e ON e.country = c.country
"""


def trade_leverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.leverage_profile(trade.leverage_pairs(_edges(spark, sf_dir)), ORIGIN))


TRADE_LEVERAGE_PROFILE_SQL = f"""
WITH {_PAIRS_SQL}, r AS (
    SELECT *, exposed_dependence - holder_dependence AS asymmetry,
           CASE WHEN holder_dependence > 0 THEN exposed_dependence / holder_dependence ELSE 'infinity'::DOUBLE END AS er
    FROM pairs
), a AS (SELECT *, 'holds' AS side FROM r WHERE holder = '{ORIGIN}' ORDER BY asymmetry DESC, exposed LIMIT 5),
b AS (SELECT *, 'exposed' AS side FROM r WHERE exposed = '{ORIGIN}' ORDER BY asymmetry DESC, holder LIMIT 5)
SELECT holder, exposed, round(bilateral_trade, 6) AS bilateral_trade, round(holder_dependence, 6) AS holder_dependence,
       round(exposed_dependence, 6) AS exposed_dependence, round(asymmetry, 6) AS asymmetry,
       round(er, 6) AS exposure_ratio, side
FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
"""


def trade_sector_fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.sector_fragility(trade_flows(spark, sf_dir).where(F.col("year") == YEAR)))


TRADE_SECTOR_FRAGILITY_SQL = f"""
WITH {TRADE_FLOWS_SQL}, e AS (
    SELECT sector, exporter, importer, sum(trade_value) AS w FROM trade_flows
    WHERE year = {YEAR} AND sector <> 'other' GROUP BY 1, 2, 3
), s AS (
    SELECT sector, importer AS country, sum(w) AS imp, sum(w * w) AS sq, count(*) FILTER (WHERE w > 0) AS n, max(w) AS top
    FROM e GROUP BY 1, 2
), first AS (
    SELECT sector, importer, exporter FROM (SELECT *, row_number() OVER (PARTITION BY sector, importer ORDER BY w DESC, exporter) rn FROM e)
    WHERE rn = 1
), pool AS (SELECT sector, count(DISTINCT exporter) AS p FROM e WHERE w > 0 GROUP BY 1),
t AS (SELECT country, sum(imp) AS total FROM s GROUP BY 1)
SELECT s.sector, s.country, round(imp, 6) AS sector_imports, round(sq / (imp * imp), 6) AS supplier_hhi,
       round(imp / total, 6) AS reliance, round(0.6 * sq / (imp * imp) + 0.4 * imp / total, 6) AS fragility,
       n AS supplier_count, first.exporter AS top_supplier, round(top / imp, 6) AS top_share, p AS supplier_pool
FROM s JOIN first ON first.sector = s.sector AND first.importer = s.country JOIN pool ON pool.sector = s.sector
JOIN t ON t.country = s.country
"""


def trade_supply_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.supply_ranking(trade_flows(spark, sf_dir).where(F.col("year") == YEAR)))


TRADE_SUPPLY_RANKING_SQL = f"""
WITH {TRADE_FLOWS_SQL}, x AS (
    SELECT sector, exporter, sum(trade_value) AS v FROM trade_flows WHERE year = {YEAR} AND sector <> 'other' GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY v DESC, exporter) AS rn FROM x)
SELECT sector, count(*) FILTER (WHERE v > 0) AS exporter_count, round(sum(v * v) / (sum(v) * sum(v)), 6) AS supply_hhi,
       round(sum(v) FILTER (WHERE rn <= 3) / sum(v), 6) AS top3_share,
       max(exporter) FILTER (WHERE rn = 1) AS dominant_supplier
FROM r GROUP BY 1
"""


def trade_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.shock(_edges(spark, sf_dir), ORIGIN))


def _shock_sql(steps: int = 3, severity: float = 0.5, factor: float = 0.7, digits: int = 6) -> str:
    parts = [
        f"""{_EDGES_SQL}, nodes AS (
    SELECT country, sum(m) AS imports FROM (
        SELECT exporter AS country, 0 AS m FROM edges UNION ALL SELECT importer, weight FROM edges) GROUP BY 1
), s0 AS (
    SELECT country, imports, CASE WHEN country = '{ORIGIN}' THEN {severity} ELSE 0 END AS impact,
           CASE WHEN country = '{ORIGIN}' THEN {severity} ELSE 0 END AS reduction FROM nodes
)"""
    ]
    for i in range(steps):
        parts.append(f"""h{i} AS (
    SELECT importer AS country, sum(weight * reduction) / sum(weight) AS lost FROM edges
    JOIN s{i} ON country = exporter GROUP BY 1
), i{i} AS (
    SELECT s.country, imports, reduction,
           CASE WHEN s.country = '{ORIGIN}' THEN impact ELSE greatest(impact, coalesce(lost, 0)) END AS impact
    FROM s{i} s LEFT JOIN h{i} h ON h.country = s.country
), s{i + 1} AS (
    SELECT country, imports, impact,
           CASE WHEN country = '{ORIGIN}' THEN reduction ELSE greatest(reduction, impact * {factor}) END AS reduction
    FROM i{i}
)""")
    return (
        "WITH " + ", ".join(parts) + f" SELECT country, round(imports, {digits}) AS imports, round(impact, {digits}) AS impact, "
        f"round(reduction, {digits}) AS reduction FROM s{steps}"
    )


def trade_top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.top_edges(_edges(spark, sf_dir), 25), 4)


TRADE_TOP_EDGES_SQL = f"""
WITH {_EDGES_SQL}
SELECT exporter, importer, round(weight, 4) AS weight FROM edges ORDER BY edges.weight DESC, exporter, importer LIMIT 25
"""


def trade_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trade.connectivity(_edges(spark, sf_dir)))


TRADE_CONNECTIVITY_SQL = f"""
WITH {_EDGES_SQL}, d AS (SELECT country, count(*) AS degree FROM sides GROUP BY 1),
g AS (SELECT max(degree) AS md, count(*) AS n, (SELECT count(*) FROM edges) AS e FROM d)
SELECT country, degree, round(degree / md, 6) AS degree_ratio, round(e / (n * (n - 1)), 6) AS density,
       round((degree / md + e / (n * (n - 1))) / 2, 6) AS connectivity
FROM d, g
"""


def trade_export_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = trade_flows(spark, sf_dir).withColumn("t", (F.col("year") * 4 + F.col("quarter") - 1).cast("double"))
    series = flows.groupBy(F.col("exporter").alias("country"), "t").agg((F.sum("trade_value") / 1e6).alias("y"))
    return _rounded(trade.linear_trend(series, ["country"], "t", "y"), 4)


TRADE_EXPORT_TREND_SQL = f"""
WITH {TRADE_FLOWS_SQL}, q AS (
    SELECT exporter AS country, CAST(year * 4 + quarter - 1 AS DOUBLE) AS t, sum(trade_value) / 1e6 AS y
    FROM trade_flows GROUP BY 1, 2
)
SELECT country, round(regr_slope(y, t), 4) AS slope, round(regr_intercept(y, t), 4) AS intercept,
       round(regr_r2(y, t), 4) AS r2,
       round(sqrt(greatest(0, regr_syy(y, t) * (1 - regr_r2(y, t)) / count(*))), 4) AS residual_std,
       count(*) AS n, max(t) AS last_t
FROM q GROUP BY 1
"""


def trade_year_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = trade.edges(trade_flows(spark, sf_dir), "year").groupBy(F.col("exporter").alias("country"), "year").agg(
        F.round(F.sum("weight"), 4).alias("gdp_usd")
    )
    known = totals.withColumn("gdp_usd", F.when(F.col("year") < 1999, F.col("gdp_usd")))
    return trade.newest_metadata(known, YEAR)


TRADE_YEAR_METADATA_SQL = f"""
WITH {TRADE_FLOWS_SQL}, t AS (
    SELECT exporter AS country, year, round(sum(trade_value), 4) AS gdp FROM trade_flows GROUP BY 1, 2
), k AS (SELECT country, year, CASE WHEN year < 1999 THEN gdp END AS gdp FROM t WHERE year BETWEEN {YEAR - 5} AND {YEAR})
SELECT country, max_by(gdp, year) FILTER (WHERE gdp IS NOT NULL) AS gdp_usd, CAST({YEAR} - max(year) AS INTEGER) AS lag_years
FROM k GROUP BY 1
"""


def trade_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.centrality(trade.edges(trade_flows(spark, sf_dir), "year"), "year"))


def trade_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.risk(_edges(spark, sf_dir)))


def trade_blocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = trade.edges(trade_flows(spark, sf_dir), "year")
    return _rounded(trade.bloc_evolution(graph.trade_blocs(edge, "year")))


def trade_bloc_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = _edges(spark, sf_dir)
    return _rounded(trade.inter_bloc_flows(edge, graph.trade_blocs(edge)), 4)


QUERIES = {
    f.__name__: f
    for f in (
        trade_concentration, trade_sector_rollup, trade_country_year_totals, trade_country_features,
        trade_data_quality, trade_quality_overall, trade_leverage_pairs, trade_country_leverage,
        trade_leverage_profile, trade_sector_fragility, trade_supply_ranking, trade_shock, trade_top_edges,
        trade_connectivity, trade_export_trend, trade_year_metadata, trade_centrality, trade_risk, trade_blocs,
        trade_bloc_flows,
    )
}
ORACLES = {
    name: text
    for name in QUERIES
    if (text := globals().get(f"{name.upper()}_SQL")) is not None
} | {"trade_shock": _shock_sql()}
