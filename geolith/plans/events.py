"""Event queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import events, trade
from geolith.sources.views import GDELT_SQL, TRADE_FLOWS_SQL, gdelt, trade_flows

from .trade import _rounded

COUNTRY = "C03"


def _sql_case(column: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in events.ROOT_NAMES.items())
    return f"CASE substr({column}, 1, 2) {whens} ELSE 'Other' END"


_PREPARED_SQL = f"""{GDELT_SQL}, prepared AS (
    SELECT *, substr(event_code, 1, 2) AS root, {_sql_case("event_code")} AS event_type,
           CASE WHEN goldstein >= 5 THEN 'strongly cooperative' WHEN goldstein >= 1 THEN 'cooperative'
                WHEN goldstein > -1 THEN 'neutral' WHEN goldstein >= -5 THEN 'tense' ELSE 'highly conflictual' END AS tone,
           CASE WHEN substr(event_code, 1, 2)::INT BETWEEN 1 AND 8 THEN 'Diplomatic Cooperation'
                WHEN substr(event_code, 1, 2)::INT BETWEEN 9 AND 12 THEN 'Diplomatic Pressure'
                WHEN substr(event_code, 1, 2)::INT BETWEEN 13 AND 16 THEN 'Escalation & Protest'
                WHEN substr(event_code, 1, 2)::INT BETWEEN 17 AND 20 THEN 'Conflict & Violence' ELSE 'Other' END AS theme,
           CASE WHEN a1 = '{COUNTRY}' AND a2 = '{COUNTRY}' THEN 'Both' WHEN a1 = '{COUNTRY}' THEN 'Initiator'
                ELSE 'Recipient' END AS role, a1 = '{COUNTRY}' AND a2 = '{COUNTRY}' AS domestic
    FROM (SELECT * FROM gdelt WHERE a1 = '{COUNTRY}' OR a2 = '{COUNTRY}'
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id) = 1)
)"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.prepare(gdelt(spark, sf_dir), COUNTRY)


def events_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["event_id", "a1", "a2", "event_type", "tone", "theme", "role", "domestic", "goldstein", "num_articles"]
    return _rounded(_prepared(spark, sf_dir).select(*columns))


EVENTS_PREPARED_SQL = f"""
WITH {_PREPARED_SQL}
SELECT event_id, a1, a2, event_type, tone, theme, role, domestic, round(goldstein, 6) AS goldstein, num_articles
FROM prepared
"""


def events_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = events.top_events(_prepared(spark, sf_dir))
    return _rounded(top.select("event_id", "a1", "a2", "root", "goldstein", "num_articles", events.event_sentence().alias("sentence")))


EVENTS_TOP5_SQL = f"""
WITH {_PREPARED_SQL}, best AS (
    SELECT * FROM prepared QUALIFY row_number() OVER (PARTITION BY a1, a2, root ORDER BY num_articles DESC, event_id) = 1
), kept AS (SELECT * FROM best WHERE a1 <> a2 OR NOT EXISTS (SELECT 1 FROM best WHERE a1 <> a2)),
picked AS (
    SELECT * FROM (SELECT * FROM kept ORDER BY goldstein, event_id LIMIT 3)
    UNION SELECT * FROM (SELECT * FROM kept ORDER BY goldstein DESC, event_id LIMIT 2)
)
SELECT event_id, a1, a2, root, round(goldstein, 6) AS goldstein, num_articles,
       a1 || ' and ' || a2 || ': ' || lower(event_type) || ' (' || lower(tone) || ', ' || num_articles || ' articles)'
           AS sentence
FROM picked ORDER BY abs(picked.goldstein) DESC, event_id LIMIT 5
"""


def events_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.partners(_prepared(spark, sf_dir), COUNTRY))


_PARTNER_SQL = f"""{_PREPARED_SQL}, p AS (
    SELECT *, CASE role WHEN 'Recipient' THEN a1 ELSE a2 END AS partner FROM prepared
)"""
EVENTS_PARTNERS_SQL = f"""
WITH {_PARTNER_SQL}
SELECT partner, count(*) AS events, round(avg(goldstein), 6) AS mean_goldstein FROM p WHERE partner <> '{COUNTRY}'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8
"""


def events_partner_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.partner_bands(_prepared(spark, sf_dir), COUNTRY)


EVENTS_PARTNER_BANDS_SQL = f"""
WITH {_PARTNER_SQL}
SELECT partner, count(*) FILTER (WHERE goldstein <= -5) AS conflict, count(*) FILTER (WHERE goldstein >= 5) AS cooperative,
       count(*) FILTER (WHERE goldstein > -5 AND goldstein < 5) AS neutral
FROM p WHERE partner <> '{COUNTRY}' GROUP BY 1
"""


def events_day_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.day_metrics(_prepared(spark, sf_dir), "sql_date"))


EVENTS_DAY_METRICS_SQL = f"""
WITH {_PREPARED_SQL}
SELECT sql_date, count(*) AS events, round(avg(goldstein), 6) AS mean_goldstein,
       round(100 * avg(CASE WHEN role = 'Initiator' THEN 1 ELSE 0 END), 6) AS initiator_pct,
       count(*) FILTER (WHERE domestic) AS domestic, count(*) FILTER (WHERE NOT domestic) AS international,
       count(*) FILTER (WHERE a2 = 'NAN') AS ambiguous, sum(num_articles)::BIGINT AS articles
FROM prepared GROUP BY 1
"""


def events_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.value_counts(_prepared(spark, sf_dir), "event_type"))


EVENTS_TYPE_COUNTS_SQL = f"""
WITH {_PREPARED_SQL}
SELECT event_type, count(*) AS events, round(avg(goldstein), 6) AS mean_goldstein FROM prepared GROUP BY 1
"""


def events_scope_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.scope_statistics(_prepared(spark, sf_dir)))


EVENTS_SCOPE_STATISTICS_SQL = f"""
WITH {_PREPARED_SQL}, t AS (
    SELECT domestic, event_type, count(*) AS n, sum(goldstein) AS g, count(*) FILTER (WHERE role = 'Initiator') AS i,
           round(sum(goldstein) / count(*), 9) AS m
    FROM prepared GROUP BY 1, 2
), r AS (
    SELECT *, row_number() OVER (PARTITION BY domestic ORDER BY n DESC, event_type) AS by_n,
           row_number() OVER (PARTITION BY domestic ORDER BY m, event_type) AS worst,
           row_number() OVER (PARTITION BY domestic ORDER BY m DESC, event_type) AS best FROM t
)
SELECT domestic, sum(n)::BIGINT AS events, round(sum(g) / sum(n), 6) AS mean_goldstein, sum(i)::BIGINT AS initiated,
       max(event_type) FILTER (WHERE by_n = 1) AS top_type, max(event_type) FILTER (WHERE worst = 1) AS worst_type,
       max(event_type) FILTER (WHERE best = 1) AS best_type
FROM r GROUP BY 1
"""


def events_actor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.actor_network(gdelt(spark, sf_dir))[1])


EVENTS_ACTOR_EDGES_SQL = f"""
WITH {GDELT_SQL}, top AS (
    SELECT actor FROM (SELECT a1 AS actor FROM gdelt UNION ALL SELECT a2 FROM gdelt) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50
)
SELECT least(a1, a2) AS source, greatest(a1, a2) AS target, count(*) AS n, round(avg(goldstein), 6) AS mean_goldstein,
       array_to_string(list_slice(list_sort(list_distinct(list({_sql_case("event_code")}))), 1, 3), ', ') AS types
FROM gdelt WHERE a1 <> a2 AND a1 IN (SELECT actor FROM top) AND a2 IN (SELECT actor FROM top) GROUP BY 1, 2
"""


def events_actor_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        events.actor_events(gdelt(spark, sf_dir), COUNTRY).select("event_id", "a1", "a2", "event_type", "goldstein", "num_articles")
    )


EVENTS_ACTOR_EXPLORER_SQL = f"""
WITH {GDELT_SQL}, t AS (
    SELECT *, {_sql_case("event_code")} AS event_type FROM gdelt WHERE a1 = '{COUNTRY}' OR a2 = '{COUNTRY}'
)
SELECT event_id, a1, a2, event_type, round(goldstein, 6) AS goldstein, num_articles FROM t
QUALIFY row_number() OVER (PARTITION BY a1, a2, event_type, round(goldstein, 1) ORDER BY num_articles DESC, event_id) = 1
"""


def events_historical_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = trade.edges(trade_flows(spark, sf_dir).withColumn("period", F.col("year") * 4 + F.col("quarter")), "period")
    dyads = edge.groupBy(events.dyad_key(F.col("exporter"), F.col("importer")).alias("dyad"), "period").agg(
        F.round(
            (F.sum(F.when(F.col("exporter") < F.col("importer"), F.col("weight")).otherwise(-F.col("weight"))))
            / F.sum("weight"),
            4,
        ).alias("s")
    )
    return _rounded(events.historical_context(dyads, "period"))


EVENTS_HISTORICAL_CONTEXT_SQL = f"""
WITH {TRADE_FLOWS_SQL}, d AS (
    SELECT least(exporter, importer) || '-' || greatest(exporter, importer) AS dyad, year * 4 + quarter AS period,
           round(sum(CASE WHEN exporter < importer THEN trade_value ELSE -trade_value END) / sum(trade_value), 4) AS s
    FROM trade_flows GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY dyad ORDER BY period DESC) AS rn FROM d),
m AS (
    SELECT dyad, avg(s) AS mean, round(avg(s) FILTER (WHERE rn <= 3) - avg(s) FILTER (WHERE rn > 3), 9) AS ch
    FROM r WHERE rn <= 10 GROUP BY 1
)
SELECT dyad, round(mean, 6) AS mean,
       CASE WHEN ch > 0.05 THEN 'improving' WHEN ch < -0.05 THEN 'deteriorating' ELSE 'stable' END AS trend,
       CASE WHEN round(mean, 4) >= 0.3 THEN 'strongly cooperative' WHEN round(mean, 4) >= 0.1 THEN 'moderately cooperative'
            WHEN round(mean, 4) >= -0.1 THEN 'broadly neutral' WHEN round(mean, 4) >= -0.3 THEN 'moderately tense'
            ELSE 'historically adversarial' END AS label
FROM m
"""


def events_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.kmeans_themes(_prepared(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        events_prepared, events_top5, events_partners, events_partner_bands, events_day_metrics, events_type_counts,
        events_scope_statistics, events_actor_edges, events_actor_explorer, events_historical_context, events_themes,
    )
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
