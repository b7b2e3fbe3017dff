"""Queries that join the agents: insights, fusion, questions; and windows over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import forecast, fusion, policy, questions, trade
from geolith.sources.views import CONFLICTS_SQL, TRADE_FLOWS_SQL, conflicts, table, trade_flows
from geolith.streaming import events as stream

from .trade import _rounded


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights of a trade and an events agent about every nation, one per facet."""
    nothing = [F.lit(None).cast("string").alias(c) for c in ("sector", "pair", "caveat")]
    flows = trade_flows(spark, sf_dir)
    edge = trade.edges(flows.where("year = 2000"))
    hhi = trade.concentration(edge).select(
        F.lit("trade").alias("agent"), F.col("country").alias("entity_iso3"), F.lit("concentration").alias("facet"),
        F.concat(F.lit("HHI "), F.format_number("hhi", 3)).alias("claim"), F.col("hhi").alias("score"),
        F.round(F.least(F.lit(1.0), F.col("partner_count") / 40), 6).alias("confidence"), *nothing,
    )
    friction = (
        policy.timeline(conflicts(spark, sf_dir))
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("country") == F.col("n_nationkey"))
        .select(
            F.lit("events").alias("agent"), F.col("n_name").alias("entity_iso3"), F.lit("concentration").alias("facet"),
            F.concat(F.lit("conflicts "), F.col("conflicts").cast("string")).alias("claim"),
            F.col("conflicts").cast("double").alias("score"),
            F.round(F.least(F.lit(0.7), 0.3 + 0.1 * F.log10(1.0 + F.col("conflicts"))), 6).alias("confidence"), *nothing,
        )
    )
    return hhi.unionByName(friction)


def fusion_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = fusion.dedupe_insights(_insights(spark, sf_dir))
    both = fusion.corroborations(single).select(
        "kind", "entity_iso3", "facet", "agents", "confidence", F.lit(None).cast("string").alias("caveat")
    )
    one = single.select(
        F.lit("insight").alias("kind"), "entity_iso3", "facet", F.col("agent").alias("agents"), "confidence", "caveat"
    )
    ranked = fusion.rank_findings(both.unionByName(one), ["concentration"], ["NATION_1", "NATION_2"], "trade")
    return _rounded(ranked.drop("caveat"))


FUSION_FINDINGS_SQL = f"""
WITH {TRADE_FLOWS_SQL}, {CONFLICTS_SQL}, s AS (
    SELECT exporter AS c, importer AS p FROM trade_flows WHERE year = 2000
    UNION SELECT importer, exporter FROM trade_flows WHERE year = 2000
), t AS (SELECT 'trade' AS agent, c AS e, round(least(1.0, count(*) / 40), 6) AS conf FROM s GROUP BY 2),
k AS (
    SELECT 'events' AS agent, n_name AS e, round(least(0.7, 0.3 + 0.1 * log10(1.0 + count(*))), 6) AS conf
    FROM (SELECT country_a AS c FROM conflicts WHERE relationship_type = 'conflict'
          UNION ALL SELECT country_b FROM conflicts WHERE relationship_type = 'conflict')
    JOIN nation ON n_nationkey = c GROUP BY 2
), i AS (SELECT * FROM t UNION ALL SELECT * FROM k),
f AS (
    SELECT 'corroboration' AS kind, e, string_agg(agent, ',' ORDER BY agent) AS agents,
           least(0.97, 1 - exp(sum(ln(greatest(1 - conf, 1e-9))))) AS confidence FROM i GROUP BY 2 HAVING count(*) >= 2
    UNION ALL SELECT 'insight', e, agent, conf FROM i
), r AS (
    SELECT *, round(confidence * 1.3 * CASE kind WHEN 'insight' THEN
               CASE WHEN e IN ('NATION_1', 'NATION_2') THEN 1.0 ELSE 0.7 END * CASE agents WHEN 'trade' THEN 1.1 ELSE 1.0 END
           ELSE 1.2 END, 9) AS rs
    FROM f
)
SELECT kind, e AS entity_iso3, 'concentration' AS facet, agents, round(confidence, 6) AS confidence,
       round(rs, 6) AS rank_score,
       (row_number() OVER (ORDER BY kind = 'insight', rs DESC, e, agents, kind))::INTEGER AS position
FROM r
"""


def fusion_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _insights(spark, sf_dir).withColumn("confidence", F.col("confidence") * 2)
    return fusion.invalid_insights(rows).groupBy("problem").agg(F.count("*").alias("n"))


FUSION_INVALID_SQL = FUSION_FINDINGS_SQL.split(", f AS (")[0].split("),\nf AS (")[0] + """)
SELECT 'confidence outside 0..1' AS problem, count(*) AS n FROM i WHERE 2 * conf > 1 HAVING count(*) > 0
"""


def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )
    names = table(spark, sf_dir, "nation").select(
        F.element_at(F.array(F.lit("the"), F.lit("un"), F.lit("der"), F.lit("los")), (F.pmod("n_nationkey", F.lit(4)) + 1).cast("int")).alias("alias"),
        F.col("n_name").alias("iso3"),
    ).where("length(iso3) = 8")
    return questions.parse(asked, names)


def planted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a question for every order, in one of five forms, about nations of the tables."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(25)).cast("long").alias("ka"), F.pmod(F.col("o_custkey") * 7 + 3, F.lit(25)).cast("long").alias("kb"),
        F.year("o_orderdate").cast("string").alias("y"),
    )
    a, b = F.broadcast(nation.select(F.col("k").alias("ka"), F.col("n_name").alias("a"))), F.broadcast(nation.select(F.col("k").alias("kb"), F.col("n_name").alias("b")))
    form = F.pmod("id", F.lit(5))
    text = (
        F.when(form == 0, F.concat(F.lit("What happens if "), "a", F.lit(" stops exporting oil to "), "b", F.lit("?")))
        .when(form == 1, F.concat(F.lit("Forecast the grain trade of  "), F.lower("a"), F.lit(".")))
        .when(form == 2, F.concat(F.lit("How do "), "a", F.lit(" and "), "b", F.lit(" relate in "), "y", F.lit("?")))
        .when(form == 3, F.lit("Top three countries by chip exports"))
        .otherwise(F.concat(F.lit("Recent events in "), "a", F.lit(", please")))
    )
    return asked.join(a, "ka").join(b, "kb").select("id", text.alias("text"))


def question_gold_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of planted questions, whose right answers follow from how they are made."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("iso3"))
    return questions.parse(planted_questions(spark, sf_dir), names)


QUESTION_GOLD_PLANS_SQL = """
WITH q AS (
    SELECT o_orderkey AS id, o_orderkey % 5 AS form, a.n_name AS a, b.n_name AS b, year(o_orderdate)::INTEGER AS y
    FROM orders JOIN nation a ON a.n_nationkey = o_custkey % 25 JOIN nation b ON b.n_nationkey = (o_custkey * 7 + 3) % 25
), p AS (SELECT *, CASE WHEN a = b THEN a WHEN a < b THEN a || ',' || b ELSE b || ',' || a END AS ab FROM q)
SELECT id, CASE form WHEN 0 THEN 'shock' WHEN 1 THEN 'forecast' WHEN 2 THEN CASE WHEN a = b THEN 'profile' ELSE 'bilateral' END
                     WHEN 3 THEN 'ranking' ELSE 'events' END AS intent,
       CASE form WHEN 0 THEN ab WHEN 2 THEN ab WHEN 3 THEN '' ELSE a END AS countries, CASE form WHEN 2 THEN y END AS year,
       CASE form WHEN 0 THEN 'energy' WHEN 1 THEN 'agriculture' WHEN 3 THEN 'electronics' ELSE 'all' END AS sector,
       CASE form WHEN 0 THEN 1.0::DOUBLE END AS severity, (CASE form WHEN 3 THEN 3 ELSE 5 END)::INTEGER AS "limit", 1.0::DOUBLE AS understanding
FROM p
"""


def question_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    plain = questions.reformulate(F.coalesce("text", F.lit("")))
    return asked.select("conv_id", "turn", F.length(plain).alias("chars"), (plain != F.coalesce("text", F.lit(""))).alias("changed"))


QUESTION_REWRITES_SQL = r"""
WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'),
b AS (SELECT *, regexp_replace(regexp_replace(t, '\bu\.?s\.?a?\.?(\W|$)', 'United States\1', 'gi'), '\buk\b', 'United Kingdom', 'gi') AS x FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '\bper ?cent\b', '%', 'gi'), '\bhalf\b', '50%', 'gi'), '\btop ten\b', 'top 10', 'gi') AS y FROM b),
d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(y, '\btop five\b', 'top 5', 'gi'), '\btop three\b', 'top 3', 'gi'), '\bwhat happens if\b', 'shock:', 'gi') AS z FROM c),
e AS (SELECT *, trim(regexp_replace(z, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS plain FROM d)
SELECT conv_id, turn, length(plain)::INTEGER AS chars, plain <> t AS changed FROM e
"""


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = stream.tumbling(table(spark, sf_dir, "events"))
    return _rounded(daily.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total", "largest"), 4)


STREAM_DAILY_SQL = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total,
       round(max(value), 4) AS largest
FROM events GROUP BY 1, 2
"""


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream.sessions(table(spark, sf_dir, "events"))
    start = F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start")
    return _rounded(found.select("user_id", start, "n", "total"), 4)


STREAM_SESSIONS_SQL = """
WITH g AS (
    SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, round(sum(value), 4) AS total
FROM s GROUP BY user_id, sid
"""


def trade_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = trade_flows(spark, sf_dir).withColumn("t", F.col("year") * 4 + F.col("quarter"))
    series = flows.groupBy(F.col("exporter").alias("country"), "t").agg(F.sum("trade_value").alias("exports"))
    return _rounded(forecast.forecast(series, "country", "t", "exports"), 4)


QUERIES = {
    f.__name__: f
    for f in (
        fusion_findings, fusion_invalid, question_plans, question_gold_plans, question_rewrites, stream_daily, stream_sessions,
        trade_forecast,
    )
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
