"""Logical tables over the driver's star schema, and the same tables as SQL.

Each function returns the DataFrame of one logical table; the constant beside it
is the text of the same table for a WITH clause. Dimension tables of fixed size
(nation) are broadcast, everything else is left to the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: HS chapters of the named sectors; all others are "other".
AGRICULTURE_CHAPTERS = (1, 24)
ENERGY_CHAPTER = 27
ELECTRONICS_CHAPTERS = (84, 85, 90)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sector_of_chapter(chapter: Column) -> Column:
    """Sector of an HS chapter; null or unknown chapters are "other"."""
    return (
        F.when(chapter.between(*AGRICULTURE_CHAPTERS), "agriculture")
        .when(chapter == ENERGY_CHAPTER, "energy")
        .when(chapter.isin(*ELECTRONICS_CHAPTERS), "electronics")
        .otherwise("other")
    )


def _nations(spark: SparkSession, sf_dir: str, key: str, name: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return F.broadcast(nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows between the supplier's and the customer's nation, self trade included."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_suppkey",
        F.pmod(F.col("l_partkey"), F.lit(97)).cast("int").alias("chapter"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("trade_value"),
        F.col("l_quantity").alias("quantity"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_nations(spark, sf_dir, "s_nationkey", "exporter"), "s_nationkey")
        .join(_nations(spark, sf_dir, "c_nationkey", "importer"), "c_nationkey")
        .select(
            "exporter",
            "importer",
            F.year("o_orderdate").alias("year"),
            F.quarter("o_orderdate").alias("quarter"),
            "chapter",
            sector_of_chapter(F.col("chapter")).alias("sector"),
            "trade_value",
            "quantity",
        )
    )


def trade_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between different nations with a known, non-negative value."""
    return raw_flows(spark, sf_dir).where((F.col("exporter") != F.col("importer")) & (F.col("trade_value") >= 0))


RAW_FLOWS_SQL = """raw_flows AS (
    SELECT ns.n_name AS exporter, nc.n_name AS importer, CAST(year(o_orderdate) AS INTEGER) AS year,
           CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(l_partkey % 97 AS INTEGER) AS chapter,
           CASE WHEN l_partkey % 97 BETWEEN 1 AND 24 THEN 'agriculture' WHEN l_partkey % 97 = 27 THEN 'energy'
                WHEN l_partkey % 97 IN (84, 85, 90) THEN 'electronics' ELSE 'other' END AS sector,
           l_extendedprice * (1 - l_discount) AS trade_value, l_quantity AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey
)"""
TRADE_FLOWS_SQL = f"""{RAW_FLOWS_SQL}, trade_flows AS (
    SELECT * FROM raw_flows WHERE exporter <> importer AND trade_value >= 0
)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote per nation and week: the week's last order decides; Y, N or A from its status."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    week = F.date_trunc("week", "o_orderdate").cast("date")
    last = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("country_code"), week.alias("resolution_day"))
        .agg(
            F.max_by(
                F.struct("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year")), "o_orderkey"
            ).alias("last")
        )
    )
    vote = F.when(F.col("last.o_orderstatus") == "O", "Y").when(F.col("last.o_orderstatus") == "F", "N").otherwise("A")
    return (
        last.join(_nations(spark, sf_dir, "country_code", "country_name"), "country_code")
        .select(
            "country_code",
            "country_name",
            F.col("last.year").alias("year"),
            F.date_format("resolution_day", "yyyy-MM-dd").alias("resolution"),
            F.col("last.o_orderpriority").alias("topic"),
            vote.alias("vote"),
        )
        .withColumn("vote_numeric", vote_number(F.col("vote")))
    )


def vote_number(vote: Column) -> Column:
    """Y, N and A as 1, -1 and 0; anything else, absence too, is null."""
    return F.when(vote == "Y", 1.0).when(vote == "N", -1.0).when(vote == "A", 0.0)


VOTES_SQL = """last_votes AS (
    SELECT c_nationkey AS country_code, CAST(date_trunc('week', o_orderdate) AS DATE) AS d,
           max(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), votes AS (
    SELECT v.country_code, n.n_name AS country_name, CAST(year(o.o_orderdate) AS INTEGER) AS year,
           strftime(v.d, '%Y-%m-%d') AS resolution, o.o_orderpriority AS topic,
           CASE o.o_orderstatus WHEN 'O' THEN 'Y' WHEN 'F' THEN 'N' ELSE 'A' END AS vote,
           CASE o.o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN -1.0 ELSE 0.0 END AS vote_numeric
    FROM last_votes v JOIN orders o ON o.o_orderkey = v.k JOIN nation n ON n.n_nationkey = v.country_code
)"""


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dyads from events: both sides, day, issue, deaths, kind of relation."""
    e = table(spark, sf_dir, "events")
    other = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(
        F.pmod("user_id", F.lit(25)).cast("int").alias("country_a"),
        F.pmod(other, F.lit(25)).cast("int").alias("country_b"),
        F.year("ts").alias("year"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("issue"),
        F.col("value").alias("deaths"),
        F.when(F.col("event_type").isin("error", "signup"), "conflict")
        .when(F.col("event_type") == "purchase", "peace_partner")
        .otherwise("neutral")
        .alias("relationship_type"),
        F.concat(F.col("event_type"), F.lit("-"), F.pmod("event_id", F.lit(50)).cast("string")).alias("conflict_name"),
    ).where("country_a IS NOT NULL AND country_b IS NOT NULL AND country_a <> country_b")


CONFLICTS_SQL = """conflicts AS (
    SELECT * FROM (
        SELECT CAST(user_id % 25 AS INTEGER) AS country_a,
               CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS INTEGER) AS country_b,
               CAST(year(ts) AS INTEGER) AS year, CAST(ts AS DATE) AS day, event_type AS issue, value AS deaths,
               CASE WHEN event_type IN ('error', 'signup') THEN 'conflict' WHEN event_type = 'purchase'
                    THEN 'peace_partner' ELSE 'neutral' END AS relationship_type,
               event_type || '-' || CAST(event_id % 50 AS VARCHAR) AS conflict_name
        FROM events)
    WHERE country_a IS NOT NULL AND country_b IS NOT NULL AND country_a <> country_b
)"""


def gdelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded daily events: actors, code, Goldstein value, articles, source."""
    e = table(spark, sf_dir, "events")
    other = F.get_json_object("props", "$.k").try_cast("long")

    def code(n: Column) -> Column:
        return F.concat(F.lit("C"), F.lpad(F.pmod(n, F.lit(25)).cast("string"), 2, "0"))

    return e.select(
        "event_id",
        F.date_format("ts", "yyyyMMdd").alias("sql_date"),
        code(F.col("user_id")).alias("a1"),
        code(other).alias("a2"),
        F.lpad((10 + F.pmod("event_id", F.lit(200))).cast("string"), 3, "0").alias("event_code"),
        F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("value") / 25 - 10)).alias("goldstein"),
        (1 + F.pmod("event_id", F.lit(20))).cast("int").alias("num_articles"),
        F.concat(F.lit("https://news.example/"), F.floor(F.col("event_id") / 2).cast("string")).alias("url"),
    )


GDELT_SQL = """gdelt AS (
    SELECT event_id, strftime(ts, '%Y%m%d') AS sql_date,
           'C' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS a1,
           'C' || lpad(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS VARCHAR), 2, '0') AS a2,
           lpad(CAST(10 + event_id % 200 AS VARCHAR), 3, '0') AS event_code,
           greatest(-10.0, least(10.0, value / 25 - 10)) AS goldstein,
           CAST(1 + event_id % 20 AS INTEGER) AS num_articles,
           'https://news.example/' || CAST(event_id // 2 AS VARCHAR) AS url
    FROM events
)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and quarter with indicators; some are null by rule, so that imputation has work.

    ``period`` counts quarters from the year 0.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("qty"), F.sum("l_discount").alias("disc"), F.count("*").alias("n_lines"))
    )
    period = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("period")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("c_nationkey", period)
        .agg(
            F.round(F.avg("o_totalprice"), 6).alias("price"),
            F.round(F.sum("disc") / F.sum("n_lines"), 6).alias("discount"),
            F.round(F.sum("qty"), 6).alias("volume"),
            F.round(F.avg("c_acctbal"), 6).alias("wealth"),
        )
    )
    gap = F.pmod(F.col("c_nationkey") + F.col("period"), F.lit(11)) == 0
    return base.join(_nations(spark, sf_dir, "c_nationkey", "iso3"), "c_nationkey").select(
        "iso3",
        "period",
        F.when(~gap, F.col("price")).alias("price"),
        "discount",
        F.when(F.pmod("period", F.lit(13)) != F.pmod("c_nationkey", F.lit(13)), F.col("volume")).alias("volume"),
        "wealth",
        F.round(F.col("price") / 10000 + F.col("wealth") / 1000 - F.col("discount") * 10, 6).alias("composite"),
    )


PANEL_SQL = """order_lines AS (
    SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_discount) AS disc, count(*) AS n_lines FROM lineitem GROUP BY 1
), panel_base AS (
    SELECT c_nationkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS period,
           round(avg(o_totalprice), 6) AS price, round(sum(disc) / sum(n_lines), 6) AS discount,
           round(sum(qty), 6) AS volume, round(avg(c_acctbal), 6) AS wealth
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN order_lines ON l_orderkey = o_orderkey GROUP BY 1, 2
), panel AS (
    SELECT n_name AS iso3, period, CASE WHEN (c_nationkey + period) % 11 <> 0 THEN price END AS price, discount,
           CASE WHEN period % 13 <> c_nationkey % 13 THEN volume END AS volume, wealth,
           round(price / 10000 + wealth / 1000 - discount * 10, 6) AS composite
    FROM panel_base JOIN nation ON n_nationkey = c_nationkey
)"""
