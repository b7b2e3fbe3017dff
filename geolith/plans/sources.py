"""Queries through files: tables are written as their sources bring them, read back and used; and what is served from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import formats
from geolith.operators import events, fusion, graph, policy, questions, trade
from geolith.session import scratch_folder
from geolith.sources import readers
from geolith.sources.views import (
    CONFLICTS_SQL, GDELT_SQL, PANEL_SQL, RAW_FLOWS_SQL, TRADE_FLOWS_SQL, VOTES_SQL, conflicts, gdelt, panel, raw_flows,
    table, trade_flows, votes,
)
from geolith.streaming import events as stream
from geolith.streaming.updates import Updates

from . import cache
from .events import COUNTRY, EVENTS_PREPARED_SQL
from .briefing import FUSION_FINDINGS_SQL, _insights, fusion_findings
from .trade import ORIGIN, TRADE_QUALITY_OVERALL_SQL, YEAR, _rounded, _shock_sql


def sources_trade_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly trade files: flows by sector and year, the year also from the file's name."""
    code = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("code"))
    a, b = F.broadcast(code.toDF("exporter", "i")), F.broadcast(code.toDF("importer", "j"))
    rows = raw_flows(spark, sf_dir).join(a, "exporter").join(b, "importer").select(
        F.col("year").alias("t"), "i", "j", (F.col("chapter") * 10000 + 1234).alias("k"), F.col("trade_value").alias("v"), F.col("quantity").alias("q"),
        F.format_string("HS92_Y%d_V202401", "year").alias("BACI"),
    )
    folder = scratch_folder(spark, "trade")
    rows.write.partitionBy("BACI").option("header", True).csv(folder)
    raw = readers.read_baci(spark, folder).where("t = file_year")
    flows = readers.baci_flows(raw, code.select(F.col("code").alias("country_code"), F.col("name").alias("country_name")))
    return _rounded(flows, 4)


SOURCES_TRADE_FILES_SQL = f"""
WITH {RAW_FLOWS_SQL}
SELECT exporter, importer, year, sector, round(sum(trade_value), 4) AS trade_value, round(sum(quantity), 4) AS quantity
FROM raw_flows WHERE exporter <> importer GROUP BY ALL
"""


def sources_event_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headless event files of 58 columns, read by position and counted by country and event."""
    held = {1: "sql_date", 7: "a1", 17: "a2", 26: "event_code", 30: "goldstein", 33: "num_articles", 57: "url"}
    wide = gdelt(spark, sf_dir).select(*((F.col(held[i]) if i in held else F.lit(f"x{i}")).cast("string").alias(f"c{i}") for i in range(58)))
    folder = scratch_folder(spark, "events")
    wide.write.option("sep", "\t").csv(folder)
    found = readers.read_gdelt(spark, folder)
    return found.groupBy("a1", "event_code", "actor1").agg(F.count("*").alias("n"), F.round(F.sum(F.col("goldstein").try_cast("double")), 4).alias("total"))


SOURCES_EVENT_FILE_SQL = f"""
WITH {GDELT_SQL} SELECT a1, event_code, 'x6' AS actor1, count(*) AS n, round(sum(goldstein), 4) AS total FROM gdelt GROUP BY 1, 2
"""


def sources_day_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries that each day's events name."""
    return readers.day_countries(gdelt(spark, sf_dir))


SOURCES_DAY_COUNTRIES_SQL = f"""
WITH {GDELT_SQL} SELECT sql_date, a1 AS country FROM gdelt WHERE a1 IS NOT NULL UNION SELECT sql_date, a2 FROM gdelt WHERE a2 IS NOT NULL
"""


def sources_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table as they are."""
    return readers.preview(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


SOURCES_PREVIEW_SQL = """
SELECT to_json({'s_suppkey': s_suppkey, 's_name': s_name, 's_nationkey': s_nationkey})::VARCHAR AS row
FROM (SELECT * FROM supplier ORDER BY s_suppkey, s_name LIMIT 20)
"""


def sources_dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dyad files: known scores from 1990 on, in order of years per dyad."""
    year = F.substring("sql_date", 1, 4)
    rows = gdelt(spark, sf_dir).where("a1 <> a2").groupBy("a1", "a2", year.alias("year")).agg(
        F.when(F.count("*") > 1, F.round(F.avg("goldstein"), 4)).alias("s"), F.count("*").alias("d")
    )
    folder = scratch_folder(spark, "dyads")
    rows.select("a1", "a2", F.lit(1).alias("ca"), F.lit(2).alias("cb"), "year", "s", "d", F.lit("more").alias("rest")).write.option("header", True).csv(folder)
    series = readers.dyad_series(readers.read_dyads(spark, folder))
    return series.select("dyad", F.size("series").cast("long").alias("n"), F.aggregate("series", F.lit(0.0), lambda a, x: a + x["d"]).alias("total"), F.get("series", F.lit(0))["year"].alias("first_year"))


SOURCES_DYADS_SQL = f"""
WITH {GDELT_SQL}, g AS (SELECT a1, a2, substr(sql_date, 1, 4)::INTEGER AS year, count(*) AS d FROM gdelt WHERE a1 <> a2 GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT least(a1, a2) || '-' || greatest(a1, a2) AS dyad, count(*) AS n, sum(d)::DOUBLE AS total, min(year) AS first_year FROM g WHERE year >= 1990 GROUP BY 1
"""


def sources_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by years, of which one is written anew: the others stay."""
    edge = trade.edges(trade_flows(spark, sf_dir), "year")
    folder = scratch_folder(spark, "years")
    readers.write_years(edge, folder)
    readers.write_years(edge.where("year = 1995 AND exporter <= 'NATION_15'"), folder)
    return _rounded(spark.read.parquet(folder).groupBy("year").agg(F.count("*").alias("n"), F.sum("weight").alias("total")), 2)


SOURCES_REBUILD_SQL = f"""
WITH {TRADE_FLOWS_SQL}, e AS (SELECT year, exporter, importer, sum(trade_value) AS w FROM trade_flows GROUP BY ALL)
SELECT year, count(*) AS n, round(sum(w), 2) AS total FROM e WHERE year <> 1995 OR exporter <= 'NATION_15' GROUP BY 1
"""


def sources_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed service responses: known values of three-letter countries by year."""
    yearly = panel(spark, sf_dir).groupBy("iso3", F.floor(F.col("period") / 4).alias("year")).agg(F.max("volume").alias("value"))
    code = F.format_string("N%02d", F.regexp_extract("iso3", r"\d+", 0).cast("int"))
    row = F.struct(F.when(F.col("iso3") != "NATION_3", code).otherwise("").alias("countryiso3code"), F.col("year").cast("string").alias("date"), "value")
    bodies = yearly.groupBy("iso3").agg(F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list(row), {"ignoreNullFields": "false"}), F.lit("]")).alias("body"))
    folder = scratch_folder(spark, "indicators")
    bodies.repartition("iso3").write.partitionBy("iso3").text(folder)
    return _rounded(readers.read_world_bank(spark, f"{folder}/*/*.txt", "volume"), 4)


SOURCES_INDICATORS_SQL = f"""
WITH {PANEL_SQL}
SELECT printf('N%02d', regexp_extract(iso3, '[0-9]+')::INT) AS country, (period // 4)::INTEGER AS year, round(max(volume), 4) AS volume
FROM panel WHERE iso3 <> 'NATION_3' GROUP BY 1, 2 HAVING max(volume) IS NOT NULL
"""


_materialised: dict[tuple[str, str], tuple[str, tuple]] = {}


def _state_of(flows: DataFrame) -> tuple:
    """What changes with the tables that ``flows`` reads: names, sizes and times of their files."""
    spark = flows.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(flows.inputFiles())]
    found = (p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p) for p in paths)
    return tuple((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found)


def materialised(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the trade tables of ``sf_dir``, built by the first query that needs them and anew when their files change."""
    flows = trade_flows(spark, sf_dir)
    key, state = (spark.sparkContext.applicationId, sf_dir), _state_of(flows)
    if key not in _materialised or _materialised[key][1] != state:
        folder = scratch_folder(spark, "trade-tables")
        cache.build(flows, folder)
        _materialised[key] = folder, state
    return _materialised[key][0]


def cache_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of a year from the materialised edges and centralities."""
    folder = materialised(spark, sf_dir)
    edge = cache.edges_of(spark, folder, YEAR, "all").select("exporter", "importer", F.col("trade_value").alias("weight"))
    return _rounded(graph.risk(edge, cache.centrality_of(spark, folder, YEAR)))


def cache_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shock to a year's trade, read from the materialised edges."""
    edge = cache.edges_of(spark, materialised(spark, sf_dir), YEAR, "all").select("exporter", "importer", F.col("trade_value").alias("weight"))
    return _rounded(trade.shock(edge, ORIGIN))


CACHE_SHOCK_SQL = _shock_sql()


def cache_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data quality over all years from the materialised table."""
    return _rounded(cache.quality_of(spark, materialised(spark, sf_dir)))


CACHE_QUALITY_SQL = TRADE_QUALITY_OVERALL_SQL.replace("FROM raw_flows", "FROM trade_flows").replace(RAW_FLOWS_SQL, TRADE_FLOWS_SQL)


def cache_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a year and sector from the materialised tables."""
    return _rounded(cache.edges_of(spark, materialised(spark, sf_dir), 1996, "energy"), 4)


CACHE_EDGES_SQL = f"""
WITH {TRADE_FLOWS_SQL}
SELECT exporter, importer, year, sector, round(sum(trade_value), 4) AS trade_value FROM trade_flows
WHERE year = 1996 AND sector = 'energy' GROUP BY ALL
"""


def cache_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country's exports and imports in every year, from the materialised tables."""
    found = cache.history(spark, materialised(spark, sf_dir), "NATION_7")
    return found.select("year", F.round("exports", 4).alias("exports"), F.round("imports", 4).alias("imports"))


CACHE_HISTORY_SQL = f"""
WITH {TRADE_FLOWS_SQL}
SELECT year, round(sum(CASE WHEN exporter = 'NATION_7' THEN trade_value ELSE 0 END), 4) AS exports,
       round(sum(CASE WHEN importer = 'NATION_7' THEN trade_value ELSE 0 END), 4) AS imports
FROM trade_flows WHERE 'NATION_7' IN (exporter, importer) GROUP BY 1
"""


def fusion_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings name their sources."""
    return fusion.citation_rate(fusion_findings(spark, sf_dir))


FUSION_CITATIONS_SQL = f"SELECT kind, count(*) AS n, avg((agents <> '')::INT)::DOUBLE AS cited FROM ({FUSION_FINDINGS_SQL}) GROUP BY 1"


def fusion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade agent's best evidence per country."""
    found = fusion.best_evidence(_insights(spark, sf_dir), "trade", "concentration", "trade")
    return found.select("entity_iso3", F.round("trade_confidence", 6).alias("trade_confidence"))


FUSION_EVIDENCE_SQL = f"""
WITH {TRADE_FLOWS_SQL}, s AS (
    SELECT exporter AS c, importer AS p FROM trade_flows WHERE year = 2000 UNION SELECT importer, exporter FROM trade_flows WHERE year = 2000
)
SELECT c AS entity_iso3, round(least(1.0, count(*) / 40), 6) AS trade_confidence FROM s GROUP BY 1
"""


def fusion_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three components and the one that limits it."""
    parts = panel(spark, sf_dir).select("iso3", "period", (F.col("discount") * 10).alias("completeness"), F.lit(0.6).alias("connectivity"), (F.pmod("period", F.lit(10)) / 10.0).alias("propagation"))
    found = fusion.assess_confidence(parts, ["completeness", "connectivity", "propagation"])
    return _rounded(found.select("iso3", "period", "confidence", "limiting"), 5)


FUSION_CONFIDENCE_SQL = f"""
WITH {PANEL_SQL}, x AS (SELECT iso3, period, discount * 10 AS a, 0.6 AS b, (period % 10) / 10.0 AS c FROM panel)
SELECT iso3, period, round((a + b + c) / 3, 5) AS confidence,
       CASE WHEN round(a, 9) <= least(b, c) THEN 'completeness' WHEN b <= c THEN 'connectivity' ELSE 'propagation' END AS limiting FROM x
"""


def policy_edges_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of some issues and a least intensity."""
    edges = policy.filter_edges(policy.conflict_edges(conflicts(spark, sf_dir)), ["error", "purchase"], 60.0)
    return _rounded(edges.select("a", "b", "issues", "conflict_count", "avg_intensity"))


POLICY_EDGES_FILTERED_SQL = f"""
WITH {CONFLICTS_SQL}, e AS (
    SELECT least(country_a, country_b) AS a, greatest(country_a, country_b) AS b, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues,
           count(*) FILTER (WHERE relationship_type = 'conflict') AS conflict_count, avg(deaths) FILTER (WHERE deaths <> 0) AS i,
           bool_or(issue IN ('error', 'purchase')) AS wanted FROM conflicts GROUP BY 1, 2
)
SELECT a, b, issues, conflict_count, round(i, 6) AS avg_intensity FROM e WHERE wanted AND coalesce(i, 0) >= 60
"""


def policy_common_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that votes, trade and a shorter range have in common."""
    return policy.common_years(votes(spark, sf_dir), trade_flows(spark, sf_dir), spark.range(1994, 1998).select(F.col("id").cast("int").alias("year")))


POLICY_COMMON_YEARS_SQL = f"""
WITH {VOTES_SQL}, {TRADE_FLOWS_SQL} SELECT year FROM votes INTERSECT SELECT year FROM trade_flows INTERSECT SELECT range::INTEGER FROM range(1994, 1998)
"""


def events_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a served table found again among the events by address, type and value."""
    all_events = gdelt(spark, sf_dir).withColumn("event_type", events.root_name(F.col("event_code")))
    asked = all_events.where("event_id % 3 = 0").select(
        F.col("event_id").alias("asked_id"), "url", "event_type", (F.col("goldstein") + F.when(F.col("event_id") % 2 == 0, 1e-8).otherwise(0.5)).alias("goldstein")
    )
    return events.matched(asked, all_events)


EVENTS_MATCHED_SQL = f"""
WITH {GDELT_SQL}, r AS (SELECT *, substr(event_code, 1, 2) AS root FROM gdelt)
SELECT a.event_id AS asked_id, min(b.event_id) AS event_id
FROM r a JOIN r b ON a.url = b.url AND (a.root = b.root OR a.root > '20' AND b.root > '20')
     AND abs(a.goldstein + CASE WHEN a.event_id % 2 = 0 THEN 1e-8 ELSE 0.5 END - b.goldstein) < 1e-6
WHERE a.event_id % 3 = 0 GROUP BY 1
"""


def trade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures as claims show them: shares, signed changes, labels, codes and days."""
    orders = table(spark, sf_dir, "orders")
    share = F.when(F.col("o_orderkey") % 5 > 0, F.pmod("o_orderkey", F.lit(50)) / 50.0)
    name = F.element_at(F.array(*map(F.lit, ["trade_share_lag1", "gdp_slope3", "open_markets"])), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return orders.select(
        "o_orderkey", formats.percent(share, 2).alias("share"), formats.signed(share - 0.5, 3).alias("change"), formats.feature_label(name).alias("label"),
        formats.is_iso3(F.col("o_orderpriority")).alias("iso3"), formats.iso_day(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"),
    )


TRADE_LABELS_SQL = """
WITH x AS (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 50) / 50.0 END AS s FROM orders)
SELECT o_orderkey, coalesce(printf('%.2f%%', (s * 100)::DOUBLE), 'n/a') AS share,
       CASE WHEN s IS NULL THEN 'n/a' ELSE printf('%+.3f', (s - 0.5)::DOUBLE) END AS change,
       CASE o_orderkey % 3 WHEN 0 THEN 'Trade Share (last year)' WHEN 1 THEN 'Gdp (trend)' ELSE 'Open Markets' END AS label,
       regexp_full_match(o_orderpriority, '[A-Z]{3}') AS iso3, strftime(o_orderdate, '%Y-%m-%d') AS day FROM x
"""


def questions_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year that votes, trade and conflicts all cover."""
    parts = (("policy", votes(spark, sf_dir)), ("trade", trade_flows(spark, sf_dir)), ("conflict", conflicts(spark, sf_dir)))
    latest = [df.groupBy(F.lit(name).alias("agent"), "year").count().select("agent", "year") for name, df in parts]
    return questions.aligned_year(latest[0].unionByName(latest[1]).unionByName(latest[2]))


QUESTIONS_ALIGNED_SQL = f"""
WITH {VOTES_SQL}, {TRADE_FLOWS_SQL}, {CONFLICTS_SQL}, l AS (
    SELECT max(year) AS y FROM votes UNION ALL SELECT max(year) FROM trade_flows UNION ALL SELECT max(year) FROM conflicts
)
SELECT min(y) AS aligned_year, max(y) AS newest_year, count(*) AS agents FROM l
"""


def fusion_plan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of plans by split: exact match, precision, recall, F1, Brier score, latencies."""
    k = F.col("o_orderkey")
    scored = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("split"), (k % 3 == 0).alias("exact"), (k % 2).alias("hit"), (1 + k % 2).alias("predicted"), F.lit(2).alias("gold"),
        ((k % 10) / 10.0).alias("understanding"), F.col("o_totalprice").alias("ms"),
    )
    return _rounded(fusion.plan_scores(scored))


FUSION_PLAN_SCORES_SQL = """
WITH x AS (
    SELECT o_orderstatus AS split, avg((o_orderkey % 3 = 0)::INT) AS exact_match, sum(o_orderkey % 2) / sum(1 + o_orderkey % 2) AS p,
           sum(o_orderkey % 2) / (2 * count(*)) AS r, avg(((o_orderkey % 10) / 10.0::DOUBLE - (o_orderkey % 3 = 0)::INT) ** 2) AS brier,
           quantile_disc(o_totalprice, 0.5) AS p50_ms, quantile_disc(o_totalprice, 0.95) AS p95_ms FROM orders GROUP BY 1
)
SELECT split, round(exact_match, 6) AS exact_match, round(p, 6) AS precision, round(r, 6) AS recall, round(brier, 6) AS brier,
       round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x
"""


def events_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for every event of a country."""
    prepared = events.prepare(gdelt(spark, sf_dir), COUNTRY)
    return prepared.groupBy(events.event_sentence().alias("sentence")).agg(F.count("*").alias("n"))


EVENTS_SENTENCES_SQL = f"""
WITH p AS ({EVENTS_PREPARED_SQL})
SELECT a1 || ' and ' || a2 || ': ' || lower(event_type) || ' (' || lower(tone) || ', ' || num_articles || ' articles)' AS sentence, count(*) AS n
FROM p GROUP BY 1
"""


def sources_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook's lines as codes, and a column decoded by them."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    lines = nation.select((F.col("k") + 10).alias("line_no"), F.concat(F.lit(" "), F.col("k").cast("string"), F.lit(" = "), "n_name", F.lit(" ")).alias("line")).union(
        spark.createDataFrame([(1, "Country"), (2, "free text of no use."), (90, "Other:"), (91, "1) Land")], "line_no long, line string")
    )
    codes = readers.codebook_lines(lines.withColumn("dataset", F.lit("trade")))
    customers = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.lit("77")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).alias("country"))
    return readers.decode(customers, codes, "trade", "country").groupBy("country_label").agg(F.count("*").alias("n"))


SOURCES_CODEBOOK_SQL = """
SELECT CASE WHEN c_custkey % 9 = 0 THEN '77' ELSE n_name END AS country_label, count(*) AS n
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
"""


def stream_live_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a real stream over the event files, run until it has read all that is there."""
    schema = table(spark, sf_dir, "events").schema
    live = stream.read_events(spark, f"{sf_dir}/events.parquet*", schema)
    folder = scratch_folder(spark, "stream")
    found = stream.run_available(stream.tumbling(live), f"live_{folder[-32:]}", folder, "complete")
    return _rounded(found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total", "largest"), 4)


STREAM_LIVE_DAILY_SQL = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS largest
FROM events GROUP BY 1, 2
"""


#: Noise of the yearly update's filter.
STEP_NOISE, VALUE_NOISE = 0.5, 2.0


def stream_yearly_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel and its filter states after years that arrive one by one, a stop between them, and a corrected first year."""
    rows = panel(spark, sf_dir)
    folder = scratch_folder(spark, "updates")
    rows.write.partitionBy("period").parquet(f"{folder}/panel")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/panel")
    first, last = rows.agg(F.min("period").cast("long"), F.max("period").cast("long")).first()
    updates = Updates(folder, ["price", "discount", "volume", "wealth"], "composite", STEP_NOISE, VALUE_NOISE, min_countries=5)
    if first is None:
        return updates.rows(spark, rows.schema).select("iso3", "period", "composite", F.lit(0.0).alias("state"), F.lit(0.0).alias("variance"))
    years = range(first // 4, last // 4 + 1)
    live = stream.read_events(spark, f"{folder}/sent/*", rows.schema, 1)
    for year in years:
        sent = rows.where(F.col("period").between(4 * year, 4 * year + 3))
        sent.coalesce(1).write.parquet(f"{folder}/sent/{year}")
        if year == years[len(years) // 2]:
            updates.run(live, f"{folder}/checkpoint")
    again = rows.where(F.col("period").between(4 * years[0], 4 * years[0] + 3))
    again.withColumn("composite", F.col("composite") + 1).coalesce(1).write.parquet(f"{folder}/sent/corrected")
    updates.run(live, f"{folder}/checkpoint")
    found = updates.rows(spark, rows.schema).select("iso3", "period", "composite")
    return _rounded(found.join(updates.states(spark).select("iso3", "period", "state", "variance"), ["iso3", "period"], "left"), 4)


STREAM_YEARLY_UPDATES_SQL = f"""
WITH RECURSIVE {PANEL_SQL}, o AS (
    SELECT iso3, period, composite AS v, row_number() OVER (PARTITION BY iso3 ORDER BY period) AS i FROM panel
), f AS (
    SELECT iso3, period, i, v, v AS x, {VALUE_NOISE}::DOUBLE AS p FROM o WHERE i = 1
    UNION ALL
    SELECT o.iso3, o.period, o.i, o.v,
           CASE WHEN f.x IS NULL THEN o.v WHEN o.v IS NULL THEN f.x
                ELSE f.x + (f.p + {STEP_NOISE}) / (f.p + {STEP_NOISE} + {VALUE_NOISE}) * (o.v - f.x) END,
           CASE WHEN f.x IS NULL THEN {VALUE_NOISE}::DOUBLE WHEN o.v IS NULL THEN f.p + {STEP_NOISE}
                ELSE (1 - (f.p + {STEP_NOISE}) / (f.p + {STEP_NOISE} + {VALUE_NOISE})) * (f.p + {STEP_NOISE}) END
    FROM f JOIN o ON o.iso3 = f.iso3 AND o.i = f.i + 1
)
SELECT iso3, period, round(v + CASE WHEN period // 4 = (SELECT min(period) // 4 FROM panel) THEN 1 ELSE 0 END, 4) AS composite,
       round(x, 4) AS state, round(p, 4) AS variance FROM f
"""

QUERIES = {
    f.__name__: f
    for f in (
        sources_trade_files, sources_event_file, sources_day_countries, sources_preview, sources_dyads, sources_rebuild,
        sources_indicators, cache_risk, cache_shock, cache_quality, cache_edges, cache_history, fusion_citations, fusion_evidence, fusion_confidence,
        policy_edges_filtered, policy_common_years, events_matched, trade_labels, stream_live_daily, stream_yearly_updates, questions_aligned,
        fusion_plan_scores, events_sentences, sources_codebook,
    )
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
