"""Queries of cleaning, record, identifier and upload operators, over tables with the faults they mend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import text
from geolith.operators import graph, identity, influence, learning, policy, records, trade, uploads
from geolith.session import ship_package
from geolith.sources.views import (
    CONFLICTS_SQL, GDELT_SQL, PANEL_SQL, RAW_FLOWS_SQL, TRADE_FLOWS_SQL, VOTES_SQL, conflicts, gdelt, panel, raw_flows,
    table, trade_flows, votes,
)

from .trade import _rounded


def trade_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows whose names carry blanks, are empty or "nan", and whose values are text."""
    spoiled = raw_flows(spark, sf_dir).select(
        F.when(F.col("chapter") % 10 == 0, "nan").when(F.col("chapter") % 10 == 1, "  ").otherwise(F.concat(F.lit(" "), "exporter", F.lit("  "))).alias("exporter"),
        "importer",
        F.col("year").cast("string").alias("year"),
        F.when(F.col("chapter") == 33, "n/a").otherwise(F.col("trade_value").cast("string")).alias("trade_value"),
        F.when(F.col("sector") != "other", F.concat(F.lit(" "), F.upper("sector"))).alias("sector"),
    )
    clean = trade.clean_flows(spoiled)
    return clean.groupBy("exporter", "importer", "year", "sector").agg(F.count("*").alias("n"), F.round(F.sum("trade_value"), 4).alias("value"))


TRADE_CLEANED_SQL = f"""
WITH {RAW_FLOWS_SQL}
SELECT exporter, importer, year, sector, count(*) AS n, round(sum(trade_value), 4) AS value FROM raw_flows
WHERE chapter % 10 > 1 AND chapter <> 33 AND exporter <> importer AND trade_value >= 0 GROUP BY ALL
"""


def trade_latest_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the latest year and one sector, asked for as a user writes it."""
    flows = trade.require_columns(trade_flows(spark, sf_dir), "exporter", "importer", "year", "sector", "trade_value")
    return _rounded(trade.edges(trade.of_sector(trade.of_year(flows), " Energy "), "year"), 4)


TRADE_LATEST_ENERGY_SQL = f"""
WITH {TRADE_FLOWS_SQL}
SELECT exporter, importer, year, round(sum(trade_value), 4) AS weight FROM trade_flows
WHERE sector = 'energy' AND year = (SELECT max(year) FROM trade_flows) GROUP BY 1, 2, 3
"""


def trade_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure bands of every country's share of trade with each partner."""
    partners = trade.partner_totals(trade.edges(trade_flows(spark, sf_dir), "year"), "year")
    total = partners.groupBy("year", "country").agg(F.sum("partner_total").alias("total"))
    shares = partners.join(total, ["year", "country"])
    return shares.groupBy("year", trade.exposure_band(F.col("partner_total") / F.col("total")).alias("band")).agg(F.count("*").alias("n"))


TRADE_EXPOSURE_SQL = f"""
WITH {TRADE_FLOWS_SQL}, s AS (
    SELECT year, exporter AS c, importer AS p, trade_value AS v FROM trade_flows
    UNION ALL SELECT year, importer, exporter, trade_value FROM trade_flows
), pt AS (SELECT year, c, p, sum(v) AS v FROM s GROUP BY ALL),
x AS (SELECT year, v / sum(v) OVER (PARTITION BY year, c) AS share FROM pt)
SELECT year, CASE WHEN share >= 0.1 THEN 'severe economic exposure' WHEN share >= 0.03 THEN 'material economic exposure'
                  WHEN share >= 0.01 THEN 'moderate economic exposure' ELSE 'limited economic exposure' END AS band, count(*) AS n
FROM x GROUP BY 1, 2
"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_name").alias("country"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("bloc"), F.col("n_regionkey").cast("int").alias("bloc_id"))


def trade_region_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between given blocs, here the regions."""
    return _rounded(trade.inter_bloc_flows(trade.edges(trade_flows(spark, sf_dir)), _regions(spark, sf_dir)), 2)


TRADE_REGION_FLOWS_SQL = f"""
WITH {TRADE_FLOWS_SQL}
SELECT 'R' || a.n_regionkey AS from_bloc, 'R' || b.n_regionkey AS to_bloc, round(sum(trade_value), 2) AS flow
FROM trade_flows JOIN nation a ON a.n_name = exporter JOIN nation b ON b.n_name = importer GROUP BY 1, 2
"""


def trade_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of given blocs: members by strength, mean share of trade inside the bloc."""
    edge = trade.edges(trade_flows(spark, sf_dir))
    both = edge.unionByName(edge.select(F.col("importer").alias("exporter"), F.col("exporter").alias("importer"), "weight"))
    home, other = _regions(spark, sf_dir), _regions(spark, sf_dir).select(F.col("country").alias("importer"), F.col("bloc").alias("other"))
    members = both.withColumnRenamed("exporter", "country").join(home, "country").join(other, "importer")
    blocs = members.groupBy("country", "bloc", "bloc_id").agg(
        F.sum("weight").alias("strength"), (F.sum(F.when(F.col("bloc") == F.col("other"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("internal_share")
    )
    found = graph.bloc_summary(blocs)
    return found.select("bloc_id", "bloc", "members", "member_list", F.round("mean_internal_share", 6).alias("mean_internal_share"), F.round("total_strength", 2).alias("total_strength"))


TRADE_REGION_SUMMARY_SQL = f"""
WITH {TRADE_FLOWS_SQL}, s AS (
    SELECT exporter AS c, importer AS p, trade_value AS v FROM trade_flows
    UNION ALL SELECT importer, exporter, trade_value FROM trade_flows
), m AS (
    SELECT c, a.n_regionkey AS r, sum(v) AS strength, sum(CASE WHEN a.n_regionkey = b.n_regionkey THEN v ELSE 0 END) / sum(v) AS share
    FROM s JOIN nation a ON a.n_name = c JOIN nation b ON b.n_name = p GROUP BY 1, 2
)
SELECT r::INTEGER AS bloc_id, 'R' || r AS bloc, count(*) AS members, string_agg(c, ', ' ORDER BY strength DESC, c) AS member_list,
       round(avg(share), 6) AS mean_internal_share, round(sum(strength), 2) AS total_strength
FROM m GROUP BY 1, 2
"""


def trade_bloc_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each country's main partner by year as its bloc, and where it switched."""
    partners = trade.partner_totals(trade.edges(trade_flows(spark, sf_dir), "year"), "year")
    blocs = partners.groupBy("country", "year").agg(F.min_by("partner", F.struct(-F.col("partner_total"), "partner")).alias("bloc"))
    return trade.bloc_evolution(blocs)


TRADE_BLOC_SWITCHES_SQL = f"""
WITH {TRADE_FLOWS_SQL}, s AS (
    SELECT year, exporter AS c, importer AS p, trade_value AS v FROM trade_flows
    UNION ALL SELECT year, importer, exporter, trade_value FROM trade_flows
), pt AS (SELECT year, c, p, sum(v) AS v FROM s GROUP BY ALL),
b AS (SELECT c, year, first(p ORDER BY v DESC, p) AS bloc FROM pt GROUP BY 1, 2),
l AS (SELECT *, lag(bloc) OVER (PARTITION BY c ORDER BY year) AS previous_bloc FROM b)
SELECT c AS country, year, bloc, previous_bloc, coalesce(bloc <> previous_bloc, false) AS switched FROM l
"""


PAGERANK_ROUNDS = 40


def trade_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of every year's trade by joins."""
    return _rounded(graph.pagerank_table(trade.edges(trade_flows(spark, sf_dir), "year"), "year", tolerance=1e-9))


def _pagerank_sql() -> str:
    steps = [
        f"""r{i + 1} AS MATERIALIZED (
    SELECT b.year, b.c, b.n, b.idle, 0.15 / b.n + 0.85 * (coalesce(f.flow, 0) + i.spread / b.n) AS p FROM r{i} b
    LEFT JOIN (SELECT l.year, l.importer AS c, sum(r.p * l.share) AS flow FROM l JOIN r{i} r ON r.year = l.year AND r.c = l.exporter GROUP BY 1, 2) f
         ON f.year = b.year AND f.c = b.c
    JOIN (SELECT year, sum(CASE WHEN idle THEN p ELSE 0 END) AS spread FROM r{i} GROUP BY 1) i ON i.year = b.year
)"""
        for i in range(PAGERANK_ROUNDS)
    ]
    return f"""
WITH {TRADE_FLOWS_SQL}, e AS MATERIALIZED (SELECT year, exporter, importer, sum(trade_value) AS w FROM trade_flows GROUP BY ALL),
l AS MATERIALIZED (SELECT year, exporter, importer, w / sum(w) OVER (PARTITION BY year, exporter) AS share FROM e),
k AS (SELECT year, exporter AS c FROM e UNION SELECT year, importer FROM e),
r0 AS MATERIALIZED (
    SELECT year, c, count(*) OVER (PARTITION BY year) AS n, (year, c) NOT IN (SELECT (year, exporter) FROM e) AS idle,
           1 / count(*) OVER (PARTITION BY year) AS p FROM k
), {", ".join(steps)}
SELECT year, c AS country, round(p, 6) AS pagerank FROM r{PAGERANK_ROUNDS}
"""


TRADE_PAGERANK_SQL = _pagerank_sql()


def records_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years out of dates written in several ways, some of them missing or out of range."""
    kind, day = F.pmod("o_orderkey", F.lit(7)), F.col("o_orderdate").cast("date")
    written = (
        F.when(kind == 0, day.cast("string")).when(kind == 1, F.year(day).cast("string")).when(kind == 2, F.concat(F.year(day).cast("string"), F.lit(".0")))
        .when(kind == 3, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd HH:mm:ss"))).when(kind == 4, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 5, "nan").otherwise("3021")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.select(kind.cast("int").alias("kind"), records.year_of(written).alias("year")).groupBy("kind", "year").agg(F.count("*").alias("n"))


RECORDS_YEARS_SQL = """
SELECT (o_orderkey % 7)::INTEGER AS kind, CASE WHEN o_orderkey % 7 < 5 THEN year(o_orderdate)::INTEGER END AS year, count(*) AS n
FROM orders GROUP BY 1, 2
"""


def records_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filled of three topic columns."""
    k = F.pmod("o_orderkey", F.lit(4))
    topic = records.topic_of(
        F.when(k == 0, F.col("o_orderpriority")).when(k == 1, " "), F.when(k == 1, F.concat(F.lit(" "), "o_orderstatus")).when(k == 2, "NaN"),
        F.when(k < 3, F.col("o_orderpriority")),
    )
    return table(spark, sf_dir, "orders").groupBy(topic.alias("topic")).agg(F.count("*").alias("n"))


RECORDS_TOPICS_SQL = """
SELECT CASE o_orderkey % 4 WHEN 0 THEN trim(o_orderpriority) WHEN 1 THEN trim(o_orderstatus) WHEN 2 THEN trim(o_orderpriority) END AS topic,
       count(*) AS n FROM orders GROUP BY 1
"""

_TYPES = ["GOV", "mil", "REB", "", "XYZ"]


def records_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for actors without a name."""
    types = F.element_at(F.array(*map(F.lit, _TYPES)), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    place = F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("a1"))
    return gdelt(spark, sf_dir).groupBy(records.describe_actor(place, types).alias("actor")).agg(F.count("*").alias("n"))


RECORDS_ACTORS_SQL = f"""
WITH {GDELT_SQL}, x AS (
    SELECT CASE WHEN event_id % 3 > 0 THEN a1 END AS place,
           CASE event_id % 5 WHEN 0 THEN 'government' WHEN 1 THEN 'military' WHEN 2 THEN 'rebel' END AS kind FROM gdelt
)
SELECT CASE WHEN place IS NOT NULL AND kind IS NOT NULL THEN 'a ' || kind || ' source in ' || place
            WHEN place IS NOT NULL THEN 'an unnamed party from ' || place
            WHEN kind IS NOT NULL THEN 'a ' || kind || ' source' ELSE 'an unidentified party' END AS actor, count(*) AS n
FROM x GROUP BY 1
"""


def _country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 2).cast("int").alias("code"), F.format_string("N%02d", F.col("n_nationkey").cast("int")).alias("iso3"), F.col("n_name").alias("name"),
        F.concat(F.lit("land "), F.col("n_nationkey").cast("string")).alias("alias"),
    )


def _party_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation written in one of six ways."""
    k, n = F.pmod("c_custkey", F.lit(6)), F.col("c_nationkey").cast("int")
    number = (n + 2).cast("string")
    code = (
        F.when(k == 0, number).when(k == 1, F.concat(number, F.lit(".0"))).when(k == 2, F.concat(F.lit("7000, "), number, F.lit(", 5")))
        .when(k == 3, F.format_string("n%02d", n))
    )
    label = F.when(k == 4, F.concat(F.lit(" LAND "), n.cast("string"))).when(k == 5, F.concat(F.lit("faction "), n.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"), label.alias("label"))


def records_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties by number, number in text, list, three letters, alias, and such as no table knows."""
    found = records.resolve_parties(_party_rows(spark, sf_dir), "code", "label", _country_names(spark, sf_dir), "party")
    return found.groupBy("party", "party_code").agg(F.count("*").alias("n"))


RECORDS_PARTIES_SQL = """
SELECT CASE WHEN c_custkey % 6 < 5 THEN n_name ELSE 'faction ' || c_nationkey END AS party,
       CASE WHEN c_custkey % 6 < 5 THEN c_nationkey + 2
            ELSE 10000 + ('0x' || substr(md5('faction ' || c_nationkey), 1, 8))::BIGINT % 900000 END::INTEGER AS party_code,
       count(*) AS n
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2
"""


def records_sovereign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only parties whose code is a state's."""
    found = records.resolve_parties(_party_rows(spark, sf_dir), "code", "label", _country_names(spark, sf_dir), "party")
    return records.sovereign(found, "party_code").groupBy("party_code").agg(F.count("*").alias("n"))


RECORDS_SOVEREIGN_SQL = """
SELECT (c_nationkey + 2)::INTEGER AS party_code, count(*) AS n FROM customer WHERE c_custkey % 6 < 5 GROUP BY 1
"""


def records_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dyadic conflict dataset in the common layout."""
    raw = conflicts(spark, sf_dir).select(
        (F.col("country_a") + 2).cast("string").alias("gwno_a"), (F.col("country_b") + 2).cast("string").alias("gwno_b"), F.col("year").cast("string").alias("year"),
        F.lit("2").alias("intensity_level"), F.col("deaths").cast("string").alias("bd_best"), F.col("issue").alias("incompatibility"),
        F.col("country_a").cast("string").alias("dyad_id"), "conflict_name",
    )
    found = records.master_records(raw, "ucdp-dyadic", _country_names(spark, sf_dir))
    return found.groupBy("country_a", "country_b", "year", "issue", "relationship_type", "dataset", "dyad_id").agg(
        F.count("*").alias("n"), F.round(F.sum("deaths"), 3).alias("deaths"), F.max("intensity").alias("intensity")
    )


RECORDS_MASTER_SQL = f"""
WITH {CONFLICTS_SQL}
SELECT a.n_name AS country_a, b.n_name AS country_b, year, issue, 'conflict' AS relationship_type, 'ucdp-dyadic' AS dataset,
       country_a AS dyad_id, count(*) AS n, round(sum(deaths), 3) AS deaths, 2.0::DOUBLE AS intensity
FROM conflicts c JOIN nation a ON a.n_nationkey = c.country_a JOIN nation b ON b.n_nationkey = c.country_b
WHERE year BETWEEN 1989 AND 2025 GROUP BY a.n_name, b.n_name, year, issue, c.country_a
"""


def records_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of dyads out of flag columns, merged into the records of the same dyad and year."""
    rows = conflicts(spark, sf_dir).select(F.col("country_a").alias("dyad_id"), F.col("country_b").alias("conflict_id"), "year", "issue")
    flags = rows.groupBy("dyad_id", "conflict_id", "year").agg(F.count("*").alias("n")).where("dyad_id % 2 = 0").select(
        F.concat(F.col("dyad_id").cast("string"), F.lit(".0")).try_cast("double").cast("int").cast("string").alias("dyad_id"),
        F.col("conflict_id").cast("string").alias("conflict_id"), F.col("year").cast("string").alias("year"),
        F.when(F.col("n") % 2 == 0, "1.0").otherwise("0").alias("1"), F.lit("1").alias("2"),
    )
    merged = records.merge_issues(rows, records.issue_flags(flags, {"1": "water", "2": "land"}))
    return merged.groupBy("issue", "year").agg(F.count("*").alias("n"))


RECORDS_ISSUES_SQL = f"""
WITH {CONFLICTS_SQL}, f AS (
    SELECT country_a, country_b, year, CASE WHEN count(*) % 2 = 0 THEN 'water, land' ELSE 'land' END AS issues
    FROM conflicts WHERE country_a % 2 = 0 AND year BETWEEN 1989 AND 2025 GROUP BY 1, 2, 3
)
SELECT coalesce(issues, issue) AS issue, year, count(*) AS n FROM conflicts LEFT JOIN f USING (country_a, country_b, year) GROUP BY 1, 2
"""


def records_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores less the governance penalty."""
    p = panel(spark, sf_dir).select(
        "iso3", "period", F.col("composite").alias("score"), F.when(F.col("price").isNotNull(), F.pmod(F.col("wealth"), F.lit(100.0))).alias("freedom"),
        (F.col("wealth") / 60).alias("wealth_score"), (F.col("composite") - 2).alias("ci_lower"), (F.col("composite") + 2).alias("ci_upper"),
    )
    return records.adjusted_scores(p).select("iso3", "period", "governance_penalty", "wealth_bonus", "adjusted_score", "adj_ci_lower", "adj_ci_upper")


RECORDS_ADJUSTED_SQL = f"""
WITH {PANEL_SQL}, x AS (
    SELECT iso3, period, composite AS s, CASE WHEN price IS NOT NULL THEN ((wealth % 100.0) + 100.0) % 100.0 END AS f, wealth / 60 AS w FROM panel
), y AS (
    SELECT *, CASE WHEN f IS NULL OR f >= 70 THEN 0.0 WHEN f >= 40 THEN round((70 - f) / 30 * 8.0, 2) ELSE round(8.0 + (40 - f) / 40 * 7.0, 2) END::DOUBLE AS p,
           CASE WHEN w > 75 AND s < 65 THEN 3.0 ELSE 0.0 END::DOUBLE AS b FROM x
)
SELECT iso3, period, p AS governance_penalty, b AS wealth_bonus, round(greatest(0.0, least(100.0, s - p + b)), 2) AS adjusted_score,
       round(greatest(0.0, least(100.0, s - 2 - p * 0.5)), 2) AS adj_ci_lower, round(greatest(0.0, least(100.0, s + 2 + 1.5)), 2) AS adj_ci_upper FROM y
"""


def influence_large_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel without excluded states, in terciles of the latest composite."""
    small = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("iso3"))
    kept = records.without(panel(spark, sf_dir), small).groupBy("iso3").agg(F.max_by("composite", "period").alias("score"))
    return records.terciles(kept.select("iso3", F.round("score", 6).alias("score")), "score")


INFLUENCE_LARGE_STATES_SQL = f"""
WITH {PANEL_SQL}, kept AS (
    SELECT iso3, round(arg_max(composite, period), 6) AS score FROM panel
    WHERE iso3 NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0) GROUP BY 1
), cuts AS (SELECT quantile_cont(score, 1 / 3.0) AS low, quantile_cont(score, 2 / 3.0) AS high FROM kept)
SELECT iso3, score, CASE WHEN score <= low THEN 'low' WHEN score <= high THEN 'medium' WHEN score IS NOT NULL THEN 'high' END AS tercile
FROM kept, cuts
"""


def _countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _country_names(spark, sf_dir).select(
        F.col("code").alias("country_code"), F.col("name").alias("country_name"), F.concat(F.lit("x"), F.col("code").cast("string")).alias("country_iso2"),
        F.col("iso3").alias("country_iso3"), F.array("alias").alias("aliases"),
    )


def identity_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by number, letters, name in any case, or alias; others stay unknown."""
    k, n = F.pmod("c_custkey", F.lit(6)), F.col("c_nationkey").cast("int")
    asked = table(spark, sf_dir, "customer").select(
        F.when(k == 0, (n + 2).cast("string")).when(k == 1, F.format_string(" n%02d ", n)).when(k == 2, F.concat(F.lit("X"), (n + 2).cast("string")))
        .when(k == 3, F.concat(F.lit("nation_"), n.cast("string"))).when(k == 4, F.concat(F.lit("Land "), n.cast("string"))).otherwise("nowhere").alias("asked")
    )
    return identity.resolve(asked, _countries(spark, sf_dir), "asked").groupBy("country_code", "country_name", "iso3").agg(F.count("*").alias("n"))


IDENTITY_RESOLVED_SQL = """
SELECT (n_nationkey + 2)::INTEGER AS country_code, n_name AS country_name, printf('N%02d', n_nationkey) AS iso3, count(*) AS n
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 6 < 5 GROUP BY 1, 2, 3
"""


def identity_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names suggested for misspelt ones."""
    missed = table(spark, sf_dir, "nation").select(F.regexp_replace("n_name", "^NATIO", "NATO").alias("asked")).union(spark.createDataFrame([("zzz",), ("_1",)], "asked string"))
    return identity.suggest(missed, _countries(spark, sf_dir), "asked")


IDENTITY_SUGGESTIONS_SQL = """
WITH m AS (SELECT DISTINCT regexp_replace(n_name, '^NATIO', 'NATO') AS asked FROM nation UNION SELECT 'zzz' UNION SELECT '_1'),
p AS (
    SELECT asked, n_name, 1 - levenshtein(lower(asked), lower(n_name)) / greatest(length(asked), length(n_name), 1) AS l,
           contains(lower(n_name), lower(asked)) AS inside FROM m, nation
), g AS (SELECT *, max(l >= 0.6) OVER (PARTITION BY asked) AS any_good FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY l DESC, n_name) AS r FROM g WHERE CASE WHEN any_good THEN l >= 0.6 ELSE inside END)
SELECT asked, string_agg(n_name, ', ' ORDER BY r) AS suggestions FROM k WHERE r <= 3 GROUP BY 1
"""


def policy_votes_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes cast twice: the later one counts."""
    cast = votes(spark, sf_dir)
    twice = cast.withColumn("at", F.lit(0)).unionByName(cast.where("country_code % 3 = 0").withColumns({"vote": F.lit("A"), "vote_numeric": F.lit(0.0), "at": F.lit(1)}))
    return policy.dedupe_votes(twice, "at").groupBy("country_code", "vote").agg(F.count("*").alias("n"))


POLICY_VOTES_ONCE_SQL = f"""
WITH {VOTES_SQL}
SELECT country_code::INTEGER AS country_code, CASE WHEN country_code % 3 = 0 THEN 'A' ELSE vote END AS vote, count(*) AS n FROM votes GROUP BY 1, 2
"""


def policy_synthetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of parties that no table knows."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", policy.synthetic_code(F.lower("s_name")).cast("long").alias("code"))


POLICY_SYNTHETIC_CODES_SQL = """
SELECT s_suppkey, 10000 + ('0x' || substr(md5(lower(s_name)), 1, 8))::BIGINT % 900000 AS code FROM supplier
"""


def influence_panel_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the panel twice, once with less coverage: the fuller one counts."""
    p = panel(spark, sf_dir).withColumn("covered", F.lit(1.0))
    poorer = p.withColumns({"composite": F.lit(0.0), "covered": F.lit(0.5)})
    return _rounded(influence.dedupe_panel(p.unionByName(poorer), "covered").select("iso3", "period", "composite", "covered"), 4)


INFLUENCE_PANEL_ONCE_SQL = f"WITH {PANEL_SQL} SELECT iso3, period, round(composite, 4) AS composite, 1.0::DOUBLE AS covered FROM panel"


def influence_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean of the dimensions present, less what their reliability costs."""
    p = panel(spark, sf_dir)
    d = p.select("iso3", "period", (F.col("price") / 1999).alias("d1"), (F.col("discount") * 499).alias("d2"), (F.col("volume") / 99).alias("d3"), (F.col("wealth") / 101).alias("d4"), F.lit(None).cast("double").alias("d5"))
    return _rounded(influence.composite(d).select("iso3", "period", "composite_raw", "composite_adjusted"), 4)


INFLUENCE_COMPOSITE_SQL = f"""
WITH {PANEL_SQL}, x AS (
    SELECT iso3, period, (coalesce(price / 1999 * 0.15, 0) + discount * 499 * 0.25 + coalesce(volume / 99 * 0.2, 0) + wealth / 101 * 0.25)
           / (CASE WHEN price IS NULL THEN 0 ELSE 0.15 END + 0.25 + CASE WHEN volume IS NULL THEN 0 ELSE 0.2 END + 0.25) AS c FROM panel
)
SELECT iso3, period, round(c, 4) AS composite_raw, round(c - 1.25, 4) AS composite_adjusted FROM x
"""


def influence_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed scores where there are some, else the panel's."""
    p = panel(spark, sf_dir)
    smooth = p.where("period % 2 = 0").select("iso3", "period", F.when(F.col("period") % 4 == 0, 0.0).otherwise(F.col("composite") + 1).alias("kalman_score"))
    return _rounded(influence.preferred_score(p, smooth, "composite"), 4)


INFLUENCE_PREFERRED_SQL = f"""
WITH {PANEL_SQL}
SELECT iso3, period, round(composite + CASE WHEN period % 4 = 2 THEN 1 ELSE 0 END, 4) AS score FROM panel
"""


def influence_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the latest scores with an outside ranking of most countries."""
    scores = panel(spark, sf_dir).groupBy("iso3").agg(F.max_by("composite", "period").alias("score"))
    outside = table(spark, sf_dir, "nation").where("n_nationkey % 4 > 0").select(F.col("n_name").alias("iso3"), ((F.col("n_nationkey") * 7) % 25).alias("rank"))
    return _rounded(influence.benchmark_agreement(scores, outside))


INFLUENCE_BENCHMARK_SQL = f"""
WITH {PANEL_SQL}, s AS (SELECT iso3, arg_max(composite, period) AS score FROM panel GROUP BY 1),
b AS (
    SELECT rank() OVER (ORDER BY score) AS x, rank() OVER (ORDER BY -((n_nationkey * 7) % 25)) AS y
    FROM s JOIN nation ON n_name = iso3 WHERE n_nationkey % 4 > 0
)
SELECT round(corr(x, y), 6) AS spearman, count(*) AS n FROM b
"""


DRIVERS = ["wealth", "discount"]


def influence_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moves each country's next composite, by the exact attributions of a linear model."""
    rows = influence.lag_features(panel(spark, sf_dir), "composite").select("iso3", "period", "target").join(panel(spark, sf_dir), ["iso3", "period"])
    found = learning.attributions(rows, learning.coefficients(rows, DRIVERS, "target"), "iso3", "period")
    return _rounded(learning.drivers(found, "iso3"), 4)


INFLUENCE_DRIVERS_SQL = f"""
WITH {PANEL_SQL}, l AS (SELECT *, lead(composite) OVER (PARTITION BY iso3 ORDER BY period) AS y FROM panel),
c AS (SELECT wealth AS a, discount AS b, y FROM l WHERE y IS NOT NULL AND wealth IS NOT NULL AND discount IS NOT NULL),
m AS (SELECT covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb FROM c),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m),
x AS (
    SELECT iso3, 'wealth' AS feature, coalesce(wa * (wealth - (SELECT avg(wealth) FROM panel)), 0) AS v FROM l, w
    UNION ALL SELECT iso3, 'discount', coalesce(wb * (discount - (SELECT avg(discount) FROM panel)), 0) FROM l, w
), g AS (SELECT iso3, feature, avg(abs(v)) AS mean_abs, avg(v) AS mean FROM x GROUP BY 1, 2)
SELECT iso3, feature, round(mean_abs, 4) AS mean_abs, round(mean, 4) AS mean,
       (row_number() OVER (PARTITION BY iso3 ORDER BY mean_abs DESC, feature))::INTEGER AS rank FROM g
"""


def upload_binary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of a wide upload hold 0 and 1 and both."""
    wide = table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "O").cast("int").cast("string").alias("open"), F.lit("1").alias("always"),
        F.pmod("o_orderkey", F.lit(3)).cast("string").alias("three"), F.when(F.col("o_orderkey") > 4, (F.col("o_totalprice") > 100000).cast("int")).cast("string").alias("large"),
    )
    found = uploads.binary_columns(wide, wide.columns)
    return wide.agg(*(F.lit(c in found).alias(c) for c in wide.columns), F.count("*").alias("n"))


UPLOAD_BINARY_COLUMNS_SQL = """
SELECT min((o_orderstatus = 'O')::INT) = 0 AND max((o_orderstatus = 'O')::INT) = 1 AS open, false AS always, false AS three,
       min((o_totalprice > 100000)::INT) FILTER (WHERE o_orderkey > 4) = 0 AND max((o_totalprice > 100000)::INT) FILTER (WHERE o_orderkey > 4) = 1 AS large, count(*) AS n FROM orders
"""


def upload_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a column per country, one row per value."""
    status = {f"NATION_{i}": F.max(F.when(F.col("c_nationkey") == i, F.col("o_orderstatus"))).alias(f"NATION_{i}") for i in range(25)}
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(*status.values())
    return uploads.wide_to_long(wide, list(status))


UPLOAD_LONG_SQL = """
SELECT strftime(o_orderdate, '%Y-%m') AS month, 'NATION_' || c_nationkey AS country, max(o_orderstatus) AS stance
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
"""


def text_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case texts without accents, by their digests."""
    ship_package(spark)
    plain = F.regexp_replace(F.col("text"), r"[^\p{L}\n ]", "")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.trim(plain).alias("t"))
    return docs.select("doc_id", F.md5(F.regexp_replace(text.folded(F.col("t")), r"\s", "")).alias("digest"))


TEXT_FOLDED_SQL = r"""
SELECT doc_id, md5(regexp_replace(lower(strip_accents(regexp_replace(text, '[^\p{L}\n ]', '', 'g'))), '\s', '', 'g')) AS digest
FROM documents WHERE text IS NOT NULL
"""


def text_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second text read wrongly as Latin-1 once, and repaired."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    spoiled = F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(text.repair_mojibake(spoiled)).alias("digest"))


TEXT_REPAIRED_SQL = "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL"


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages as one key."""
    docs = table(spark, sf_dir, "documents")
    key = text.normalize_key(F.concat_ws(" / ", F.lit(" Key"), "lang", "source", F.lit("! ")))
    return docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


TEXT_KEYS_SQL = """
SELECT trim(regexp_replace(lower(concat_ws(' / ', ' Key', lang, source, '! ')), '[^a-z0-9]+', '_', 'g'), '_') AS key, count(*) AS n
FROM documents GROUP BY 1
"""


def text_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, neighbouring swaps counted as one, between a name and three ways to misspell it."""
    ship_package(spark)
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("a"))
    b = F.explode(F.array(F.col("a"), F.concat(F.lit("an"), F.substring("a", 3, 99)), F.concat(F.substring("a", 1, 2), F.substring("a", 4, 99)), F.concat("a", F.lit("xyz"))))
    return n.select("a", b.alias("b")).select("a", "b", text.osa(F.col("a"), F.col("b")).alias("distance"))


TEXT_TYPOS_SQL = """
SELECT lower(n_name) AS a, b.b, b.d::INTEGER AS distance FROM nation, LATERAL (
    VALUES (lower(n_name), 0), ('an' || substr(lower(n_name), 3), 1), (substr(lower(n_name), 1, 2) || substr(lower(n_name), 4), 1), (lower(n_name) || 'xyz', 3)
) b(b, d)
"""

QUERIES = {
    f.__name__: f
    for f in (
        trade_cleaned, trade_latest_energy, trade_exposure, trade_region_flows, trade_region_summary, trade_bloc_switches, trade_pagerank,
        records_years, records_topics, records_actors, records_parties, records_sovereign, records_master, records_issues,
        records_adjusted, influence_large_states, identity_resolved, identity_suggestions, policy_votes_once,
        policy_synthetic_codes, influence_panel_once, influence_composite, influence_drivers, influence_preferred, influence_benchmark,
        upload_binary_columns, upload_long, text_folded, text_repaired, text_keys, text_typos,
    )
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES}
