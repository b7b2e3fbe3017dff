"""Policy queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import policy
from geolith.sources.views import CONFLICTS_SQL, VOTES_SQL, conflicts, votes

from .trade import _rounded

YEAR = 2000
#: Anchors of the blocs over the driver's nations, in order of precedence.
ANCHORS = {"first": ["NATION_0", "NATION_1"], "second": ["NATION_5", "NATION_6"], "third": ["NATION_10", "NATION_11"]}

_PAIRS_SQL = f"""{VOTES_SQL}, vp AS (
    SELECT x.country_name AS a, y.country_name AS b, x.year, x.resolution, x.topic, x.vote AS va, y.vote AS vb
    FROM votes x JOIN votes y ON x.year = y.year AND x.resolution = y.resolution AND x.country_name < y.country_name
), yearly AS (
    SELECT a, b, year, sum(CASE WHEN va = vb THEN 1 ELSE 0 END) AS same, count(*) AS total FROM vp GROUP BY 1, 2, 3
), temporal AS (
    SELECT *, same / total AS rate FROM yearly QUALIFY count(*) OVER (PARTITION BY a, b) >= 2
)"""


def policy_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.agreement(votes(spark, sf_dir)))


POLICY_AGREEMENT_SQL = f"""
WITH {_PAIRS_SQL}
SELECT a, b, sum(same)::BIGINT AS same, sum(total)::BIGINT AS total, round(sum(same) / sum(total), 6) AS rate
FROM yearly GROUP BY 1, 2
"""


def policy_temporal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.temporal_agreement(votes(spark, sf_dir)))


POLICY_TEMPORAL_AGREEMENT_SQL = f"""
WITH {_PAIRS_SQL} SELECT a, b, year, same::BIGINT AS same, total, round(rate, 6) AS rate FROM temporal
"""


def policy_agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.agreement_matrix(votes(spark, sf_dir)))


POLICY_AGREEMENT_MATRIX_SQL = f"""
WITH {_PAIRS_SQL}, m AS (SELECT a, b, avg(rate) AS r FROM temporal GROUP BY 1, 2),
names AS (SELECT DISTINCT country_name AS c FROM votes)
SELECT x.c AS a, y.c AS b, round(CASE WHEN x.c = y.c THEN 1.0 ELSE coalesce(m.r, 0.5) END, 6) AS agreement
FROM names x CROSS JOIN names y LEFT JOIN m ON m.a = least(x.c, y.c) AND m.b = greatest(x.c, y.c) AND x.c <> y.c
"""


def policy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.compare(votes(spark, sf_dir), "NATION_2", "NATION_20")


POLICY_COMPARE_SQL = f"""
WITH {VOTES_SQL}
SELECT x.year, x.resolution, x.topic, x.vote AS vote_a, y.vote AS vote_b, x.vote = y.vote AS match
FROM votes x JOIN votes y ON x.year = y.year AND x.resolution = y.resolution
WHERE x.country_name = 'NATION_2' AND y.country_name = 'NATION_20'
ORDER BY x.year DESC, x.resolution DESC LIMIT 100
"""


def policy_vote_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.vote_drift(policy.temporal_agreement(votes(spark, sf_dir))))


POLICY_VOTE_DRIFT_SQL = f"""
WITH {_PAIRS_SQL}, r AS (
    SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY year) AS f,
           row_number() OVER (PARTITION BY a, b ORDER BY year DESC) AS l FROM temporal
), d AS (
    SELECT a, b, 100 * (avg(rate) FILTER (WHERE l <= 5) - avg(rate) FILTER (WHERE f <= 5)) AS drift FROM r GROUP BY 1, 2
)
SELECT a, b, round(drift, 6) AS drift,
       CASE WHEN drift > 3 THEN 'converging' WHEN drift < -3 THEN 'diverging' ELSE 'stable' END AS direction FROM d
"""

_VECTORS_SQL = f"""{VOTES_SQL}, vec AS (
    SELECT country_name, resolution, avg(CASE vote WHEN 'Y' THEN 1.0 WHEN 'N' THEN -1.0 ELSE 0.0 END) AS x
    FROM votes WHERE year BETWEEN {YEAR - 7} AND {YEAR} GROUP BY 1, 2
), unit AS (
    SELECT country_name, resolution, x / sqrt(sum(x * x) OVER (PARTITION BY country_name)) AS u FROM vec
)"""


def policy_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = policy.vote_vectors(votes(spark, sf_dir), YEAR)
    return _rounded(policy.cosine_pairs(vectors, "country_name", "resolution", "x"))


POLICY_SIMILARITY_SQL = f"""
WITH {_VECTORS_SQL}
SELECT p.country_name AS a, q.country_name AS b, round(sum(p.u * q.u), 6) AS cosine
FROM unit p JOIN unit q ON p.resolution = q.resolution AND p.country_name < q.country_name
WHERE p.u <> 0 AND q.u <> 0 GROUP BY 1, 2
"""


def policy_anchor_blocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.anchor_blocs(policy.vote_vectors(votes(spark, sf_dir), YEAR), ANCHORS))


_ANCHOR_ROWS = ", ".join(f"('{c}', '{b}', {i})" for i, (b, cs) in enumerate(ANCHORS.items()) for c in cs)
POLICY_ANCHOR_BLOCS_SQL = f"""
WITH {_VECTORS_SQL}, anchors(country_name, bloc, o) AS (VALUES {_ANCHOR_ROWS}),
centre AS (
    SELECT bloc, o, resolution, sum(u) / (SELECT count(*) FROM anchors z WHERE z.bloc = a.bloc) AS c
    FROM unit JOIN anchors a USING (country_name) GROUP BY 1, 2, 3
), len AS (SELECT bloc, sqrt(sum(c * c)) AS l FROM centre GROUP BY 1),
scores AS (
    SELECT u.country_name, c.bloc, c.o, round(sum(u.u * c.c) / any_value(len.l), 9) AS s
    FROM unit u JOIN centre c USING (resolution) JOIN len ON len.bloc = c.bloc GROUP BY 1, 2, 3
), best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY country_name ORDER BY s DESC, o) = 1)
SELECT b.country_name, coalesce(a.bloc, b.bloc) AS bloc, round(s, 6) AS score,
       CASE WHEN a.bloc IS NULL THEN 'vote_model' ELSE 'anchor' END AS provenance
FROM best b LEFT JOIN anchors a USING (country_name)
"""


def policy_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.topics(votes(spark, sf_dir))


POLICY_TOPICS_SQL = f"""
WITH {VOTES_SQL} SELECT topic, count(*) AS votes FROM votes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100
"""


def policy_topic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.topic_positions(votes(spark, sf_dir)))


POLICY_TOPIC_POSITIONS_SQL = f"""
WITH {VOTES_SQL}
SELECT country_name, topic, count(*) FILTER (WHERE vote = 'Y') AS yes, count(*) FILTER (WHERE vote = 'N') AS no,
       count(*) FILTER (WHERE vote = 'A') AS abstain, round(count(*) FILTER (WHERE vote = 'Y') / count(*), 6) AS pct_yes
FROM votes GROUP BY 1, 2
"""


def policy_active_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.active_years(votes(spark, sf_dir))


POLICY_ACTIVE_YEARS_SQL = f"""
WITH {VOTES_SQL}
SELECT country_name, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS active_years, count(*) AS votes
FROM votes GROUP BY 1
"""


def policy_conflict_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = votes(spark, sf_dir).withColumn("country_name", F.col("country_code"))
    known = policy.agreement(codes).select(F.col("a").cast("int"), F.col("b").cast("int"), "rate", "total")
    return _rounded(policy.conflict_edges(conflicts(spark, sf_dir), known))


POLICY_CONFLICT_EDGES_SQL = f"""
WITH {CONFLICTS_SQL}, {VOTES_SQL}, ag AS (
    SELECT x.country_code AS a, y.country_code AS b, sum(CASE WHEN x.vote = y.vote THEN 1 ELSE 0 END) / count(*) AS rate,
           count(*) AS total
    FROM votes x JOIN votes y ON x.year = y.year AND x.resolution = y.resolution AND x.country_code < y.country_code
    GROUP BY 1, 2 HAVING count(*) >= 5
), d AS (
    SELECT least(country_a, country_b) AS a, greatest(country_a, country_b) AS b,
           string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years,
           string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues,
           count(*) FILTER (WHERE relationship_type = 'conflict') AS cc,
           count(*) FILTER (WHERE relationship_type = 'peace_partner') AS pc,
           sum(coalesce(deaths, 0)) AS td, avg(deaths) FILTER (WHERE deaths <> 0) AS ai
    FROM conflicts GROUP BY 1, 2
)
SELECT a, b, years, issues, coalesce(cc, 0) AS conflict_count, coalesce(total, 0) AS agreements,
       round(coalesce(td, 0), 6) AS total_deaths, round(ai, 6) AS avg_intensity, round(rate, 6) AS un_agree_rate,
       CASE WHEN cc > 0 THEN 'conflict' WHEN pc > 0 THEN 'peace_partner' WHEN rate >= 0.66 THEN 'ally' ELSE 'neutral' END
           AS relationship_type
FROM d FULL OUTER JOIN ag USING (a, b)
"""


def policy_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.timeline(conflicts(spark, sf_dir), "day").select(
        "country", F.col("day").cast("string").alias("day"), "conflicts", F.round("deaths", 4).alias("deaths")
    )


_SIDES_SQL = f"""{CONFLICTS_SQL}, sides AS (
    SELECT country_a AS country, country_b AS partner, * FROM conflicts
    UNION ALL SELECT country_b, country_a, * FROM conflicts
)"""
POLICY_TIMELINE_SQL = f"""
WITH {_SIDES_SQL}
SELECT country, day::VARCHAR AS day, count(*) AS conflicts, round(sum(deaths), 4) AS deaths
FROM sides WHERE relationship_type = 'conflict' GROUP BY 1, 2
"""


def policy_deaths_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    deaths = policy.deaths_by(conflicts(spark, sf_dir), "day")
    return _rounded(deaths.withColumn("day", F.col("day").cast("string")), 4)


POLICY_DEATHS_BY_DAY_SQL = f"""
WITH {CONFLICTS_SQL}
SELECT day::VARCHAR AS day, round(sum(deaths), 4) AS deaths FROM conflicts WHERE relationship_type = 'conflict' GROUP BY 1
"""


def policy_new_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.new_conflicts(conflicts(spark, sf_dir), "day").withColumn("day", F.col("day").cast("string"))


POLICY_NEW_CONFLICTS_SQL = f"""
WITH {CONFLICTS_SQL}, f AS (SELECT conflict_name, min(day) AS day FROM conflicts GROUP BY 1)
SELECT day::VARCHAR AS day, count(*) AS new_conflicts FROM f GROUP BY 1
"""


def policy_issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.issue_summary(conflicts(spark, sf_dir))


POLICY_ISSUE_SUMMARY_SQL = f"WITH {CONFLICTS_SQL} SELECT issue, count(*) AS n FROM conflicts GROUP BY 1"


def policy_stance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.stance_matrix(conflicts(spark, sf_dir)), 4)


POLICY_STANCE_MATRIX_SQL = f"""
WITH {_SIDES_SQL}, c AS (SELECT country, issue, count(*) AS n, sum(deaths) AS deaths FROM sides GROUP BY 1, 2)
SELECT country, issue, n, round(deaths, 4) AS deaths,
       (row_number() OVER (PARTITION BY country ORDER BY n DESC, issue))::INTEGER AS rank FROM c
"""


def policy_co_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.co_activity(conflicts(spark, sf_dir))


POLICY_CO_ACTIVITY_SQL = f"""
WITH {_SIDES_SQL}, cells AS (SELECT DISTINCT country, issue, day FROM sides)
SELECT x.country AS a, y.country AS b, count(*) AS weight
FROM cells x JOIN cells y ON x.issue = y.issue AND x.day = y.day AND x.country < y.country GROUP BY 1, 2
"""


def policy_graph_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conflicts(spark, sf_dir).select(
        "day", F.least("country_a", "country_b").alias("a"), F.greatest("country_a", "country_b").alias("b")
    )
    return policy.graph_delta(pairs.where("day = DATE'2024-01-10'"), pairs.where("day = DATE'2024-01-11'"))


POLICY_GRAPH_DELTA_SQL = f"""
WITH {CONFLICTS_SQL}, p AS (SELECT DISTINCT day, least(country_a, country_b) AS a, greatest(country_a, country_b) AS b FROM conflicts),
x AS (SELECT a, b FROM p WHERE day = DATE '2024-01-10'), y AS (SELECT a, b FROM p WHERE day = DATE '2024-01-11')
SELECT a, b, 'added' AS change FROM (SELECT * FROM y EXCEPT SELECT * FROM x)
UNION ALL SELECT a, b, 'removed' FROM (SELECT * FROM x EXCEPT SELECT * FROM y)
"""


def policy_profile_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.profile_partners(conflicts(spark, sf_dir)), 4)


POLICY_PROFILE_PARTNERS_SQL = f"""
WITH {_SIDES_SQL}, c AS (SELECT country, partner, count(*) AS n, sum(deaths) AS deaths FROM sides GROUP BY 1, 2)
SELECT country, partner, n, round(deaths, 4) AS deaths,
       (row_number() OVER (PARTITION BY country ORDER BY n DESC, partner))::INTEGER AS rank
FROM c QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, partner) <= 5
"""


def policy_conflict_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = policy.timeline(conflicts(spark, sf_dir), "day").select(
        "country", F.datediff("day", F.lit("2024-01-01")).cast("double").alias("t"), F.col("conflicts").cast("double").alias("y")
    )
    return _rounded(policy.linear_forecast(daily, "country", "t", "y", 15, 5))


POLICY_CONFLICT_FORECAST_SQL = f"""
WITH {_SIDES_SQL}, s AS (
    SELECT country, date_diff('day', DATE '2024-01-01', day)::DOUBLE AS t, count(*)::DOUBLE AS y
    FROM sides WHERE relationship_type = 'conflict' GROUP BY 1, 2
), w AS (SELECT *, max(t) OVER (PARTITION BY country) AS lt FROM s),
f AS (
    SELECT country, regr_slope(y, t) AS sl, regr_intercept(y, t) AS ic, max(lt) AS lt FROM w WHERE t >= lt - 15
    GROUP BY 1 HAVING count(*) >= 4
)
SELECT country, h::INTEGER AS h, round(greatest(0, ic + sl * (lt + h)), 6) AS forecast,
       CASE WHEN sl > 0.1 THEN 'rising' WHEN sl < -0.1 THEN 'falling' ELSE 'stable' END AS trend
FROM f, range(1, 6) r(h)
"""

PIVOT_YEARS = list(range(1995, 2002))


def policy_year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.year_pivot(votes(spark, sf_dir), PIVOT_YEARS)


POLICY_YEAR_PIVOT_SQL = (
    f"WITH {VOTES_SQL} SELECT country_name, "
    + ", ".join(f"count(*) FILTER (WHERE year = {y}) AS y{y}" for y in PIVOT_YEARS)
    + " FROM votes WHERE vote = 'Y' GROUP BY 1"
)

QUERIES = {
    f.__name__: f
    for f in (
        policy_agreement, policy_temporal_agreement, policy_agreement_matrix, policy_compare, policy_vote_drift,
        policy_similarity, policy_anchor_blocs, policy_topics, policy_topic_positions, policy_active_years,
        policy_conflict_edges, policy_timeline, policy_deaths_by_day, policy_new_conflicts, policy_issue_summary,
        policy_stance_matrix, policy_co_activity, policy_graph_delta, policy_profile_partners,
        policy_conflict_forecast, policy_year_pivot,
    )
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES}
