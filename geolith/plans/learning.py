"""Queries of graph measures and models that SQL cannot express; tests hold them against invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import boosting, events, fusion, graph, influence, learning, network, policy, trade, uploads
from geolith.session import ship_package
from geolith.sources.views import CONFLICTS_SQL, PANEL_SQL, TRADE_FLOWS_SQL, VOTES_SQL, conflicts, gdelt, panel, trade_flows, votes

from .policy import ANCHORS
from .trade import _rounded

INDICATORS = ["price", "discount", "volume", "wealth"]


def _conflict_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(spark, sf_dir).groupBy(
        F.col("country_a").cast("string").alias("exporter"), F.col("country_b").cast("string").alias("importer")
    ).agg(F.count("*").cast("double").alias("weight"))


def policy_network_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.network_metrics(_conflict_graph(spark, sf_dir)))


def policy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners and connected component of every country of the conflict graph."""
    edge = _conflict_graph(spark, sf_dir)
    degree = network.undirected(edge).groupBy(F.col("exporter").alias("country")).agg(F.count("*").alias("degree"))
    return network.components(edge).join(degree, "country").select("country", "component", "degree")


POLICY_COMPONENTS_SQL = f"""
WITH RECURSIVE {CONFLICTS_SQL}, e AS (
    SELECT country_a::VARCHAR AS a, country_b::VARCHAR AS b FROM conflicts UNION SELECT country_b::VARCHAR, country_a::VARCHAR FROM conflicts
), reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT r.a AS country, min(r.b) AS component, (SELECT count(*) FROM e WHERE e.a = r.a) AS degree FROM reach r GROUP BY 1
"""


def policy_spectral_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.spectral_embedding(_conflict_graph(spark, sf_dir)))


def policy_walk_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of the conflict graph by whom random walks meet beside them."""
    found = graph.walk_embedding(_conflict_graph(spark, sf_dir), 4)
    return found.select("country", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"), F.size("embedding").alias("axes"))


def policy_bloc_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.discovered_blocs(policy.vote_vectors(votes(spark, sf_dir), 2000), 0.05)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel, stored: a row for each nation and quarter. Models read it many times, the orders behind it are read once."""
    return network._checkpointed(panel(spark, sf_dir))


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir)
    lags = influence.lag_features(rows, "composite").select("iso3", "period", "lag1", "delta1", "target")
    return network._checkpointed(rows.join(lags, ["iso3", "period"]))


def influence_temporal_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four expanding folds of the ensemble of boosted and bagged trees, with its three intervals."""
    return _rounded(boosting.quantile_cv(_lagged(spark, sf_dir), [*INDICATORS, "lag1", "delta1"], "target"))


def influence_tree_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moves each country's next composite, by exact attributions of boosted trees; the parts of each row add up."""
    rows, features = _lagged(spark, sf_dir), [*INDICATORS, "lag1", "delta1"]
    model = boosting.fit_trees(rows, features, "target", [boosting.Spec("target", F.lit(True), 0.5)], "iso3", "period")["target"]
    return _rounded(learning.drivers(boosting.tree_attributions(rows, model, "iso3", "period"), "iso3"))


def influence_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _lagged(spark, sf_dir), [*INDICATORS, "lag1"]
    fitted = learning.fit(rows, features, "target", "gbt")
    return _rounded(learning.group_importance(learning.permutation_importance(fitted, rows, features, "target")))


def influence_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lagged(spark, sf_dir)
    return _rounded(learning.what_if(learning.fit(rows, INDICATORS, "target", "ridge"), rows, {"wealth": 500.0}))


def influence_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return _rounded(learning.isolation_outliers(_panel(spark, sf_dir), INDICATORS))


def influence_rotated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(learning.rotated_scores(_panel(spark, sf_dir), INDICATORS))


def influence_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(learning.baselines(panel(spark, sf_dir), "composite"))


def upload_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = votes(spark, sf_dir).select("country_name", "year", "topic", "vote", F.col("resolution").alias("session"))
    rows = uploads.normalise(raw, "un votes", set())
    return rows.groupBy("country", "issue", "interaction").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


UPLOAD_NORMALISED_SQL = f"""
WITH {VOTES_SQL}
SELECT country_name AS country, topic AS issue,
       CASE vote WHEN 'Y' THEN 'support' WHEN 'N' THEN 'opposition' ELSE 'neutral' END AS interaction,
       count(*) AS n, sum(vote_numeric)::DOUBLE AS score
FROM votes GROUP BY 1, 2, 3
"""


def events_cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.cluster_quality(events.prepare(gdelt(spark, sf_dir), "C03"))
    rows = [(k, str(round(v, 6) if isinstance(v, float) else v)) for k, v in found.items()]
    return spark.createDataFrame(rows, "measure string, value string")


def fusion_shock_camps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = trade.edges(trade_flows(spark, sf_dir).where("year = 2000"))
    impacts = trade.shock(edge, "NATION_3").select(F.col("country").alias("entity_iso3"), "impact")
    rows = [(c, b, 0.7) for b, members in ANCHORS.items() for c in members]
    blocs = spark.createDataFrame(rows, "entity_iso3 string, bloc string, confidence double")
    return _rounded(fusion.shock_camps(impacts, blocs))


_CAMPS = ", ".join(f"('{c}', '{b}')" for b, cs in ANCHORS.items() for c in cs)


def _camps_sql() -> str:
    from .trade import _shock_sql

    return (
        f"WITH shock AS ({_shock_sql(digits=15)}), camps(c, bloc) AS (VALUES {_CAMPS}) "
        "SELECT bloc, round(avg(impact), 6) AS mean_impact, count(*) AS hit, 0.7::DOUBLE AS confidence "
        "FROM shock JOIN camps ON c = country WHERE impact > 0 GROUP BY 1"
    )


def fusion_bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = trade.leverage_pairs(trade.edges(trade_flows(spark, sf_dir).where("year = 2000")), 0.0)
    dependence = pairs.select(
        F.least("holder", "exposed").alias("a"), F.greatest("holder", "exposed").alias("b"),
        (F.col("exposed_dependence") * 3).alias("dependence"), F.lit(0.8).alias("dc"),
    )
    rate = policy.agreement(votes(spark, sf_dir)).select("a", "b", (100 * F.col("rate")).alias("match_rate"), F.lit(0.6).alias("ac"))
    return _rounded(fusion.bilateral_tension(dependence, rate))


FUSION_BILATERAL_SQL = f"""
WITH {TRADE_FLOWS_SQL}, {VOTES_SQL}, s AS (
    SELECT exporter AS c, importer AS p, trade_value AS v FROM trade_flows WHERE year = 2000
    UNION ALL SELECT importer, exporter, trade_value FROM trade_flows WHERE year = 2000
), pt AS (SELECT c, p, sum(v) AS v FROM s GROUP BY 1, 2), t AS (SELECT c, sum(v) AS total FROM pt GROUP BY 1),
d AS (
    SELECT pt.c AS a, pt.p AS b, 3 * greatest(pt.v / ta.total, pt.v / tb.total) AS dependence
    FROM pt JOIN t ta ON ta.c = pt.c JOIN t tb ON tb.c = pt.p WHERE pt.c < pt.p
), m AS (
    SELECT x.country_name AS a, y.country_name AS b, 100 * sum(CASE WHEN x.vote = y.vote THEN 1 ELSE 0 END) / count(*) AS rate
    FROM votes x JOIN votes y ON x.year = y.year AND x.resolution = y.resolution AND x.country_name < y.country_name
    GROUP BY 1, 2
)
SELECT a, b, round(dependence, 6) AS dependence, round(rate, 6) AS match_rate, 'divergence' AS kind, 0.6::DOUBLE AS confidence
FROM d JOIN m USING (a, b) WHERE dependence >= 0.10 AND rate < 50
"""

INFLUENCE_BASELINES_SQL = f"""
WITH {PANEL_SQL}, w AS (
    SELECT lead(composite) OVER s AS f, composite AS c, lag(composite) OVER s AS b FROM panel
    WINDOW s AS (PARTITION BY iso3 ORDER BY period)
)
SELECT round(avg(abs(f - c)), 6) AS naive_mae, round(avg(abs(f - 2 * c + b)), 6) AS drift_mae, count(f - c) AS n FROM w
"""


QUERIES = {
    f.__name__: f
    for f in (
        policy_network_metrics, policy_components, policy_spectral_embedding, policy_walk_embedding, policy_bloc_discovery, influence_temporal_cv,
        influence_tree_drivers, influence_importance, influence_what_if, influence_outliers, influence_rotated_scores, influence_baselines,
        upload_normalised, events_cluster_quality, fusion_shock_camps, fusion_bilateral,
    )
}
ORACLES = {
    "policy_components": POLICY_COMPONENTS_SQL,
    "influence_baselines": INFLUENCE_BASELINES_SQL,
    "upload_normalised": UPLOAD_NORMALISED_SQL,
    "fusion_shock_camps": _camps_sql(),
    "fusion_bilateral": FUSION_BILATERAL_SQL,
}
