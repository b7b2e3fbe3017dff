import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.operators import events, fusion, graph, learning, policy, uploads

RING = [(f"N{i}", f"N{(i + 1) % 6}", 1.0) for i in range(6)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "exporter string, importer string, weight double")


def test_network_metrics_of_a_ring_and_a_loose_pair(spark):
    found = {r.country: r for r in graph.network_metrics(edges(spark, [*RING, ("X", "Y", 1.0)])).collect()}
    assert {r.degree for c, r in found.items() if c[0] == "N"} == {2}
    assert len({r.component for r in found.values()}) == 2
    assert len({round(r.eigenvector, 6) for c, r in found.items() if c[0] == "N"}) == 1
    assert found["X"].pagerank == pytest.approx(found["Y"].pagerank)


def test_spectral_embedding_separates_two_groups(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 10.0) for g in "AB" for i in range(4) for j in range(i)] + [("A0", "B0", 0.1)]
    found = {r.country: r.x1 for r in graph.spectral_embedding(edges(spark, rows)).collect()}
    assert len({np.sign(found[f"A{i}"]) for i in range(4)} | {-np.sign(found[f"B{i}"]) for i in range(4)}) == 1


def test_discovered_blocs(spark):
    rows = [(f"{g}{i}", f"r{k}", 1.0 if g == "A" else -1.0) for g in "AB" for i in range(3 if g == "A" else 2) for k in range(5)]
    vectors = spark.createDataFrame(rows, "country_name string, resolution string, x double")
    found = {r.country: r.cluster for r in policy.discovered_blocs(vectors).collect()}
    assert found == {"A0": 1, "A1": 1, "A2": 1, "B0": 2, "B1": 2}


def training(spark, n=12):
    rng = np.random.default_rng(3)
    rows = [(f"C{i}", t, float(x), float(z), float(3 * x + rng.normal(0, 0.1))) for i in range(12) for t in range(n) for x, z in [rng.normal(size=2)]]
    return spark.createDataFrame(rows, "iso3 string, period int, x double, z double, y double")


def test_models_learn_and_explain(spark):
    df = training(spark).cache()
    cv = learning.temporal_cv(df, ["x", "z"], "y", "ridge", 2).collect()
    assert len(cv) == 2 and all(r.r2 > 0.9 and 0 <= r.coverage <= 1 for r in cv)
    fitted = learning.fit(df, ["x", "z"], "y", "forest")
    found = {r.feature: r.importance for r in learning.permutation_importance(fitted, df, ["x", "z"], "y").collect()}
    assert found["x"] > 10 * abs(found["z"])
    assert learning.adjusted_effect(df, "x", "y", ["z"]) == pytest.approx(3, abs=0.1)
    ridge = learning.fit(df, ["x", "z"], "y", "ridge")
    assert learning.what_if(ridge, df, {"x": 1.0}).agg(F.avg("effect")).first()[0] == pytest.approx(3, abs=0.3)
    ranked = learning.predictions(ridge, df, 0.5)
    assert sorted(r["rank"] for r in ranked.where("period = 0").collect()) == list(range(1, 13))
    assert learning.feature_columns(df.withColumn("my_score", F.col("x")), "y") == ["x", "z"]


def test_importance_groups(spark):
    rows = [("gdp_lag1", 1.0), ("gdp_slope", 2.0), ("trade", 0.5)]
    found = learning.group_importance(spark.createDataFrame(rows, "feature string, importance double")).collect()
    assert [(r.feature, r.importance) for r in found] == [("gdp", 3.0), ("trade", 0.5)]


def test_outliers_and_rotation(spark):
    df = training(spark).select("iso3", "period", "x", "z").union(spark.createDataFrame([("ODD", 0, 40.0, -40.0)], "a string, b int, c double, d double"))
    top = learning.isolation_outliers(df, ["x", "z"]).orderBy(F.desc("anomaly")).first()
    assert top.iso3 == "ODD" and top.is_outlier
    scores = learning.rotated_scores(training(spark), ["x", "z", "y"])
    assert scores.agg(F.min("score"), F.max("score")).first() == (0.0, 100.0)
    rotated = learning.varimax(np.array([[0.8, 0.6], [0.8, -0.6]]))
    assert np.allclose(rotated @ rotated.T, np.array([[1.0, 0.28], [0.28, 1.0]]))


def test_upload_layouts(spark):
    long = spark.createDataFrame([("France", "2001-05-01", "Yes", 1.0, "x"), ("Peru", "1999", "no", 2.0, None)], "Country string, date string, vote string, intensity double, note string")
    found = uploads.infer_schema(long, set())
    assert found["roles"] == {"country": "Country", "year": "date", "stance": "vote", "intensity": "intensity"}
    rows = {r.country: r for r in uploads.normalise(long, "un votes", set()).collect()}
    assert (rows["France"].year, rows["France"].score, rows["France"].interaction) == (2001, 1.0, "support")
    assert rows["France"].extra_features == {"note": "x"} and rows["Peru"].extra_features == {}
    names = [f"C{i}" for i in range(9)]
    wide = spark.createDataFrame([(2000, "topic", *([1.0, None, -1.0] * 3))], "yr int, topic string, " + ", ".join(f"{n} double" for n in names))
    assert uploads.infer_schema(wide, set(names))["wide"] == names
    spread = uploads.normalise(wide, "battle log", set(names)).collect()
    assert len(spread) == 6 and {r.interaction for r in spread} == {"conflict"} and {r.year for r in spread} == {2000}
    flags = spark.createDataFrame([(0, 0, "0"), (1, 2, "1"), (None, 1, "1")], "a int, b int, c string")
    assert uploads.binary_columns(flags, ["a", "b", "c"]) == ["a", "c"]


def test_cluster_quality(spark):
    rows = [(i, f"{1 + 9 * (i % 2):02d}", float(8 if i % 2 else -8) + (i % 3) * 0.1) for i in range(60)]
    rows += [(100 + i, f"{5 + 14 * (i % 2):02d}", float(2 if i % 2 else -2) + (i % 3) * 0.1) for i in range(60)]
    found = events.cluster_quality(spark.createDataFrame(rows, "event_id long, root string, goldstein double"))
    assert found["silhouette"] > found["null"] and found["label"] == "strong"
    assert events.cluster_quality(spark.createDataFrame(rows[:5], "event_id long, root string, goldstein double")) == {"reason": "under ten events"}


def test_cross_checks(spark):
    partners = spark.createDataFrame([("X", "P", 0.2, 0.8), ("X", "Q", 0.01, 0.8), ("X", "R", 0.3, 0.8)], "entity_iso3 string, partner string, share double, confidence double")
    relations = spark.createDataFrame([("X", "P", "conflict", 0.6), ("X", "Q", "conflict", 0.6), ("X", "R", "ally", 0.6)], "entity_iso3 string, partner string, relation string, confidence double")
    assert [(r.partner, r.confidence) for r in fusion.critical_partners(partners, relations).collect()] == [("P", 0.6)]
    days = spark.createDataFrame([("A-B", 5, -3.0, 0.5), ("A-C", 5, 3.0, 0.5), ("A-D", 1, 3.0, 0.5)], "dyad string, events int, mean_goldstein double, confidence double")
    history = spark.createDataFrame([("A-B", 0.4), ("A-C", 0.3), ("A-D", 0.3)], "dyad string, mean double")
    assert {r.dyad: r.kind for r in fusion.event_friction(days, history).collect()} == {"A-B": "divergence", "A-C": "corroboration"}
    trend = spark.createDataFrame([("X", "rising", 0.9), ("Y", "stable", 0.9)], "entity_iso3 string, trend string, confidence double")
    bloc = spark.createDataFrame([("X", "west", 0.7), ("Y", "west", 0.7)], "entity_iso3 string, bloc string, confidence double")
    assert [r.entity_iso3 for r in fusion.momentum_check(trend, bloc).collect()] == ["X"]
    scored = spark.createDataFrame([("dev", True, 2, 2, 2, 1.0, 5.0), ("dev", False, 1, 2, 2, 0.5, 9.0)], "split string, exact boolean, hit int, predicted int, gold int, understanding double, ms double")
    r = fusion.plan_scores(scored).first()
    assert (r.exact_match, r.precision, r.f1, r.p50_ms, r.p95_ms) == (0.5, 0.75, 0.75, 5.0, 9.0) and r.brier == pytest.approx(0.125)


def test_linear_attributions_add_up(spark):
    rows = spark.createDataFrame([(i, float(i), float(i * i % 7), 2.0 * i - 3.0 * (i * i % 7) + 1.0) for i in range(20)], "id int, a double, b double, y double")
    weights = learning.coefficients(rows, ["a", "b"], "y")
    assert weights == pytest.approx({"a": 2.0, "b": -3.0})
    found = learning.attributions(rows, weights, "id")
    sums = {r.id: r.s for r in found.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    mean = rows.agg(F.avg("y")).first()[0]
    assert sums == pytest.approx({r.id: r.y - mean for r in rows.collect()})
    assert [r.feature for r in learning.drivers(found).orderBy("rank").collect()] == ["a", "b"]
