import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.operators import events, forecast, fusion, influence, policy, questions


def panel(spark, n=14):
    rng = np.random.default_rng(2)
    rows = [(c, t, float(50 + i * 3 + t * (i - 1) + rng.normal()), float(rng.normal())) for i, c in enumerate("ABC") for t in range(n)]
    rows.append(("D", 0, 1.0, 1.0))
    return spark.createDataFrame(rows, "iso3 string, period int, composite double, other double")


def test_kalman_bands_and_forecast(spark):
    filtered = influence.kalman(panel(spark), "composite").cache()
    rows = filtered.collect()
    assert {r.iso3 for r in rows} == {"A", "B", "C"}
    assert all(r.ci_lower_95 <= r.kalman_score <= r.ci_upper_95 for r in rows)
    ahead = influence.kalman_forecast(filtered).orderBy("iso3", "horizon").collect()
    assert [r.horizon for r in ahead[:5]] == [1, 2, 3, 4, 5]
    assert all(a.forecast_std <= b.forecast_std for a, b in zip(ahead, ahead[1:]) if a.iso3 == b.iso3)
    assert ahead[-1].forecast_score > ahead[0].forecast_score
    assert influence.coverage(filtered).first().coverage > 0.8


def test_filter_ignores_missing_values_but_grows_uncertain():
    values = np.array([1.0, 2.0, np.nan, np.nan, 3.0])
    states, variances, innovations = influence.kalman_filter(values, 0.5, 0.1)
    assert states[1] == states[2] == states[3] and variances[3] > variances[2] > variances[1]
    assert np.isnan(innovations[2])
    smoothed, spread = influence.smooth(states, variances, 0.5)
    assert smoothed[-1] == states[-1] and (spread <= variances + 1e-12).all()


def test_composite_reweights_what_is_present(spark):
    rows = [(50.0, 50.0, 50.0, 50.0, 50.0), (None, 40.0, None, 60.0, None), (None,) * 5]
    out = influence.composite(spark.createDataFrame(rows, "d1 double, d2 double, d3 double, d4 double, d5 double")).collect()
    assert [r.composite_raw for r in out] == [50, 50, None]
    assert out[0].composite_adjusted == pytest.approx(48.75)


def test_conformal_and_vif_and_peers(spark):
    r = spark.createDataFrame([(float(i),) for i in range(1, 11)], "r double")
    assert influence.conformal_half_width(r, "r").first().half_width == pytest.approx(9.1)
    p = panel(spark).withColumn("copy", F.col("other") * 2)
    v = {r.indicator: r.vif for r in influence.vif(p, ["composite", "other"]).collect()}
    assert v["other"] == pytest.approx(1, abs=0.2)
    vectors = influence.peer_vectors(panel(spark).where("iso3 <> 'D'"), ["composite", "other"])
    assert influence.peers(vectors, 1).count() == 3
    assert sum(x.contribution for x in influence.explain_peers(vectors, "A", "A").collect()) == pytest.approx(1)


def test_forecasts_of_odd_series(spark):
    series = {"flat": [5.0] * 30, "zeros": [0.0] * 30, "steep": [float(100 - 5 * i) for i in range(30)], "one": [3.0], "line": [float(i) for i in range(30)]}
    rows = [(k, t, y) for k, v in series.items() for t, y in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    for method in ("auto", "linear", "arima", "hybrid"):
        out = forecast.forecast(df, "k", "t", "y", method=method).collect()
        assert len(out) == 15
        assert all(np.isfinite(r.forecast) and r.forecast >= 0 and 0 <= r.confidence <= 1 for r in out)
    line = [r.forecast for r in forecast.forecast(df, "k", "t", "y", method="linear").where("k = 'line'").collect()]
    assert line == pytest.approx([30, 31, 32])


INSIGHT = "agent string, entity_iso3 string, facet string, sector string, pair string, claim string, score double, confidence double, reason string, caveat string"


def test_fusion(spark):
    rows = [
        ("trade", "USA", "risk", None, None, "a", 1.0, 0.6, "", None), ("trade", "USA", "risk", None, None, "b", 1.0, 0.8, "", None),
        ("policy", "USA", "risk", None, None, "c", 1.0, 0.5, "", None), ("policy", "IND", "risk", None, None, " ", 1.0, 1.5, "", None),
    ]
    insights = spark.createDataFrame(rows, INSIGHT)
    assert fusion.invalid_insights(insights).first().problem == "no claim"
    single = fusion.dedupe_insights(insights.where("entity_iso3 = 'USA'"))
    assert {r.claim for r in single.collect()} == {"b", "c"}
    both = fusion.corroborations(single).first()
    assert both.confidence == pytest.approx(0.9) and both.agents == "policy,trade"
    found = both.asDict() | {"caveat": None}
    findings = spark.createDataFrame(
        [(found["kind"], "USA", "risk", found["agents"], found["confidence"], None), ("insight", "USA", "risk", "trade", 0.99, None)],
        "kind string, entity_iso3 string, facet string, agents string, confidence double, caveat string",
    )
    ranked = fusion.rank_findings(findings, [], ["USA"])
    assert [r.kind for r in ranked.orderBy("position").collect()] == ["corroboration", "insight"]
    assert fusion.briefing(ranked).startswith("1. USA (risk): corroboration")
    blocs = "entity_iso3 string, bloc string, confidence double"
    d = fusion.divergences(spark.createDataFrame([("X", "a", 0.8), ("Y", "a", 0.5)], blocs), spark.createDataFrame([("X", "b", 0.6), ("Y", "a", 0.5)], blocs))
    assert {r.entity_iso3: (r.kind, round(r.confidence, 6)) for r in d.collect()} == {"X": ("divergence", 0.6), "Y": ("corroboration", 0.75)}
    parts = fusion.assess_confidence(spark.createDataFrame([(0.9, 0.3, 0.3)], "a double, b double, c double"), ["a", "b", "c"]).first()
    assert parts.confidence == pytest.approx(0.5) and parts.limiting == "b"


def test_questions(spark):
    aliases = spark.createDataFrame([("united states", "USA"), ("China", "CHN"), ("India", "IND")], "alias string, iso3 string")
    asked = {
        "What happens if China cuts off electronics exports?": ("shock", "CHN", "electronics", 1.0),
        "What happens if China loses 30 percent of trade": ("shock", "CHN", "all", 0.3),
        "Forecast exports of India": ("forecast", "IND", "all", None),
        "How do the U.S. and India get along?": ("bilateral", "IND,USA", "all", None),
        "Which countries are most fragile, top ten?": ("ranking", "", "all", None),
        "Tell me about events in India": ("profile", "IND", "all", None),
        "events in India yesterday": ("events", "IND", "all", None),
    }
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)] + [(99, None)], "id int, text string")
    plans = {r.id: r for r in questions.parse(df, aliases).collect()}
    for i, expected in enumerate(asked.values()):
        assert (plans[i].intent, plans[i].countries, plans[i].sector, plans[i].severity) == expected
    assert plans[4].limit == 10 and plans[99].understanding == 0.4
    latest = spark.createDataFrame([("a", 2023), ("a", 2024), ("b", 2022)], "agent string, year int")
    assert questions.aligned_year(latest).first().aligned_year == 2022


def test_policy_codes_and_event_labels(spark):
    df = spark.createDataFrame([("Some Group", "O'NEIL al-asad", None), ("X", "x", -5.0)], "name string, title string, g double")
    row = df.select(policy.synthetic_code(F.col("name")).alias("c"), events.title_case_words(F.col("title")).alias("t"), events.tone(F.col("g")).alias("tone")).collect()
    import hashlib

    assert row[0].c == 10000 + int(hashlib.md5(b"Some Group").hexdigest()[:8], 16) % 900000
    assert row[0].t == "O'Neil Al-Asad" and row[0].tone == "neutral" and row[1].tone == "tense"
    votes = spark.createDataFrame([(1, 2000, "r", "Y", 1), (1, 2000, "r", "N", 2)], "country_code int, year int, resolution string, vote string, k int")
    assert policy.dedupe_votes(votes, "k").first().vote == "N"


def test_forecast_as_a_table_function(spark):
    forecast.register_forecast_function(spark)
    rows = spark.sql("SELECT k, step, forecast FROM VALUES ('a', array(1D, 2D, 3D)), ('b', array(4D)) AS t(k, v), LATERAL series_forecast(v, 2) ORDER BY k, step").collect()
    assert [(r.k, r.step, round(r.forecast, 6)) for r in rows] == [("a", 1, 4.0), ("a", 2, 5.0), ("b", 1, 4.0), ("b", 2, 4.0)]


def test_scores_and_benchmarks(spark):
    p = panel(spark).where("iso3 <> 'D'")
    chosen = influence.preferred_score(p, influence.kalman(p, "composite"), "composite")
    assert chosen.count() == p.count() and chosen.where("score IS NULL").count() == 0
    scores = spark.createDataFrame([("A", 3.0), ("B", 2.0), ("C", 1.0), ("X", 9.0)], "iso3 string, score double")
    outside = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "iso3 string, rank int")
    assert tuple(influence.benchmark_agreement(scores, outside).first()) == (1.0, 3)
    edge = spark.createDataFrame([("A", None)], "a string, b string")
    assert policy.graph_json(edge).first().value == '{"a":"A","b":null}'


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ("India", "China", "agriculture", "exports", "from")], "word string")
    asked = spark.createDataFrame([(1, "Exprots from Indai, agricluture?"), (2, "chna or qqqq"), (3, None)], "id int, q string")
    found = {r.id: r.corrected for r in questions.correct_spelling(asked, words, "id", "q").collect()}
    assert found == {1: "exports from india, agriculture?", 2: "china or qqqq", 3: ""}


@pytest.mark.parametrize("seed", [1, 2])
def test_kendall_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(g), float(x), None if y == 7 else float(y)) for g, x, y in zip(rng.integers(0, 3, 400), rng.integers(0, 9, 400), rng.integers(0, 12, 400), strict=True)]
    rows += [(9, 1.0, 1.0), (9, 1.0, 2.0), (8, 4.0, 4.0)]
    found = {r.g: (r.kendall, r.n) for r in influence.kendall(spark.createDataFrame(rows, "g int, x double, y double"), "x", "y", "g").collect()}
    for g in {r[0] for r in rows}:
        part = [(x, y) for k, x, y in rows if k == g and y is not None]
        signs = [(np.sign(a - c), np.sign(b - d)) for i, (a, b) in enumerate(part) for c, d in part[:i]]
        va, vb = (sum(s[k] ** 2 for s in signs) for k in (0, 1))
        want = sum(a * b for a, b in signs) / np.sqrt(va * vb) if va * vb else None
        assert found[g] == (want if want is None else pytest.approx(want), len(part))
