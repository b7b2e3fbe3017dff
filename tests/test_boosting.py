"""Trees from Spark aggregates against plain ones, and attributions against all subsets."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geolith.operators import boosting
from geolith.operators.boosting import Ensemble, Spec, Tree, fit_trees, predictions, quantile_cv, tree_attributions


def panel(n=60, seed=3, periods=6):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"iso3": [f"C{i % 10}" for i in range(n)], "period": [i // (n // periods) for i in range(n)]})
    for c in "abcd":
        rows[c] = np.round(rng.normal(size=n), 3)
    rows.loc[5, "a"] = np.nan
    rows["y"] = np.round(2 * rows["a"].fillna(0) + (rows["b"] > 0) * rows["c"] + rng.normal(0, 0.1, n), 3)
    return rows


def frame(spark, rows):
    listed = [[None if isinstance(v, float) and math.isnan(v) else v for v in r] for r in rows.itertuples(index=False, name=None)]
    return spark.createDataFrame(listed, "iso3 string, period int, a double, b double, c double, d double, y double")


def plain_boosting(bins, y, quantile, rounds, depth, rate):
    """The same trees by trying every split of every node."""
    score = np.full(len(y), np.quantile(y, quantile))

    def grow(some, left):
        g = np.where(y[some] - score[some] < 0, quantile - 1, quantile)
        best = None
        if left:
            for f in range(bins.shape[1]):
                for b in sorted(set(bins[some, f]))[:-1]:
                    low = bins[some, f] <= b
                    if min(low.sum(), (~low).sum()) < boosting.LEAST_ROWS:
                        continue
                    gain = g[low].sum() ** 2 / low.sum() + g[~low].sum() ** 2 / (~low).sum() - g.sum() ** 2 / len(g)
                    if gain > boosting.LEAST_GAIN and (best is None or round(gain, 9) > round(best[0], 9)):
                        best = (gain, low)
        if best is None:
            step[some] = rate * np.quantile(y[some] - score[some], quantile)
            return
        grow(some[best[1]], left - 1)
        grow(some[~best[1]], left - 1)

    for _ in range(rounds):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), depth)
        score = score + step
    return score


def test_boosted_quantiles_equal_plain_trees(spark):
    rows = panel()
    df = frame(spark, rows)
    specs = [Spec(f"q{q}", F.lit(True), q, 3, 2, 0.3) for q in boosting.QUANTILES]
    models = fit_trees(df, list("abcd"), "y", specs, "iso3", "period")
    bins = models["q0.5"].binned(rows)
    found = predictions(df.withColumn("n", F.xxhash64("a", "b", "c")), models, "iso3", "period", "b").toPandas()
    order = rows.merge(found, on=["iso3", "period", "b"])
    for q in boosting.QUANTILES:
        want = plain_boosting(bins, rows["y"].to_numpy(), q, 3, 2, 0.3)
        assert order[f"q{q}"].to_numpy() == pytest.approx(want, abs=1e-9)


def by_subsets(tree: Tree, x, n):
    """Shapley values from the definition: unknown features follow both branches by their share of rows."""

    def expected(known, at=0):
        f = tree.feature[at]
        if f < 0:
            return tree.value[at]
        left, right = 2 * at + 1, 2 * at + 2
        if f in known:
            return expected(known, left if x[f] <= tree.bin[at] else right)
        return sum(tree.cover[c] / tree.cover[at] * expected(known, c) for c in (left, right))

    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for some in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                out[i] += w * (expected({*some, i}) - expected(set(some)))
    return out


def test_attributions_equal_all_subsets_and_add_up(spark):
    rows = panel(80, 5, 8)
    df = frame(spark, rows)
    model = fit_trees(df, list("abcd"), "y", [Spec("m", F.lit(True), None, 4, 3, 0.5)], "iso3", "period")["m"]
    bins = model.binned(rows)
    for i in (0, 5, 33, 79):
        want = sum(by_subsets(t, bins[i], 4) for t in model.trees)
        assert model.attribute(bins)[i] == pytest.approx(want, abs=1e-12)
    assert model.mean() == pytest.approx(model.predict(bins).mean(), abs=1e-9)
    parts = tree_attributions(df.withColumn("k", F.col("c")), model, "iso3", "period", "k").groupBy("iso3", "period", "k").agg(F.sum("contribution").alias("s"))
    both = parts.join(predictions(df.withColumn("k", F.col("c")), {"m": model}, "iso3", "period", "k"), ["iso3", "period", "k"]).collect()
    assert len(both) == 80 and all(r.s == pytest.approx(r.m - model.mean(), abs=1e-9) for r in both)


def test_one_feature_twice_on_a_path():
    tree = Tree(np.array([0, 0, -1, -1, -1]), np.array([4, 2, 0, 0, 0]), np.array([0, 0, 3.0, 1.0, 2.0]), np.array([10.0, 6, 4, 2, 4]))
    for x in range(7):
        got = Ensemble(["a"], [np.array([])], 0.0, [tree]).attribute(np.array([[x]]))[0]
        assert got == pytest.approx(by_subsets(tree, [x], 1))


def test_folds_report_error_and_coverage(spark):
    rows = panel(400, 8, 10)
    found = quantile_cv(frame(spark, rows), list("abcd"), "y", folds=2, bags=5, rounds=8).orderBy("cut").collect()
    still = rows["y"].std()
    assert [r.cut for r in found] == [7, 8] and all(r.n == 40 and r.mae < 0.6 * still and r.r2 > 0.4 for r in found)
    # 80 % intervals, 40 tested rows: four standard errors are a quarter.
    assert all(0.55 <= r.conformal_coverage <= 1 for r in found)
    assert all(0 <= r.spread_coverage <= 1 and 0 <= r.quantile_coverage <= 1 for r in found)
    assert quantile_cv(frame(spark, panel()).limit(0), list("abcd"), "y").count() == 0
