"""Models over the panel: tree ensembles with conformal widths, importance, outliers, rotated scores.

Training and scoring run in MLlib or in tasks; what reaches the driver is
bounded by the number of indicators, folds or sampled rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.session import ship_package

MODELS = {
    "gbt": lambda: GBTRegressor(maxIter=20, maxDepth=3, seed=42),
    "forest": lambda: RandomForestRegressor(numTrees=40, maxDepth=6, seed=42),
    "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0),
}
LEAKY_MARKS = ("composite", "rank", "target", "score")


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """Numeric columns that do not give the target away by name."""
    return [
        c for c, t in df.dtypes if t in ("double", "float") and c != target and not any(m in c.lower() for m in LEAKY_MARKS)
    ]


def fit(df: DataFrame, features: list[str], target: str, model: str = "gbt") -> PipelineModel:
    regressor = MODELS[model]().setFeaturesCol("features").setLabelCol(target).setPredictionCol("prediction")
    filled = [f"{c}__filled" for c in features]
    steps = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features")]
    return Pipeline(stages=[*steps, regressor]).fit(df.where(F.col(target).isNotNull()))


def coefficients(rows: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """Least-squares coefficients over the complete rows, by feature."""
    complete = rows.na.drop(subset=[*features, target])
    fitted = LinearRegression(featuresCol="features", labelCol=target, solver="normal").fit(
        VectorAssembler(inputCols=features, outputCol="features").transform(complete)
    )
    return dict(zip(features, map(float, fitted.coefficients), strict=True))


def attributions(rows: DataFrame, weights: dict[str, float], *keys: str) -> DataFrame:
    """(keys, feature, contribution): a linear model's exact Shapley values, coefficient times distance from the mean.

    Missing values contribute nothing.
    """
    means = rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in weights))
    parts = F.array(
        *(
            F.struct(F.lit(c).alias("feature"), F.coalesce(w * (F.col(c) - F.col(f"mean_{c}")), F.lit(0.0)).alias("contribution"))
            for c, w in weights.items()
        )
    )
    return rows.crossJoin(F.broadcast(means)).select(*keys, F.explode(parts).alias("p")).select(*keys, "p.feature", "p.contribution")


def drivers(found: DataFrame, *by: str, top: int = 10) -> DataFrame:
    """The features of greatest mean absolute contribution, overall or per ``by``; ties by name."""
    mean = found.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("mean_abs"), "feature"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= top)


def principal_axes(rows: DataFrame, values: str, width: int, k: int) -> DataFrame:
    """``rows`` with ``embedding``: the array ``values`` of ``width`` on its first ``k`` principal axes, zeros where there are fewer."""
    found = min(k, width)
    vectors = rows.withColumn("__v", array_to_vector(values))
    placed = PCA(k=found, inputCol="__v", outputCol="__p").fit(vectors).transform(vectors)
    padded = F.concat(vector_to_array("__p"), F.array_repeat(F.lit(0.0), k - found))
    return placed.withColumn("embedding", padded).drop("__v", "__p")


def half_width(fitted: PipelineModel, calibration: DataFrame, target: str, coverage: float = 0.8) -> float:
    """Split-conformal half-width: the absolute residual at level ceil((n + 1) * coverage) / n."""
    residuals = fitted.transform(calibration.where(F.col(target).isNotNull())).select(F.abs(F.col(target) - F.col("prediction")).alias("r"))
    n = residuals.count()
    if not n:
        return float("nan")
    return residuals.agg(F.percentile("r", float(min(1.0, np.ceil((n + 1) * coverage) / n)))).first()[0]


def temporal_folds(df: DataFrame, folds: int = 4) -> list[int]:
    """Cut-off periods of expanding folds: the last ``folds`` periods but one each."""
    periods = [r[0] for r in df.select("period").distinct().orderBy(F.desc("period")).limit(folds + 1).collect()]
    return sorted(periods)[:-1]


def temporal_cv(df: DataFrame, features: list[str], target: str, model: str = "gbt", folds: int = 4) -> DataFrame:
    """Error, R2 and interval coverage per fold: trained up to a period, tested on the next.

    The last fifth of the training periods calibrates the interval.
    """
    rows, known = [], df.where(F.col(target).isNotNull())
    for cut in temporal_folds(known, folds):
        low, high = known.where(F.col("period") <= cut).agg(F.min("period"), F.max("period")).first()
        split = high - max(1, (high - low) // 5)
        fitted = fit(known.where(F.col("period") <= split), features, target, model)
        width = half_width(fitted, known.where((F.col("period") > split) & (F.col("period") <= cut)), target)
        tested = fitted.transform(known.where(F.col("period") == cut + 1)).cache()
        if tested.limit(1).count():
            mae = RegressionEvaluator(labelCol=target, metricName="mae").evaluate(tested)
            r2 = RegressionEvaluator(labelCol=target, metricName="r2").evaluate(tested)
            inside = tested.agg(F.avg((F.abs(F.col(target) - F.col("prediction")) <= width).cast("int"))).first()[0]
            rows.append((int(cut), float(mae), float(r2), float(width), float(inside)))
        tested.unpersist()
    return df.sparkSession.createDataFrame(rows, "cut int, mae double, r2 double, half_width double, coverage double")


def baselines(df: DataFrame, value: str) -> DataFrame:
    """Errors of "no change" and of "same change as before" for the next value."""
    w = Window.partitionBy("iso3").orderBy("period")
    following, before = F.lead(value).over(w), F.lag(value).over(w)
    rows = df.select((following - F.col(value)).alias("naive"), (following - 2 * F.col(value) + before).alias("drift"))
    return rows.agg(
        F.avg(F.abs("naive")).alias("naive_mae"), F.avg(F.abs("drift")).alias("drift_mae"), F.count("naive").alias("n")
    )


def permutation_importance(fitted: PipelineModel, df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rise of the mean error when one feature is shifted to another row of its period; stands in for attribution tables."""
    known = df.where(F.col(target).isNotNull())

    def mae(rows: DataFrame) -> float:
        return fitted.transform(rows).agg(F.avg(F.abs(F.col(target) - F.col("prediction")))).first()[0]

    base = mae(known)
    order = Window.partitionBy("period").orderBy(F.xxhash64("iso3"))
    ring = F.count("*").over(Window.partitionBy("period"))
    found = []
    for c in features:
        first = F.first(c).over(order)
        moved = F.when(F.row_number().over(order) == ring, first).otherwise(F.lead(c).over(order))
        found.append((c, float(mae(known.withColumn(c, moved)) - base)))
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def group_importance(importance: DataFrame, top: int = 12) -> DataFrame:
    """Importance summed over lag, slope and rolling variants of a feature, the largest first."""
    name = F.regexp_replace("feature", r"_(lag\d+|slope|delta\d+|rolling_(mean|std)|mean|std)$", "")
    grouped = importance.groupBy(name.alias("feature")).agg(F.sum("importance").alias("importance"))
    return grouped.orderBy(F.desc("importance"), "feature").limit(top)


def what_if(fitted: PipelineModel, df: DataFrame, changes: dict[str, float]) -> DataFrame:
    """Predictions before and after adding to some features."""
    before = fitted.transform(df).select("iso3", "period", F.col("prediction").alias("before"))
    changed = df.withColumns({c: F.col(c) + d for c, d in changes.items()})
    after = fitted.transform(changed).select("iso3", "period", F.col("prediction").alias("after"))
    return before.join(after, ["iso3", "period"]).withColumn("effect", F.col("after") - F.col("before"))


def adjusted_effect(df: DataFrame, treatment: str, outcome: str, controls: list[str]) -> float:
    """Average effect by the back-door: the treatment's coefficient in a linear model with the controls."""
    known = df.dropna(subset=[treatment, outcome, *controls])
    vectors = VectorAssembler(inputCols=[treatment, *controls], outputCol="features").transform(known)
    return float(LinearRegression(labelCol=outcome, regParam=0.0).fit(vectors).coefficients[0])


def rotated_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """First varimax component of the indicators as a score from 0 to 100.

    Loadings come from the correlation matrix, a number per pair of indicators;
    they are applied as one expression. Rows with under half of the indicators
    have no score; missing ones are left out of the weights.
    """
    complete = df.dropna(subset=columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(complete)
    matrix = np.nan_to_num(np.array(Correlation.corr(vectors, "v").first()[0].toArray()))
    values, axes = np.linalg.eigh(matrix)
    kept = max(1, int((values > 1).sum()))
    loadings = varimax(axes[:, ::-1][:, :kept] * np.sqrt(np.maximum(values[::-1][:kept], 0)))
    strongest = loadings[:, np.square(loadings).sum(axis=0).argmax()]
    strongest = strongest * (1 if strongest.sum() >= 0 else -1)
    stats = df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))

    def part(c: str, w: float) -> tuple[Column, Column]:
        z = (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)
        return F.when(F.col(c).isNotNull(), z * float(w)).otherwise(0.0), F.when(F.col(c).isNotNull(), abs(float(w))).otherwise(0.0)

    sums, weights = zip(*(part(c, w) for c, w in zip(columns, strongest, strict=True)), strict=True)
    present = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    total, weight = reduce(lambda a, b: a + b, sums), reduce(lambda a, b: a + b, weights)
    enough = (present >= max(2, len(columns) // 2)) & (weight > 0)
    scored = df.crossJoin(F.broadcast(stats)).select("iso3", "period", F.when(enough, total / weight).alias("raw"))
    bounds = scored.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    spread = F.col("high") - F.col("low")
    return scored.crossJoin(F.broadcast(bounds)).select(
        "iso3", "period", F.when(spread > 0, 100 * (F.col("raw") - F.col("low")) / spread).otherwise(F.col("raw") * 0).alias("score")
    )


def varimax(loadings: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Orthogonal rotation towards few large loadings per component."""
    n, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x * np.square(x).sum(axis=0) / n))
        turn = u @ v
        if s.sum() < before * (1 + 1e-8):
            break
        before = s.sum()
    return loadings @ turn


def _isolation_tree(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Nodes (column, cut, left, right, size) of a tree that cuts at random; leaves have column -1."""
    nodes: list[tuple] = []

    def grow(some: np.ndarray, left: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, len(some)))
        if left and len(some) > 1:
            column = int(rng.integers(some.shape[1]))
            low, high = some[:, column].min(), some[:, column].max()
            if low < high:
                cut = float(rng.uniform(low, high))
                below = some[:, column] < cut
                nodes[at] = (column, cut, grow(some[below], left - 1), grow(some[~below], left - 1), len(some))
        return at

    grow(rows, depth)
    return nodes


def _usual(n: np.ndarray) -> np.ndarray:
    """Mean depth of a search among ``n`` rows."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(many - 1) + 0.5772156649) - 2 * (n - 1) / many, (n == 2).astype(float))


def _depths(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Depth of every row in one tree, all rows going down a level at once."""
    at, depth = np.zeros(len(x), int), np.zeros(len(x))
    going = np.arange(len(x))
    while len(going):
        here = nodes[at[going]]
        inner = here[:, 0] >= 0
        going, here = going[inner], here[inner]
        below = x[going, here[:, 0].astype(int)] < here[:, 1]
        at[going] = np.where(below, here[:, 2], here[:, 3]).astype(int)
        depth[going] += 1
    return depth + _usual(nodes[at, 4])


def isolation_outliers(df: DataFrame, columns: list[str], share: float = 0.03, trees: int = 200, sample: int = 256) -> DataFrame:
    """Isolation forest: (iso3, period, anomaly, is_outlier).

    Every tree draws its own rows by hash, about a quarter more than ``sample``, keeps the ``sample`` that
    come first, and is grown in a task; only cuts reach the driver. All rows are scored, column-wise. The given share of
    rows with the highest scores are outliers.
    """
    ship_package(df.sparkSession)
    known = df.dropna(subset=columns).select("iso3", "period", *columns)
    n = known.count()
    if not n:
        return known.select("iso3", "period", F.lit(0.0).alias("anomaly"), F.lit(False).alias("is_outlier"))
    size, scale = min(sample, n), 1 << 30
    depth = int(np.ceil(np.log2(max(2, size))))

    def draw(t: Column) -> Column:
        return F.pmod(F.xxhash64("iso3", "period", t), F.lit(scale))

    bar = int(scale * min(1.0, 1.25 * size / n + 8 / n))
    drawn = known.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < bar)).alias("tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(["at", "iso3", "period"]).head(size)[columns].to_numpy(float)
        nodes = _isolation_tree(rows, np.random.default_rng([42, tree]), depth)
        return pd.DataFrame({"tree": [tree], "nodes": [np.array(nodes, float).ravel().tolist()]})

    grown = drawn.withColumn("at", draw(F.col("tree"))).groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>")
    forest = [np.array(r.nodes).reshape(-1, 5) for r in grown.orderBy("tree").collect()]

    def score(batches):
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            mean = sum((_depths(t, x) for t in forest), np.zeros(len(x))) / max(1, len(forest))
            yield pd.DataFrame({"iso3": pdf["iso3"], "period": pdf["period"], "anomaly": 2 ** (-mean / max(float(_usual(size)), 1e-9))})

    scored = known.mapInPandas(score, "iso3 string, period int, anomaly double")
    cut = scored.agg(F.percentile("anomaly", 1 - share).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).select("iso3", "period", "anomaly", (F.col("anomaly") > F.col("cut")).alias("is_outlier"))


def predictions(fitted: PipelineModel, df: DataFrame, width: float) -> DataFrame:
    """Predictions with their interval and rank."""
    out = fitted.transform(df).select(
        "iso3", "period", F.col("prediction").alias("score"), (F.col("prediction") - width).alias("ci_lower"),
        (F.col("prediction") + width).alias("ci_upper"), vector_to_array("features").alias("features"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("score"), "iso3")))
