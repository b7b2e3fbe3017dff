"""Boosted and bagged regression trees whose splits come from Spark aggregates.

Values are binned once. A level of a tree is one aggregate over the rows: sums of
weights and gradients by tree, node, feature and bin. All trees that are being
grown, of every fold, quantile and bag, share that pass, so the number of jobs
depends on rounds and depth alone. What reaches the driver are these sums, a
bounded number for each tree, and the splits chosen from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.session import ship_package

from .network import _checkpointed

BINS, LEAST_ROWS, LEAST_GAIN = 32, 5, 1e-9
#: Rounds after which scores are stored, instead of made from the trees since.
STORED_ROUNDS = 5
#: Quantiles of the interval and its middle.
QUANTILES = (0.1, 0.5, 0.9)
#: Shares of the boosted trees, the bagged trees and the deeper boosted trees in the ensemble.
SHARES = (0.5, 0.25, 0.25)


@dataclass
class Spec:
    """Trees to grow: for which rows, towards which quantile (None: the mean), how many, how deep, and with which bag of rows."""

    name: str
    where: Column
    quantile: float | None = None
    rounds: int = 20
    depth: int = 3
    rate: float = 0.2
    bag: int | None = None


@dataclass
class Tree:
    """Nodes in heap order: node i has children 2i + 1 and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray


@dataclass
class Ensemble:
    """A start value and trees over binned features."""

    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, pdf: pd.DataFrame) -> np.ndarray:
        """0 for a missing value, else 1 and the number of edges below it."""
        columns = []
        for name, edges in zip(self.features, self.edges, strict=True):
            x = pdf[name].to_numpy(float)
            columns.append(np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, side="left")))
        return np.stack(columns, axis=1)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.start + sum((_value(t, bins) for t in self.trees), np.zeros(len(bins)))

    def attribute(self, bins: np.ndarray) -> np.ndarray:
        """Shapley values of every feature for every row, exactly; rows add up to the prediction less :meth:`mean`."""
        return sum((_attributed(t, bins) for t in self.trees), np.zeros(bins.shape))

    def mean(self) -> float:
        """The mean prediction over the rows that the trees were grown on."""
        leaves = [(t.feature < 0) & (t.cover > 0) for t in self.trees]
        return self.start + sum(float((t.value[on] * t.cover[on]).sum() / t.cover[0]) for t, on in zip(self.trees, leaves, strict=True))


def _value(tree: Tree, bins: np.ndarray) -> np.ndarray:
    return tree.value[_nodes(tree, bins)]


def _paths(tree: Tree) -> Iterator[tuple[float, dict]]:
    """Each leaf's value and, by feature on its path, the share of rows that goes that way and the bins that do."""
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        f = tree.feature[at]
        if f < 0:
            yield tree.value[at], path
            continue
        for child, low, high in ((2 * at + 1, -1, tree.bin[at]), (2 * at + 2, tree.bin[at], np.inf)):
            share, least, most = path.get(f, (1.0, -1, np.inf))
            stack.append((child, path | {f: (share * tree.cover[child] / tree.cover[at], max(least, low), min(most, high))}))


def _attributed(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """A leaf is a product over the features of its path: 1 or 0 where the feature is known, the share where it is not.

    A feature's value is the difference it makes to that product, weighted over all sets of the other
    features; sums over sets of one size come from a polynomial with a factor for each feature.
    """
    out = np.zeros(bins.shape)
    for value, path in _paths(tree):
        features, n = list(path), len(path)
        shares = np.array([path[f][0] for f in features])
        held = [((bins[:, f] > path[f][1]) & (bins[:, f] <= path[f][2])).astype(float) for f in features]
        weights = [1 / (n * _choose(n - 1, k)) for k in range(n)]
        for i, f in enumerate(features):
            sums = [np.ones(len(bins))]
            for j in range(n):
                if j != i:
                    known, unknown = [s * held[j] for s in sums], [s * shares[j] for s in sums]
                    sums = [a + b for a, b in zip([*unknown, 0.0], [0.0, *known], strict=True)]
            out[:, f] += value * (held[i] - shares[i]) * sum(w * s for w, s in zip(weights, sums, strict=True))
    return out


def _choose(n: int, k: int) -> int:
    return reduce(lambda x, i: x * (n - i) // (i + 1), range(k), 1)


def _edges(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    levels = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(c, levels, 10_000).alias(c) for c in features)).first()
    return [np.unique(np.array([v for v in found[c] or [] if v is not None], float)) for c in features]


def _best_split(part: pd.DataFrame) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a node, from its sums by feature and bin; ties go to the first."""
    best = None
    for f, rows in part.sort_values(["feature", "bin"]).groupby("feature", sort=True):
        w, g = rows["w"].to_numpy(), rows["g"].to_numpy()
        left_w, left_g = w.cumsum()[:-1], g.cumsum()[:-1]
        right_w, right_g = w.sum() - left_w, g.sum() - left_g
        fair = (left_w >= LEAST_ROWS) & (right_w >= LEAST_ROWS)
        if fair.any():
            gain = np.full(len(left_w), -np.inf)
            gain[fair] = left_g[fair] ** 2 / left_w[fair] + right_g[fair] ** 2 / right_w[fair] - g.sum() ** 2 / w.sum()
            i = int(np.argmax(np.round(gain, 9)))
            if gain[i] > LEAST_GAIN and (best is None or round(gain[i], 9) > round(best[0], 9)):
                best = (float(gain[i]), int(f), int(rows["bin"].iloc[i]))
    return best


def fit_trees(rows: DataFrame, features: list[str], target: str, specs: list[Spec], *ids: str) -> dict[str, Ensemble]:
    """An ensemble for every spec; those of one name (bags) add up to their mean. ``ids`` name a row, for drawing bags.

    Boosted trees follow the gradient of the pinball loss, and each leaf takes the quantile of what is
    left to explain in it; trees for the mean take means. Rows without target are left out; missing
    values stand before all others. Gains that agree to nine decimals are ties, and go to the first feature and bin.
    """
    known = rows.where(F.col(target).isNotNull())
    edges = _edges(known, features)

    def bin_of(c: str, e: np.ndarray) -> Column:
        below = F.size(F.filter(F.array(*map(F.lit, e.tolist())), lambda x: x < F.col(c))) if len(e) else F.lit(0)
        return F.when(F.col(c).isNull() | F.isnan(c), 0).otherwise(1 + below)

    bins = [bin_of(c, e) for c, e in zip(features, edges, strict=True)]

    def weight(s: Spec) -> Column:
        if s.bag is None:
            return F.when(s.where, 1.0).otherwise(0.0)
        drawn = F.pmod(F.xxhash64(*ids, F.lit(s.bag)), F.lit(1 << 30)) / float(1 << 30)
        times = sum(((drawn >= p).cast("double") for p in (0.36788, 0.73576, 0.91970, 0.98101)), F.lit(0.0))  # draws with replacement
        return F.when(s.where, times).otherwise(0.0)

    base = _checkpointed(known.select(F.array(*bins).alias("bins"), F.col(target).cast("double").alias("y"), F.array(*map(weight, specs)).alias("w")))
    w = [F.get("w", F.lit(i)) for i in range(len(specs))]
    first = base.agg(
        *(F.percentile(F.when(w[i] > 0, F.col("y")), s.quantile) if s.quantile is not None else F.sum(w[i] * F.col("y")) / F.sum(w[i]) for i, s in enumerate(specs))
    ).first()
    starts = [float(v) if v is not None else 0.0 for v in first]
    state, fresh = base.withColumn("score", F.array(*map(F.lit, starts))), [[] for _ in specs]
    grown: list[list[Tree]] = [[] for _ in specs]
    ship_package(rows.sparkSession)
    for r in range(max(s.rounds for s in specs)):
        if r and r % STORED_ROUNDS == 0:
            state, fresh = _checkpointed(_with_scores(state, fresh)), [[] for _ in specs]
        active = [i for i, s in enumerate(specs) if r < s.rounds]
        for i, tree in _grown(state, fresh, specs, active, len(features)).items():
            grown[i].append(tree)
            fresh[i].append(tree)
    out: dict[str, Ensemble] = {}
    bags = {s.name: sum(x.name == s.name for x in specs) for s in specs}
    for s, start, found in zip(specs, starts, grown, strict=True):
        whole, n = out.setdefault(s.name, Ensemble(features, edges, 0.0)), bags[s.name]
        whole.start += start / n
        whole.trees += [Tree(t.feature, t.bin, t.value / n, t.cover) for t in found]
    return out


def _columns(pdf: pd.DataFrame, fresh: list[list[Tree]]) -> tuple[np.ndarray, ...]:
    """Bins, targets, weights and scores of a batch, what the trees since the last stored scores add included."""
    bins, w = np.stack(pdf["bins"].to_numpy()), np.stack(pdf["w"].to_numpy())
    score = np.array(np.stack(pdf["score"].to_numpy()), float)
    for i, trees in enumerate(fresh):
        for tree in trees:
            score[:, i] += _value(tree, bins)
    return bins, pdf["y"].to_numpy(float), w, score


def _with_scores(state: DataFrame, fresh: list[list[Tree]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=list(_columns(pdf, fresh)[3]))

    return state.mapInPandas(run, state.schema)


def _nodes(tree: Tree, bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), int)
    while (inner := tree.feature[at] >= 0).any():
        left = bins[np.arange(len(bins)), tree.feature[at]] <= tree.bin[at]
        at = np.where(inner, np.where(left, 2 * at + 1, 2 * at + 2), at)
    return at


def _slopes(left: np.ndarray, quantile: float | None) -> np.ndarray:
    return left if quantile is None else np.where(left < 0, quantile - 1.0, quantile)


def _grown(state: DataFrame, fresh: list[list[Tree]], specs: list[Spec], active: list[int], features: int) -> dict[int, Tree]:
    """One more tree for each active spec: an aggregate for each level, and one for the leaves.

    A task adds up its rows by tree, node, feature and bin; Spark adds up the tasks.
    """
    sizes = {i: 2 ** (specs[i].depth + 1) - 1 for i in active}
    trees = {i: Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n)) for i, n in sizes.items()}
    quantiles = {i: specs[i].quantile for i in active}
    some = list(active)
    for level in range(max(specs[i].depth for i in active)):
        some = [i for i in some if level < specs[i].depth]
        if not some:
            break

        def summed(batches: Iterator[pd.DataFrame], some=tuple(some), low=2**level - 1) -> Iterator[pd.DataFrame]:
            cells = (2 * low + 1) * features * (BINS + 1)
            total = {i: np.zeros((2, cells)) for i in some}
            for pdf in batches:
                bins, y, w, score = _columns(pdf, fresh)
                for i in some:
                    at = _nodes(trees[i], bins)
                    on = (w[:, i] > 0) & (at >= low)
                    place = ((at[on, None] * features + np.arange(features)) * (BINS + 1) + bins[on]).ravel()
                    weight = w[on, i]
                    slope = weight * _slopes(y - score[:, i], quantiles[i])[on]
                    for k, value in enumerate((weight, slope)):
                        total[i][k] += np.bincount(place, np.repeat(value, features), cells)
            for i in some:
                held = np.flatnonzero(total[i][0])
                yield pd.DataFrame(
                    {
                        "spec": i, "node": held // (BINS + 1) // features, "feature": held // (BINS + 1) % features,
                        "bin": held % (BINS + 1), "w": total[i][0, held], "g": total[i][1, held],
                    }
                )

        sums = state.mapInPandas(summed, "spec int, node int, feature int, bin int, w double, g double").groupBy("spec", "node", "feature", "bin")
        going = set()
        for (i, at), part in sums.agg(F.sum("w").alias("w"), F.sum("g").alias("g")).toPandas().groupby(["spec", "node"]):
            best = _best_split(part)
            if best is not None:
                trees[i].feature[at], trees[i].bin[at] = best[1:]
                going.add(i)
        some = [i for i in some if i in going]

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins, y, w, score = _columns(pdf, fresh)
            parts = []
            for i in active:
                on = w[:, i] > 0
                parts.append(pd.DataFrame({"spec": i, "node": _nodes(trees[i], bins)[on], "w": w[on, i], "g": (y - score[:, i])[on]}))
            yield pd.concat(parts)

    levels = sorted(set(quantiles.values()) - {None}) or [0.5]
    leaves = state.mapInPandas(reached, "spec int, node int, w double, g double").groupBy("spec", "node").agg(
        F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("g")) / F.sum("w")).alias("mean"), F.percentile("g", levels).alias("quantiles")
    )
    for x in leaves.collect():
        tree, q = trees[x.spec], quantiles[x.spec]
        tree.cover[x.node] = x.w
        tree.value[x.node] = specs[x.spec].rate * (x["mean"] if q is None else x.quantiles[levels.index(q)])
    for tree in trees.values():
        for at in reversed(range(len(tree.feature))):
            if tree.feature[at] >= 0:
                tree.cover[at] = tree.cover[2 * at + 1] + tree.cover[2 * at + 2]
    return trees


def predictions(df: DataFrame, models: dict[str, Ensemble], *keys: str) -> DataFrame:
    """(keys, a column for each model): predictions of every row."""
    ship_package(df.sparkSession)
    features = next(iter(models.values())).features
    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + ", ".join(f"`{m}` double" for m in models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = next(iter(models.values())).binned(pdf)
            yield pdf[list(keys)].assign(**{name: m.predict(bins) for name, m in models.items()})

    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in features if c not in keys)).mapInPandas(run, fields)


def tree_attributions(df: DataFrame, model: Ensemble, *keys: str) -> DataFrame:
    """(keys, feature, contribution): what each feature adds to each row's prediction, exactly.

    Contributions of a row add up to its prediction less the mean over the training rows.
    """
    ship_package(df.sparkSession)
    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + "feature string, contribution double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = model.attribute(model.binned(pdf))
            for j, name in enumerate(model.features):
                yield pdf[list(keys)].assign(feature=name, contribution=found[:, j])

    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in model.features if c not in keys)).mapInPandas(run, fields)


def ensemble_specs(name: str, where: Column, bags: int = 20, rounds: int = 20) -> list[Spec]:
    """Boosted trees for each quantile, a deeper and slower set for the middle, and bagged trees for the mean."""
    quantiles = [Spec(f"{name}q{q}", where, q, rounds) for q in QUANTILES]
    return [*quantiles, Spec(f"{name}deep", where, 0.5, rounds, 4, 0.1), *(Spec(f"{name}bag{b}", where, None, 1, 4, 1.0, b) for b in range(bags))]


def quantile_cv(df: DataFrame, features: list[str], target: str, folds: int = 4, bags: int = 20, rounds: int = 20, coverage: float = 0.8) -> DataFrame:
    """Expanding folds over (iso3, period): error and coverage of the ensemble and its three intervals.

    (cut, n, mae, r2, quantile_coverage, spread_coverage, half_width, conformal_coverage). Each fold trains up to a
    period before the cut, calibrates up to the cut and tests on the next. The ensemble takes half of
    the boosted middle, a quarter each of the bags' mean and the deeper trees. Its intervals: the boosted
    quantiles, 1.28 standard deviations of the bagged trees, and the split-conformal half-width.
    All folds are trained together.
    """
    known = _checkpointed(df.where(F.col(target).isNotNull()).select("iso3", "period", *features, F.col(target).cast("double").alias("y")))
    periods = sorted(r[0] for r in known.select("period").distinct().orderBy(F.desc("period")).limit(folds + 1).collect())
    cuts, low = periods[:-1], known.agg(F.min("period")).first()[0]
    fields = "cut int, n long, mae double, r2 double, quantile_coverage double, spread_coverage double, half_width double, conformal_coverage double"
    if not cuts:
        return df.sparkSession.createDataFrame([], fields)
    split = {c: c - max(1, (c - low) // 5) for c in cuts}
    specs = [s for c in cuts for s in ensemble_specs(f"{c}/", F.col("period") <= split[c], bags, rounds)]
    models = fit_trees(known, features, "y", specs, "iso3", "period")
    scored = _checkpointed(predictions(known, models, "iso3", "period", "y"))

    def of(c: int, name: str) -> Column:
        return F.col(f"`{c}/{name}`")

    parts = []
    for c in cuts:
        trees = F.array(*(of(c, f"bag{b}") for b in range(bags)))
        mean = F.aggregate(trees, F.lit(0.0), lambda a, x: a + x) / bags
        squares = F.aggregate(trees, F.lit(0.0), lambda a, x: a + x * x) / bags
        spread = F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))
        guess = SHARES[0] * of(c, "q0.5") + SHARES[1] * mean + SHARES[2] * of(c, "deep")
        rows = scored.select(
            F.lit(c).alias("cut"), "period", "y", guess.alias("guess"), F.least(of(c, "q0.1"), of(c, "q0.9")).alias("low"),
            F.greatest(of(c, "q0.1"), of(c, "q0.9")).alias("high"), mean.alias("middle"), (1.28 * spread).alias("reach"), F.lit(split[c]).alias("split"),
        )
        parts.append(rows.where((F.col("period") > F.col("split")) & (F.col("period") <= c + 1)))
    rows = reduce(DataFrame.unionByName, parts).withColumn("error", F.abs(F.col("y") - F.col("guess")))
    width = rows.where("period <= cut").groupBy("cut").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    at = F.least(F.size("errors"), F.ceil((F.size("errors") + 1) * coverage).cast("int"))
    width = width.select("cut", F.get("errors", at - 1).alias("half_width"))
    tested = rows.where("period = cut + 1").join(F.broadcast(width), "cut", "left")
    share = lambda c: F.avg(c.cast("double"))
    return tested.groupBy("cut").agg(
        F.count("*").alias("n"), F.avg("error").alias("mae"), (1 - F.sum(F.col("error") ** 2) / (F.var_pop("y") * F.count("y"))).alias("r2"),
        share((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high"))).alias("quantile_coverage"),
        share(F.abs(F.col("y") - F.col("middle")) <= F.col("reach")).alias("spread_coverage"),
        F.max("half_width").alias("half_width"), share(F.col("error") <= F.col("half_width")).alias("conformal_coverage"),
    )
