"""Operator 9: exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, table

TOP_K = 20
PIVOTS = 16
#: Rows, by hash of their id, that pivots are chosen from and first thresholds are set by.
SAMPLE_ROWS = 1024
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16384
#: Candidates of the first group that is evaluated; each later group has twice as many.
STEP = 512


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, x): floor(64 * component) as longs; rows that have none that counts are left out."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 64).cast("long")).alias("x")
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the smallest floats in which all sums of products stay exact, else as longs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


def _choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Rows of a sample, each the farthest from those before it."""
    points = sample.astype(np.float64)
    if not len(points):
        return points
    chosen, nearest = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(PIVOTS, len(points)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def _search(q_id: int, q: np.ndarray, bounds: np.ndarray, x: np.ndarray, ids: np.ndarray, floor: float, k: int):
    """Best k of a block for one query: candidates in bound order, until no bound reaches the k-th score.

    ``floor`` is a score that k candidates somewhere are known to reach. The
    order is one of groups, each twice the size of the one before: no bound in a group is
    above those of earlier groups, so the search stops at the first group without a
    bound that reaches the k-th score.
    """
    scores, found = np.empty(0, np.int64), np.empty(0, np.int64)

    def evaluate(some: np.ndarray) -> None:
        nonlocal scores, found, floor
        fresh = x[some] @ q
        some, fresh = some[fresh >= floor], fresh[fresh >= floor]
        scores, found = np.append(scores, fresh.astype(np.int64)), np.append(found, ids[some])
        order = np.lexsort((found, -scores))[:k]
        scores, found = scores[order], found[order]
        if len(scores) == k:
            floor = max(floor, scores[-1])

    left = np.flatnonzero(bounds >= floor)
    left = left[ids[left] != q_id]
    cuts, step = [], STEP
    while (cuts[-1] if cuts else 0) + step < len(left):
        cuts.append((cuts[-1] if cuts else 0) + step)
        step *= 2
    if cuts:
        left = left[np.argpartition(-bounds[left], cuts)]
    for some in np.split(left, cuts):
        some = some[bounds[some] >= floor]
        if not len(some):
            break
        evaluate(some)
    return scores, found


def top_k(df: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to smaller vec_id.

    ``df`` and ``queries`` have (vec_id, x) as :func:`quantised` gives them. A query meets
    every row of ``df`` but those of its own vec_id; repeated rows are
    candidates of their own, of repeated queries the one with the least vector asks.
    Vectors of different length are compared as if filled with zeros.

    Each row's distances to a few pivots are stored with it. For a query, the
    greatest difference to its own distances bounds the distance from below,
    and so, with both norms, the product from above. A sample of rows sets a
    first threshold. Queries and candidates are dealt into blocks of bounded
    size by hash; a task holds one block of each, and evaluates candidates in
    bound order until the stop is exact.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    n, width = df.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    width = max(width, queries.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0])
    sample = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    shared = spark.sparkContext.broadcast(
        (sample["vec_id"].to_numpy(np.int64), _matrix(sample["x"], width), _choose_pivots(_matrix(sample["x"], width)))
    )

    def with_pivots(batches):
        pivots = shared.value[2]
        for batch in batches:
            yield batch.assign(pivot=list(_distances(_matrix(batch["x"], width).astype(np.float64), pivots)))

    schema = "vec_id long, x array<long>, pivot array<double>"
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    c_blocks = max(1, -(-n // CANDIDATE_BLOCK))

    def dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return rows.mapInPandas(with_pivots, schema).select(
            "*",
            F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other),
        )

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            seen_ids, seen, _ = shared.value
            q, x = _matrix(left["x"], width), _matrix(right["x"], width)
            ids, q_ids = right["vec_id"].to_numpy(np.int64), left["vec_id"].to_numpy(np.int64)
            near_q = np.stack(left["pivot"].to_list()).astype(np.float32)
            near_x = np.stack(right["pivot"].to_list()).T.astype(np.float32)
            apart = np.empty_like(near_x)
            slack = 1e-6 + 1e-6 * max(near_q.max(initial=0), near_x.max(initial=0))  # of single precision
            q2, x2 = (np.square(a.astype(np.float64)).sum(axis=1) for a in (q, x))
            exact_q, exact_x = _exact(q, x)
            first_q, first_x = _exact(q, seen)
            for i, q_id in enumerate(q_ids):
                known = np.sort((first_x @ first_q[i])[seen_ids != q_id])
                floor = float(known[-k]) if len(known) >= k else -np.inf
                np.subtract(near_x, near_q[i][:, None], out=apart)
                gap = np.abs(apart, out=apart).max(axis=0, initial=0).astype(np.float64)
                gap = np.maximum(0, gap - slack)
                bounds = (q2[i] + x2 - gap * gap) / 2 + 1e-6 + 1e-9 * (q2[i] + x2)  # room for rounding
                scores, found = _search(q_id, exact_q[i], bounds, exact_x, ids, floor, k)
                out.append(pd.DataFrame({"query_id": q_id, "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = (
        dealt(queries, "qb", q_blocks, "cb", c_blocks)
        .groupBy("qb", "cb")
        .cogroup(dealt(df, "cb", c_blocks, "qb", q_blocks).groupBy("qb", "cb"))
        .applyInPandas(pair, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH clean AS (
    SELECT vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM clean q, clean c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
