"""Graph measures of country networks.

Every function takes edges (exporter, importer, weight) and the columns that
name the graph; :mod:`.network` has the measures themselves, for graphs of any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.session import scratch_folder

from . import network
from .learning import principal_axes
from .network import components, modularity, spectral_embedding  # noqa: F401
from .trade import concentration

#: Most nodes of a graph whose matrix of meetings is made.
MAX_NODES = 2000
DAMPING, TOLERANCE, MAX_ROUNDS = 0.85, 1e-6, 100


def pagerank(edge: DataFrame, *keys: str) -> DataFrame:
    """(keys, country, pagerank): weighted PageRank; sinks spread evenly; ends below 1e-6 a country."""
    graphs = network.held_graphs(edge, *keys)
    if graphs is None:
        return pagerank_table(edge, *keys)

    def work(graph: network.Graph) -> dict:
        n = len(graph.names)
        out = np.bincount(graph.sources, graph.weights, n)
        share = np.divide(graph.weights, out[graph.sources], out=np.zeros(len(graph.weights)), where=out[graph.sources] > 0)
        x = np.full(n, 1 / n)
        for _ in range(MAX_ROUNDS):
            before = x
            flow = np.bincount(graph.targets, share * before[graph.sources], n)
            x = DAMPING * (flow + before[out <= 0].sum() / n) + (1 - DAMPING) / n
            if np.abs(x - before).sum() < n * TOLERANCE:
                break
        return {"pagerank": x}

    return network._by_graph(edge, keys, graphs, work, "pagerank double")


def pagerank_table(edge: DataFrame, *keys: str, tolerance: float = TOLERANCE, rounds: int = 100) -> DataFrame:
    """PageRank of every country of every graph by joins and sums, for graphs of any size.

    Each round joins ranks to the links and sums them by importer; countries
    without exports share their rank with all. It ends when no graph's
    ranks change by its size times ``tolerance``. Ranks are checkpointed each round, so
    the plan does not grow and a lost executor costs one round.
    """
    spark = edge.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_folder(spark, "pagerank"))
    named = edge if keys else edge.withColumn("__graph", F.lit(0))
    on = list(keys) or ["__graph"]
    nodes = named.select(*on, F.explode(F.array("exporter", "importer")).alias("country")).distinct()
    sizes = nodes.groupBy(*on).agg(F.count("*").alias("n"))
    out = named.groupBy(*on, F.col("exporter").alias("country")).agg(F.sum("weight").alias("out"))
    links = named.withColumnRenamed("exporter", "country").join(out.where("out > 0"), [*on, "country"])
    links = links.select(*on, "country", "importer", (F.col("weight") / F.col("out")).alias("share")).checkpoint()
    base = nodes.join(sizes, on).join(out, [*on, "country"], "left").select(*on, "country", "n", (F.coalesce("out", F.lit(0.0)) <= 0).alias("idle"))
    ranks = base.withColumn("pagerank", 1 / F.col("n")).checkpoint()
    for _ in range(rounds):
        flow = links.join(ranks, [*on, "country"]).groupBy(*on, F.col("importer").alias("country")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("flow"))
        idle = ranks.groupBy(*on).agg(F.sum(F.when(F.col("idle"), F.col("pagerank")).otherwise(0.0)).alias("spread"))
        rank = (1 - DAMPING) / F.col("n") + DAMPING * (F.coalesce("flow", F.lit(0.0)) + F.col("spread") / F.col("n"))
        after = ranks.join(flow, [*on, "country"], "left").join(idle, on).select(
            *on, "country", "n", "idle", rank.alias("pagerank"), F.abs(rank - F.col("pagerank")).alias("moved")
        ).checkpoint()
        open_ = after.groupBy(*on).agg((F.sum("moved") >= F.max("n") * tolerance).alias("open")).agg(F.bool_or("open")).first()[0]
        ranks = after.drop("moved")
        if not open_:
            break
    return ranks.select(*keys, "country", "pagerank")


def centrality(edge: DataFrame, *keys: str) -> DataFrame:
    """PageRank and betweenness of every country of every graph."""
    return pagerank(edge, *keys).join(network.betweenness(edge, *keys), [*keys, "country"])


def _scaled(column: str) -> F.Column:
    low, high = F.col(f"low_{column}"), F.col(f"high_{column}")
    return F.when(high > low, (F.coalesce(F.col(column), F.lit(0.0)) - low) / (high - low)).otherwise(0.0)


def risk(edge: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """0.4 scaled PageRank, 0.3 scaled betweenness and 0.3 HHI, which stays as it is.

    ``known`` is the graph's centrality where it has been computed before.
    """
    both = concentration(edge).select("country", "hhi").join(centrality(edge) if known is None else known, "country", "left")
    bounds = both.agg(
        *(f(c).alias(f"{n}_{c}") for c in ("pagerank", "betweenness") for n, f in (("low", F.min), ("high", F.max)))
    )
    score = 0.4 * _scaled("pagerank") + 0.3 * _scaled("betweenness") + 0.3 * F.col("hhi")
    return both.join(F.broadcast(bounds)).select("country", "pagerank", "betweenness", "hhi", score.alias("risk_score"))


def trade_blocs(edge: DataFrame, *keys: str) -> DataFrame:
    """Communities of the undirected graph, ordered by strength and named after their strongest member."""
    edge = network._checkpointed(edge.groupBy(*keys, "exporter", "importer").agg(F.sum("weight").alias("weight")))
    member = network._checkpointed(network.communities(edge, *keys))
    both = network.undirected(edge, *keys)
    own = member.select(*keys, F.col("country").alias("exporter"), F.col("community").alias("a"))
    other = member.select(*keys, F.col("country").alias("importer"), F.col("community").alias("b"))
    ends = both.join(own, [*keys, "exporter"]).join(other, [*keys, "importer"])
    sums = ends.groupBy(*keys, F.col("exporter").alias("country")).agg(
        F.sum("weight").alias("strength"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside")
    )
    rows = member.join(sums, [*keys, "country"], "left").na.fill(0.0, ["strength", "inside"])
    blocs = rows.groupBy(*keys, "community").agg(
        F.sum("strength").alias("total"), F.min_by("country", F.struct((-F.col("strength")).alias("s"), "country")).alias("bloc")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("total"), "bloc")
    named = blocs.select(*keys, "community", "bloc", F.row_number().over(order).alias("bloc_id"))
    quality = modularity(edge, member, "community", *keys)
    found = rows.join(named, [*keys, "community"])
    found = found.join(quality, list(keys), "left") if keys else found.crossJoin(F.broadcast(quality))
    share = F.when(F.col("strength") > 0, F.col("inside") / F.col("strength")).otherwise(0.0)
    return found.select(
        *keys, "country", "bloc_id", "bloc", "strength", share.alias("internal_share"), F.coalesce("modularity", F.lit(0.0)).alias("modularity")
    )


def bloc_summary(blocs: DataFrame, *keys: str) -> DataFrame:
    """Members in order of strength, their number, mean internal share, total strength."""
    return blocs.groupBy(*keys, "bloc_id", "bloc").agg(
        F.count("*").alias("members"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("s"), "country"))), lambda x: x["country"]),
            ", ",
        ).alias("member_list"),
        F.avg("internal_share").alias("mean_internal_share"),
        F.sum("strength").alias("total_strength"),
    )


def network_metrics(edge: DataFrame, *keys: str) -> DataFrame:
    """Degree, eigenvector, PageRank, betweenness, component and community in the undirected graph."""
    both = network._checkpointed(network.undirected(edge, *keys).where("weight > 0"))
    linked = both.withColumn("weight", F.lit(1.0))
    found = network._checkpointed(both.groupBy(*keys, F.col("exporter").alias("country")).agg(F.count("*").alias("degree")))
    measures = (network.eigenvector(both, *keys), pagerank(both, *keys), network.betweenness(linked, *keys), components(both, *keys), network.communities(edge, *keys))
    for measure in measures:
        found = found.join(measure, [*keys, "country"])
    return found


def random_walks(edge: DataFrame, walks: int = 10, length: int = 8) -> DataFrame:
    """(walk, path): ``walks`` walks of ``length`` nodes from every node, along links either way.

    The next node is drawn by weight: of all neighbours the one with the least
    exponential variate of its weight, made from a hash of walk, step and name, so
    walks are the same however rows are dealt. A step is one join and one minimum.
    """
    both = edge.select("exporter", "importer", "weight").unionByName(
        edge.select(F.col("importer").alias("exporter"), F.col("exporter").alias("importer"), "weight")
    )
    near = both.where("weight > 0 AND exporter <> importer").groupBy(F.col("exporter").alias("at"), F.col("importer").alias("next")).agg(F.sum("weight").alias("weight"))
    starts = near.select("at").distinct()
    path = starts.select(
        F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("i"), "at", F.array("at").alias("path")
    ).select(F.concat_ws("-", "at", F.col("i").cast("string")).alias("walk"), "at", "path")
    for step in range(1, length):
        drawn = (F.pmod(F.xxhash64("walk", F.lit(step), "next"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        path = (
            path.join(near, "at")
            .groupBy("walk")
            .agg(F.min_by(F.struct("next", "path"), F.struct(-F.log(drawn) / F.col("weight"), "next")).alias("s"))
            .select("walk", F.col("s.next").alias("at"), F.concat("s.path", F.array("s.next")).alias("path"))
        )
    return path.select("walk", "path")


def walk_embedding(edge: DataFrame, k: int = 8, window: int = 2, walks: int = 10, length: int = 8) -> DataFrame:
    """(country, embedding): how often nodes meet within ``window`` steps of random walks, on its principal axes.

    The matrix has a row and a column per node, so more than ``MAX_NODES`` are refused.
    """
    paths = random_walks(edge, walks, length)
    spots = paths.select("walk", F.posexplode("path").alias("i", "country"))
    met = spots.join(spots.select("walk", F.col("i").alias("j"), F.col("country").alias("other")), "walk").where(
        (F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= window)
    )
    counts = met.groupBy("country", "other").agg(F.log1p(F.count("*").cast("double")).alias("x"))
    names = [r[0] for r in counts.select("country").distinct().orderBy("country").limit(MAX_NODES + 1).collect()]
    if len(names) > MAX_NODES:
        raise ValueError(f"a graph has more than {MAX_NODES} nodes, too many for one matrix")
    if not names:
        return counts.select("country", F.array(F.lit(0.0)).alias("embedding"))
    held = counts.groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct("other", "x"))).alias("row"))
    values = F.transform(F.array(*map(F.lit, names)), lambda c: F.coalesce(F.element_at("row", c), F.lit(0.0)))
    return principal_axes(held.select("country", values.alias("values")), "values", len(names), k).select("country", "embedding")
