"""Measures of networks of any size: shortest paths, communities, eigenvectors.

Every function takes edges (exporter, importer, weight) and the columns that
name the graph; many graphs are measured at once. There are two ways. Edges
that stay under ``EDGE_LIMIT``, which is checked, are sent to all tasks in sparse
form, and the work is dealt: sources of paths in blocks, other measures by graph.
Beyond it all steps are joins and sums over the edge table, with the lineage cut
each round, so that no task, and never the driver, holds a graph.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.session import scratch_folder, ship_package

#: Most edges, of all graphs together, that are sent to all tasks: some 6 MB in sparse form.
EDGE_LIMIT = 250_000
#: Sources of paths that one piece of work has.
SOURCE_BLOCK = 32
#: Pairs of source and node that are worked on at once where paths are found by joins.
PAIRS_AT_ONCE = 50_000_000
#: Lengths of paths that differ by rounding are equal.
SAME_LENGTH = 1e-12
#: Multiplications between two checkpoints, and most checkpoints of an iteration.
STEPS, MOST_STEPS = 6, 60
TOLERANCE = 1e-6
#: Nodes of a graph whose eigenvectors are found at once.
DENSE_NODES = 400


@dataclass
class Graph:
    """A graph in sparse form: ``targets[begin[i]:begin[i + 1]]`` are the nodes that node ``i`` links to."""

    key: tuple
    names: list
    begin: np.ndarray
    sources: np.ndarray
    targets: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(key: tuple, names: list, sources: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> Graph:
        n = len(names)
        order = np.argsort(sources * n + targets, kind="stable")
        sources, targets, weights = sources[order], targets[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(sources * n + targets) != 0])[: len(sources)])
        weights = np.add.reduceat(weights, first) if len(first) else weights
        sources, targets = sources[first], targets[first]
        return Graph(key, names, np.searchsorted(sources, np.arange(n + 1)), sources, targets, weights)

    def undirected(self) -> Graph:
        """Both directions summed, without links to oneself."""
        out = self.sources != self.targets
        s, t, w = self.sources[out], self.targets[out], self.weights[out]
        return Graph.of(self.key, self.names, np.concatenate([s, t]), np.concatenate([t, s]), np.concatenate([w, w]))

    def times(self, x: np.ndarray) -> np.ndarray:
        """The weight matrix times ``x``, a vector or columns of vectors."""
        out = np.zeros_like(x)
        np.add.at(out, self.sources, self.weights.reshape(-1, *[1] * (x.ndim - 1)) * x[self.targets])
        return out

    def near(self, i: int) -> zip:
        part = slice(self.begin[i], self.begin[i + 1])
        return zip(self.targets[part].tolist(), self.weights[part].tolist(), strict=True)


def held_graphs(edge: DataFrame, *keys: str) -> list[Graph] | None:
    """The graphs of an edge table in sparse form; None if they have more than ``EDGE_LIMIT`` edges together."""
    rows = edge.groupBy(*keys, "exporter", "importer").agg(F.sum("weight").alias("weight")).limit(EDGE_LIMIT + 1).toPandas()
    if len(rows) > EDGE_LIMIT:
        return None
    groups = rows.groupby(list(keys), dropna=False, sort=True) if keys and len(rows) else [((), rows)] if len(rows) else []
    out = []
    for key, part in groups:
        names = sorted(set(part["exporter"]) | set(part["importer"]))
        at = {c: i for i, c in enumerate(names)}
        ends = (part[c].map(at).to_numpy(np.int64) for c in ("exporter", "importer"))
        out.append(Graph.of(tuple(key), names, *ends, part["weight"].to_numpy(float)))
    return out


def _dealt(edge: DataFrame, keys: tuple, graphs: list[Graph], pieces: list[tuple], work: Callable[..., pd.DataFrame], columns: str) -> DataFrame:
    """``work`` of every piece (number of its graph, and more), the pieces dealt to tasks, with the graph's keys."""
    spark = edge.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(graphs)
    fields = "".join(f"{k} {edge.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in batch.itertuples(index=False):
                graph = shared.value[piece.graph]
                out = work(graph, piece.low, piece.high)
                for i, k in enumerate(keys):
                    out.insert(i, k, [graph.key[i]] * len(out))
                yield out

    frame = spark.createDataFrame(pieces, "graph int, low int, high int")
    return frame.repartition(max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, fields + columns)


def _by_graph(edge: DataFrame, keys: tuple, graphs: list[Graph], work: Callable[[Graph], dict], columns: str) -> DataFrame:
    pieces = [(i, 0, 0) for i in range(len(graphs))]
    return _dealt(edge, keys, graphs, pieces, lambda g, low, high: pd.DataFrame({"country": g.names} | work(g)), f"country string, {columns}")


def _checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Unlike a checkpoint's rows, a table brings along no constraints of the plan it
    comes from; over many rounds these take longer to plan than the rounds take to run.
    """
    folder = scratch_folder(df.sparkSession, "network")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def nodes_of(edge: DataFrame, *keys: str) -> DataFrame:
    return edge.select(*keys, F.explode(F.array("exporter", "importer")).alias("country")).distinct()


def undirected(edge: DataFrame, *keys: str) -> DataFrame:
    """Both directions of every link between two countries, summed."""
    turned = edge.select(*keys, F.col("importer").alias("exporter"), F.col("exporter").alias("importer"), "weight")
    both = edge.select(*keys, "exporter", "importer", "weight").unionByName(turned).where("exporter <> importer")
    return both.groupBy(*keys, "exporter", "importer").agg(F.sum("weight").alias("weight"))


# Shortest paths.


def _shares(near: list[list[tuple[int, float]]], source: int) -> np.ndarray:
    """What the shortest paths from ``source`` add to the nodes between: Dijkstra, then sums from the far end."""
    n = len(near)
    distance, paths, before = np.full(n, np.inf).tolist(), [0.0] * n, [[] for _ in range(n)]
    distance[source], paths[source] = 0.0, 1.0
    queue, done, order = [(0.0, source)], [False] * n, []
    while queue:
        d, v = heapq.heappop(queue)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for w, cost in near[v]:
            there = d + cost
            if there < distance[w] * (1 - SAME_LENGTH) or distance[w] == np.inf:
                distance[w], paths[w], before[w] = there, paths[v], [v]
                heapq.heappush(queue, (there, w))
            elif not done[w] and there <= distance[w] * (1 + SAME_LENGTH):
                paths[w] += paths[v]
                before[w].append(v)
    share, total = [0.0] * n, np.zeros(n)
    for w in reversed(order):
        for v in before[w]:
            share[v] += paths[v] / paths[w] * (1 + share[w])
        if w != source:
            total[w] += share[w]
    return total


def betweenness(edge: DataFrame, *keys: str) -> DataFrame:
    """(keys, country, betweenness): the share of shortest paths through each country, directed, normalised.

    A link is 1 / weight long; paths of equal length up to rounding count together.
    Sources are dealt to tasks in blocks, and what each adds is summed by country.
    """
    graphs = held_graphs(edge, *keys)
    if graphs is None:
        return _betweenness_by_joins(edge, *keys)

    def work(graph: Graph, low: int, high: int) -> pd.DataFrame:
        near = [[(w, 1 / x) for w, x in graph.near(v) if x > 0] for v in range(len(graph.names))]
        part = sum((_shares(near, s) for s in range(low, high)), np.zeros(len(near)))
        return pd.DataFrame({"country": graph.names, "n": len(near), "part": part})

    pieces = [(i, low, min(low + SOURCE_BLOCK, len(g.names))) for i, g in enumerate(graphs) for low in range(0, len(g.names), SOURCE_BLOCK)]
    parts = _dealt(edge, keys, graphs, pieces, work, "country string, n long, part double")
    return _normalised(parts.groupBy(*keys, "country").agg(F.max("n").alias("n"), F.sum("part").alias("part")), keys)


def _normalised(parts: DataFrame, keys: tuple) -> DataFrame:
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return parts.select(*keys, "country", F.when(F.col("n") > 2, F.col("part") / pairs).otherwise(0.0).alias("betweenness"))


def _betweenness_by_joins(edge: DataFrame, *keys: str) -> DataFrame:
    """The same by joins, for batches of sources whose pairs with all nodes are bounded.

    Distances are relaxed from the nodes that got nearer. The links on shortest
    paths are then a matrix T for each source: powers of T from the source add up to the
    numbers of paths, s, and powers of its transpose from T' (1 / s) to y; each node's part is s * y.
    """
    links = edge.groupBy(*keys, "exporter", "importer").agg(F.sum("weight").alias("weight")).where("weight > 0 AND exporter <> importer")
    links = _checkpointed(links.select(*keys, F.col("exporter").alias("u"), F.col("importer").alias("v"), (1 / F.col("weight")).alias("cost")))
    nodes = _checkpointed(nodes_of(edge, *keys))
    sizes = nodes.groupBy(*keys).agg(F.count("*").alias("n")) if keys else nodes.agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    batches = -(-pairs // PAIRS_AT_ONCE)
    found = [_parts_of(nodes.where(F.pmod(F.xxhash64("country"), F.lit(batches)) == b), links, keys) for b in range(batches)]
    if not found:
        return nodes.withColumn("betweenness", F.lit(0.0))
    total = reduce(DataFrame.unionByName, found).groupBy(*keys, "country").agg(F.sum("part").alias("part"))
    sized = nodes.join(sizes, list(keys)) if keys else nodes.crossJoin(F.broadcast(sizes))
    return _normalised(sized.join(total, [*keys, "country"], "left").na.fill(0.0, ["part"]), keys)


def _parts_of(sources: DataFrame, links: DataFrame, keys: tuple) -> DataFrame:
    s = [*keys, "s"]
    state = sources.select(*keys, F.col("country").alias("s"), F.col("country").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh"))
    state = _checkpointed(state)
    old, new = F.col("old"), F.col("new")
    nearer = old.isNull() | (new < old * (1 - SAME_LENGTH))
    while state.where("fresh").limit(1).count():
        ahead = state.where("fresh").withColumnRenamed("v", "u").join(links, [*keys, "u"]).select(*s, "v", F.lit(None).cast("double").alias("old"), (F.col("d") + F.col("cost")).alias("new"))
        both = state.select(*s, "v", F.col("d").alias("old"), F.lit(None).cast("double").alias("new")).unionByName(ahead)
        least = both.groupBy(*s, "v").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        state = _checkpointed(least.select(*s, "v", F.when(nearer, new).otherwise(old).alias("d"), F.coalesce(nearer, F.lit(False)).alias("fresh")))
    from_, to = state.select(*s, F.col("v").alias("u"), F.col("d").alias("du")), state.select(*s, "v", F.col("d").alias("dv"))
    tight = from_.join(links, [*keys, "u"]).join(to, [*s, "v"]).where((F.col("du") + F.col("cost") <= F.col("dv") * (1 + SAME_LENGTH)) & (F.col("v") != F.col("s")))
    tight = _checkpointed(tight.select(*s, "u", "v"))

    def powers(x: DataFrame, at: str, to: str) -> DataFrame:
        """The sum of ``x`` and what it becomes along the links on shortest paths, as often as there are links."""
        parts = [x]
        while parts[-1].limit(1).count():
            moved = parts[-1].withColumnRenamed("node", at).join(tight, [*s, at]).groupBy(*s, F.col(to).alias("node")).agg(F.sum("x").alias("x"))
            parts.append(_checkpointed(moved))
        return reduce(DataFrame.unionByName, parts).groupBy(*s, "node").agg(F.sum("x").alias("x"))

    start = sources.select(*keys, F.col("country").alias("s"), F.col("country").alias("node"), F.lit(1.0).alias("x"))
    paths = _checkpointed(powers(_checkpointed(start), "u", "v"))
    first = paths.select(*s, F.col("node").alias("v"), (1 / F.col("x")).alias("x")).join(tight, [*s, "v"])
    y = powers(_checkpointed(first.groupBy(*s, F.col("u").alias("node")).agg(F.sum("x").alias("x"))), "v", "u")
    part = paths.withColumnRenamed("x", "paths").join(y, [*s, "node"]).where("node <> s")
    return _checkpointed(part.groupBy(*keys, F.col("node").alias("country")).agg(F.sum(F.col("paths") * F.col("x")).alias("part")))


# Components.


def components(edge: DataFrame, *keys: str) -> DataFrame:
    """(keys, country, component): connected components, each named by its first country.

    Labels sink to the least among neighbours, and to the label of that label,
    until none changes; the rounds grow with the logarithm of the longest chain in most graphs.
    """
    graphs = held_graphs(edge, *keys)
    if graphs is not None:

        def work(graph: Graph) -> dict:
            label, both = np.arange(len(graph.names)), graph.undirected()
            while True:
                least = label.copy()
                np.minimum.at(least, both.sources, label[both.targets])
                least = least[least]
                if (least == label).all():
                    return {"component": [graph.names[i] for i in label]}
                label = least

        return _by_graph(edge, keys, graphs, work, "component string")
    links = _checkpointed(undirected(edge, *keys).select(*keys, F.col("exporter").alias("country"), "importer"))
    state = _checkpointed(nodes_of(edge, *keys).withColumn("component", F.col("country")))
    while True:
        labels = state.select(*keys, F.col("country").alias("importer"), "component")
        least = links.join(labels, [*keys, "importer"]).groupBy(*keys, "country").agg(F.min("component").alias("least"))
        lower = state.join(least, [*keys, "country"], "left").withColumn("least", F.least("component", "least"))
        above = state.select(*keys, F.col("country").alias("least"), F.col("component").alias("top"))
        after = lower.join(above, [*keys, "least"]).select(*keys, "country", F.least("least", "top").alias("component"), "least", F.col("component").alias("was"))
        after = _checkpointed(after)
        moved = after.where("component <> was").limit(1).count()
        state = after.select(*keys, "country", "component")
        if not moved:
            return state


# Communities.


def louvain(graph: Graph, resolution: float = 1.0) -> np.ndarray:
    """Communities of an undirected graph; nodes are visited in order, so runs agree."""
    member = np.arange(len(graph.names))
    while True:
        size, m2 = len(graph.names), graph.weights.sum()
        degree = np.bincount(graph.sources, graph.weights, size)
        near = [[(w, x) for w, x in graph.near(v) if w != v and x > 0] for v in range(size)]
        group, total, moved_any, moved = list(range(size)), degree.tolist(), False, m2 > 0
        while moved:
            moved = False
            for v in range(size):
                links = defaultdict(float)
                for w, x in near[v]:
                    links[group[w]] += x
                d = degree[v] / m2 * resolution
                total[group[v]] -= degree[v]
                best, gain = group[v], links.get(group[v], 0.0) - total[group[v]] * d
                for g in sorted(links):
                    if links[g] - total[g] * d > gain + 1e-12:
                        best, gain = g, links[g] - total[g] * d
                total[best] += degree[v]
                if best != group[v]:
                    group[v], moved, moved_any = best, True, True
        if not moved_any:
            return member
        labels = {g: i for i, g in enumerate(dict.fromkeys(group))}
        of = np.array([labels[g] for g in group])
        member = of[member]
        graph = Graph.of(graph.key, list(range(len(labels))), of[graph.sources], of[graph.targets], graph.weights)


def communities(edge: DataFrame, *keys: str) -> DataFrame:
    """(keys, country, community): communities of high modularity of the undirected graph, each named by its first country."""
    graphs = held_graphs(edge, *keys)
    if graphs is not None:

        def work(graph: Graph) -> dict:
            member = louvain(graph.undirected())
            first = {g: graph.names[i] for i, g in reversed(list(enumerate(member.tolist())))}
            return {"community": [first[g] for g in member.tolist()]}

        return _by_graph(edge, keys, graphs, work, "community string")
    member = _communities_by_joins(edge, *keys)
    first = member.groupBy(*keys, "group").agg(F.min("country").alias("community"))
    return member.join(first, [*keys, "group"]).select(*keys, "country", "community")


#: Rounds in which many nodes move at once, the part of them that may move in one round, and most rounds of a level.
JOINT_ROUNDS, TURNS, LOCAL_ROUNDS = 8, 2, 16


def _communities_by_joins(edge: DataFrame, *keys: str) -> DataFrame:
    """(keys, country, group) by local moves in rounds and communities that become nodes.

    In a round a node goes to the neighbouring community of highest gain; ties go to the
    least name, and two lone nodes meet under the lesser. In the first rounds every node whose turn
    it is, by a hash, moves. In all later ones a move is made only if none of higher gain leaves or
    enters either community, so gains add up and modularity rises. A level ends when nothing
    moves, or after ``LOCAL_ROUNDS``; its communities are the nodes of the next, until a level joins none.
    """
    links = _checkpointed(undirected(edge, *keys).where("weight > 0").select(*keys, F.col("exporter").alias("u"), F.col("importer").alias("v"), "weight"))
    member, first = _checkpointed(nodes_of(edge, *keys).withColumn("group", F.col("country"))), True
    while True:
        degree = links.groupBy(*keys, F.col("u").alias("node")).agg(F.sum("weight").alias("degree"))
        sums = degree.groupBy(*keys).agg(F.sum("degree").alias("m2")) if keys else degree.agg(F.sum("degree").alias("m2"))
        state = degree.join(sums, list(keys)) if keys else degree.crossJoin(F.broadcast(sums))
        state = _checkpointed(state.select(*keys, "node", "degree", "m2", F.col("node").alias("group"), F.lit(False).alias("moved")))
        for r in range(0 if first else JOINT_ROUNDS, LOCAL_ROUNDS):
            state = _checkpointed(_moved(links, state, keys, r))
            if r >= JOINT_ROUNDS and not state.where("moved").limit(1).count():
                break
        first = False
        if state.select(*keys, "group").distinct().count() == state.count():
            return member
        of = state.select(*keys, "node", F.col("group").alias("next"))
        member = _checkpointed(
            member.join(of.withColumnRenamed("node", "group"), [*keys, "group"], "left").select(*keys, "country", F.coalesce("next", "group").alias("group"))
        )
        links = links.join(of.withColumnRenamed("node", "u"), [*keys, "u"]).drop("u").withColumnRenamed("next", "u")
        links = links.join(of.withColumnRenamed("node", "v"), [*keys, "v"]).drop("v").withColumnRenamed("next", "v")
        links = _checkpointed(links.groupBy(*keys, "u", "v").agg(F.sum("weight").alias("weight")))


def _moved(links: DataFrame, state: DataFrame, keys: tuple, turn: int) -> DataFrame:
    """The nodes after one round of moves."""
    groups = state.groupBy(*keys, "group").agg(F.sum("degree").alias("total"), F.count("*").alias("members"))
    placed = state.join(groups, [*keys, "group"]).select(*keys, "node", "degree", "m2", "group", "total", "members")
    beside = placed.select(*keys, F.col("node").alias("v"), "group", "total", "members")
    offers = links.where("u <> v").join(beside, [*keys, "v"]).groupBy(*keys, F.col("u").alias("node"), "group")
    offers = offers.agg(F.sum("weight").alias("inside"), F.first("total").alias("total"), F.first("members").alias("members"))
    mine = placed.withColumnsRenamed({"group": "own", "total": "own_total", "members": "own_members"})
    at_home, pull = F.col("group") == F.col("own"), F.col("degree") / F.col("m2")
    meets_lesser = (F.col("members") > 1) | (F.col("own_members") > 1) | (F.col("group") < F.col("own"))
    gain = F.when(~at_home & meets_lesser, F.round(F.col("inside") - F.col("total") * pull, 9))
    best = offers.join(mine, [*keys, "node"]).groupBy(*keys, "node").agg(
        F.first("degree").alias("degree"), F.first("m2").alias("m2"), F.first("own").alias("own"),
        F.max(F.coalesce(F.when(at_home, F.col("inside")), F.lit(0.0)) - (F.col("own_total") - F.col("degree")) * pull).alias("stay"),
        F.min(F.when(gain.isNotNull(), F.struct((-gain).alias("loss"), "group"))).alias("best"),
    )
    more = -F.col("best.loss") - F.col("stay")
    offered = best.withColumn("more", F.when(more > 1e-9, more))
    if turn < JOINT_ROUNDS:
        goes = F.col("more").isNotNull() & (F.pmod(F.xxhash64("node") + turn, F.lit(TURNS)) == 0)
    else:
        move = F.struct("more", "node")
        wanted = offered.where("more IS NOT NULL").select(*keys, F.explode(F.array("own", "best.group")).alias("group"), move.alias("move"))
        first = _checkpointed(wanted.groupBy(*keys, "group").agg(F.max("move").alias("move")))
        leaves = first.select(*keys, F.col("group").alias("own"), F.col("move.node").alias("leaver"))
        enters = first.select(*keys, F.col("group").alias("goal"), F.col("move.node").alias("enterer"))
        offered = offered.withColumn("goal", F.col("best.group")).join(leaves, [*keys, "own"], "left").join(enters, [*keys, "goal"], "left")
        goes = F.col("more").isNotNull() & (F.col("leaver") == F.col("node")) & (F.col("enterer") == F.col("node"))
    goes = F.coalesce(goes, F.lit(False))
    return offered.select(*keys, "node", "degree", "m2", F.when(goes, F.col("best.group")).otherwise(F.col("own")).alias("group"), goes.alias("moved"))


def modularity(edge: DataFrame, member: DataFrame, group: str, *keys: str) -> DataFrame:
    """(keys, modularity) of a division of the undirected graph, (keys, country, group)."""
    both = undirected(edge, *keys).where("weight > 0")
    ends = both.join(member.select(*keys, F.col("country").alias("exporter"), F.col(group).alias("a")), [*keys, "exporter"])
    ends = ends.join(member.select(*keys, F.col("country").alias("importer"), F.col(group).alias("b")), [*keys, "importer"])
    by = ends.groupBy(*keys, "a").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    m2 = F.sum("total")
    return by.groupBy(*keys).agg((F.sum("inside") / m2 - F.sum(F.col("total") * F.col("total")) / (m2 * m2)).alias("modularity"))


# Eigenvectors.


def eigenvector(edge: DataFrame, *keys: str) -> DataFrame:
    """(keys, country, eigenvector): eigenvector centrality in the undirected graph, of unit length in each graph.

    Power iteration from equal values; adding each country's own value keeps
    graphs of two sides from swinging. It ends when a step moves no more than 1e-6 a country.
    """
    graphs = held_graphs(edge, *keys)
    if graphs is not None:

        def work(graph: Graph) -> dict:
            both = graph.undirected()
            x = np.full(len(graph.names), 1 / np.sqrt(max(1, len(graph.names))))
            for _ in range(STEPS * MOST_STEPS):
                y = both.times(x) + x
                y /= np.linalg.norm(y) or 1.0
                moved, x = np.abs(y - x).sum(), y
                if moved < len(x) * TOLERANCE:
                    break
            return {"eigenvector": x}

        return _by_graph(edge, keys, graphs, work, "eigenvector double")
    links = undirected(edge, *keys).select(*keys, F.col("exporter").alias("country"), F.col("importer").alias("other"), "weight")
    nodes = _checkpointed(nodes_of(edge, *keys))
    links = _with_own(links, nodes, keys, 1.0)
    x = _unit(nodes.withColumn("x", F.lit(1.0)), keys)
    for _ in range(MOST_STEPS):
        before = x
        for _ in range(STEPS):
            x = _times(links, x, keys, ["x"])
        x = _unit(_checkpointed(x), keys)
        both = x.join(before.select(*keys, "country", F.col("x").alias("was")), [*keys, "country"]).groupBy(*keys)
        moved = both.agg((F.sum(F.abs(F.col("x") - F.col("was"))) >= TOLERANCE * F.count("*")).alias("open"))
        if not moved.agg(F.bool_or("open")).first()[0]:
            break
    return x.withColumnRenamed("x", "eigenvector")


def _unit(x: DataFrame, keys: tuple) -> DataFrame:
    length = x.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    both = x.join(F.broadcast(length), list(keys)) if keys else x.crossJoin(F.broadcast(length))
    return both.select(*keys, "country", (F.col("x") / F.col("length")).alias("x"))


def _with_own(links: DataFrame, nodes: DataFrame, keys: tuple, own: float) -> DataFrame:
    """The matrix plus ``own`` times identity, so that a product reads its vector once."""
    return _checkpointed(links.unionByName(nodes.select(*keys, "country", F.col("country").alias("other"), F.lit(own).alias("weight"))))


def _times(links: DataFrame, x: DataFrame, keys: tuple, columns: list[str]) -> DataFrame:
    """Rows of the matrix times the columns of ``x``."""
    ahead = links.join(x.withColumnRenamed("country", "other"), [*keys, "other"])
    return ahead.groupBy(*keys, "country").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns))


def _coordinates(axes: np.ndarray, dimensions: int) -> np.ndarray:
    """The axes after the first, zeros where there are fewer, the largest entry of each positive."""
    found = axes[:, 1 : dimensions + 1]
    if found.size:
        found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1, 1)
    out = np.zeros((len(axes), dimensions))
    out[:, : found.shape[1]] = found
    return out


def _ritz(moments: np.ndarray, width: int) -> tuple[np.ndarray, float, float]:
    """From the products Y'Y, Y'MY and (MY)'(MY): weights of the best axes in Y, by falling eigenvalue, and their errors.

    Axes that the columns of Y do not span get weights of zero.
    """
    gram, middle, outer = moments.reshape(3, width, width)
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    held = values > max(values.max(initial=0.0), 1e-300) * 1e-13
    white = axes[:, held] / np.sqrt(values[held])
    found, turned = np.linalg.eigh(white.T @ ((middle + middle.T) / 2) @ white)
    weights = (white @ turned)[:, ::-1]
    errors = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", weights, outer, weights) - found[::-1] ** 2, 0.0))
    return np.pad(weights, ((0, 0), (0, width - weights.shape[1]))), errors, found[::-1]


def spectral_embedding(edge: DataFrame, *keys: str, dimensions: int = 2) -> DataFrame:
    """(keys, country, x1, ...): coordinates from the lowest non-trivial eigenvectors of the normalised Laplacian.

    Block iteration with the scaled weights, (S + 1) / 2, on a few more vectors than are asked for;
    products of the block with itself, a few numbers for each graph, give the best
    axes in it (Rayleigh and Ritz), until their errors are under 1e-7. Missing axes are zeros.
    """
    columns = [f"x{i + 1}" for i in range(dimensions)]
    graphs = held_graphs(edge, *keys)
    width = dimensions + 5
    if graphs is None:
        return _spectral_by_joins(edge, keys, dimensions, width).select(*keys, "country", *columns)

    def work(graph: Graph) -> dict:
        both, n = graph.undirected(), len(graph.names)
        degree = np.bincount(both.sources, both.weights, n)
        scale = np.divide(1, np.sqrt(degree), out=np.zeros(n), where=degree > 0)
        both.weights = both.weights * scale[both.sources] * scale[both.targets]
        if n <= DENSE_NODES:
            dense = np.zeros((n, n))
            dense[both.sources, both.targets] = both.weights
            axes = np.linalg.eigh(np.eye(n) - dense)[1]
        else:
            axes = np.random.default_rng(42).standard_normal((n, width))
            for _ in range(STEPS * MOST_STEPS):
                for _ in range(STEPS):
                    axes = np.linalg.qr((both.times(axes) + axes) / 2)[0]
                ahead = (both.times(axes) + axes) / 2
                weights, errors, _ = _ritz(np.stack([axes.T @ axes, axes.T @ ahead, ahead.T @ ahead]), width)
                axes = axes @ weights
                if errors[: dimensions + 1].max() < 1e-7:
                    break
        return dict(zip(columns, _coordinates(axes, dimensions).T, strict=True))

    return _by_graph(edge, keys, graphs, work, ", ".join(f"{c} double" for c in columns))


def _spectral_by_joins(edge: DataFrame, keys: tuple, dimensions: int, width: int) -> DataFrame:
    both = undirected(edge, *keys).where("weight > 0")
    degree = both.groupBy(*keys, F.col("exporter").alias("country")).agg(F.sum("weight").alias("degree"))
    scaled = both.withColumnsRenamed({"exporter": "country", "importer": "other"}).join(degree, [*keys, "country"])
    scaled = scaled.join(degree.select(*keys, F.col("country").alias("other"), F.col("degree").alias("other_degree")), [*keys, "other"])
    half = F.col("weight") / F.sqrt(F.col("degree") * F.col("other_degree")) / 2
    nodes = _checkpointed(nodes_of(edge, *keys))
    links = _with_own(scaled.select(*keys, "country", "other", half.alias("weight")), nodes, keys, 0.5)
    cs, ahead = [f"y{i}" for i in range(width)], [f"z{i}" for i in range(width)]
    noise = [(F.pmod(F.xxhash64("country", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias(c) for i, c in enumerate(cs)]
    x = nodes.select(*keys, "country", *noise)
    products = [F.sum(F.col(a) * F.col(b)) for left, right in ((cs, cs), (cs, ahead), (ahead, ahead)) for a in left for b in right]
    fields = "".join(f"{k} {edge.schema[k].dataType.simpleString()}, " for k in keys)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_ritz(np.array(m), width) for m in batch["moments"]]
            out = batch[list(keys)].copy()
            out["turn"] = [w.ravel().tolist() for w, _, _ in found]
            out["error"] = [float(e[: dimensions + 1].max(initial=0.0)) for _, e, _ in found]
            yield out

    ship_package(edge.sparkSession)
    for _ in range(MOST_STEPS):
        for _ in range(STEPS):
            x = _times(links, x, keys, cs)
        x = _checkpointed(x)
        beyond = _times(links, x, keys, cs).withColumnsRenamed(dict(zip(cs, ahead, strict=True)))
        moments = x.join(beyond, [*keys, "country"]).groupBy(*keys).agg(F.array(*products).alias("moments"))
        turns = _checkpointed(moments.mapInPandas(solved, fields + "turn array<double>, error double"))
        turned = x.join(F.broadcast(turns), list(keys)) if keys else x.crossJoin(F.broadcast(turns))
        new = [reduce(lambda a, b: a + b, (F.col(c) * F.get("turn", F.lit(i * width + j)) for i, c in enumerate(cs))).alias(f"y{j}") for j in range(width)]
        x = turned.select(*keys, "country", *new)
        worst = turns.agg(F.max("error")).first()[0]
        if worst is None or worst < 1e-7:
            break
    axes = [f"y{i + 1}" for i in range(dimensions)]
    x = _checkpointed(x)
    signs = x.groupBy(*keys).agg(*(F.signum(F.max_by(c, F.abs(c))).alias(f"sign_{c}") for c in axes))
    both = x.join(F.broadcast(signs), list(keys)) if keys else x.crossJoin(F.broadcast(signs))
    return both.select(*keys, "country", *((F.col(c) * F.col(f"sign_{c}")).alias(f"x{i + 1}") for i, c in enumerate(axes)))
