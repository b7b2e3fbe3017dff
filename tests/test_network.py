"""Measures of networks against plain routines, each in both ways: dealt to tasks and by joins."""

import heapq
import random

import numpy as np
import pytest

from geolith.operators import graph, network


def links(seed, n=24, m=70, equal=True):
    """A random directed graph; equal weights make many paths of equal length."""
    rng = random.Random(seed)
    rows = {(rng.randrange(n), rng.randrange(n)): float(rng.choice([1, 2, 4]) if equal else rng.uniform(0.5, 9)) for _ in range(m)}
    return [(f"c{a:02d}", f"c{b:02d}", w) for (a, b), w in rows.items() if a != b]


def blocks(seed, groups=5, size=14, inside=0.5, across=0.02):
    rng = random.Random(seed)
    nodes = [(g, i) for g in range(groups) for i in range(size)]
    rows = []
    for a in nodes:
        for b in nodes:
            if a < b and rng.random() < (inside if a[0] == b[0] else across):
                rows.append((f"g{a[0]}n{a[1]:02d}", f"g{b[0]}n{b[1]:02d}", rng.choice([1.0, 2.0, 3.0])))
    return rows


def frame(spark, *tables):
    rows = [(k, *r) for k, t in enumerate(tables) for r in t]
    return spark.createDataFrame(rows, "g int, exporter string, importer string, weight double")


@pytest.fixture(params=["dealt", "joined"])
def way(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(network, "EDGE_LIMIT", 0)
    return request.param


def matrix(rows):
    names = sorted({x for r in rows for x in r[:2]})
    out = np.zeros((len(names), len(names)))
    for a, b, w in rows:
        out[names.index(a), names.index(b)] += w
    return names, out


def plain_betweenness(rows):
    """Distances and numbers of paths from every node by Dijkstra, then a count of every triple."""
    names, w = matrix(rows)
    n = len(names)
    dist, count = np.full((n, n), np.inf), np.zeros((n, n))
    for s in range(n):
        dist[s, s], count[s, s] = 0, 1
        queue, done = [(0.0, s)], set()
        while queue:
            d, v = heapq.heappop(queue)
            if v in done:
                continue
            done.add(v)
            for t in np.flatnonzero(w[v] > 0):
                there = d + 1 / w[v, t]
                if there < dist[s, t] - 1e-9:
                    dist[s, t], count[s, t] = there, count[s, v]
                    heapq.heappush(queue, (there, t))
                elif abs(there - dist[s, t]) <= 1e-9 and t not in done:
                    count[s, t] += count[s, v]
    total = np.zeros(n)
    for s in range(n):
        for t in range(n):
            for v in range(n):
                if len({s, t, v}) == 3 and count[s, t] and abs(dist[s, v] + dist[v, t] - dist[s, t]) <= 1e-9:
                    total[v] += count[s, v] * count[v, t] / count[s, t]
    return dict(zip(names, total / ((n - 1) * (n - 2)), strict=True))


def test_betweenness_equals_counting(spark, way):
    tables = links(1), links(2, 18, 60, equal=False), [("a", "b", 1.0)]
    found = {(r.g, r.country): r.betweenness for r in network.betweenness(frame(spark, *tables), "g").collect()}
    expected = {(k, c): v for k, t in enumerate(tables[:2]) for c, v in plain_betweenness(t).items()} | {(2, "a"): 0.0, (2, "b"): 0.0}
    assert found == pytest.approx(expected, abs=1e-12)


def test_betweenness_in_batches_of_sources(spark, monkeypatch):
    monkeypatch.setattr(network, "EDGE_LIMIT", 0)
    monkeypatch.setattr(network, "PAIRS_AT_ONCE", 200)
    rows = links(3, 20, 60)
    found = {r.country: r.betweenness for r in network.betweenness(frame(spark, rows).drop("g")).collect()}
    assert found == pytest.approx(plain_betweenness(rows), abs=1e-12)


def test_sparse_paths_hold_many_nodes():
    """20,000 nodes in a ring with chords: one source takes memory in proportion to links."""
    n = 20_000
    s = np.arange(n)
    g = network.Graph.of((), list(range(n)), np.concatenate([s, s]), np.concatenate([(s + 1) % n, (s + 7) % n]), np.ones(2 * n))
    near = [[(w, 1 / x) for w, x in g.near(v)] for v in range(n)]
    share = network._shares(near, 0)
    assert share[0] == 0 and share.sum() > n and len(share) == n


def test_components(spark, way):
    rows = [("b", "a", 1.0), ("b", "c", 1.0), ("x", "y", 1.0), *((f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(30)), ("z", "z", 1.0)]
    found = {r.country: r.component for r in network.components(frame(spark, rows).drop("g")).collect()}
    assert {found[c] for c in "abc"} == {"a"} and found["y"] == "x" and found["z"] == "z"
    assert {v for k, v in found.items() if k[0] == "n"} == {"n00"}


def quality(rows, member):
    names, w = matrix(rows)
    both = w + w.T
    np.fill_diagonal(both, 0)
    m2, degree = both.sum(), both.sum(axis=1)
    return sum(both[i, j] / m2 - degree[i] * degree[j] / m2**2 for i, a in enumerate(names) for j, b in enumerate(names) if member[a] == member[b])


def test_communities_by_joins_are_as_good_as_one_by_one(spark, monkeypatch):
    tables = blocks(1), blocks(3, 3, 20, 0.3, 0.05)
    e = frame(spark, *tables)
    dealt = {(r.g, r.country): r.community for r in network.communities(e, "g").collect()}
    monkeypatch.setattr(network, "EDGE_LIMIT", 0)
    joined = {(r.g, r.country): r.community for r in network.communities(e, "g").collect()}
    assert joined.keys() == dealt.keys()
    for k, rows in enumerate(tables):
        one, other = (quality(rows, {c: v for (g, c), v in d.items() if g == k}) for d in (dealt, joined))
        assert other >= 0.99 * one
    # The planted groups of the first graph are found, and modularity by joins is that of the matrix.
    assert len({v for (g, _), v in joined.items() if g == 0}) == 5
    member = network.communities(e, "g").withColumnRenamed("community", "m")
    by = {r.g: r.modularity for r in network.modularity(e, member, "m", "g").collect()}
    found = {(r.g, r.country): r.m for r in member.collect()}
    assert by == pytest.approx({k: quality(t, {c: v for (g, c), v in found.items() if g == k}) for k, t in enumerate(tables)})


def test_eigenvectors_equal_dense_ones(spark, way):
    tables = (links(5, 20, 90, equal=False),)
    found = {(r.g, r.country): r.eigenvector for r in network.eigenvector(frame(spark, *tables), "g").collect()}
    for k, rows in enumerate(tables):
        names, w = matrix(rows)
        both = w + w.T
        np.fill_diagonal(both, 0)
        top = np.abs(np.linalg.eigh(both)[1][:, -1])
        assert [found[k, c] for c in names] == pytest.approx(top, abs=2e-3)


def test_spectral_layout_equals_dense_up_to_sign(spark, way, monkeypatch):
    monkeypatch.setattr(network, "DENSE_NODES", 0)
    tables = blocks(7, 3, 12, 0.6, 0.06), blocks(9, 4, 8, 0.7, 0.1)
    found = {(r.g, r.country): (r.x1, r.x2) for r in network.spectral_embedding(frame(spark, *tables), "g").collect()}
    for k, rows in enumerate(tables):
        names, w = matrix(rows)
        both = w + w.T
        degree = both.sum(axis=1)
        values, axes = np.linalg.eigh(np.eye(len(names)) - both / np.sqrt(np.outer(degree, degree)))
        assert np.diff(values)[1:3].min() > 1e-3
        for i in (0, 1):
            got, want = np.array([found[k, c][i] for c in names]), axes[:, i + 1]
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-5


def test_blocs_and_metrics(spark):
    rows = blocks(11, 3, 6, 0.9, 0.05)
    e = frame(spark, rows, rows[:20])
    found = {(r.g, r.country): r for r in graph.network_metrics(e, "g").collect()}
    names, w = matrix(rows)
    assert [found[0, c].degree for c in names] == ((w + w.T) > 0).sum(axis=1).tolist()
    through = plain_betweenness([(a, b, 1.0) for a, b, _ in rows] + [(b, a, 1.0) for a, b, _ in rows])
    assert [found[0, c].betweenness for c in names] == pytest.approx([through[c] for c in names])
    blocs = graph.trade_blocs(e, "g").where("g = 0").collect()
    assert len(blocs) == len(names) and {r.bloc_id for r in blocs} == {1, 2, 3}
    assert blocs[0].modularity == pytest.approx(quality(rows, {r.country: r.bloc for r in blocs}))
    assert graph.trade_blocs(e.limit(0), "g").count() == 0


def test_empty_tables(spark, way):
    e = frame(spark).drop("g")
    for f in (network.betweenness, network.components, network.communities, network.eigenvector, network.spectral_embedding):
        assert f(e).count() == 0

