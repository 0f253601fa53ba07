"""Measures of graphs beyond graph.SMALL: pendant trees, cycles and parts against plain walks, in one task and as joins."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from lorewright.operators import graph


def random_links(seed: int) -> list[tuple[str, str]]:
    """A core with cycles, trees that hang on it, a lone tree, a pair, and a ring of its own."""
    r = random.Random(seed)
    core = [(f"c{a}", f"c{b}") for a, b in combinations(range(9), 2) if r.random() < 0.25]
    trees = [(f"t{k}", r.choice([f"c{r.randrange(9)}", f"t{r.randrange(k)}"] if k else ["c0"])) for k in range(14)]
    return core + trees + [("l0", "l1"), ("l1", "l2"), ("l1", "l3"), ("l3", "l4"), ("p0", "p1"), ("r0", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r0"), ("r0", "x0"), ("x0", "x1"), ("x1", "x2"), ("x2", "x0"), ("t0", "t0")]


def built(spark, links):
    rows = [(k, a, "r", b, 0.0, "") for k, (a, b) in enumerate(links)]
    t = spark.createDataFrame(rows, "ord long, s string, p string, o string, score double, doc string")
    return graph.nodes(t).cache(), graph.edges(t).cache()


def walks(links):
    """Distances and counts of shortest paths between all nodes."""
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).update({b} - {a})
        near.setdefault(b, set()).update({a} - {b})
    dist, ways = {}, {}
    for s in near:
        d, w, queue = {s: 0}, {s: 1}, [s]
        for v in queue:
            for x in near[v]:
                if x not in d:
                    d[x], w[x] = d[v] + 1, 0
                    queue.append(x)
                if d[x] == d[v] + 1:
                    w[x] += w[v]
        dist[s], ways[s] = d, w
    return near, dist, ways


@pytest.mark.parametrize(("seed", "small"), [(1, 50_000), (2, 50_000), (3, 0)])
def test_measures_equal_plain_walks(spark, monkeypatch, seed, small):
    links = random_links(seed)
    node, edge = built(spark, links)
    near, dist, ways = walks(links)
    n = len(near)
    monkeypatch.setattr(graph, "SMALL", small)
    close = {r.id: r.score for r in graph.close(node, edge).collect()}
    assert close == pytest.approx({s: (len(d) - 1) / sum(d.values()) if len(d) > 1 else 0.0 for s, d in dist.items()})
    between = {r.id: r.score for r in graph.between(node, edge).collect()}
    through = lambda v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in near for t in dist[s] if s != t and v not in (s, t) and v in dist[s] and dist[s][v] + dist[v][t] == dist[s][t])
    assert between == pytest.approx({v: through(v) / ((n - 1) * (n - 2)) for v in near})
    bridges = {frozenset((r.src, r.dst)) for r in graph.bridges(node, edge).collect()}
    parted = lambda a, b: b not in walks([x for x in links if set(x) != {a, b}] + [(a, a), (b, b)])[1][a]
    assert bridges == {frozenset((a, b)) for a, b in links if a != b and parted(a, b)}


def test_blocks_of_sources_add_up(spark, monkeypatch):
    node, edge = built(spark, random_links(4))
    want = {m: {r.id: r.score for r in getattr(graph, m)(node, edge).collect()} for m in ("close", "between")}
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "PAIRS", 60)
    for m in want:
        assert {r.id: r.score for r in getattr(graph, m)(node, edge).collect()} == pytest.approx(want[m])


def test_no_measure_refuses_a_graph_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 3)
    node, edge = built(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("c", "d"), ("d", "f")])
    assert graph.bridges(node, edge).count() == 3 and graph.close(node, edge).count() == graph.between(node, edge).count() == graph.groups(node, edge).count() == 6


def test_ranks_of_a_graph_without_cycles_end_with_its_longest_path(spark, monkeypatch):
    node, edge = built(spark, [("a", "c"), ("b", "c"), ("c", "d")])
    monkeypatch.setattr(graph, "SMALL", 0)
    rounds, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: rounds.append(1) or settle(df))
    got = {r.id: r.score for r in graph.rank(node, edge, rounds=400, tolerance=1e-13).collect()}
    y = {"a": 1.0, "b": 1.0, "c": 2.7, "d": 1 + 0.85 * 2.7}
    assert got == pytest.approx({k: v / sum(y.values()) for k, v in y.items()}) and len(rounds) < 8


def test_kinds_of_nodes_have_the_entries_of_single_nodes(spark, monkeypatch):
    node, edge = built(spark, random_links(5))
    want = {r.id: r.score for r in graph.eigen(node, edge).collect()}
    for small in (40, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        assert {r.id: r.score for r in graph.eigen(node, edge).collect()} == pytest.approx(want)
    rows, settle = [], graph.settle
    star = built(spark, [("m", f"s{k}") for k in range(30)])
    monkeypatch.setattr(graph, "SMALL", 4)
    monkeypatch.setattr(graph, "settle", lambda df: rows.append(1) or settle(df))
    graph.eigen(*star)
    assert len(rows) < 8
