"""Graphs with hubs, and communities at sizes and with ties, against plain versions."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from asofloom import bridges as b
from asofloom.bridges import graphs
from asofloom.operators import graph


def random_graph(seed, hubs, nodes, edges):
    rng = np.random.default_rng(seed)
    return sorted({(int(x), int(y)) for x, y in zip(rng.integers(0, nodes, edges), rng.integers(0, hubs, edges), strict=True)})


def around(pairs):
    out = defaultdict(set)
    for x, y in pairs:
        if x != y:
            out[x].add(y)
            out[y].add(x)
    return out


@pytest.mark.parametrize("hubs, nodes, edges, entries", [(5, 400, 900, 50), (300, 300, 700, 40), (40, 3000, 9000, 10**6), (2, 900, 900, 7)])
def test_nodes_two_steps_away(spark, monkeypatch, hubs, nodes, edges, entries):
    monkeypatch.setattr(graph, "ENTRIES", entries)
    pairs = random_graph(hubs, hubs, nodes, edges)
    near = around(pairs)
    want = {x: len(set().union(*(near[y] for y in near[x])) - near[x] - {x}) for x in near}
    every = pa.table({"a": [x for x in near for _ in near[x]], "c": [f"n{y}" for x in near for y in near[x]]})
    named = pa.array([[f"n{y}" for y in near[x]] for x in near])
    lists = pa.table({"a": [f"n{x}" for x in every["a"].to_pylist()], "c": every["c"]})
    assert (graph.reached(lists, named) - 1).tolist() == list(want.values())


@pytest.mark.parametrize("name", [lambda x: x, str])
def test_two_hops(spark, name):
    pairs = random_graph(1, 7, 300, 600)
    near = around(pairs)
    want = {name(x): len(set().union(*(near[y] for y in near[x])) - near[x] - {x}) for x in near}
    df = spark.createDataFrame([(d, name(x), name(y)) for d in (1, 2) for x, y in pairs if d == 2 or x % 2], f"d int, s {'string' if name is str else 'long'}, t {'string' if name is str else 'long'}")
    found = graph.two_hops(graph.neighbour_pairs(df, ["d"]), ["d"])
    got = {(r["d"], r["__node"]): r["v"] for r in found.collect()}
    near_1 = around([p for p in pairs if p[0] % 2])
    want_1 = {name(x): len(set().union(*(near_1[y] for y in near_1[x])) - near_1[x] - {x}) for x in near_1}
    assert got == {(2, x): n for x, n in want.items() if n} | {(1, x): n for x, n in want_1.items() if n}


def test_two_hops_lists_no_pairs(spark):
    """A hub of 20,000 nodes: its 400 million pairs aren't made."""
    df = spark.range(20_000).selectExpr("id + 1 as s", "0L as t")
    got = graph.two_hops(graph.neighbour_pairs(df, []), []).groupBy("v").count().collect()
    assert [tuple(r) for r in got] == [(19_999, 20_000)]


def plain_louvain(n, edges):
    own, near, loops = list(range(n)), [defaultdict(float) for _ in range(n)], [0.0] * n
    for x, y, w in edges:
        near[x][y] += w
        near[y][x] += w
    total = sum(w for _, _, w in edges)
    while True:
        degree = [sum(near[i].values()) + 2 * loops[i] for i in range(len(near))]
        label, weight, gained, moved = list(range(len(near))), degree[:], False, True
        while moved:
            moved = False
            for i in range(len(near)):
                ties = defaultdict(float)
                for j, w in near[i].items():
                    ties[label[j]] += w
                home = label[i]
                weight[home] -= degree[i]
                best, most = home, ties[home] - weight[home] * degree[i] / (2 * total)
                for c in sorted(ties):
                    gain = ties[c] - weight[c] * degree[i] / (2 * total)
                    if gain > most + 1e-12:
                        best, most = c, gain
                weight[best] += degree[i]
                if best != home:
                    label[i], moved, gained = best, True, True
        if not gained:
            return own
        index = {c: k for k, c in enumerate(dict.fromkeys(label))}
        own = [index[label[c]] for c in own]
        merged, inner = [defaultdict(float) for _ in index], [0.0] * len(index)
        for i in range(len(near)):
            inner[index[label[i]]] += loops[i]
            for j, w in near[i].items():
                x, y = index[label[i]], index[label[j]]
                if x == y:
                    inner[x] += w / 2
                else:
                    merged[x][y] += w
        near, loops = merged, inner


@pytest.mark.parametrize("weighted", [True, False])
def test_louvain_in_arrays(weighted):
    pairs = [(x, y) for x, y in {(min(p), max(p)) for p in random_graph(3, 60, 500, 1500)} if x != y]
    w = np.random.default_rng(1).integers(1, 9, len(pairs)) / 4 if weighted else np.ones(len(pairs))
    x, y = np.array(pairs, np.int32).T
    assert graphs.moved(500, x, y, w if weighted else None).tolist() == plain_louvain(500, list(zip(x.tolist(), y.tolist(), w.tolist(), strict=True)))


def test_communities_have_no_bound_of_their_own(spark):
    assert b.Community("s", "t").max_edges is None
    got = b.Community("s", "t", weight="w").run(spark.createDataFrame([("a", "b", 2.0), ("b", "c", 2.0), ("c", "a", 2.0), ("c", "d", 0.5), ("d", "e", 2.0)], "s string, t string, w double")).collect()
    assert {(r["node"], r["community"]) for r in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
