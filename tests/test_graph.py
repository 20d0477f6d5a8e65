"""Graph operators against plain evaluators."""

import random
from collections import defaultdict

import pytest

from quarryline.operators import graph as G


def _df(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def _reach(edges, roots):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    seen, level, n = {r: 0 for r in roots}, set(roots), 0
    while level:
        n += 1
        level = {y for x in level for y in out[x]} - set(seen)
        seen |= {x: n for x in level}
    return seen


@pytest.fixture(scope="module")
def edges():
    r = random.Random(3)
    names = [f"n{i}" for i in range(25)]
    return sorted({(r.choice(names), r.choice(names)) for _ in range(40)})


def test_reachable(spark, edges):
    got = {r.id: r.hops for r in G.reachable(G.plain(_df(spark, edges)), spark.createDataFrame([("n1",), ("n1",)], "id string")).collect()}
    assert got == _reach([e for e in edges if e[0] != e[1]], ["n1"])


def test_components(spark, edges):
    plain = [e for e in edges if e[0] != e[1]]
    want = {}
    for a in {x for e in plain for x in e}:
        both = {b for b in _reach(plain, [a]) if a in _reach(plain, [b])}
        if len(both) > 1:
            want[a] = min(both)
    assert {r.id: r.component for r in G.strong_components(_df(spark, edges)).collect()} == want


def test_components_of_known_graphs(spark):
    got = {r.id: r.component for r in G.strong_components(_df(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("x", "y"), ("c", "d"), ("z", "z")])).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert G.strong_components(_df(spark, [("x", "y")])).count() == 0


def test_pagerank(spark, edges):
    plain = [e for e in edges if e[0] != e[1]]
    nodes, out = sorted({x for e in plain for x in e}), defaultdict(list)
    for a, b in plain:
        out[a].append(b)
    rank = {x: 1 / len(nodes) for x in nodes}
    for _ in range(60):
        dead = sum(rank[x] for x in nodes if not out[x])
        new = {x: 0.15 / len(nodes) + 0.85 * dead / len(nodes) for x in nodes}
        for a in nodes:
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    got = {r.id: r["rank"] for r in G.pagerank(G.plain(_df(spark, edges)), rounds=60, tolerance=1e-9).collect()}
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-6 for x in rank)


def test_communities_of_two_triangles(spark):
    e = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1")]
    assert {r.id: r.label for r in G.communities(_df(spark, e)).collect()} == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "b3": "b1"}


def test_follow_chains_and_cycles(spark):
    e = _df(spark, [("v1", "v2"), ("v2", "v3"), ("p", "q"), ("q", "p")])
    got = {r.id: r.last for r in G.follow(e, spark.createDataFrame([("v1",), ("v3",), ("p",)], "id string")).collect()}
    assert got == {"v1": "v3", "v3": "v3", "p": "p"}


def test_empty_graph(spark):
    e = _df(spark, [])
    assert G.pagerank(e).count() == G.communities(e).count() == G.strong_components(e).count() == G.degrees(e).count() == 0


def test_follow_of_long_chains_and_cycles(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(103)] + [("x", "y"), ("y", "z"), ("z", "y")]
    got = {r.id: (r.last, r.hops) for r in G.follow(_df(spark, chain), spark.createDataFrame([("c000",), ("x",), ("y",)], "id string")).collect()}
    assert got["c000"] == ("c103", 103) and got["y"] == ("y", 2) and got["x"][0] in "yz" and got["x"][1] < 10


def test_walks_have_no_bound_unless_given():
    from inspect import signature

    from quarryline.operators import references as R

    assert signature(G.reachable).parameters["most"].default is None and signature(R.cascade).parameters["most"].default is None
