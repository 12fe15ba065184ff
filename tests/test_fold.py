"""Folds against a recursive walk, on graphs with and without cycles."""

import random

import pytest

from ripplegraph.operators import fold as F


def walk(edges, own, nodes, combine):
    """What each node inherits: a search upwards that takes a node it is in the middle of as unknown."""
    parents = {n: sorted({a for a, b in edges if b == n}) for n in nodes}

    def value(n, open_):
        if n in open_:
            return F.UNKNOWN
        if own.get(n) is not None:
            return own[n]
        return combine([value(p, open_ | {n}) for p in parents[n]])

    return {n: value(n, frozenset()) for n in nodes}


def folded(spark, edges, own, **how):
    e = spark.createDataFrame(edges, "src string, dst string")
    o = spark.createDataFrame(list(own.items()), "node string, value int")
    rows = F.fold(e, o, **how).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.value for r in rows}


CASES = {
    "low and untagged parents": ([("u", "m"), ("l", "m")], {"u": None, "l": 0, "m": None}, {"u": 1, "l": 0, "m": 1}),
    "high wins": ([("u", "m"), ("h", "m"), ("l", "m")], {"h": 2, "l": 0}, {"u": 1, "l": 0, "h": 2, "m": 2}),
    "declassified in the middle": ([("h", "m"), ("m", "x")], {"h": 2, "m": 0}, {"h": 2, "m": 0, "x": 0}),
    "pure cycle and self": ([("a", "b"), ("b", "a"), ("s", "s")], {}, {"a": 1, "b": 1, "s": 1}),
    "cycle with a tagged escape": ([("a", "b"), ("b", "a"), ("r", "a")], {"r": 2}, {"a": 2, "b": 2, "r": 2}),
    "cycle with a cleared escape, and behind it": ([("a", "b"), ("b", "a"), ("r", "a"), ("b", "x"), ("l", "x")], {"r": 0, "l": 0}, {"a": 1, "b": 1, "r": 0, "x": 1, "l": 0}),
    "a tag cuts a cycle": ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x")], {"a": 0}, {"a": 0, "b": 0, "c": 0, "x": 0}),
    "two cycles in a row": ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("h", "a")], {"h": 2}, dict.fromkeys("abcdh", 2)),
    "diamond": ([("h", "m"), ("m", "l"), ("m", "r"), ("l", "x"), ("r", "x"), ("h", "x"), ("h", "x")], {"h": 2}, dict.fromkeys("hmlrx", 2)),
    "no edges": ([], {"a": None, "b": 2}, {"a": 1, "b": 2}),
}


def test_small_graphs_side_by_side(spark):
    of = lambda k, x: f"{k}.{x}"
    edges = [(of(k, a), of(k, b)) for k, (e, _, _) in enumerate(CASES.values()) for a, b in e]
    own = {of(k, n): v for k, (_, o, _) in enumerate(CASES.values()) for n, v in o.items()}
    got = folded(spark, edges, own)
    for k, (name, (_, _, want)) in enumerate(CASES.items()):
        assert {n.split(".")[1]: v for n, v in got.items() if n.startswith(f"{k}.")} == want, name


@pytest.mark.parametrize("rule", [F.most_restrictive, F.least_restrictive])
def test_random_graphs_equal_a_walk(spark, rule):
    r = random.Random(4)
    nodes, edges = [], []
    for graph in range(6):
        part = [f"v{graph}.{i}" for i in range(11)]
        nodes += part
        edges += [(r.choice(part), r.choice(part)) for _ in range(12 + graph)]
    own = {v: r.choice([None, None, None, 0, 2]) for v in nodes}
    combine = (lambda x: max(x, default=1)) if rule is F.most_restrictive else (lambda x: min(x, default=1))
    assert folded(spark, edges, own, rule=rule) == walk(edges, own, nodes, combine)


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("x", "a"), ("b", "b")]
    got = F.strong_components(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(map(tuple, got.collect())) == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e"), ("g", "g")]


def test_keys_have_rules_of_their_own(spark):
    e = spark.createDataFrame([("a", "m"), ("b", "m")], "src string, dst string")
    own = spark.createDataFrame([("pii", "a", 0), ("pii", "b", 2), ("cleared", "a", 0), ("cleared", "b", 2)], "key string, node string, value int")
    got = F.fold_keys(e, own, ["pii", "cleared"], F.RULES | {"cleared": F.least_restrictive}).where("node = 'm'").collect()
    assert sorted((r.key, r.value) for r in got) == [("cleared", 0), ("pii", 2)]


def _kinds(df):
    return df.selectExpr("src", "dst", "substring(src, 1, 1) as src_kind", "substring(dst, 1, 1) as dst_kind")


def test_edges_with_kinds_fold_and_layer_one_kind_after_the_other(spark):
    from ripplegraph.operators import fold, layout

    edges = _kinds(spark.sql("select * from values ('a1', 'b1'), ('a2', 'b1'), ('a1', 'c1'), ('b1', 'c1'), ('a3', 'c2'), ('a2', 'c3') as t(src, dst)"))
    own = spark.sql("select * from values ('a1', 2, 'a'), ('a2', 0, 'a'), ('c3', 2, 'c'), ('d1', null, 'd') as t(node, value, kind)")
    want = {("a1", 2), ("a2", 0), ("a3", 1), ("b1", 2), ("c1", 2), ("c2", 1), ("c3", 2), ("d1", 1)}
    assert set(map(tuple, fold.fold(edges, own).collect())) == want
    assert set(map(tuple, layout.layers(edges).collect())) == {("a1", 0), ("a2", 0), ("a3", 0), ("b1", 1), ("c1", 2), ("c2", 1), ("c3", 1)}


def test_a_round_reads_no_edges_of_kinds_it_cannot_use(spark):
    from ripplegraph.operators import graph

    # the second part fails when it is read
    edges = spark.sql("select 'a1' as src, 'b1' as dst, 'a' as src_kind, 'b' as dst_kind union all select raise_error('read'), 'd', 'c', 'd' from range(1)")
    seeds = spark.sql("select 0 as key, 'a1' as node, 'a' as kind")
    assert sorted(map(tuple, graph.bfs_levels(edges, seeds).collect())) == [(0, "a1", 0), (0, "b1", 1)]
