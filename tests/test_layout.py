"""Layers and places of a drawing, and selectors over columns."""

import random

import pytest

from ripplegraph.operators import graph, layout


def frame(spark, rows, schema="src string, dst string"):
    return spark.createDataFrame(rows, schema)


def test_every_edge_leads_to_a_later_layer(spark):
    r = random.Random(7)
    nodes = [f"v{i:02}" for i in range(30)]
    edges = [tuple(sorted(r.sample(nodes, 2))) for _ in range(45)]
    longest = dict.fromkeys(nodes, 0)
    for n in nodes:
        for a, b in edges:
            if b == n:
                longest[n] = max(longest[n], longest[a] + 1)
    e = frame(spark, edges)
    found = layout.layers(e, frame(spark, [(n,) for n in nodes], "node string"))
    assert {x.node: x.layer for x in found.collect()} == longest
    rows = layout.ordered(e, found).collect()
    by = {}
    for x in rows:
        by.setdefault(x.layer, []).append(x.place)
    assert len(rows) == 30 and all(sorted(p) == list(range(len(p))) for p in by.values())
    place = {x.node: x.place for x in layout.ordered(frame(spark, [("b", "y"), ("a", "z"), ("c", "x")]), layout.layers(frame(spark, [("b", "y"), ("a", "z"), ("c", "x")])), sweeps=1).collect()}
    assert [place[n] for n in "abc"] == [0, 1, 2] and [place[n] for n in "zyx"] == [0, 1, 2]


def test_nodes_of_a_cycle_share_a_layer(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("e", "e"), ("e", "f"), (None, "g"), ("d", "x"), ("x", "d")]
    got = {x.node: x.layer for x in layout.layers(frame(spark, edges)).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "x": 2, "e": 0, "f": 1}


def test_assembly(spark):
    columns = frame(spark, [("M", "a", "s", "A"), ("m", "a", "s", "a"), ("m", "b", None, None), ("n", "c", "m", "a")], "model string, column string, src_model string, src_column string")
    exposures = frame(spark, [("m", "dash"), ("m", "dash"), ("zzz", "none")], "model string, exposure string")
    rowsets = frame(spark, [("m", "a", "r"), ("m", "b", "r"), ("m", "a", "n"), ("q", "z", "r")], "src_model string, src_column string, model string")
    nodes, edges = layout.assembled(columns, exposures, rowsets)
    assert {tuple(x) for x in nodes.collect()} == {("col_m_a", "column", "a"), ("col_s_a", "column", "a"), ("col_m_b", "column", "b"), ("col_n_c", "column", "c"), ("exposure_dash", "exposure", "dash"), ("rowset_r", "rowset", "r")}
    assert sorted(map(tuple, edges.collect())) == [("col_m_a", "col_n_c", "lineage"), ("col_m_a", "exposure_dash", "exposure"), ("col_m_a", "rowset_r", "rowset"), ("col_m_b", "exposure_dash", "exposure"), ("col_m_b", "rowset_r", "rowset"), ("col_s_a", "col_m_a", "lineage")]


def test_columns_come_from_declared_parents_alone(spark):
    edges = frame(spark, [("M", "x", "a", "y"), ("m", "x", None, "lit"), ("m", "x", "far", "z"), ("a", "y", "b", "w"), ("a", "y", "c", "v"), ("b", "w", "m", "x"), ("d", "u", "m", "x")], "model string, column string, src_model string, src_column string")
    declared = frame(spark, [("A", "m"), ("b", "a"), ("m", "b")], "parent string, child string")
    models = frame(spark, [("m",), ("a",), ("b",), ("c",), ("d",)], "model string")
    rows = lambda s: {tuple(x) for x in graph.select_columns(edges, declared, models, s).collect()}
    up = {("upstream", "column", "a", "y", 1), ("upstream", "column", "b", "w", 2), ("upstream", "direct_ref", None, "lit", 1), ("upstream", "source", "far", "z", 1)}
    own = {("self", "column", "m", "x", 0)}
    down = {("downstream", "column", "d", "u", 1), ("downstream", "column", "b", "w", 1), ("downstream", "column", "a", "y", 2)}
    assert rows("+M.x") == own | up and rows("m.X+") == own | down and rows("m.x") == rows("+m+") == own | up | down
    assert rows("+none.x+") == set()
    for bad in ("+", "m.", ".x", "++"):
        with pytest.raises(ValueError):
            graph.parse_column_selector(bad)
