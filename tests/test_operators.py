import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import text, tri
from ripplegraph.operators import bi, diff, fold, graph, impact, policy
from ripplegraph.plans import lineage
from ripplegraph.sources.artifacts import Project, saved_changes
from ripplegraph.streaming import changes


def test_levels_on_random_graphs_with_cycles(spark):
    r = random.Random(3)
    pairs = {(r.randrange(30), r.randrange(30)) for _ in range(45)}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    seeds = spark.createDataFrame([("a", 0), ("b", 5), ("b", 9)], "key string, node int")
    want = set()
    for key, start in {"a": [0], "b": [5, 9]}.items():
        level = dict.fromkeys(start, 0)
        todo = list(start)
        while todo:
            x = todo.pop(0)
            for a, b in pairs:
                if a == x and b not in level:
                    level[b] = level[x] + 1
                    todo.append(b)
        want |= {(key, n, k) for n, k in level.items()}
    assert {tuple(x) for x in graph.bfs_levels(edges, seeds).collect()} == want


def test_fold_settles_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5), (5, 4)], "src int, dst int")
    own = spark.createDataFrame([(1, 2), (2, None), (3, None), (4, None), (5, None)], "node int, value int")
    assert {tuple(x) for x in fold.fold(edges, own).collect()} == {(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)}


def test_kleene_tables_and_causes(spark):
    states = [(True, False), (False, False), (None, False), (None, True)]
    rows = [(*a, *b) for a, b in itertools.product(states, states)]
    df = spark.createDataFrame(rows, "a boolean, ae boolean, b boolean, be boolean")
    a, b = tri.Tri(F.col("a"), F.col("ae")), tri.Tri(F.col("b"), F.col("be"))
    for got in df.select("*", tri.all_of(a, b).cause().alias("c_and"), tri.any_of(a, b).cause().alias("c_or"), tri.not_(a).cause().alias("c_not")).collect():
        unknown = "error" if (got.a is None and got.ae) or (got.b is None and got.be) else "missing"
        want = "false" if False in (got.a, got.b) else "true" if got.a and got.b else unknown
        assert got.c_and == want
        want = "true" if True in (got.a, got.b) else "false" if got.a is False and got.b is False else unknown
        assert got.c_or == want
        assert got.c_not == ("false" if got.a else "true" if got.a is False else "error" if got.ae else "missing")
    empty = df.limit(1).select(tri.all_of().cause().alias("x"), tri.any_of().cause().alias("y")).first()
    assert tuple(empty) == ("true", "false")


def test_fail_safe_knobs(spark):
    df = spark.createDataFrame([(None, False), (None, True)], "v boolean, e boolean")
    t = tri.Tri(F.col("v"), F.col("e"))
    get = lambda *a, **k: [x[0] for x in df.orderBy("e").select(tri.resolve(t, *a, **k)).collect()]
    assert get("fail_closed", "skip", blocking=True) == ["fire", "dropped"]
    assert get("fail_closed", "fail_open", blocking=False) == ["quiet", "quiet"]
    assert get("fail_open", "fail_closed", blocking=False, warn_fires=True) == ["quiet", "fire"]


def test_bad_policies_are_refused():
    ok = {"name": "r", "decision": "warn", "when": {"field": "x", "op": "eq", "value": 1}}
    policy.check({"version": 1, "rules": [ok]})
    for bad in ({"version": 2}, {"version": 1, "rules": [ok | {"decision": "maybe"}]}, {"version": 1, "rules": [ok | {"when": {}}]}, {"version": 1, "rules": [ok | {"on_error": "x"}]}, {"version": 1, "rules": [ok | {"when": {"reach": {"min_count": 0}}}]}):
        with pytest.raises(ValueError):
            policy.check(bad)


def test_expressions_and_comments(spark):
    rows = [("a+b", "a+b", "equivalent"), ("a + b", "a  +\n b", "equivalent"), ("a+b", "b+a", "meaning_changed"), ("", "a", "indeterminate"), (None, None, "equivalent")]
    df = spark.createDataFrame([r[:2] for r in rows], "x string, y string")
    assert [r[0] for r in df.select(diff.compare_expressions(F.col("x"), F.col("y"))).collect()] == [r[2] for r in rows]
    sql = spark.createDataFrame([("select /* x\ny */ a -- t\n, b",)], "s string")
    assert sql.select(text.strip_comments(F.col("s"))).first()[0] == "select a , b"


def test_git_scope_and_indeterminate_columns(spark):
    files = spark.createDataFrame([("m/a.sql",), ("macros/x.sql",), ("new.sql",), ("README.md",)], "file string")
    paths = spark.createDataFrame([("m/a.sql", "a", "model"), ("macros/x.sql", None, "macro")], "file string, node string, resource string")
    assert {(r.file, r.scope) for r in diff.git_scope(files, paths).collect()} == {("m/a.sql", "model"), ("macros/x.sql", "macro"), ("new.sql", "logic"), ("README.md", "ignorable")}
    cols = spark.createDataFrame([("a", "x")], "model string, column string")
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    assert {(r.model, r.column) for r in diff.indeterminate_columns(models, cols).collect()} == {("a", "x"), ("b", "*")}


def test_widened_selection_rebuilds_all(spark):
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    out = impact.selection(one("a"), one("b").withColumn("additive", F.lit(True)), one().limit(0), one("a", "b", "c"), widen=True)
    assert {r.status for r in out.collect()} == {"rebuild"}


def test_lineage(spark):
    spark.createDataFrame([], "o_orderkey long, o_custkey long, o_totalprice double, o_status string, o_tags array<string>").createOrReplaceTempView("t_orders")
    spark.createDataFrame([], "c_custkey long, c_name string").createOrReplaceTempView("t_customer")
    models = {
        "t_a": "with x as (select * from t_orders) select *, o_totalprice * 2 as dbl from x where o_status = 'F'",
        "t_b": "select c.c_name, sum(a.dbl) as total from t_customer c join t_a a on c.c_custkey = a.o_custkey group by c.c_name",
        "t_c": "select o_orderkey as k from t_orders union all select c_custkey from t_customer",
        "t_d": "select o_orderkey, tag from t_orders lateral view explode(o_tags) as tag",
        "t_e": "select c_name from t_customer where c_custkey in (select o_custkey from t_orders where o_status = 'F')",
        "t_f": "select nothing_here from t_orders",
        "t_g": "select * except (o_tags) from t_orders",
    }
    e, p, o = (x.collect() for x in lineage.edges(spark, models))
    have = {tuple(x) for x in e}
    assert {("t_a", "dbl", "t_orders", "o_totalprice", "derived", 0), ("t_a", "o_status", "t_orders", "o_status", "direct", 0), ("t_b", "total", "t_a", "dbl", "derived", 0), ("t_b", "c_name", "t_customer", "c_name", "direct", 0)} <= have
    assert {("t_c", "k", "t_orders", "o_orderkey", "renamed", 0), ("t_c", "k", "t_customer", "c_custkey", "renamed", 1), ("t_d", "tag", "t_orders", "o_tags", "derived", 0)} <= have
    assert not [x for x in have if x[0] == "t_g" and x[1] == "o_tags"]
    preds = {(x.model, x.source, x.source_column) for x in p}
    assert {("t_a", "t_orders", "o_status"), ("t_b", "t_a", "o_custkey"), ("t_b", "t_customer", "c_custkey"), ("t_e", "t_orders", "o_custkey"), ("t_e", "t_orders", "o_status")} <= preds
    assert [x.model for x in o] == ["t_f"]


def test_artifacts(spark, tmp_path):
    manifest = {
        "metadata": {"adapter_type": "duckdb"},
        "nodes": {
            "model.p.A": {"name": "A", "resource_type": "model", "compiled_code": "select 1", "depends_on": {"nodes": ["source.p.raw.s", "seed.p.z"], "macros": ["macro.p.m"]}, "meta": {"pii": True}, "config": {"meta": {"pii": False}}, "columns": {"X": {"name": "X", "description": "said"}}},
            "seed.p.z": {"name": "z", "resource_type": "seed"},
            "model.q.a": {"name": "a", "resource_type": "model"},
            "test.p.t1": {"name": "t1", "resource_type": "test", "column_name": "X", "test_metadata": {"name": "relationships", "kwargs": {"to": "ref('p', 'Z')", "field": "ID"}}, "depends_on": {"nodes": ["model.p.A"]}},
            "test.p.t2": {"name": "t2", "resource_type": "test", "test_metadata": {"name": "unique", "kwargs": {"column_name": "y"}}, "depends_on": {"nodes": ["model.p.A", "model.q.a"]}},
        },
        "sources": {"source.p.raw.s": {"name": "s", "identifier": "RAW_S"}},
        "macros": {"macro.p.m": {"depends_on": {"macros": ["macro.p.base"]}}},
        "exposures": {"exposure.p.d": {"name": "d", "type": "dashboard", "depends_on": {"nodes": ["model.p.A"]}}},
    }
    catalog = {"nodes": {"model.p.A": {"metadata": {"name": "A"}, "columns": {"X": {"name": "X", "type": "INT", "comment": "c"}}}}, "sources": {"source.p.raw.s": {"metadata": {"name": "raw_s"}, "columns": {"K": {"type": "TEXT"}}}}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    (tmp_path / "c.json").write_text(json.dumps(catalog))
    p = Project(spark, f"file://{tmp_path}/m.json", f"file://{tmp_path}/c.json")
    assert {(r.name, r.sql) for r in p.nodes().collect()} == {("a", "select 1"), ("z", None)}
    assert {tuple(r) for r in p.node_edges().collect()} == {("raw_s", "a"), ("z", "a")}
    assert {tuple(r) for r in p.columns().collect()} == {("a", "x", "INT", "said"), ("raw_s", "k", "TEXT", None)}
    assert {tuple(r) for r in p.tests().collect()} == {("test.p.t1", "relationships", "a", "x", "z", "id"), ("test.p.t2", "unique", None, "y", None, None)}
    assert {tuple(r) for r in p.exposures().collect()} == {("d", "dashboard", "a")}
    assert {tuple(r) for r in p.universe().collect()} == {("a", "manifest", True), ("z", "manifest", False), ("raw_s", "source", True)}
    assert {tuple(r) for r in p.meta("$.pii", "boolean").collect()} == {("a", False), ("z", None)}
    reach = graph.bfs_levels(p.macro_edges(), spark.createDataFrame([("m", "macro.p.base")], "key string, node string"))
    assert {r.node for r in reach.collect()} == {"macro.p.base", "macro.p.m", "model.p.A"}


def test_saved_changes_in_three_envelopes(spark, tmp_path):
    c = [{"model": "a", "column": "x", "kind": "removed"}]
    for name, body in {"1": c, "2": {"changes": c}, "3": {"changeset": {"changes": c}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert {(r.file, r.ordinal, r.model, r.kind) for r in saved_changes(spark, f"file://{tmp_path}").collect()} == {(f"{n}.json", 0, "a", "removed") for n in "123"}
    (tmp_path / "4.json").write_text('{"nothing": 1}')
    with pytest.raises(Exception, match="no changes in"):
        saved_changes(spark, f"file://{tmp_path}").collect()


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "a", "added"), ("2024-01-01 02:00:00", "a", "removed"), ("2024-01-01 03:00:00", "b", "added"), ("2024-01-05 00:00:00", "b", "logic_changed")]
    spark.createDataFrame(rows, "t string, model string, kind string").selectExpr("cast(t as timestamp) as ts", "model", "kind").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, model string, kind string").parquet(f"file://{tmp_path}/in")
    for name, df in {"kinds": changes.changes_by_kind(stream), "best": changes.strongest_change(stream, ["model"])}.items():
        df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert {(r.kind, r.n_changes) for r in spark.table("kinds").collect()} == {("added", 2), ("removed", 1), ("logic_changed", 1)}
    assert {(r.model, r.kind) for r in spark.table("best").collect()} == {("a", "removed"), ("b", "added"), ("b", "logic_changed")}


def test_relation_names_that_are_not_unique_name_nothing(spark):
    rel = spark.createDataFrame([(1, "D", "S", "T"), (2, "D", "S2", "t"), (3, '"d"', "s3", "u")], "relation_id int, database string, schema string, table string")
    assert {tuple(r) for r in bi.relation_index(rel).collect()} == {("d.s.t", 1), ("s.t", 1), ("d.s2.t", 2), ("s2.t", 2), ("d.s3.u", 3), ("s3.u", 3), ("u", 3)}


def test_signatures_read_literals_and_comments(spark):
    pairs = [
        ("x = 'a  b'", "x = 'a b'", "meaning_changed"),
        ("select a -- c\n, b from t", "select a -- c , b from t", "meaning_changed"),
        ("select a /* c */ from t", "select  a\nfrom t", "equivalent"),
        ("select 'it''s -- no comment' /* * */", "select 'it''s -- no comment'", "equivalent"),
        ("select 'a''b'", "select 'a' 'b'", "meaning_changed"),
        ('select "a  b"', 'select "a b"', "meaning_changed"),
        ("a+b", "a + b", "equivalent"),
        ("ab", "a b", "meaning_changed"),
        ("select 'open", "select 'other", "indeterminate"),
        ("select (a", "select a", "indeterminate"),
        (None, "a", "indeterminate"),
        ("-- only", "a", "indeterminate"),
        (None, "", "equivalent"),
        ("'" + "x y" * 20_000 + "'", "'" + "x y" * 20_000 + "' -- long", "equivalent"),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", diff.compare_expressions(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [p[2] for p in pairs]


def test_unattributed_changes_are_indeterminate(spark):
    models = spark.createDataFrame([("m", "a", "b"), ("n", "a", "a -- x"), ("o", "a", None), ("p", "a", "c")], "model string, base_sql string, head_sql string")
    explained = spark.createDataFrame([("p", "x")], "model string, column string")
    columns = spark.createDataFrame([("m", "u"), ("m", "v"), ("n", "w")], "model string, column string")
    got = {(r.model, r.column, r.semantic) for r in diff.unattributed(models, explained, columns).collect()}
    assert got == {("m", "u", "indeterminate"), ("m", "v", "indeterminate"), ("o", "*", "indeterminate")}


def test_selector(spark):
    assert graph.parse_selector("+a.b") == (True, "a.b", False) and graph.parse_selector("a+") == (False, "a", True) and graph.parse_selector("a") == (True, "a", True)
    with pytest.raises(ValueError):
        graph.parse_selector("+")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b")], "src string, dst string")
    assert {tuple(r) for r in graph.select(edges, "+b").collect()} == {("b", "self", 0), ("a", "upstream", 1), ("x", "upstream", 1), ("c", "upstream", 2)}


def test_lineage_of_set_operations_leaves_no_views_behind(spark):
    spark.createDataFrame([], "a long, b long").createOrReplaceTempView("t_left")
    spark.createDataFrame([], "c long").createOrReplaceTempView("t_right")
    e, p, _ = (x.collect() for x in lineage.edges(spark, {"t_i": "select a from t_left intersect select c from t_right", "t_x": "select a from t_left except select c from t_right"}))
    assert {tuple(x)[:5] for x in e} == {("t_i", "a", "t_left", "a", "direct"), ("t_i", "a", "t_right", "c", "renamed"), ("t_x", "a", "t_left", "a", "direct")}
    assert {(x.model, x.source, x.source_column) for x in p} == {("t_x", "t_right", "c")}
    assert not spark.catalog.tableExists("t_i")


def test_verdict_causes(spark):
    schema = "k string, is_break boolean, excused boolean, critical boolean, overridden boolean, is_filter boolean, is_exposure boolean, is_shift boolean"
    quiet = [False] * 7
    rows = [("safe", *quiet), ("filter", *quiet[:4], True, False, False), ("both", False, False, True, True, False, False, False), ("both", *quiet[:4], False, True, False), ("waved", False, False, True, True, True, True, True), ("shift", *quiet[:6], True), ("demoted", True, True, *quiet[2:]), ("block", True, False, *quiet[2:])]
    from ripplegraph.operators import verdict

    got = {r.k: r.verdict for r in verdict.verdict(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {"safe": "safe", "filter": "review", "both": "review", "waved": "safe", "shift": "review", "demoted": "review", "block": "block"}
