"""Compiled SQL, test indexes, changed columns, changes from files alone, reach by name and confidence of snapshots."""

from pyspark.sql import functions as F

from ripplegraph.operators import bi, diff, graph, impact, policy
from ripplegraph.sources import artifacts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_compiled_sql_is_never_guessed(spark):
    nodes = spark.createDataFrame(
        [("a", "own", "target/compiled/p/a.sql", "p", "m/a.sql"), ("b", "", "target/compiled/x/b.sql", "p", "m/b.sql"), ("c", None, None, "p", "m/c.sql"), ("d", None, "gone.sql", "p", "m/d.sql"), ("e", None, None, "p", "m/e.sql"), ("f", None, None, None, "m/f.sql"), ("g", None, None, "p", None), ("h", None, None, "p", "m/h.sql")],
        "name string, sql string, compiled_path string, package_name string, original_file_path string",
    )
    files = spark.createDataFrame([("p/a.sql", "A"), ("x/b.sql", "B"), ("p/m/b.sql", "B2"), ("p/m/c.sql", "C"), ("q/m/c.sql", "C2"), ("p/new/d.sql", "D"), ("q/d.sql", "D2"), ("p/1/e.sql", "E"), ("p/2/e.sql", "E2"), ("q/f.sql", "F")], "path string, sql string")
    assert rows(artifacts.resolve_compiled(nodes, files)) == [("a", "own", "embedded"), ("b", "B", "path"), ("c", "C", "layout"), ("d", "D", "package"), ("e", None, None), ("f", "F", "name"), ("g", None, None), ("h", None, None)]


def test_compiled_files_are_listed(spark, tmp_path):
    for path, sql in (("p/m/a.sql", "select 1\n-- x"), ("b.sql", "x"), ("empty.sql", ""), ("p/readme.md", "no")):
        (tmp_path / "compiled" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "compiled" / path).write_text(sql)
    assert rows(artifacts.compiled_files(spark, f"file://{tmp_path}")) == [("b.sql", "x"), ("p/m/a.sql", "select 1\n-- x")]


def test_tests_by_column_and_by_the_other_side(spark):
    tests = spark.createDataFrame([("t1", "not_null", "m", "c", None, None), ("t2", "relationships", "m", "c", "n", "ID"), ("t3", "x", "m", None, None, None), ("t4", "x", None, "c", "n", None)], "test_id string, test string, model string, column string, ref_model string, ref_column string")
    assert rows(artifacts.test_index(tests)) == sorted([("m", "c", "t1", "own"), ("m", "c", "t2", "own"), ("n", "id", "t2", "referenced"), ("m", None, "t3", "model"), (None, "c", "t4", "unattributable")], key=str)


def test_columns_that_are_derived_in_another_way(spark):
    make = lambda r: spark.createDataFrame(r, "model string, column string, transformation string, expression string, source string")
    base = [("m", "same", "derived", "a + b", "x"), ("m", "code", "derived", "a + b", "x"), ("m", "src", "direct", "a", "x"), ("m", "way", "direct", "a", "x"), ("m", "bad", "derived", "a +", "x"), ("m", "two", "derived", "a", "x"), ("m", "two", "derived", "b", "y"), ("m", "lost", "direct", "a", "x"), ("o", "c", "direct", "a", "x")]
    head = [("m", "same", "derived", "A  + b -- n", "x"), ("m", "code", "derived", "a - b", "x"), ("m", "src", "direct", "a", "y"), ("m", "way", "derived", "a", "x"), ("m", "bad", "derived", "a + 1", "x"), ("m", "two", "derived", "a", "x"), ("m", "new", "direct", "a", "x"), ("o", "c", "direct", "b", "x")]
    columns = spark.createDataFrame([("m", c) for c in ("same", "code", "src", "way", "bad", "two", "lost", "new", "plain")] + [("n", "p"), ("n", "q"), ("o", "c")], "model string, column string")
    models = spark.createDataFrame([("m",), ("n",)], "model string")
    got = rows(diff.logic_changed_columns(models, columns, make(base), make(head)))
    assert got == sorted([("m", "code", "meaning_changed"), ("m", "src", "meaning_changed"), ("m", "way", "meaning_changed"), ("m", "bad", "indeterminate"), ("m", "two", "meaning_changed"), ("m", "lost", "meaning_changed"), ("m", "new", "meaning_changed"), ("n", "p", "indeterminate"), ("n", "q", "indeterminate")])


def test_changes_from_files_alone(spark):
    scopes = spark.createDataFrame([("a.sql", "a", "model"), ("b.sql", "b", "model"), ("m.sql", "mac", "macro"), ("x.yml", None, "logic"), ("r.md", None, "ignorable")], "file string, node string, scope string")
    columns = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "model string, column string")
    assert rows(diff.git_changeset(scopes, columns)) == [(m, c, "logic_changed", "indeterminate") for m, c in (("a", "x"), ("a", "y"), ("b", "*"))]


def test_reach_by_name(spark):
    columns = spark.createDataFrame([(1, "m", "a", "derived"), (1, "m", "b", "direct"), (1, "m", "b", "direct"), (2, "m", "a", "odd")], "key int, model string, column string, transformation string")
    models = spark.createDataFrame([(1, "m"), (1, "n"), (2, "m")], "key int, model string")
    shown = spark.createDataFrame([(1, "d"), (1, "d")], "key int, exposure string")
    got = rows(impact.reshaped(columns, models, shown))
    assert got == sorted([(1, "column", "m", "a", "derived_recompute"), (1, "column", "m", "b", "direct_passthrough"), (2, "column", "m", "a", "odd"), (1, "model", "m", None, "derived_recompute"), (1, "model", "m", None, "direct_passthrough"), (1, "model", "n", None, None), (2, "model", "m", None, "odd"), (1, "exposure", "d", None, None)], key=str)


def test_confidence_of_a_snapshot(spark):
    snaps = spark.createDataFrame([(1, True, "2024-01-01T00:00:00Z"), (2, True, "2023-12-01T00:00:00Z"), (3, True, "soon"), (4, False, None), (5, True, "2024-01-01T10:00:00Z"), (6, True, "2024-01-02T00:00:00Z"), (7, None, None)], "k int, present boolean, generated_at string")
    reached = spark.createDataFrame([(1, "column"), (2, "column"), (5, "column"), (5, "table")], "k int, precision string")
    got = {r.k: (r.level, r.stale, r.n_precise, r.n_coarse, r.age_hours) for r in bi.reach_confidence(snaps, reached, ["k"], F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()}
    assert got == {1: ("full", False, 1, 0, 12.0), 2: ("partial", True, 1, 0, 756.0), 3: ("partial", True, 0, 0, None), 4: ("absent", True, 0, 0, None), 5: ("partial", False, 1, 1, 2.0), 6: ("full", False, 0, 0, 0.0), 7: ("absent", True, 0, 0, None)}


def test_models_by_the_names_of_their_relations(spark):
    models = spark.createDataFrame([("a", '"D"."S"."T"', "d", "s"), ("b", None, "d", "s"), ("c", "e.s.t", None, None), ("f", "s.u", None, "s"), ("g", "z.s.u", None, None), ("h", None, "d", None)], "model string, relation_name string, database string, schema string")
    index = bi.model_index(models)
    assert rows(index) == [("d.s.a", "a"), ("d.s.b", "b"), ("d.s.t", "a"), ("e.s.t", "c"), ("s.a", "a"), ("s.b", "b"), ("s.u", "f"), ("z.s.u", "g")]
    refs = spark.createDataFrame([(1, "D.S.T"), (2, "x.s.b"), (3, "x.s.t"), (4, "s.u"), (5, None), (6, "t")], "i int, relation string")
    assert {r.i: r.model for r in bi.join_relations(refs, index).collect()} == {1: "a", 2: "b", 3: None, 4: "f", 5: None, 6: None}


def test_info_of_models_and_columns(spark):
    nodes = spark.createDataFrame([("m", "s"), ("n", None)], "node string, schema string")
    got = graph.model_info(nodes, spark.createDataFrame([("m", "b"), ("m", "a")], "node string, column string"), spark.createDataFrame([("m", "n"), ("x", "n"), ("m", "n")], "parent string, child string"))
    assert rows(got) == [("m", "s", ["a", "b"], [], ["n"]), ("n", None, [], ["m", "x"], [])]
    columns = spark.createDataFrame([("M", "a", "int"), ("n", "b", None)], "model string, column string, data_type string")
    edges = spark.createDataFrame([("n", "b", "m", "A"), ("n", "b", None, "lit"), ("n", "c", "m", "a")], "model string, column string, src_model string, src_column string")
    assert rows(graph.column_info(columns, edges)) == [("M", "a", "int", 0, 2), ("n", "b", None, 2, 0)]


def test_overrides_lower_hits_and_none_is_passed_over(spark):
    hits = spark.createDataFrame([(1, "r", "fire", "block"), (1, "q", "fire", "warn"), (2, "r", "fire", "block"), (3, "r", "fire", "block"), (5, "r", "dropped", "block"), (None, "agg", "fire", "block")], "k int, rule string, outcome string, decision string")
    overrides = spark.createDataFrame([(1, "break"), (2, "change"), (3, "change"), (4, "break"), (5, "change")], "k int, verb string")
    breaks = spark.createDataFrame([(3,), (3,)], "k int")
    capped = policy.apply_overrides(hits, overrides, breaks, ["k"], F.col("rule") == "agg")
    assert rows(capped.select("k", "rule", "was", "decision", "overridden")) == sorted([(1, "r", "block", "warn", True), (1, "q", "warn", "warn", False), (2, "r", "block", "allow", True), (3, "r", "block", "block", False), (None, "agg", "block", "block", False)], key=str)
    got = rows(policy.override_records(capped, overrides, breaks, ["k"]).select("k", "effect", "rule", "on_break"))
    assert got == [(1, "applied", "r", False), (2, "applied", "r", False), (3, "ineffective", None, True), (4, "ineffective", None, False), (5, "ineffective", None, False)]


def _joined(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_overrides_of_one_model_make_no_pairs_with_its_changes(spark):
    changes = spark.sql("select 'm' as model, concat('c', id) as column, 'added' as kind from range(40) union all select 'n', 'c1', 'added'")
    over = spark.sql("select 'm' as model, if(id % 2 = 0, concat('c', id), null) as column, if(id in (1, 4), 'break', 'change') as verb, id as line from range(80)")
    got = diff.attach_overrides(changes, over)
    assert {(r.model, r.column, r.verb, r.line) for r in got.collect()} == {("m", f"c{i}", "break", 4 if i == 4 else 1) for i in range(40)} | {("n", "c1", None, None)}
    stale = diff.stale_overrides(changes, over)
    assert {r.line for r in stale.collect()} == set(range(40, 80, 2))
    assert "Join Inner" not in _joined(got) and " OR " not in _joined(stale)


def test_a_table_brings_the_number_of_its_columns_to_a_dashboard(spark):
    columns = spark.sql("select 'm' as model, concat('c', id) as column from range(30) union all select 'n', 'x'")
    named = spark.sql("select * from values (1, 'm', 'c1'), (1, 'n', 'x'), (4, 'n', 'y') as t(card, model, column)")
    tables = spark.sql("select * from values (1, 'm'), (1, 'n'), (2, 'm'), (3, 'n'), (4, 'n') as t(card, model)")
    on = spark.sql("select * from values ('a', 1), ('b', 2), ('c', 1), ('c', 2), ('d', 3), ('e', 4), (null, 1), (null, 2) as t(dashboard, card)")
    got = bi.dashboard_reach(columns, named, tables, on)
    want = {("a", "column", 2), ("b", "table", 30), ("c", "column", 31), ("d", "table", 1), (None, "column", 31)}
    assert {tuple(r) for r in got.collect()} == want
    assert "count(distinct" not in _joined(got)


def test_metadata_that_is_there_twice_is_judged_once(spark):
    from ripplegraph import queries

    plan = _joined(queries.metadata_axes(spark, "/root/testdata/sf0.001"))
    assert plan.count("Aggregate [") == 2
