"""Two versions at once, replays over a history, and identity of catalogs."""

import random

from pyspark.sql import functions as F

from ripplegraph.operators import identity, replay, versions

RANK = {"derived": 3, "renamed": 2, "direct": 1}


def test_product_reach_equals_a_search_per_change(spark):
    r = random.Random(8)
    nodes = [f"v{i}" for i in range(14)]
    edges = [(v, r.choice(nodes), r.choice(nodes), r.choice(list(RANK))) for v in ("base", "head") for _ in range(18)]
    held = [("base", n) for n in nodes[:12]] + [("head", n) for n in nodes[3:]]
    changes = [(i, r.choice(nodes), r.choice(["removed", "added", "type_changed"])) for i in range(12)] + [(99, "gone", "removed"), (98, None, "added")]
    shown = [(v, n, f"e{i % 3}") for i, (v, n) in enumerate(held) if i % 4 == 0]
    frames = [spark.createDataFrame(x, s) for x, s in ((changes, "key int, node string, kind string"), (held, "version string, node string"), (edges, "version string, src string, dst string, transformation string"), (shown, "version string, node string, exposure string"))]
    for has_base in (True, False):
        begun, reached = versions.changeset_reach(*frames, has_base)
        got = {(x.key, x.version, x.reached_kind, x.node): (x.level, x.severity) for x in reached.collect()}
        want, state = {}, {}
        for key, node, kind in changes:
            v = "base" if has_base and kind == "removed" else "head"
            state[key] = (v, (v, node) in held)
            if not state[key][1]:
                continue
            level, todo, worst = {node: 0}, [node], {}
            while todo:
                x = todo.pop(0)
                for w, a, b, t in edges:
                    if w == v and a == x:
                        worst[b] = max(worst.get(b, 0), RANK[t])
                        if b not in level:
                            level[b] = level[x] + 1
                            todo.append(b)
            want |= {(key, v, "node", n): (k, worst[n]) for n, k in level.items() if k}
            for w, n, e in shown:
                if w == v and n in level:
                    k = (key, v, "exposure", e)
                    want[k] = (min(want.get(k, (99,))[0], level[n] + 1), None)
        assert got == want
        rows = {x.key: x for x in versions.by_change(begun, reached).collect()}
        assert {k: (x.version, x.resolved) for k, x in rows.items()} == state
        assert all((x.n_nodes is None) == (not x.resolved) for x in rows.values())


def test_nothing_changed(spark):
    empty = [spark.createDataFrame([], s) for s in ("key int, node string, kind string", "version string, node string", "version string, src string, dst string, transformation string", "version string, node string, exposure string")]
    begun, reached = versions.changeset_reach(*empty)
    assert versions.by_change(begun, reached).collect() == [] and versions.affected(reached).collect() == []


def test_as_of_meets_the_version_that_was_valid(spark):
    r = random.Random(3)
    history = [(r.choice("ab"), r.randrange(1000) * 10, i) for i in range(60)] + [("c", 5000, 77), ("c", 5000, 78)]
    changes = [(i, r.choice("abcd"), r.randrange(1000) * 10) for i in range(200)] + [(900, "c", 5000), (901, "c", 4999), (902, None, 5), (903, "a", 10**6)]
    h = spark.createDataFrame(history, "node string, s long, v int").select("node", F.timestamp_seconds("s").alias("at"), "v")
    c = spark.createDataFrame(changes, "id int, node string, s long").select("id", "node", F.timestamp_seconds("s").alias("made"))
    want = {i: max(((s, v) for n, s, v in history if n == node and s <= at), default=(None, None))[1] for i, node, at in changes}
    for stretch in (7, 500, 10**7):
        got = replay.as_of(c, replay.intervals(h, "node", "at", "v"), "node", "made", ["v"], stretch).collect()
        assert {x.id: x.v for x in got} == want and len(got) == len(changes)


def test_tables_of_a_replay(spark):
    policy = {"version": 1, "rules": [{"name": "a", "decision": "block", "when": {"field": "x", "op": "gt", "value": 5}}, {"name": "b", "decision": "warn", "when": {"field": "x", "op": "gt", "value": 100}}]}
    subjects = spark.createDataFrame([(1, "p", 9), (2, "p", None), (3, "q", 1), (4, "r", 7)], "id int, point string, x int")
    hits = replay.replay(policy, subjects, "point", ["id"])
    assert {tuple(x) for x in replay.point_decisions(hits, subjects, "point").collect()} == {("p", "block", 2, 1), ("q", "allow", 0, 0), ("r", "block", 1, 0)}
    assert {tuple(x) for x in replay.rule_table(policy, hits, "point").collect()} == {("a", 2, 0, 3, 1, False), ("b", 0, 0, 0, 0, True)}
    points = spark.createDataFrame([(True, 4, 1), (False, 8, None), (None, None, None), (False, None, 2)], "widened boolean, n_skippable int, n_forced int")
    assert tuple(replay.selection_table(points).first()) == (3, 1, 33.3, 4.0, 3)


def catalog(spark, rows):
    return spark.createDataFrame(rows, "node string, column string, data_type string, j string").withColumn("meta", F.parse_json("j"))


def test_digests_follow_content_not_order(spark):
    rows = [(f"n{i}", f"c{k}", "int", f'{{"a": {i}, "b": {{"x": [1, {k}], "y": null}}}}') for i in range(30) for k in range(3)]
    same = rows[::-1]
    turned = [(f"n{i}", f"c{k}", "int", f'{{"b": {{"y": null, "x": [1, {k}]}}, "a": {i}}}') for i in range(30) for k in range(3)]
    digest = lambda r: identity.fingerprint(identity.leaf_digests(identity.node_digests(catalog(spark, r)))).first()[0]
    base = digest(rows)
    assert base == digest(same) == digest(turned) and digest([]) is None
    for other in (rows[1:], rows + [("n0", "c9", "int", "{}")], [("n0", "c0", "long", rows[0][3]), *rows[1:]], [("n0", "c0", "int", None), *rows[1:]], [("n0", "c0", "int", "null"), *rows[1:]], [("N0", *rows[0][1:]), *rows[1:]]):
        assert digest(other) != base
    head = [(n, c, t, "{}" if n == "n7" and c == "c1" else j) for n, c, t, j in turned if n != "n3"] + [("new", "c", None, None), ("bare", None, None, None)]
    got = identity.changed_nodes(identity.node_digests(catalog(spark, rows)), identity.node_digests(catalog(spark, head)))
    assert {tuple(x) for x in got.collect()} == {("n7", "changed"), ("n3", "removed"), ("new", "added"), ("bare", "added")}


def test_degradation(spark):
    rows = [
        (1, 1, "x", "x", None, None, None, None, "degraded", "identical catalogs"),
        (1, 1, "x", "y", "2024-01-01T00:00:00Z", "r", "2024-01-02T00:00:00Z", "r", "available", None),
        (1, 1, "x", "y", "2024-01-01T00:00:00Z", "r", "2024-01-02T00:00:00.123456Z", "q", "degraded", "stale head catalog"),
        (1, 1, "x", "y", "2024-01-01T00:00:00+02:00", None, "2023-12-31T23:00:00Z", None, "degraded", "stale head catalog"),
        (1, 1, "x", "y", "2024-01-03T00:00:00Z", "r", "2024-01-02T00:00:00Z", "q", "available", None),
        (1, 1, "x", "y", "not a time", "r", "2024-01-02T00:00:00Z", "q", "available", None),
        (1, 1, None, None, None, None, None, None, "available", None),
        (0, 1, "x", "x", None, None, None, None, "unavailable", "no catalog on a side"),
        (None, 1, "x", "y", None, None, None, None, "unavailable", "no catalog on a side"),
    ]
    df = spark.createDataFrame(rows, "base_nodes int, head_nodes int, base_fingerprint string, head_fingerprint string, catalog_at string, catalog_run string, manifest_at string, manifest_run string, want string, why string")
    for x in identity.structural_status(df).collect():
        assert (x.status, x.reason) == (x.want, x.why), x
