"""Typed leaves of policies: changes, metadata, configuration, inherited values, facts and what is reached."""

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import impact, policy, verdict

SUBJECTS = """
select * from values
 ('a', 'pii', 'removed', null,              '{"pii": true}',  '{"tier": 1}',  '{"grants": {"select": ["x"]}}', map('pii', 2), true,  true,  1L, 3L),
 ('a', 'id',  'logic_changed', 'meaning_changed', '{"tier": null}', '{"tier": 1}', '{}', map('pii', 0), true, false, 0L, 1L),
 ('b', 'id',  'logic_changed', 'indeterminate', '{}', '{}', '{"grants": {"select": ["z", "x"]}}', map('pii', 1), true, false, 0L, 0L),
 ('c', 'id',  'added', 'equivalent', null, null, null, map(), false, false, 0L, 0L),
 ('d', 'id',  'type_changed', null, '{"pii": "no"}', '{"tier": "gold"}', '{"grants": {"select": "x"}}', map('pii', 0), null, null, null, null)
 as t(model, column, kind, semantic, cm, mm, cf, inferred, resolved, provable_break, n_exposures, n_reached)"""


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.sql(SUBJECTS).select("*", *(F.parse_json(a).alias(b) for a, b in (("cm", "column_meta"), ("mm", "model_meta"), ("cf", "config"))))


def causes(subjects, p):
    policy.check({"version": 1, "rules": [{"name": "r", "decision": "warn", "when": p}]})
    return [r[0] for r in subjects.orderBy("model", F.desc("column")).select(policy.compile_predicate(p).cause()).collect()]


LEAVES = [
    ({"change": {"field": "kind", "op": "in", "value": ["removed", "added"]}}, "true false false true false"),
    ({"change": {"field": "semantic", "op": "eq", "value": "indeterminate"}}, "true false true false true"),
    ({"change": {"field": "breaking", "op": "is_true"}}, "true true true false true"),
    ({"change": {"field": "column", "op": "matches", "value": "p.*"}}, "true false false false false"),
    ({"meta": {"key": "pii", "op": "is_true"}}, "true false false false true"),
    ({"meta": {"key": "tier", "op": "ge", "value": 1}}, "true error missing missing error"),
    ({"meta": {"key": "pii", "op": "subset_of", "value": ["x"]}}, "error missing missing missing error"),
    ({"inferred_meta": {"key": "pii", "op": "is_true"}}, "true false missing missing true"),
    ({"inferred_meta": {"key": "pii", "op": "absent"}}, "false false missing missing false"),
    ({"config": {"key": "grants.select", "op": "not_subset_of", "value": ["x"]}}, "false false true false error"),
    ({"config": {"key": "grants.select", "op": "eq", "value": "x"}}, "false missing false missing true"),
    ({"structural": {"fact": "provable_test_break"}}, "true false false false false"),
    ({"structural": {"fact": "touches_exposure"}}, "true false false missing missing"),
    ({"structural": {"fact": "reaches_anything"}}, "true true false missing missing"),
    ({"all": []}, "true true true true true"),
    ({"any": []}, "false false false false false"),
    ({"not": {"any": [{"meta": {"key": "tier", "op": "ge", "value": 1}}, {"meta": {"key": "pii", "op": "eq", "value": "y"}}]}}, "false error missing missing error"),
]


def test_leaves(spark, subjects):
    tris = [policy.compile_predicate(p).cause().alias(f"l{i}") for i, (p, _) in enumerate(LEAVES)]
    rows = subjects.orderBy("model", F.desc("column")).select(*tris).collect()
    for i, (p, want) in enumerate(LEAVES):
        assert [r[i] for r in rows] == want.split(), p


def test_reach_counts_what_is_proven(spark, subjects):
    reached = spark.sql("""select * from values
     ('a', 'pii', 'exposure', 'dash', null, '{"tier": 1}', null, map(), 'dashboard', '{"name": "ann"}', null),
     ('a', 'pii', 'exposure', 'bi', null, '{"tier": 9}', null, map(), 'dashboard', null, '{"tier": 1}'),
     ('a', 'pii', 'exposure', 'bare', null, null, null, map(), 'app', null, null),
     ('a', 'pii', 'model', 'm', 'derived_recompute', '{"tier": "x"}', '{"grants": {"select": ["z"]}}', map(), null, null, null),
     ('a', 'id', 'model', 'm', 'direct_passthrough', '{"tier": 5}', null, map(), null, null, null),
     ('a', 'id', 'column', 'm.c', 'direct_passthrough', '{}', null, map('pii', 2), null, null, null),
     ('c', 'id', 'model', 'm', 'direct_passthrough', '{"tier": 5}', null, map(), null, null, null)
     as t(model, column, reached_kind, name, mechanism, m, c, inferred, type, o, d)""").select("*", *(F.parse_json(a).alias(b) for a, b in (("m", "meta"), ("c", "config"), ("o", "owner"), ("d", "dashboard"))))
    tier = {"meta": {"key": "tier", "op": "eq", "value": 1}}
    asked = [
        ({"kind": "exposure", "where": tier}, "true false false missing missing"),
        ({"kind": "exposure", "where": tier, "min_count": 2}, "true false false missing missing"),
        ({"kind": "exposure", "where": tier, "min_count": 3}, "missing false false missing missing"),
        ({"kind": "exposure", "where": tier, "mechanism": ["derived_recompute"]}, "false false false missing missing"),
        ({"kind": "exposure", "where": {"meta": {"key": "owner.name", "op": "eq", "value": "ann"}}}, "true false false missing missing"),
        ({"kind": "model", "where": {"meta": {"key": "tier", "op": "gt", "value": 1}}}, "error true false missing missing"),
        ({"kind": "model", "mechanism": ["direct_passthrough"], "where": {"meta": {"key": "tier", "op": "gt", "value": 1}}}, "false true false missing missing"),
        ({"kind": "model", "where": {"config": {"key": "grants.select", "op": "not_subset_of", "value": ["x"]}}}, "true false false missing missing"),
        ({"kind": "column", "where": {"inferred_meta": {"key": "pii", "op": "is_true"}}}, "false true false missing missing"),
        ({"kind": "model", "where": {"inferred_meta": {"key": "pii", "op": "is_true"}}}, "missing missing false missing missing"),
        ({"kind": "model", "where": {"change": {"field": "kind", "op": "eq", "value": "added"}}}, "error error false missing missing"),
    ]
    rules = [{"name": f"r{i}", "decision": "block", "when": {"reach": r}} for i, (r, _) in enumerate(asked)]
    p = policy.check({"version": 1, "rules": rules})
    seen = policy.with_reaches(p, subjects, reached, ["model", "column"])
    rows = seen.orderBy("model", F.desc("column")).select(*(policy.compile_predicate(r["when"]).cause().alias(r["name"]) for r in rules)).collect()
    for i, (r, want) in enumerate(asked):
        assert [x[i] for x in rows] == want.split(), r
    assert policy.evaluate(p, seen, ["model", "column"]).count() > 0


def test_over_the_whole_changeset(spark, subjects):
    leaf = {"meta": {"key": "pii", "op": "eq", "value": True}}
    for when, cause in (
        (leaf, "true"),
        ({"meta": {"key": "tier", "op": "gt", "value": 7}}, "error"),
        ({"meta": {"key": "none", "op": "eq", "value": 7}}, "missing"),
        ({"change": {"field": "kind", "op": "eq", "value": "x"}}, "false"),
        ({"all": [leaf, {"structural": {"fact": "provable_test_break"}}]}, "true"),
        ({"not": leaf}, "false"),
        ({"any": []}, "false"),
    ):
        rule = {"name": "r", "decision": "block", "scope": "aggregate", "when": when}
        row = policy.aggregate_outcome({"version": 1, "rules": [rule]}, rule, subjects).first()
        assert row.cause == cause and row.outcome == ("quiet" if cause == "false" else "fire"), when


def test_meanings_have_defaults(spark, subjects):
    p = {"version": 1, "defaults": {"on_meaning_changed": "block", "on_indeterminate": "warn"}, "rules": []}
    got = policy.semantic_default_hits(p, subjects, ["model", "column"]).collect()
    assert sorted((r.model, r.rule, r.decision) for r in got) == [("a", "builtin:on_meaning_changed", "block"), ("b", "builtin:on_indeterminate", "warn")]
    assert policy.semantic_default_hits({"version": 1, "defaults": {"on_indeterminate": "allow"}, "rules": []}, subjects, ["model"]).count() == 0


def test_unreadable_rules_are_refused():
    for when in (
        {"meta": {"key": "a", "op": "like", "value": 1}},
        {"change": {"field": "size", "op": "eq", "value": 1}},
        {"structural": {"fact": "x"}},
        {"reach": {"kind": "test", "where": {"meta": {"key": "a", "op": "exists"}}}},
        {"reach": {"min_count": 0, "where": {"meta": {"key": "a", "op": "exists"}}}},
        {"meta": {"key": "a", "op": "exists"}, "not": {"all": []}},
        {"reach": {"where": {"meta": {"key": "a", "op": "matches", "value": "("}}}},
    ):
        with pytest.raises(ValueError):
            policy.check({"version": 1, "rules": [{"name": "r", "decision": "warn", "when": when}]})


def test_plain_operators_never_stop_a_job(spark):
    df = spark.createDataFrame([("zz", ["a"]), ("5", []), (None, None)], "t string, l array<string>")
    for op, value, want in (("is_true", None, "error error false"), ("gt", 3, "error true missing"), ("le", 5.0, "error true missing")):
        assert [r[0] for r in df.select(policy.compile_predicate({"field": "t", "op": op, "value": value}).cause()).collect()] == want.split(), op
    for op, want in (("intersects", "true false missing"), ("subset_of", "true true missing"), ("not_subset_of", "false false missing"), ("superset_of", "true false missing")):
        assert [r[0] for r in df.select(policy.compile_predicate({"field": "l", "op": op, "value": ["a"]}).cause()).collect()] == want.split(), op


def test_what_is_unknown_counts_as_the_worse(spark):
    facts = spark.sql("select * from values (1, true, null, false, true), (2, null, false, false, true), (3, false, null, true, null), (4, false, false, null, false), (5, false, null, false, null), (6, true, true, true, true) as t(g, is_break, excused, critical, overridden)")
    got = {r.g: (r.verdict, r.n_unexcused) for r in verdict.verdict(facts, ["g"]).collect()}
    assert got == {1: ("block", 1), 2: ("block", 1), 3: ("review", 0), 4: ("review", 0), 5: ("safe", 0), 6: ("review", 0)}
    res = spark.sql("select * from values (1, 'parsed'), (1, null), (2, 'parsed'), (3, 'odd') as t(g, status)")
    assert {r.g: r.level for r in impact.confidence(res, ["g"]).collect()} == {1: "partial", 2: "full", 3: "partial"}
