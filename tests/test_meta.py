"""Operators over metadata of any shape, against a plain reading of their rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import meta as M

ABSENT = object()
VALUES = [ABSENT, None, True, False, 0, 1, -2, 1.0, 1.5, 0.0, 1e20, 10**30, "", "zz", "1", "true", "a-1", [], [1], [1, "a"], ["a", "b"], [True], [[1]], [{"x": 1}], [None], {}, {"a": 1}, {"a": {"b": 2}}, "日本", "x" * 3000]
EXPECTED = [None, True, 1, 1.0, 1.5, 0, "zz", "", "a.*", "1", "True", [], [1], ["a", "b", "c"], [1, "a", None], [[1]], {"a": 1}, [True, "zz"]]


def plain(op, value, expected):
    """True, False, 'missing' or 'error'."""
    there = value is not ABSENT
    if op in M.TOTAL:
        return {"exists": there, "absent": not there, "is_true": there and bool(value), "is_false": there and not bool(value)}[op]
    if not there:
        return "missing"
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    try:
        if op in ("eq", "ne"):
            return (value == expected) == (op == "eq")
        if op in ("in", "not_in"):
            return (value in expected) == (op == "in") if isinstance(expected, list) else "error"
        if op == "matches":
            if not isinstance(expected, str) or isinstance(value, (list, dict)):
                return "error"
            return re.fullmatch(expected, str(value)) is not None
        if op in M.SETS:
            if not isinstance(value, list) or not isinstance(expected, list):
                return "error"
            a, b = set(value), set(expected)
            return {"intersects": bool(a & b), "subset_of": a <= b, "not_subset_of": not a <= b, "superset_of": a >= b}[op]
        return M.ORDERS[op](value, expected) if number(value) and number(expected) else "error"
    except TypeError:
        return "error"


def operands(op):
    """What an operator is worth trying with."""
    if op in M.TOTAL:
        return [None]
    lists = [x for x in EXPECTED if isinstance(x, list)]
    if op in M.SETS or op in ("in", "not_in"):
        return [*lists, 1, "zz"]
    if op == "matches":
        return [x for x in EXPECTED if isinstance(x, str)] + [1, []]
    return [None, True, 1, 1.0, 1.5, 0, "zz"] if op in M.ORDERS else EXPECTED


@pytest.mark.parametrize("ops", [M.TOTAL, ("eq",), ("ne",), ("in", "not_in"), ("matches",), M.SETS[:2], M.SETS[2:], tuple(M.ORDERS)], ids=lambda x: "-".join(x))
def test_every_shape_under_every_operator(spark, ops):
    rows = [(i, None if v is ABSENT else json.dumps({"k": {"d": v}})) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("m", F.parse_json(F.coalesce("j", F.lit('{"k": {}}'))))
    v = M.lookup(F.col("m"), "k.d")
    asked = [(op, e) for op in ops for e in operands(op)]
    for r in df.select("i", *(M.compare(op, v, e).cause().alias(f"e{k}") for k, (op, e) in enumerate(asked))).collect():
        for k, (op, e) in enumerate(asked):
            assert r[f"e{k}"] == str(plain(op, VALUES[r.i], e)).lower(), (op, VALUES[r.i], e)


def test_lookups_tell_null_from_absent(spark):
    df = spark.createDataFrame([('{"a": {"b": null, "c d": 1, "x": [1]}, "n": 3}',)], "j string").withColumn("m", F.parse_json("j"))
    keys = ["a", "a.b", "a.c d", "a.z", "n", "n.b", "a.x.b", "", "a.", ".a", "a.b.c"]
    row = df.select(*(M.compare("exists", M.lookup(F.col("m"), k)).cause().alias(f"k{i}") for i, k in enumerate(keys))).first()
    assert list(row) == ["true", "true", "true", "false", "true"] + ["false"] * 6
    assert df.select(M.compare("eq", M.lookup(F.col("m"), "a.b"), None).cause()).first()[0] == "true"
    nothing = df.select(M.compare("eq", M.lookup(F.lit(None).cast("variant"), "a"), 1).cause()).first()[0]
    assert nothing == "missing"


def test_config_has_empty_sets_and_inherited_has_unknowns(spark):
    rows = [("{}",), ('{"g": null}',), ('{"g": []}',), ('{"g": ["a"]}',), ('{"g": ["z"]}',), ('{"g": "a"}',)]
    df = spark.createDataFrame(rows, "j string").select(F.parse_json("j").alias("m"))
    v = M.lookup(F.col("m"), "g")
    seen = lambda t: [r[0] for r in df.select(t.cause()).collect()]
    assert seen(M.compare_config("not_subset_of", v, ["a"])) == ["false", "false", "false", "false", "true", "error"]
    assert seen(M.compare_config("superset_of", v, ["a"])) == ["false", "false", "false", "true", "false", "error"]
    assert seen(M.compare_config("eq", v, None)) == ["missing", "true", "false", "false", "false", "false"]
    assert seen(M.compare_config("exists", v)) == ["false"] + ["true"] * 5
    for op in M.OPERATORS:
        assert seen(M.compare_inferred(op, v, ["a"] if op in M.SETS else "a"))[0] == "missing"
    levels = F.create_map(F.lit("pii"), F.lit(2), F.lit("g"), F.lit(0), F.lit("u"), F.lit(1))
    for key, want in (("pii", "true"), ("u", "missing"), ("none", "missing"), ("g", "false")):
        assert seen(M.compare_inferred("is_true", M.inferred_lookup(F.col("m"), levels, key)))[0] == want
    assert seen(M.compare_inferred("is_true", M.inferred_lookup(F.col("m"), levels, "g"))) == ["false", "false", "false", "true", "true", "true"]


def test_exposures(spark):
    df = spark.sql("select 'e' as name, cast(null as string) as kind, parse_json('{\"email\": \"x\"}') as owner, parse_json('{\"tier\": 1}') as own, parse_json('{\"tier\": 2}') as dash, true as is_dash union all select 'f', 'app', cast(null as variant), parse_json('{}'), null, true")
    c = F.col
    look = lambda key, d=None, i=None: [r[0] for r in df.select(F.to_json(M.exposure_lookup(c("name"), c("kind"), c("owner"), c("own"), key, d, i))).collect()]
    assert look("name") == ['"e"', '"f"'] and look("type") == [None, '"app"'] and look("name.x") == [None, None]
    assert look("owner.email") == ['"x"', None] and look("owner") == ['{"email":"x"}', None] and look("tier") == ["1", None]
    assert look("tier", c("dash"), c("is_dash")) == ["2", None] and look("name", c("dash"), c("is_dash")) == [None, '"f"']


def test_unreadable_patterns_are_refused_when_the_rule_is_read(spark):
    for bad in ("(", "[a", "*"):
        with pytest.raises(ValueError):
            M.compare("matches", F.lit(None).cast("variant"), bad)
    with pytest.raises(ValueError):
        M.compare("like", F.lit(None).cast("variant"), "a")
