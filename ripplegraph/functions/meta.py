"""Metadata of any shape, as VARIANT: dotted lookups and the operators of rules, which never raise.

A lookup tells three things apart: an absent key is a NULL column, a key that is there with a JSON null is a variant null, anything else
its value.  Operators dispatch on the value's own type (``schema_of_variant``) and give a ``Tri``: unknown by a missing
key, or unknown by a shape that the operator can't take.  Values compare as JSON does with booleans as 0 and 1 and numbers by value,
elements of a list one by one; below that, by their canonical JSON.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.tri import Tri

#: The operators of rules.
TOTAL = ("exists", "absent", "is_true", "is_false")
SETS = ("intersects", "subset_of", "not_subset_of", "superset_of")
ORDERS = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
OPERATORS = (*TOTAL, "eq", "ne", "in", "not_in", "matches", *SETS, *ORDERS)


def _path(key: str) -> str:
    out = "$"
    for part in key.split("."):
        if "'" in part and '"' in part:
            raise ValueError(f"key {key!r}: a part can't hold both kinds of quotes")
        quote = '"' if "'" in part else "'"
        out += f"[{quote}{part}{quote}]"
    return out


def lookup(container: Column, key: str) -> Column:
    """The value under a dotted key of nested objects; NULL where a part is absent, a variant null where it is null."""
    if not all(key.split(".")):
        return F.lit(None).cast("variant")
    return F.try_variant_get(container, _path(key), "variant")


def variant(value) -> Column:
    """A constant as a variant."""
    return F.parse_json(F.lit(json.dumps(list(value) if isinstance(value, (set, tuple, frozenset)) else value, default=str)))


def first_of(*found: Column) -> Column:
    """The first lookup that is there: of a column and its model, the column wins, also with a null."""
    return F.coalesce(*found)


def exposure_lookup(name: Column, kind: Column, owner: Column, own: Column, key: str, dashboard: Column | None = None, is_dashboard: Column | None = None) -> Column:
    """A key of an exposure: name, type and owner are fields of its own, anything else its metadata.

    A dashboard of a BI tool (``is_dashboard``) whose metadata is known has it from there, reserved fields included.
    """
    head, _, rest = key.partition(".")
    if head in ("name", "type"):
        plain = {"name": name, "type": kind}[head]
        out = F.lit(None).cast("variant") if rest else F.when(plain.isNotNull(), plain.cast("variant"))
    elif head == "owner":
        whole = F.when(F.schema_of_variant(owner) != "VOID", owner)
        out = lookup(whole, rest) if rest else whole
    else:
        out = lookup(own, key)
    if dashboard is None:
        return out
    return F.when(F.coalesce(is_dashboard & dashboard.isNotNull(), F.lit(False)), lookup(dashboard, key)).otherwise(out)


def _is(v: Column, *kinds: str) -> Column:
    k = F.schema_of_variant(v)
    return F.coalesce(reduce(lambda a, b: a | b, [k.startswith(x) for x in kinds]), F.lit(False))


def _number(v: Column) -> Column:
    return _is(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def truthy(v: Column) -> Column:
    """Whether a value counts as set: not null, not false, not zero, not empty."""
    out = F.when(_is(v, "VOID"), False).when(_is(v, "BOOLEAN"), _get(v, "boolean")).when(_number(v), _get(v, "double") != 0)
    out = out.when(_is(v, "STRING"), _get(v, "string") != "").when(_is(v, "ARRAY"), F.size(_get(v, "array<variant>")) > 0)
    return F.coalesce(out.otherwise(F.schema_of_variant(v) != "OBJECT<>"), F.lit(True))


def _scalar(v: Column) -> Column:
    """A name for a value: equal for equal values."""
    real = _get(v, "double")
    whole = (real == F.floor(real)) & (F.abs(real) < 1e15)
    exact = _is(v, "BIGINT", "INT", "SMALLINT", "TINYINT") | F.coalesce(F.schema_of_variant(v).rlike(r"^DECIMAL\(\d+,0\)$"), F.lit(False))
    number = F.when(exact, _get(v, "string")).when(whole, real.try_cast("long").cast("string")).otherwise(real.cast("string"))
    flag = F.when(_get(v, "boolean"), "n1").otherwise("n0")
    return F.when(_is(v, "VOID"), "null").when(_is(v, "BOOLEAN"), flag).when(_number(v), F.concat(F.lit("n"), number)).when(_is(v, "STRING"), F.concat(F.lit("s"), _get(v, "string"))).otherwise(F.to_json(v))


def _elements(v: Column) -> Column:
    return F.transform(_get(v, "array<variant>"), lambda x: F.coalesce(_scalar(x), F.lit("null")))


def _canonical(v: Column) -> Column:
    # every name has its length before it, so no list is spelled like another
    listed = F.concat(F.lit("["), F.array_join(F.transform(_elements(v), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ","), F.lit("]"))
    return F.when(_is(v, "ARRAY"), listed).otherwise(_scalar(v))


def _flat(v: Column) -> Column:
    """Whether a value is a list of plain values."""
    return _is(v, "ARRAY") & ~F.coalesce(F.exists(_get(v, "array<variant>"), lambda x: _is(x, "ARRAY", "OBJECT")), F.lit(False))


def _text(v: Column) -> Column:
    """The text that a pattern is held against; NULL for lists and objects."""
    real = _get(v, "double")
    number = F.when(_is(v, "BIGINT"), _get(v, "string")).when((real == F.floor(real)) & (F.abs(real) < 1e15), F.concat(real.try_cast("long").cast("string"), F.lit(".0"))).otherwise(real.cast("string"))
    flag = F.when(_get(v, "boolean"), "True").otherwise("False")
    return F.when(_is(v, "STRING"), _get(v, "string")).when(_is(v, "VOID"), "None").when(_is(v, "BOOLEAN"), flag).when(_number(v), number)


def check_operator(op: str, expected) -> None:
    """A ValueError for what no value could satisfy: an unknown operator, a pattern that can't be read."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator: {op}")
    if op == "matches" and isinstance(expected, str):
        try:
            re.compile(expected)
            spark = SparkSession.getActiveSession()
            if spark is not None:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(expected)
        except Exception as e:
            raise ValueError(f"pattern {expected!r} can't be read: {e}") from None


def compare(op: str, v: Column, expected=None) -> Tri:
    """An operator on a looked-up variant; nothing that a value can be makes it raise."""
    check_operator(op, expected)
    present, never = v.isNotNull(), F.lit(False)
    if op == "exists":
        return Tri.of(present)
    if op == "absent":
        return Tri.of(~present)
    if op in ("is_true", "is_false"):
        return Tri.of(present & (truthy(v) if op == "is_true" else ~truthy(v)))

    def given(value: Column, fits: Column) -> Tri:
        # a value that is there and gives no answer has the wrong shape
        answer = F.when(present & fits, value)
        return Tri(answer, present & answer.isNull())

    listed = isinstance(expected, (list, tuple, set, frozenset))
    e = variant(expected)
    if op in ("eq", "ne"):
        same = _canonical(v) == _canonical(e)
        return given(same if op == "eq" else ~same, F.lit(True))
    if op in ("in", "not_in"):
        if not listed:
            return given(never, never)
        among = F.array_contains(F.array(*(_canonical(variant(x)) for x in expected)), _canonical(v)) if len(expected) else never
        return given(among if op == "in" else ~among, F.lit(True))
    if op == "matches":
        return given(_text(v).rlike(rf"\A(?:{expected})\z"), F.lit(True)) if isinstance(expected, str) else given(never, never)
    if op in SETS:
        if not listed or any(isinstance(x, (list, tuple, dict, set)) for x in expected):
            return given(never, never)
        left = F.coalesce(_elements(v), F.array().cast("array<string>"))
        right = F.array(*(_scalar(variant(x)) for x in expected)).cast("array<string>")
        part = lambda a, b: F.size(F.array_except(a, b)) == 0
        answer = {"intersects": F.size(F.array_intersect(left, right)) > 0, "subset_of": part(left, right), "not_subset_of": ~part(left, right), "superset_of": part(right, left)}[op]
        return given(answer, _flat(v))
    if isinstance(expected, bool) or not isinstance(expected, (int, float)):
        return given(never, never)
    wide = _get(v, "decimal(38,9)")
    small = isinstance(expected, int) and abs(expected) < 1 << 62
    exact = ORDERS[op](wide, F.lit(expected)) if small else F.lit(None).cast("boolean")
    return given(F.coalesce(F.when(_is(v, "BIGINT"), exact), ORDERS[op](_get(v, "double"), F.lit(float(expected)))), _number(v))


def compare_config(op: str, v: Column, expected=None) -> Tri:
    """An operator on a configuration: for sets, what is absent or null is the empty set, which is proven and not unknown."""
    if op in SETS:
        v = F.when(v.isNull() | _is(v, "VOID"), variant([])).otherwise(v)
    return compare(op, v, expected)


def compare_inferred(op: str, v: Column, expected=None) -> Tri:
    """An operator on an inherited value: unknown for every operator where nothing could be proven."""
    found = compare(op, v, expected)
    return Tri(F.when(v.isNotNull(), found.value), v.isNotNull() & found.error)


def inferred_lookup(own: Column, levels: Column, key: str) -> Column:
    """A column's own value as it is; else true or false as its parents were folded; NULL if that is unknown.

    ``levels`` maps keys to 0 (not set), 1 (unknown) and 2 (set).
    """
    level = F.try_element_at(levels, F.lit(key))
    return F.coalesce(lookup(own, key), F.when(level == 2, variant(True)).when(level == 0, variant(False)))
