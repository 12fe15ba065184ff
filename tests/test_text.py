"""Reading SQL: what is the same code, what can't be told, and which comments are directives."""

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.operators import diff

SAME, OTHER, UNSURE = "equivalent", "meaning_changed", "indeterminate"
PAIRS = [
    ("a + b", "a  +   b", None, SAME), ("a /* c */", "a", None, SAME), ("A + B", "a + b", None, SAME), ("SUM(x)", "sum( x )", None, SAME),
    ("(a + b)", "a + b", None, OTHER), ("a and b", "b and a", None, OTHER), ("a + b", "a - b", None, OTHER), ("a::int", "a::text", None, OTHER),
    ("case when a>0 then 1 else 0 end", "case when a>=0 then 1 else 0 end", None, OTHER), ('"a"', "a", None, OTHER), ('"A"', '"a"', None, OTHER), ("'A'", "'a'", None, OTHER),
    ("a +", "a + b", None, UNSURE), ("a + b", "a +", None, UNSURE), ("a +", "a + -- note", None, SAME), (None, None, None, SAME), (None, "a", None, UNSURE),
    (r"'it\'s -- x', 1", r"'it\'s -- y', 2", None, UNSURE), (r"'it\'s -- x', 1", r"'it\'s -- y', 2", "bigquery", OTHER), (r"'it\'s -- x', 1", r"'it\'s -- x',  1", "spark", SAME),
    ("$$ a -- b $$", "$$ a -- c $$", None, UNSURE), ("$$ a -- b $$", "$$ a -- c $$", "postgres", OTHER), ("$t$ a -- b $t$", "$t$ a -- c $t$", "snowflake", OTHER),
    ("éa", "é a", None, OTHER), ("1.5", "1 . 5", None, OTHER), ("1.5e3", "1.5 e3", None, OTHER), ("a <= b", "a < = b", None, OTHER), ("a||b", "a || b", None, SAME),
    ("a # x", "a # y", None, UNSURE), ("a # x", "a # y", "mysql", SAME), ("a # b", "a # c", "postgres", OTHER), ('"""a -- b"""', '"""a -- c"""', "bigquery", OTHER),
    ("'open -- x", "'open -- y", None, UNSURE), ("'open -- x", "'open -- x", None, SAME), ("a /* open", "a /* other", None, UNSURE), ("a /* x /* y */ */", "a /* z /* y */ */", None, UNSURE), ("(a", "(b", None, UNSURE),
    ("'-- not a comment'", "'-- different'", None, OTHER), ("'it''s'", "'it''s' -- c", None, SAME), ("`a b`", "`a  b`", None, OTHER), ("count(*)", "count( * )", None, SAME), ("t.*", "t . *", None, SAME), ("-1", "- 1", None, SAME),
    ("(x AND y) OR (x AND NOT y)", "x", None, OTHER), ("a OR NOT a", "TRUE", None, OTHER), ("'" + "x''" * 20000 + "'", "'" + "x''" * 20000 + "' ", None, SAME), ("'" + r"x\'" * 20000 + "'", "'" + r"x\'" * 20000 + "' -- c", "hive", SAME),
]


def test_pairs(spark):
    for dialect in {p[2] for p in PAIRS}:
        rows = [(i, b, h) for i, (b, h, d, _) in enumerate(PAIRS) if d == dialect]
        df = spark.createDataFrame(rows, "i int, b string, h string")
        for r in df.select("i", diff.compare_expressions(F.col("b"), F.col("h"), dialect).alias("got")).collect():
            assert r.got == PAIRS[r.i][3], (PAIRS[r.i][0][:60], PAIRS[r.i][1][:60], dialect)
    with pytest.raises(ValueError):
        diff.compare_expressions(F.lit("a"), F.lit("b"), "cobol")


def test_what_is_not_proven_the_same_has_changed(spark):
    df = spark.createDataFrame([("select 1 # a", "select 1 # b", True), ("select 1 -- a", "select 1", True), (None, "x", True), (None, "x", False)], "b string, h string, m boolean")
    assert [r[0] for r in df.select(diff.logic_status(F.col("b"), F.col("h"), F.col("m"))).collect()] == ["changed", "unchanged", "indeterminate", "unchanged"]


PRAGMAS = [
    ('select\n  -- ripple:allow-change column=amount_eur reason="renamed"\n  amount as amount_eur\n', [(2, "change", "amount_eur", "column", "renamed", None)]),
    ('select\n  -- ripple:allow-change reason="intended"\n  amount as amount_eur,\n  id\n', [(2, "change", "amount_eur", "column", "intended", None)]),
    ('-- ripple:allow(change) reason="whole"\nselect id, amount from t\n', [(1, "change", None, "model", "whole", None)]),
    ("select\n-- RIPPLE:ALLOW-BREAK reason='why' column=Old_Id\n new_id", [(2, "break", "old_id", "column", "why", None)]),
    ("select\n  -- ripple:allow-change column=amount\n  amount\n", [(2, "change", "amount", "column", None, "no reason")]),
    ('select\n  -- ripple:allow-change reason="  " column=a\n  a\n', [(2, "change", "a", "column", None, "no reason")]),
    ('select\n  -- ripple:allow-foo reason="x"\n  a\n', [(2, "foo", "a", "column", "x", "unknown verb")]),
    ('select\n  -- ripple:allow-change reason="see the column=x note"\n  amount as b\n', [(2, "change", "b", "column", "see the column=x note", None)]),
    ('select id from t\n-- ripple:allow-change reason="dangling"\n', [(2, "change", None, "column", "dangling", None)]),
    ("select '-- ripple:allow-change reason=\"no\"' as a", []),
    ('select a, -- ripple:allow-change reason="next"\n  sum(x, y)\n  as\n total, b', [(1, "change", "total", "column", "next", None)]),
    ('select\n/* ripple:allow-break\n   reason="block" */\n "Quoted", t.z from t', [(2, "break", "quoted", "column", "block", None)]),
    ('-- the word select here is no code\n-- ripple:allow-change reason="r"\nselect 1', [(2, "change", None, "model", "r", None)]),
    ('select\n-- ripple:allow-change reason="none"\n sum(x), y', [(2, "change", None, "column", "none", None)]),
    ('select\n-- ripple:allow-change reason="one"\n a,\n-- ripple:allow-break reason="two"\n t.b\nfrom t', [(2, "change", "a", "column", "one", None), (4, "break", "b", "column", "two", None)]),
    ("", []), (None, []), ("x" * 5000, []),
]


def test_directives(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(PRAGMAS)], "i int, s string")
    for r in df.select("i", text.pragmas(F.col("s")).alias("p")).collect():
        assert [tuple(p) for p in r.p] == PRAGMAS[r.i][1], PRAGMAS[r.i][0]
    other = df.where("i = 0").select(text.pragmas(F.replace("s", F.lit("ripple"), F.lit("lineage")), marker="lineage")).first()[0]
    assert len(other) == 1


def test_a_text_is_read_once_per_reading(spark):
    df = spark.createDataFrame([("a", "b")], "b string, h string")
    for found in (diff.compare_expressions(F.col("b"), F.col("h")), text.same_code(F.col("b"), F.col("h")), diff.logic_status(F.col("b"), F.col("h"), F.lit(True))):
        plan = df.select(found.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 2 <= plan.count("regexp_extract_all(") <= 2 * (len(text.READINGS) + 1)
