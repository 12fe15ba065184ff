"""Structured cards against a recursive reading of each."""

import json
import random

from pyspark.sql import functions as F

from ripplegraph.operators import cards as C

FIELDS = {i: (f"t{i % 3}", f"c{i}") for i in range(8)} | {20: ("t9", "C1")}
TABLES = {i: f"t{i}" for i in range(4)}
RANKS = {n: k for k, (n, _) in enumerate(C.CLAUSES)}


def resolve(cards, card):
    """columns {(relation, column): role}, relations, unknown of a card; no circles."""
    columns, relations, unknown = {}, set(), []

    def refs(node):
        if isinstance(node, list) and node and node[0] == "field":
            return [node]
        inner = node if isinstance(node, list) else node.values() if isinstance(node, dict) else []
        return [r for x in inner for r in refs(x)]

    def source(s):
        if isinstance(s, str) and s.startswith("card__") and s[6:].isdigit():
            sub = resolve(cards, int(s[6:])) if int(s[6:]) in cards else ({}, set(), [])
            relations.update(sub[1])
            return sub[0]
        if isinstance(s, int) and s in TABLES:
            relations.add(TABLES[s])
        return {}

    def clause(node, role, names):
        for r in refs(node):
            if len(r) < 2 or not isinstance(r[1], (int, str)):
                continue
            hit = FIELDS.get(r[1]) if isinstance(r[1], int) else names.get(r[1].lower())
            if hit is None:
                unknown.append(r)
            else:
                key = (hit[0], hit[1].lower())
                relations.add(hit[0])
                columns.setdefault(key, role)

    def query(q):
        names = {}
        for rel, col in sorted(source(q.get("source-table")), reverse=True):
            names[col] = (rel, col)
        if isinstance(q.get("source-query"), dict):
            query(q["source-query"])
        for name, role in C.CLAUSES:
            clause(q.get(name), role, names)
        for j in q.get("joins") or []:
            source(j.get("source-table"))
            clause(j.get("condition"), "join", names)
            clause(j.get("fields"), "field", names)

    d = cards[card]
    if isinstance(d, dict) and d.get("type") == "query":
        query(d["query"] if isinstance(d.get("query"), dict) else d)
    return columns, relations, unknown


def run(spark, cards):
    c = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in cards.items()], "card long, j string").select("card", F.parse_json("j").alias("query"))
    f = spark.createDataFrame([(k, *v) for k, v in FIELDS.items()], "field_id long, relation string, column string")
    t = spark.createDataFrame(list(TABLES.items()), "table_id long, relation string")
    return [x.collect() for x in C.resolve_cards(c, f, t)]


def test_cards_equal_a_recursive_reading(spark):
    r = random.Random(5)
    ref = lambda: ["field", r.choice([*range(10), 20, "c1", "C3", "c4", None]), r.choice([None, {"base-type": "x"}])]

    def query(k, deep=0):
        q = {"source-table": r.choice([0, 1, 9, f"card__{r.randrange(k)}" if k else 2, "card__x", f"card__{k + 500}", None])}
        for name, _ in r.sample(C.CLAUSES, 3):
            q[name] = r.choice([[ref(), ref()], ["and", ["=", ref(), 1], ["not", {"x": ref()}]], {"e": ["+", ref(), 2]}, [], None, ["field"], "text"])
        if deep < 2 and r.random() < 0.4:
            q["source-query"] = query(k, deep + 1)
        if r.random() < 0.4:
            q["joins"] = [{"source-table": r.choice([2, 3, f"card__{r.randrange(k)}" if k else 1]), "condition": ["=", ref(), ref()], "fields": r.choice(["all", [ref()]])} for _ in range(r.randrange(3))]
        return q

    cards = {k: {"type": "query", "query": query(k)} for k in range(60)}
    cards |= {100: {"type": "native"}, 101: {}, 102: None, 103: {"type": "query", "source-table": 1, "fields": [["field", 3]]}, 104: {"type": "query", "query": {"fields": [["field", 99]], "source-table": 1}}, 105: {"type": "query", "query": {"source-table": 77}}, 106: {"type": 5}}
    columns, relations, rows = run(spark, cards)
    want = {k: resolve(cards, k) for k in cards}
    assert {(x.card, x.relation, x.column): x.role for x in columns} == {(k, *c): role for k, (cs, _, _) in want.items() for c, role in cs.items()}
    assert {(x.card, x.relation) for x in relations} == {(k, rel) for k, (_, rs, _) in want.items() for rel in rs}
    for x in rows:
        cs, rs, unknown = want[x.card]
        structured = isinstance(cards[x.card], dict) and cards[x.card].get("type") == "query"
        precision = "column" if cs else "table" if rs else "none"
        assert (x.precision, x.reason) == (precision, "unknown_query_kind" if not structured else "unknown_table" if precision == "none" else "unknown_field" if precision == "table" and unknown else None), x.card
    assert len(rows) == len(cards)


def test_cards_that_read_each_other_end(spark):
    q = lambda src, *refs: {"type": "query", "query": {"source-table": src, "fields": [["field", x, None] for x in refs]}}
    columns, relations, rows = run(spark, {1: q("card__2", 1, "c5"), 2: q("card__1", 5, "c1"), 3: q("card__3", "c1"), 4: q("card__2", "c1", "c5")})
    got = {}
    for x in columns:
        got.setdefault(x.card, set()).add(x.column)
    assert got == {1: {"c1", "c5"}, 2: {"c1", "c5"}, 4: {"c1", "c5"}}
    assert {(x.card, x.precision) for x in rows} == {(1, "column"), (2, "column"), (3, "none"), (4, "column")}
    assert run(spark, {7: {"type": "native"}})[:2] == [[], []]
