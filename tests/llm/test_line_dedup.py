import random

import pytest

from ripplegraph.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance_matches_full_matrix():
    r = random.Random(3)
    for _ in range(4000):
        a = "".join(r.choice("abé") for _ in range(r.randrange(9)))
        b = "".join(r.choice("abé") for _ in range(r.randrange(9)))
        for d in (0, 1, 2, 3):
            assert L.within(a, b, d) == (distance(a, b) <= d)


def brute(rows, d, per):
    at = sorted({(L.LAST if i is None else i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n"))})
    out = set()
    for k, (i, n, x) in enumerate(at):
        if any(c.isalnum() for c in x) and any(x == y or distance(x, y) <= min(d, min(len(x), len(y)) // per) for _, _, y in at[:k] if abs(len(y) - len(x)) <= d and any(c.isalnum() for c in y)):
            out.add((i, n))
    return out


def corpus():
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.choice([1, 3, 8, 9, 10, 14, 19, 20, 23, 41]))) for _ in range(24)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(r.randrange(5)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                k = r.randrange(len(x) or 1)
                x[k : k + r.randrange(2)] = r.choice(["", "z", "zz"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    return rows + [(None, base[1]), (500, None), (501, ""), (502, "y" * 500), (503, "y" * 499 + "x")]


def test_drops_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as key", "2 as id", "3 as line_no")
    assert {tuple(x) for x in L.drops(docs, 2, 10).collect()} == brute(rows, 2, 10)
    out = {x.doc_id: x for x in L.line_dedup(docs, 2, 10).collect()}
    gone = brute(rows, 2, 10)
    for i, t in rows:
        key = L.LAST if i is None else i
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (key, n) not in gone)
        assert out[i].text == want
        assert out[i].n_dropped == sum(k == key for k, _ in gone)
    assert out[0].key == 1 and out[0].id == 2


def test_empty_table_and_repeats(spark):
    x = "a line that is long enough to count"
    docs = spark.createDataFrame([(1, x), (1, x), (2, x + "!"), (3, "y" * 50_000), (4, "y" * 49_999 + "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in L.line_dedup(docs).collect()) == [(1, x), (1, x), (2, ""), (3, "y" * 50_000), (4, "")]
    assert L.line_dedup(docs.limit(0)).collect() == []


def test_rows_without_or_with_a_shared_doc_id_have_their_own_verdicts(spark):
    a, b, c, d = (f"line {x * 30} of a document" for x in "abcd")
    rows = [(1, a), (None, f"{a}\n{b}"), (None, c), (None, None), (7, f"{a}\n{d}"), (7, f"short\n{'e' * 40}\n{'f' * 40}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in L.line_dedup(docs).collect()), key=str)
    assert got == sorted([(1, a, 0), (None, b, 1), (None, c, 0), (None, None, 0), (7, d, 1), (7, rows[5][1], 0)], key=str)
    # the same first line in two documents without doc_id stays in one of them
    twice = spark.createDataFrame([(None, f"{a}\n{b}"), (None, f"{a}\n{c}")], "doc_id long, text string")
    assert sum((r.text or "").count(a) for r in L.line_dedup(twice).collect()) == 1


def test_short_lines_have_to_be_equal_and_rulers_stay(spark):
    docs = spark.createDataFrame([(1, "Read more\n\n---\n}\nyes\nRead more"), (2, "Read more\n\n---\n}\nno\nRead mare"), (3, "read more again\nread more agaim")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.line_dedup(docs).collect()}
    assert got == {1: "Read more\n\n---\n}\nyes", 2: "\n---\n}\nno\nRead mare", 3: "read more again"}


def test_columns_of_any_name_come_through(spark):
    docs = spark.createDataFrame([(1, "one line of a text", 7), (2, "one line of a text", 8)], "doc_id long, text string, x int")
    names = ["_d", "_h", "_gone", "_cell", "_word", "_bits", "_gone__d", "line_no", "key", "a b"]
    wide = docs.select("doc_id", "text", *(docs["x"].alias(n) for n in names))
    got = {r.doc_id: r.asDict() for r in L.line_dedup(wide).collect()}
    assert [got[d][n] for d in (1, 2) for n in names] == [7] * len(names) + [8] * len(names) and got[2]["text"] == ""
    for taken in ("n_lines", "N_Dropped"):
        with pytest.raises(ValueError):
            L.line_dedup(docs.withColumnRenamed("x", taken))
