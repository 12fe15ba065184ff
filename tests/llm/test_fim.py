import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ripplegraph.llm import fim

TEXTS = ["", "a", "é", "abc def", "日本語 text", "a<P>b", "x<S>", "<M", "<<P", "a<", ">b", "\n\n", "Ab1cD", "🙂🙂a🙂", "\x00a\x7fz{[@`", "word " * 4000, "é" * 3000, "Z" * 5000, "<P><S", "S>P>"]


def brute(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(5)
    signs = ["a", "Zb", "é", "日", "🙂", " ", "\n", "<", "P", ">", "<P", "S>", "1", "[", "\x80", "߿", "￿"]
    return TEXTS + ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(600)]


def test_ranks_and_selects_equal_a_scan():
    got = texts()
    data, off = fim.T.arrow_bytes(pa.array(got))
    u = fim.Units(data, off)
    split = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in got]
    assert u.count.tolist() == [len(x) for x in split]
    for share in (0, 0.3, 0.5, 1):
        k = (u.count * share).astype(np.int64)
        at = u.cut(k)
        assert (at - off[:-1]).tolist() == [len("".join(x[:n]).encode()) for x, n in zip(split, k)]
        assert u.chars(off[:-1], at).tolist() == [len("".join(x[:n])) for x, n in zip(split, k)]


def test_equals_brute_force_and_reads_back(spark):
    rows = [(i % 400, t) for i, t in enumerate(texts())] + [(None, "null id"), (None, None), (7, None), (-3, "below zero"), (2**62, "large id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "'x' as output", "doc_id", "1 as n", "2 as h1", "3 as form").repartition(5)
    out = fim.fill_in_middle(docs)
    got = out.select("*", fim.restored(out["output"], out["form"]).alias("text")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted((r.text for r in got)) == sorted(t or "" for _, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_marks_that_could_not_be_read_back_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("P>", "<S>", "<M>"), ("", "", "")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=marks)
