import random
import re
from collections import Counter

import pytest

from ripplegraph.llm import quality_classifier as C
from ripplegraph.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)


def corpus(n=1600):
    r = random.Random(2)
    words = [f"wo{chr(97 + i % 26)}{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(40, 160))]
        bad = i % 7 == 0
        docs.append((i, "\n".join([" ".join(x + "###" * (bad and r.random() < 0.6) for x in w)] * (1 + (i % 50 == 1))), r.choice(["en", "de", None])))
        if i % 2 or bad:
            labels.append((i, int(not bad), 0))
    return docs + [(9001, None, None), (9002, "", "en"), (None, "x y", "fr"), (3, "again é", "en"), (9003, "a b " * 20_000, "en"), (9004, "\n\n \n", "en")], labels


def test_rules(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("lang", "text", "doc_id", "1 as stratum", "2 as quality", "3 as n_words")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (77, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality_rules(d, lab, risk=0.05).collect()
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got) == Counter((i, *base(t)) for i, t, _ in docs)
    for x in got:
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.kept and x.base_failed)
    q = {i: y for i, y, _ in labels}
    bad = [x for x in got if q.get(x.doc_id) == 0 and not x.base_failed]
    good = [x for x in got if q.get(x.doc_id) == 1 and not x.base_failed]
    assert sum(x.kept for x in bad) < 0.05 * len(bad) and sum(not x.kept for x in good) < 0.05 * len(good)
    none = Q.quality_rules(d, lab.limit(0)).collect()
    assert all(x.kept != x.base_failed for x in none)
    assert Q.quality_rules(d.limit(0), lab).collect() == []
    kept = {x.doc_id for x in got if x.kept}
    assert {x.doc_id for x in Q.filter_documents(d, lab, risk=0.05).collect()} == kept


def test_binomial_bound_is_exact():
    from math import comb

    for n, k in ((10, 0), (50, 3), (200, 7)):
        assert Q.chance(k, n, 0.05) == pytest.approx(sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)))
    assert Q.chance(0, 0, 0.05) == 1.0


def test_classifier_on_held_out_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("text", "doc_id", "1 as quality", "2 as score")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = C.classify(d, lab).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _, _ in docs)
    q = {i: y for i, y, _ in labels}
    held = [x for x in got if x.held_out and x.doc_id in q]
    assert sum(x.predicted == q[x.doc_id] for x in held) > 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert {x.score for x in C.classify(d, lab.limit(0)).collect()} == {0.5}
    assert C.classify(d.limit(0), lab).collect() == []


def test_a_good_row_keeps_no_bad_row_of_its_doc_id(spark):
    good = " ".join(f"wo{chr(97 + i % 26)}{i}" for i in range(80))
    rows = [(None, good, "en"), (None, "too short", "en"), (None, None, None), (4, good + " end", "en"), (4, "short", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.text for r in Q.filter_documents(docs, none).collect()) == [good, good + " end"]


def test_a_language_without_its_own_certificate_has_base_rules_alone(spark):
    r = random.Random(4)
    say = lambda mark: " ".join(f"wo{r.randrange(400)}{mark}" for _ in range(60))
    rows = [(i, say("" if i % 5 else "##"), "en") for i in range(2000)] + [(3000 + i, say("#" if i > 9 else ""), "de") for i in range(40)] + [(4000, say("#"), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(x == "de" or i % 5 > 0), 0) for i, _, x in rows if i < 3010], "doc_id long, quality int, toxic int")
    kept = {x.doc_id: x.kept for x in Q.quality_rules(docs, labels).collect()}
    assert all(kept[i] for i, _, x in rows if x != "en")
    assert not any(kept[i] for i in range(0, 2000, 5)) and sum(not kept[i] for i in range(2000) if i % 5) < 0.02 * 1600


def test_columns_of_any_name_come_through_the_filter(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "en", "keep me", "too"), (2, "short", "en", "x", "y")], "doc_id long, text string, lang string, _stratum string, _cell string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.filter_documents(docs, none)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, good, "en", "keep me", "too")]
