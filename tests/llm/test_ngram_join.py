import random
import re

import pytest

from ripplegraph.llm.ngram_join import ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    head = {d: d for d in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d), links[d]) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "Of", "and", "é", "Übung"] + [f"w{i}" for i in range(120)]
    base = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 40, 90]))] for _ in range(14)]
    rows = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 300_000), (1004, "long " * 20_000)]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_links_match_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as sig", "'a' as grp", "null as n")
    assert {tuple(x) for x in ngram_components(docs, k, percent).collect()} == brute(rows, k, percent)


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A B c\nd")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_components(docs, 3, 90).collect()), key=str)
    assert [x[:3] for x in got] == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, None)]
    assert ngram_components(docs.limit(0), 3, 90).collect() == []
