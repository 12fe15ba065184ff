import math
import re
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import lm_score as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def test_base_scores_match_brute_force_and_the_model_beats_them(spark):
    rng = np.random.default_rng(3)
    tongues = [[f"{c}{i}" for i in range(300)] for c in ("ka", "lo", "mi")]
    rows = [(i, " ".join(rng.choice(tongues[i % 3], int(rng.integers(1, 200))))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "É Zürich"), (None, "ka1 never"), (5, "ka2 KA2"), (next(i for i in range(910, 999) if not L.is_training(i)), "x " * 20_000), (904, "y" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as block", "2 as n")
    got = L.score_texts(docs).collect()
    learn = [t for d, t in rows if L.is_training(d)]
    count = Counter(w for t in learn for w in words(t))
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        want[d, d is not None and not L.is_training(d), len(w), sum(count[x] > 0 for x in w), total, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 20 and r.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert L._numbers(L._planes(x)).tolist() == x.tolist()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    share = rng.random(L.CLASSES)
    m = L.LogBilinear.fresh(share / share.sum())
    one, two = np.full(L.CLASSES, 5), np.full(L.CLASSES, 9)
    assert (10 ** m.log10(one, two, np.arange(L.CLASSES))).sum() == pytest.approx(1, abs=1e-4)
    n, v = 1000, {0: (30, 4)}
    s = L.Shape(n, 50, np.array([9.0]), v)
    cls, inner = s.classes(np.array([-1, -1, -1, -1, -1, 0]), np.zeros(6, np.int64), np.array([10, 10, 5, 5, 0, 9]))
    assert cls.tolist() == [L.TOP] * 5 + [0] and inner[5] == 0
    inner = inner[:5]
    assert (10**inner).sum() == pytest.approx(1)


def test_empty_table_and_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_texts(none).collect() == []
    one = L.score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in one] == [(3, 0, 0, 0.0)]
