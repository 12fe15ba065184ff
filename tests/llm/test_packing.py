import random
from collections import defaultdict

import public_tokenizers as P

from ripplegraph.llm import packing as K


def test_matches_are_best_fit(spark):
    r = random.Random(2)
    for most, n in ((12, 60), (30, 40), (3, 200)):
        docs = [(i, r.randrange(1, most)) for i in range(r.randrange(n))]
        gaps = [(-i - 1, 1 + i % 3, r.randrange(1, most)) for i in range(n)]
        want, free = defaultdict(int), sorted(g for _, _, g in gaps)
        for _, size in sorted(docs, key=lambda d: -d[1]):
            fit = next((g for g in free if g >= size), None)
            want[size, fit] += 1
            if fit:
                free.remove(fit)
        rows = K.matched(spark.createDataFrame(docs, "item long, length long"), spark.createDataFrame(gaps, "sequence_id long, slot long, size long")).collect()
        assert sorted(x.item for x in rows) == [i for i, _ in docs]
        taken = [(x.sequence_id, x.slot) for x in rows if x.slot is not None]
        assert len(taken) == len(set(taken))
        size, got = {(a, b): g for a, b, g in gaps}, defaultdict(int)
        for x in rows:
            got[x.length, size.get((x.sequence_id, x.slot))] += 1
        assert got == want


def check(rows, limit):
    seqs = defaultdict(list)
    for item, length, seq, off in rows:
        seqs[seq].append((off, length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= limit
    return len(seqs)


def test_pack_is_gapless_and_tight(spark):
    r = random.Random(4)
    items = [(i, r.choice([r.randrange(1, 257), 7, 1])) for i in range(3000)]
    df = spark.createDataFrame(items, "item long, length long")
    out = df.join(K.best_fit(df, 256), "item").select("item", "length", "sequence_id", "offset").collect()
    assert sorted((x[0], x[1]) for x in out) == items
    assert check(out, 256) <= -(-sum(n for _, n in items) // 256) * 1.03 + 1


def test_documents_are_cut_from_the_front(spark):
    docs = spark.createDataFrame([(1, "a b " * 5000), (2, None), (2, None), (None, "x"), (3, "")], "doc_id long, text string").selectExpr("text", "doc_id", "1 as item", "2 as length")
    out = K.pack_documents(docs, P.path("byte_bpe_50k.json"), 0, 2048).collect()
    one = sorted((x.piece, x.start, x.length) for x in out if x.doc_id == 1)
    assert all(n == 2048 for _, _, n in one[1:]) and one[0][2] < 2048
    assert [s for _, s, _ in one] == [sum(n for _, _, n in one[:k]) for k in range(len(one))]
    assert len(out) == len(one) + 4
    check([(0, x.length, x.sequence_id, x.offset) for x in out], 2048)
    assert K.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json"), 0).collect() == []
