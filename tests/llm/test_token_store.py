import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ripplegraph.llm import token_store as S
from ripplegraph.llm.encoding import Encoder

TEXTS = ["", "Hello  world", " a\n\nb \t c ", "it's  we'll x", "　 y", "x" * 5000, "tail  ", "\n", "É 12 34,5!!", "a<|endoftext|>b <|endoftext|>", "the quick. " * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_the_whole_text(name):
    own = Tokenizer.from_file(P.path(name))
    r = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "1", "é", "-", "\t", "<|endoftext|>", "ß.", "İ", "\x1f", "word", "end.", " \n"]
    texts = [*TEXTS, None] + ["".join(r.choice(parts) for _ in range(30)) for _ in range(2000)]
    e = Encoder(P.path(name))
    for texts in (texts, texts[:50], ["x"], []):
        ids, at = e(pa.array(texts, pa.string()), 7)
        for t, i, j in zip(texts, at[:-1], at[1:]):
            assert ids[i:j].tolist() == [*own.encode(t or "", add_special_tokens=False).ids, 7], repr(t)
        assert at[-1] == len(ids)


def test_index_is_minimal_and_perfect():
    for n in (0, 1, 2, 5, 2048):
        keys = np.array(random.Random(n).sample(range(-(10**12), 10**12), n), np.int64)
        _, slot = S.build_index(keys)
        assert sorted(slot) == list(range(n))
    s = S.Shard(S.pack([None, 3, 3, 9], [np.array(x, "<u2") for x in ([1], [2, 3], [], [4])], 2))
    assert [x.tolist() for x in s.find(3)] == [[2, 3], []] and s.find(0) == [] and s.find(77) == []


def test_round_trip(spark, tmp_path):
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS * 3)] + [(None, "x"), (2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as part", "2 as data")
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at, want, ids = 0, [], {}
    for d, t in rows:
        x = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, len(x), zlib.crc32(x.tobytes())))
        ids[d] = [*ids.get(d, []), x.tolist()]
    got = sorted(map(tuple, S.token_store(docs, P.path("word_bpe_49k.json"), 1).collect()), key=lambda r: r[1])
    assert sorted([(d, n, c) for d, _, n, c in got], key=str) == sorted(want, key=str)
    keys = [d for d, *_ in got]
    assert keys == sorted(keys, key=lambda d: (d is not None, d or 0))
    for _, start, n, _ in got:
        assert start == at
        at += n
    path = f"file://{tmp_path}/store"
    S.write_store(docs, path, P.path("word_bpe_49k.json"), 1)
    found = {}
    for r in S.lookup(spark, path, spark.createDataFrame([(0,), (7,), (2000,), (555,), (-1,)], "doc_id long")).collect():
        found[r.doc_id] = [*found.get(r.doc_id, []), r.ids]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(ids[k]) for k in (0, 7, 2000)}
    assert S.token_store(docs.limit(0), P.path("word_bpe_49k.json"), 1).collect() == []


def test_a_key_with_most_rows_goes_on_in_further_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SHARD_DOCS", 10)
    rows = [(5, f"text {i}") for i in range(300)] + [(i, "x") for i in range(10)] + [(None, f"t{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/hot"
    S.write_store(docs, path, P.path("word_bpe_49k.json"), 1)
    parts = spark.read.parquet(path).where("low <= 5 and high >= 5").select("part", "shard").collect()
    assert len(parts) > 20 and len({p.part for p in parts}) > 1
    assert S.lookup(spark, path, spark.createDataFrame([(5,), (3,)], "doc_id long")).groupBy("doc_id").count().orderBy("doc_id").collect() == [(3, 1), (5, 301)]


def test_runs_of_marks_and_accents_match_the_library():
    r = random.Random(3)
    letters = "aB zé.,!?;:#*$%&ñ×÷'\n\t 12-_çÉ\"(x"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = Encoder(P.path(name))
        out, at = e(pa.array(texts), 1)
        assert [out[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [x.ids + [1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
