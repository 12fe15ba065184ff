"""Token-id shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by doc_id (and a hash of the text, so that one doc_id may hold any number
of rows), encoded, and written as shards of bounded size.  A shard is one binary value of a Parquet table, so any store
that Spark writes to will do:

    magic 4s | id width u4 | documents u4 | distinct keys u4 | buckets u4 | tokens u8
    displacement i4[buckets] | fingerprint u4[keys] | ordinal u4[keys]      the hash index, by slot
    keys i8[documents] | has key u1[documents] | offset u8[documents + 1] | payload

A key's bucket gives a displacement, that gives its slot, and the slot holds a fingerprint and the place of
the key's first document: one probe whatever the size.  A fingerprint that differs means that the key is not
there; one that agrees is wrong for a foreign key with odds of 2**-32, so the stored key is compared as well.

Edge cases: a null text is empty and has the end id alone; a null doc_id sorts first and is not in the index;
rows that repeat a doc_id stand next to each other, ordered by a hash of the text, over as many shards as they need; an
empty table has no shards; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T
from ripplegraph.llm.encoding import encoder

_HEAD = struct.Struct("<4sIIIIQ")
_MAGIC = b"RGT1"
#: Documents of a shard, and bytes of ids after which a shard ends.
SHARD_DOCS, SHARD_BYTES = 2048, 4 << 20
STORE = "part int, shard int, low long, high long, docs long, tokens long, data binary"


def _slots(keys: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    return (T.mix64(keys ^ T.mix64(seed)) % np.uint64(size)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets and the slot of each of the distinct keys: a minimal perfect hash."""
    n = len(keys)
    if not n:
        return np.zeros(1, np.int32), np.zeros(0, np.int64)
    hashed = keys.astype(np.int64).view(np.uint64)
    buckets = n // 4 + 1
    bucket = (T.mix64(hashed) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(buckets + 1))
    taken, slot, shift = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(buckets, np.int32)
    for b in np.argsort(first[:-1] - first[1:], kind="stable"):
        own = order[first[b] : first[b + 1]]
        if len(own) < 2:
            break
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64, dtype=np.uint64)
            at = _slots(hashed[own][None, :], tries[:, None], n)
            good = ~taken[at].any(1) & (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
            if good.any():
                k = int(np.argmax(good))
                shift[b], slot[own] = seed + k, at[k]
                taken[at[k]] = True
                break
            seed += 64
    # a bucket with one key takes any free slot
    single = np.flatnonzero(np.diff(first) == 1)
    free = np.flatnonzero(~taken)
    slot[order[first[single]]] = free
    shift[single] = -(free + 1)
    return shift, slot


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (T.mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype("<u4")


def pack(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """A shard of documents in order; equal keys stand next to each other.  ``width`` is the bytes of an id."""
    has = np.array([k is not None for k in keys], np.uint8)
    plain = np.array([k or 0 for k in keys], "<i8")
    distinct, ordinal = np.unique(plain[has == 1], return_index=True)
    ordinal = np.flatnonzero(has)[ordinal] if len(distinct) else ordinal
    shift, slot = build_index(distinct)
    prints, places = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slot], places[slot] = _fingerprint(distinct), ordinal
    offset = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    head = _HEAD.pack(_MAGIC, width, len(keys), len(distinct), len(shift), int(offset[-1]))
    return b"".join([head, shift.astype("<i4").tobytes(), prints.tobytes(), places.tobytes(), plain.tobytes(), has.tobytes(), offset.tobytes(), *(x.tobytes() for x in ids)])


class Shard:
    """Reads a shard: all documents in order, or one by key in constant time."""

    def __init__(self, data: bytes):
        magic, self.width, self.docs, n, buckets, self.tokens = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        self.shift, self.prints, self.places = take("<i4", buckets), take("<u4", n), take("<u4", n)
        self.keys, self.has, self.offset = take("<i8", self.docs), take("u1", self.docs), take("<u8", self.docs + 1)
        self.payload = take(f"<u{self.width}", self.tokens)

    def ids(self, i: int) -> np.ndarray:
        return self.payload[int(self.offset[i]) : int(self.offset[i + 1])]

    def find(self, key: int) -> list[np.ndarray]:
        """The ids of each document under the key."""
        if not len(self.prints):
            return []
        k = np.array([key], np.int64)
        shift = int(self.shift[int(T.mix64(k.view(np.uint64))[0] % np.uint64(len(self.shift)))])
        if shift == 0:
            return []
        slot = -shift - 1 if shift < 0 else int(_slots(k.view(np.uint64), np.array([shift], np.uint64), len(self.prints))[0])
        i = int(self.places[slot])
        if self.prints[slot] != _fingerprint(k)[0] or self.keys[i] != key:
            return []
        out = []
        while i < self.docs and self.keys[i] == key and self.has[i]:
            out.append(self.ids(i))
            i += 1
        return out


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text) and write them as shards in ascending doc_id order."""
    spark = T.session(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(tokenizer)
        width = encode.dtype.itemsize
        part, shard = TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[np.ndarray] = []
        size = 0

        def flush():
            known = [k for k in keys if k is not None]
            row = [part, shard, min(known, default=None), max(known, default=None), len(keys), size, pack(keys, ids, width)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "shard", "low", "high", "docs", "tokens", "data"])

        for b in T.pieces(batches, holds=tokenizer):
            flat, at = encode(b.column(1), end_id)
            for k, i, j in zip(b.column(0).to_pylist(), at[:-1], at[1:]):
                if len(keys) >= SHARD_DOCS or size * width >= SHARD_BYTES:
                    yield flush()
                    keys, ids, size, shard = [], [], 0, shard + 1
                keys.append(k)
                ids.append(flat[i:j])
                size += int(j - i)
        if keys:
            yield flush()

    rows = T.text_frame(docs, T.text_hash().alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows.select("doc_id", "text").mapInArrow(run, STORE).write.option("compression", "zstd").mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    store = spark.read.schema(STORE).parquet(path)
    # one row a part: as many as the writer had tasks
    base = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(base), F.lit(0)).alias("base"))
    starts = store.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("within")).join(parts, "part").select("part", "shard", (F.col("base") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for part, shard, data in zip(*(b.column(b.schema.get_field_index(c)) for c in ("part", "shard", "data"))):
                s = Shard(data.as_py())
                at = s.offset.astype(np.int64)
                ids = memoryview(s.payload.astype("<u4")).cast("B")
                crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:])]
                same = [pa.array(np.full(s.docs, x.as_py(), np.int32)) for x in (part, shard)]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys, mask=s.has == 0), *same, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "part", "shard", "at", "n_tokens", "ids_crc32"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    rows = T.stash(store.select("part", "shard", "data").mapInArrow(run, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long"))
    T.session(spark)
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("at") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids (array of int) of the documents under the keys (column doc_id), a row each.

    A key meets only the shards whose range holds it: the parts' bounds, two numbers a task of the writer, name its
    parts (more than one, if a key has very many documents), and the join is on that.
    """
    store = spark.read.schema(STORE).parquet(path)
    bounds = store.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("high is not null").collect()
    if not bounds:
        return keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("array<int>").alias("ids")).limit(0)
    parts = F.array(*(F.struct(F.lit(r.part).alias("part"), F.lit(r.low).alias("low"), F.lit(r.high).alias("high")) for r in bounds))
    mine = F.filter(parts, lambda p: (p["low"] <= F.col("doc_id")) & (p["high"] >= F.col("doc_id")))
    asked = keys.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().select("doc_id", F.explode(F.transform(mine, lambda p: p["part"])).alias("part"))
    hit = asked.join(store, "part").where("doc_id between low and high").groupBy("part", "shard").agg(F.collect_list("doc_id").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for asked, data in zip(b.column(0).to_pylist(), b.column(1)):
                s = Shard(data.as_py())
                rows = [(k, x.tolist()) for k in asked for x in s.find(k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return hit.join(store.select("part", "shard", "data"), ["part", "shard"]).select("asked", "data").mapInArrow(run, "doc_id long, ids array<int>")


def token_store(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a store in the shared folder, and read that back."""
    path = f"{T.shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer, end_id)
    return read_store(docs.sparkSession, path)
