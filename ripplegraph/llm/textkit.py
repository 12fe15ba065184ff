"""Shared helpers: written intermediate tables, and vectorised word hashing of Arrow text columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  All hashing is done with
numpy on the UTF-8 bytes of an Arrow batch, so a task's memory follows the batch and not the input.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts of some KB make that a few MB.
BATCH_ROWS = 1000
#: Bytes of text taken at once, and of those hashed at once (each byte needs some 40 for a moment).
PIECE_BYTES, HASH_BYTES = 2 << 20, 1 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        dir_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        if dir_.isDefined():
            return dir_.get()
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_frame(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string with null as empty, and the named columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def text_hash() -> Column:
    """A 64-bit hash of the column text, null as empty: with doc_id it names a row's content."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_ROW = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or len(off) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end (exclusive); a text's end ends its word."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    out = np.empty(len(start), np.uint64)
    size = end - start
    cut, done = np.cumsum(size), 0
    while done < len(start):
        upto = max(done + 1, int(np.searchsorted(cut, (cut[done - 1] if done else 0) + HASH_BYTES)))
        n = size[done:upto]
        head = np.zeros(len(n), np.int64)
        np.cumsum(n[:-1], out=head[1:])
        at = np.arange(int(n.sum())) - np.repeat(head, n)
        powers = np.full(int(n.max()) + 1, _BASE)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        out[done:upto] = np.add.reduceat(_BYTE[data[at + np.repeat(start[done:upto], n)]] * powers[at], head) + n.astype(np.uint64)
        done = upto
    return mix64(out)


class Words:
    """The words of a text column: hash, byte span and text of each word, and where each text's words begin."""

    def __init__(self, col: pa.Array, lower: bool = True):
        self.data, self.off = arrow_bytes(col)
        if lower and len(self.data):
            self.data = _LOWER[self.data]
        if len(self.data):
            self.start, self.end = word_spans(self.data, self.off)
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.hash = word_hashes(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.off)  # of each text, and the number of all words
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Position and hash of each window of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = np.flatnonzero(self.doc[k - 1 :] == self.doc[:n])
        return ok, join_hashes([self.hash[i : i + n] for i in range(k)])[ok]


def join_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of hashes, in order."""
    total = np.full(len(parts[0]), np.uint64(len(parts)))
    for i, x in enumerate(parts):
        total += x * _ROW[i % 64] ^ (x >> np.uint64(17 + i // 64 % 8))
    return mix64(total)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's set begins, and the sets' distinct shingles, ascending within a text.

    A text of fewer than k words has the whole sequence as its one shingle; one without words has none.
    """
    at, found = words.windows(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        tail = np.array([join_hashes([words.hash[i : i + 1] for i in range(words.first[d], words.first[d] + words.count[d])])[0] for d in short], np.uint64)
        doc, found = np.concatenate([doc, short]), np.concatenate([found, tail])
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    doc, found = doc[keep], found[keep]
    return np.searchsorted(doc, np.arange(len(words.count) + 1)), found


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker holds under ``name`` from task to task, made if it isn't there."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES, holds: str = "") -> Iterator[pa.RecordBatch]:
    """Split batches so that each holds a few MB of text, or one longer text.

    What the worker holds under another name than ``holds`` goes, so that no operator pays for the caches of others.
    """
    for name in [n for n in _held if n != holds]:
        del _held[name]
    pa.default_memory_pool().release_unused()
    for b in batches:
        if not b.num_rows:
            continue
        _, off = arrow_bytes(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(off, off[at] + size)) - 1)
            upto = min(upto, b.num_rows)
            yield b.slice(at, upto - at)
            at = upto


def list_column(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An Arrow list column of rows of values."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (id, component), the smallest id reachable.

    ``edges`` has long columns src and dst.  Alternates large-star and small-star steps, each a
    pre-aggregated minimum per vertex and an equi-join, until the edges no longer change; the number of
    rounds follows the logarithm of the longest chain.  Isolated vertices are not in the result.
    """
    e = stash(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    sign = None
    while True:
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min(F.least("src", "dst")).alias("m"))
        big = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        big = big.where("src <> dst").distinct()
        low = big.groupBy("src").agg(F.min("dst").alias("m"))
        small = big.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct(F.col("src"), F.col("m").alias("dst")))).alias("x")).select("x.*")
        e = stash(small.where("src <> dst").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.pmod(F.xxhash64("dst", "src"), F.lit(1 << 20)))).first()
        if now == sign:
            break
        sign = now
    heads = e.select(F.col("dst").alias("id")).distinct()
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(heads.select("id", F.col("id").alias("component")))


#: Bits of a sieve at most, as a power of two: 4 MB.  Beyond it lets more through, and the exact join that follows has more to do.
SIEVE_BITS = 25


def _bits(wanted: DataFrame) -> int:
    """The size of a sieve as a power of two: some 32 bits for each wanted row, within bounds."""
    return max(16, min(SIEVE_BITS, (32 * wanted.count()).bit_length()))


def _words(cells: DataFrame) -> DataFrame:
    """The 64-bit words of a sieve, by number, from the column _cell."""
    return cells.select(F.shiftright("_cell", 6).alias("_word"), F.expr("shiftleft(1L, cast(_cell & 63 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that are none of the frame's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unclaimed(df: DataFrame, *results: str) -> None:
    """A ValueError if a column that a result is to have is there already."""
    both = sorted({c.lower() for c in df.columns} & {r.lower() for r in results})
    if both:
        raise ValueError(f"the result has columns of its own named {', '.join(both)}; rename the input's")


def _sieve(docs: DataFrame, wanted: DataFrame, keys: tuple[str, ...], keep: bool) -> DataFrame:
    cell = F.xxhash64(*keys).bitwiseAND(F.lit((1 << _bits(wanted)) - 1))
    at, word, bits = fresh(docs, "_cell", "_word", "_bits")
    words = _words(wanted.select(cell.alias("_cell"))).select(F.col("_word").alias(word), F.col("_bits").alias(bits))
    rows = docs.withColumn(at, cell).withColumn(word, F.shiftright(at, 6))
    hit = F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{at}` & 63 as int)) & 1"), F.lit(0)) == 1
    return rows.join(F.broadcast(words), word, "left").where(hit if keep else ~hit).select(*(F.col(f"`{c}`") for c in docs.columns))


def thin(docs: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``docs`` whose keys may be among ``wanted``'s: a superset, found without a shuffle of ``docs``.

    At most 2**(SIEVE_BITS - 6) words are broadcast, whatever the input; an exact join has to follow.
    """
    return _sieve(docs, wanted, keys, True)


def rest(docs: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows that ``thin`` leaves out."""
    return _sieve(docs, wanted, keys, False)


def without(docs: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``docs`` whose keys are not among ``gone``'s (null is equal to null); most rows are not shuffled."""
    same = F.lit(True)
    names = dict(zip(keys, fresh(docs, *(f"_gone_{k}" for k in keys))))
    other = gone.select(*(F.col(k).alias(n) for k, n in names.items()))
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rest(docs, gone, *keys).unionByName(thin(docs, gone, *keys).join(other, same, "left_anti"))


#: Three places in a sieve come from these shifts of a hash.
_SHIFTS = (0, 20, 39)


def bitmap(wanted: DataFrame, key: str) -> np.ndarray:
    """The sieve of a column of 64-bit hashes as words, for tasks that look up in numpy, three bits for each hash; bounded like ``thin``'s."""
    bits = _bits(wanted)
    cells = F.explode(F.array(*(F.shiftright(key, k).bitwiseAND(F.lit((1 << bits) - 1)) for k in _SHIFTS)))
    found = _words(wanted.select(cells.alias("_cell"))).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["_word"].to_numpy(np.int64)] = found["_bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes the sieve lets through."""
    hit = np.ones(len(keys), bool)
    for k in _SHIFTS:
        cell = keys >> np.int64(k) & np.int64(64 * len(words) - 1)
        hit &= (words[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return hit
