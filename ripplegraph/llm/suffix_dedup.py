"""Repeated passages by sparse suffix arrays.

Of each text's suffixes (one a word), those at minimiser positions are kept: where the hash of the next four
words is the least of ``span`` neighbouring positions.  The choice depends on content only, so two copies of
a passage keep the same places, and a passage of ``min_words`` has one among its first ``span`` positions,
with ``min_words - span + 1`` words to its right.

The kept suffixes are range-sorted by a 64-bit hash of those words, then by document, and neighbours are
compared: one whose neighbours with the same words are all from its own document is dropped.  The others are
extended: a passage over such a place starts at most ``span - 1`` words before it, so the suffixes that start
there are range-sorted by two 64-bit hashes, of the first and the second half of their ``min_words`` words,
and again compared with their neighbours; those that follow each other in a text make up a passage, as far
left and right as they go.  The order is one of hashed blocks of words, not of letters, and words count as
equal by 128 bits of hash.  A sort takes the document as its last key, so a passage that many documents share
spreads over ranges.

Words are read as they stand (case matters), white space between them does not.

Edge cases: null, empty and short texts have no passages; a null doc_id takes no part; rows that repeat a
doc_id are one document, and a passage that repeats in one document alone is not reported; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Words hashed to choose places.
GRAM = 4


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n word hashes (of the runs that fit), by doubling."""
    size = 1
    while 2 * size <= n:
        h = T.join_hashes([h[:-size], h[size:]]) if len(h) > size else h[:0]
        size *= 2
    if size < n and len(h):
        step = n - size
        h = T.join_hashes([h[:-step], h[step:]]) if len(h) > step else h[:0]
    return h


def minimisers(gram: np.ndarray, span: int) -> np.ndarray:
    """Positions that are the least of some ``span`` neighbouring ones, all of equal ones."""
    if len(gram) < span:
        return np.zeros(0, np.int64)
    low, size = gram, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: -(span - size)], low[span - size :])
    # a position is kept if one of the windows over it has it as its least
    top = np.full(len(gram), 0, np.uint64)
    pad = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    size, high = 1, pad
    while 2 * size <= span:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    if size < span:
        high = np.maximum(high[: -(span - size)], high[span - size :])
    top = high[: len(gram)]
    return np.flatnonzero(gram == top)


def _spots(hashes: np.ndarray, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept places of one text, and the hash of the words to their right."""
    at = minimisers(run_hashes(hashes, GRAM), span)
    right = run_hashes(hashes, min_words - span + 1)
    at = at[at < len(right)]
    return at, right[at]


class _Range:
    """Compares the rows of one range, which come sorted by keys, doc_id and place, with their neighbours.

    The range's first key may have begun before, so its rows are open: no first document is given.  Of any other
    key the first document is known.  Rows of one document are held until another document's row of their key
    comes, so no more is held than one document has.
    """

    def __init__(self, n_keys: int):
        self.n_keys = n_keys
        self.key: list | None = None  # of the last row given out
        self.head: int | None = None  # its first document, none if open

    def take(self, cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rows that are shared or open, their first documents, which of them are open, and rows to come again."""
        n, keys, doc = len(cols[0]), cols[: self.n_keys], cols[self.n_keys]
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        head, tail = doc[at].copy(), doc[at + size - 1]
        wait = np.zeros(len(at), bool)
        if self.key is None:
            wait[0] = True
        elif self.key == [c[0] for c in keys]:
            wait[0] = self.head is None
            head[0] = head[0] if wait[0] else self.head
        shared = head != tail
        if self.key is not None and self.head is not None and self.key == [c[0] for c in keys]:
            shared[0] = True
        single = not shared[-1] and not wait[-1]
        if single and last:
            wait[-1] = True
        kept = at[-1] if single and not last else n
        if kept:
            run = len(at) - 1 if kept == n else len(at) - 2
            self.key = [c[at[run]] for c in keys]
            self.head = None if wait[run] else int(head[run])
        keep = np.repeat(shared | wait, size) & (np.arange(n) < kept)
        same = np.zeros(n, bool)
        same[1:] = np.all([c[1:] == c[:-1] for c in cols], axis=0)
        keep &= ~same
        return [c[keep] for c in cols], np.repeat(head, size)[keep], np.repeat(wait, size)[keep], [c[kept:] for c in cols]


def neighbours(rows: DataFrame, keys: list[str], place: str, sort_rows: int = 1 << 15) -> DataFrame:
    """doc_id and place of the rows that have the keys of a row of another doc_id, and first_doc_id, the smallest doc_id with these keys.

    Rows are range-sorted by keys and doc_id (long) and place (int, 0 or more), and each range is read once, ``sort_rows`` at a
    time.  What is not known of a range's first and last key is brought together by an aggregate: two keys a range
    at most, which is the bound of the broadcast.  Rows that repeat another one wholly may be given once.
    """
    names = [*keys, "doc_id", place]

    def compared(batches: Iterator[pa.RecordBatch]):
        range_, held, count = _Range(len(keys)), [], 0

        def given(last: bool):
            nonlocal held, count
            out, first, open_, rest = range_.take([np.concatenate(c) for c in zip(*held)], last)
            held, count = [rest] if len(rest[0]) else [], 0
            return batch(out, first, open_)

        def batch(cols: list[np.ndarray], first: np.ndarray, open_: np.ndarray):
            # keys are only written where they are still needed
            arrays = [pa.array(c, pa.int64(), mask=~open_) for c in cols[:-2]]
            arrays += [pa.array(cols[-2], pa.int64()), pa.array(cols[-1], pa.int32()), pa.array(first, pa.int64(), mask=open_)]
            return pa.RecordBatch.from_arrays(arrays, [*names, "first_doc_id"])

        for b in batches:
            if b.num_rows:
                held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))])
                count += b.num_rows
            if count >= sort_rows:
                yield given(False)
        if held:
            yield given(True)
        if range_.head is not None:  # the next range's first rows may go on with this key
            yield batch([np.array([v]) for v in (*range_.key, range_.head, -1)], np.zeros(1, np.int64), np.ones(1, bool))

    schema = ", ".join(f"{c} long" for c in names[:-1]) + f", {place} int, first_doc_id long"
    found = T.stash(rows.select(*names).repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(compared, schema))
    heads = found.where("first_doc_id is null").groupBy(*keys).agg(F.min("doc_id").alias("_head"), F.max("doc_id").alias("_last"))
    both = found.where(F.col(place) >= 0).join(F.broadcast(heads.where("_head <> _last").drop("_last")), keys, "left")
    return both.select("doc_id", place, F.coalesce("first_doc_id", "_head").alias("first_doc_id")).where("first_doc_id is not null")


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, start, n_words, first_doc_id: the passages of at least ``min_words`` words that another document holds too.

    start counts words from 0; first_doc_id is the smallest doc_id that holds the passage's first window.
    """
    T.session(docs.sparkSession)
    span = (min_words - GRAM + 1) // 2 - 1
    text = T.text_frame(docs).where("doc_id is not null")

    def suffixes(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches):
            w = T.Words(b.column(1), lower=False)
            rows = [(i, *_spots(w.hash[w.first[i] : w.first[i] + n], span, min_words)) for i, n in enumerate(w.count) if n >= min_words]
            doc = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64)
            cat = lambda k, kind: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(cat(1, np.int64).astype(np.int32)), pa.array(cat(2, np.uint64).view(np.int64))], ["doc_id", "at", "right"])

    spots = T.stash(text.mapInArrow(suffixes, "doc_id long, at int, right long"))
    spots = T.stash(neighbours(spots, ["right"], "at").groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("at")))
    half = min_words // 2

    def extended(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches):
            w = T.Words(b.column(1), lower=False)
            ids, starts, heads, tails = [], [], [], []
            for i, at in enumerate(b.column(2).to_pylist()):
                h = w.hash[w.first[i] : w.first[i] + w.count[i]]
                n = max(len(h) - min_words + 1, 0)
                mark = np.zeros(n + 1, np.int64)
                a = np.array(at, np.int64)
                np.add.at(mark, np.minimum(np.maximum(a - span + 1, 0), n), 1)
                np.add.at(mark, np.minimum(a + 1, n), -1)
                s = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                ids.append(np.full(len(s), i))
                starts.append(s.astype(np.int32))
                heads.append(run_hashes(h, half)[s].view(np.int64))
                tails.append(run_hashes(h, min_words - half)[s + half].view(np.int64))
            cols = [b.column(0).take(pa.array(np.concatenate(ids).astype(np.int64))), *(pa.array(np.concatenate(c)) for c in (starts, heads, tails))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "head", "tail"])

    some = T.thin(text, spots, "doc_id").join(spots, "doc_id").select("doc_id", "text", "at")
    runs = T.stash(some.mapInArrow(extended, "doc_id long, start int, head long, tail long"))
    found = neighbours(runs, ["head", "tail"], "start")
    # windows that overlap or touch are one passage
    order = Window.partitionBy("doc_id").orderBy("start")
    step = F.col("start") - F.lag("start").over(order)
    islands = found.withColumn("new", F.when(step <= min_words, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    out = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + min_words).alias("n_words"), F.min_by("first_doc_id", "start").alias("first_doc_id"))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), "first_doc_id")
