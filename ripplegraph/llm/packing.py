"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

A document of more than ``limit`` tokens is cut into pieces of the limit, the first one shorter; whole pieces
fill a sequence each.  The others go by bands of length, longest first.  A round sorts the band's documents
and the open gaps by size and sweeps down over both: each document takes the smallest gap that still holds it
(``matched``: ranks, prefix sums over counts per size and one window per depth, all of it in Spark).  Gaps shrink, and
rounds repeat until the band is empty.  When a round has placed less than one in OPEN of its documents, the next one
also has as many new sequences to offer as the rest's tokens need, and when few are left, as many as hold them all; what
fits an older gap still takes that.

A large gap offers several places at once, as many as documents of the band surely fit.  The driver sees five numbers a
round.

Edge cases: a null text is empty and has the end id alone; rows that repeat a doc_id, or have none, are packed
as documents of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T
from ripplegraph.llm.encoding import encoder

#: Deals of a size class: one class may hold most rows.
DEALS = 32
#: New sequences are opened when a round has placed less than one in so many documents.
OPEN = 20
#: When less than one in so many of a band's documents are left, the next round has a place for each of them.
LEFT = 20
#: A band's documents are at most so many times as long as the next band's.
STEP = 4


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """item (any distinct numbers), doc_id, piece, start, length, ids_crc32 of each piece."""

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(tokenizer)
        item = TaskContext.get().partitionId() << 40
        for b in T.pieces(batches, holds=tokenizer):
            flat, at = encode(b.column(1), end_id)
            n = np.diff(at)
            many = -(-n // limit)  # pieces of each document; the first may be shorter
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = np.maximum(n[doc] - (many[doc] - piece) * limit, 0)
            length = n[doc] - (many[doc] - piece - 1) * limit - start
            ids = memoryview(flat.astype("<u4")).cast("B")
            crc = [zlib.crc32(ids[4 * i : 4 * (i + k)]) for i, k in zip((at[doc] + start).tolist(), length.tolist())]
            cols = [pa.array(np.arange(item, item + len(doc))), b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            item += len(doc)
            yield pa.RecordBatch.from_arrays(cols, ["item", "doc_id", "piece", "start", "length", "ids_crc32"])

    return T.text_frame(docs).mapInArrow(run, "item long, doc_id long, piece int, start long, length long, ids_crc32 long")


def matched(docs: DataFrame, gaps: DataFrame) -> DataFrame:
    """``docs`` (item, length) with the gap that each takes: sequence_id and slot, null where none is left.

    ``gaps`` has sequence_id, slot and size.  Sizes run from the largest down, gaps before documents; a document takes
    the last gap that no other has taken, which is the smallest that holds it.  Seen as brackets, a gap opens and a
    document closes, so the two belong together if they are neighbours at the same depth.  Depths are ranks within a
    cell (size, kind and a hash deal, so that no size is ranked in one task) moved on by the cells before it, and each
    depth has one gap and one document of a size at most.
    """
    deal = F.pmod(F.xxhash64("a", "b"), F.lit(DEALS)).cast("int").alias("deal")
    both = gaps.select(F.col("size").cast("long").alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("a"), F.col("slot").cast("long").alias("b"))
    both = both.union(docs.select("length", F.lit(1), "item", F.lit(0).cast("long"))).select("*", deal)
    cell = ["size", "kind", "deal"]
    sign = F.when(F.col("kind") == 0, F.lit(1)).otherwise(F.lit(-1))
    # at most 2 * limit * DEALS rows
    cells = both.groupBy(*cell).count().withColumn("depth", F.coalesce(F.sum(F.col("count") * sign).over(Window.orderBy(F.desc("size"), "kind", "deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("a", "b"))
    level = F.when(F.col("kind") == 0, F.col("depth") + F.col("rank")).otherwise(F.col("depth") - F.col("rank") + 1)
    rows = both.withColumn("rank", rank).join(F.broadcast(cells.select(*cell, "depth")), cell).select("size", "kind", "a", "b", level.alias("level"))
    last = F.lag(F.struct("kind", "a", "b")).over(Window.partitionBy("level").orderBy(F.desc("size"), "kind"))
    own = F.col("last.kind") == 0
    return rows.withColumn("last", last).where("kind = 1").select(F.col("a").alias("item"), F.col("size").alias("length"), F.when(own, F.col("last.a")).alias("sequence_id"), F.when(own, F.col("last.b")).alias("slot"))


def _bands(limit: int) -> list[int]:
    """The lower ends (exclusive) of the bands of length."""
    out, low = [], limit // STEP
    while low >= 2 * STEP:
        out.append(low)
        low //= STEP
    return [*out, 0]


def best_fit(items: DataFrame, limit: int) -> DataFrame:
    """item, sequence_id, offset for ``items`` (item, length from 1 to ``limit``)."""
    spark = items.sparkSession
    rest = T.stash(items.where(F.col("length") < limit).select("item", "length"))
    gaps = T.stash(spark.createDataFrame([], "sequence_id long, gap long"))
    placed, opened, turn = [], -1, 0
    whole = items.where(F.col("length") == limit).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bands = _bands(limit)
    for low in bands:
        band, rest = rest.where(F.col("length") > low), rest.where(F.col("length") <= low)
        all_ = before = None  # documents of the band, and before the last round, if it opened none
        while True:
            zero = F.lit(0).cast("long")
            size = band.agg(F.count("*").alias("n"), F.sum("length").alias("volume"), F.min("length").alias("least"), F.max("length").alias("most"), F.count_if(2 * F.col("length") > limit).alias("large"))
            at, held = size.union(gaps.where(F.col("gap") > low).agg(F.count("*"), zero, zero, zero, zero)).collect()
            held = held.n
            all_ = all_ or at.n
            if not at.n:
                break
            usable = gaps.where(F.col("gap") >= at.least)
            fresh, many = 0, max(1, -(-2 * at.n // max(1, held)))
            if LEFT * at.n < all_:
                many = max(many, limit // at.most)
                fresh = -(-at.n // (limit // at.most))
            elif OPEN * held < at.n or (before is not None and OPEN * (before - at.n) < before):
                fresh = max(-(-at.volume // limit), at.large)
                many = max(1, -(-2 * at.n // (held + fresh)))
            if fresh:
                new = spark.range(fresh).select((F.lit(opened) - F.col("id")).alias("sequence_id"), F.lit(limit).cast("long").alias("gap"))
                usable, gaps = usable.union(new), gaps.union(new)
                opened -= fresh
            before = None if fresh else at.n
            # all places of a gap but the last have the longest document's length
            slots = F.least(F.greatest(F.floor(F.col("gap") / at.most), F.lit(1)), F.lit(many))
            offers = usable.withColumn("slots", slots).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("slots"))))
            size = F.when(F.col("slot") < F.col("slots"), F.lit(at.most)).otherwise(F.col("gap") - F.lit(at.most) * (F.col("slots") - 1))
            met = T.stash(matched(band, offers.select("sequence_id", "slot", size.alias("size"))))
            taken = met.where("sequence_id is not null")
            placed.append(taken.select("item", "length", "sequence_id", F.lit(turn).alias("turn"), "slot"))
            used = taken.groupBy("sequence_id").agg(F.sum("length").alias("used"))
            gaps = T.stash(gaps.join(used, "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"))
            band, turn = met.where("sequence_id is null").select("item", "length"), turn + 1
    if not placed:
        return whole
    rows = placed[0]
    for p in placed[1:]:
        rows = rows.union(p)
    until = Window.partitionBy("sequence_id").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)  # at most ``limit`` rows
    return rows.select("item", "sequence_id", F.coalesce(F.sum("length").over(until), F.lit(0)).alias("offset")).union(whole)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    T.session(docs.sparkSession)
    items = T.stash(pieces(docs, tokenizer, end_id, limit))
    return items.join(best_fit(items.select("item", "length"), limit), "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
