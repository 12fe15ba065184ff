"""Source divergence audit: which sources of a language use words unlike each other, and which words set one apart.

Every share is an integer, p = 1 + floor(10^9 (count + 1) / (N + V)), and so is every divergence
f = floor((p - q)^2 / q); nothing depends on the order of sums.  Terms are never compared one by one:

* within a group (lang, source) they fall into cells of one (group count, lang count); f is evaluated once a cell, cells of one value are
  merged and ranked by cumulative multiplicity, and only the cells that reach the wanted ranks are expanded to terms;
* for pairs of sources, terms of one whole vector of counts fall together first, then into cells of one (count, count).
  Terms that one of the two lacks come from the group's own cells, those that both lack from their number, so no cell
  is made for an absent term.

Edge cases: null text, lang and source are empty strings; a document is a row, whatever its doc_id; groups without kept terms
still have their pairs (value 0 where the language keeps none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Bytes of text whose terms are counted together before Spark sees them.
PIECE_BYTES = 8 << 20
#: Chosen cells up to this number are broadcast; more are joined with a shuffle.
BROADCAST_CELLS = 1 << 17
UNIT = 1_000_000_000
_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that stand one after the other, lower-cased, and the text of each."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _TERM[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    joints = off[1:-1]
    joints = np.unique(joints[(joints > 0) & (joints < len(data))])
    joints = joints[(inside[joints] == 1) & (inside[joints + 1] == 1)]  # a term never runs on into the next text
    start, end = np.sort(np.concatenate([start, joints])), np.sort(np.concatenate([end, joints]))
    cuts = np.append(np.stack([start, end], 1).ravel(), len(data))
    both = pa.LargeStringArray.from_buffers(2 * len(start), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(T._LOWER[data] if len(data) else data))
    return both.take(pa.array(np.arange(0, 2 * len(start), 2))), np.searchsorted(off, start, side="right") - 1


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n (occurrences) and docs (texts with it) of a batch of text, lang and source."""
    data, off = T.arrow_bytes(batch.column(0))
    words, doc = _terms(data, off)
    coded = words.dictionary_encode()
    code, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lang, source = (batch.column(i).dictionary_encode() for i in (1, 2))
    group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    groups, group = np.unique(group, return_inverse=True)
    wide = max(1, len(vocabulary))
    pairs, n = np.unique(doc * wide + code, return_counts=True)  # text and term
    cells, at = np.unique(group[pairs // wide] * wide + pairs % wide, return_inverse=True)
    of = groups[cells // wide]
    take = lambda d, i: d.take(pa.array(i)).cast(pa.string())
    wide_s = max(1, len(source.dictionary))
    counts = [np.bincount(at, w, len(cells)).astype(np.int64) for w in (n, None)]
    return pa.RecordBatch.from_arrays([take(lang.dictionary, of // wide_s), take(source.dictionary, of % wide_s), take(vocabulary, cells % wide), *map(pa.array, counts)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: occurrences of each term in each group, and rows that hold it."""
    T.session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches, size=PIECE_BYTES):
            yield _count(b)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("text"), text("lang"), text("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """p of a count in a group of ``total`` occurrences of V terms; in decimals, as 10^9 times the counts of a large corpus leave 64 bits."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", (wide(count) + F.lit(1)) * F.lit(UNIT), wide(total) + wide("V"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact in 64 bits: both are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _total(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,0)"))


def _ranked(df: DataFrame, by: Column, tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(by.desc(), F.col(tie))))


def _term_part(rows: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the ``top`` terms of each group by divergence from its language."""
    known = groups.select("lang", "source", "size", "V", "lang_n")
    valued = cells.join(known, ["lang", "source"]).withColumn("p", _share("n", "size")).withColumn("q", _share("total", "lang_n")).where("p > q")
    valued = T.stash(valued.select("lang", "source", "n", "total", "m", divergence(F.col("p"), F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    reached = merged.withColumn("before", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < top)
    chosen = T.stash(valued.join(reached.select("lang", "source", "value"), ["lang", "source", "value"], "left_semi").select("lang", "source", "n", "total", "value"))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_CELLS else chosen
    found = rows.join(chosen, ["lang", "source", "n", "total"]).select("lang", "source", F.col("term").alias("item"), "value")
    return _ranked(found, F.col("value"), "item").where(F.col("rank") <= top)


def _pair_part(vectors: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language by divergence over all kept terms."""
    f = divergence
    # cells of two counts, from the distinct vectors of counts
    whole = vectors.where(F.size("v") > 1).groupBy("lang", "v").agg(F.count("*").alias("m"))
    first = whole.select("lang", "m", "v", F.posexplode("v").alias("i", "a")).select("lang", "m", "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    joint = first.groupBy("lang", F.col("a.source").alias("sa"), F.col("b.source").alias("sb"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.sum("m").alias("m"))
    side = lambda x: groups.select("lang", F.col("source").alias(f"s{x}"), F.col("size").alias(f"total{x}"), F.col("z").alias(f"z{x}"))
    joint = joint.join(side("a"), ["lang", "sa"]).join(side("b").join(groups.select("lang", "V").distinct(), "lang"), ["lang", "sb"])
    joint = joint.withColumn("pa", _share("na", "totala")).withColumn("pb", _share("nb", "totalb"))
    pa_, pb, za, zb = map(F.col, ("pa", "pb", "za", "zb"))
    gain = lambda p, q, y, z: F.col("m") * (f(p, q) - f(p, z) - f(y, q) + f(y, z))
    ways = F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item"), gain(pa_, pb, za, zb).alias("g")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item"), gain(pb, pa_, zb, za).alias("g")))
    both = joint.select("lang", F.explode(ways).alias("w")).groupBy("lang", "w.source", "w.item").agg(_total(F.col("w.g")).alias("both"))
    # a group's own cells against the share of an absent term, of which a language has as many as its groups differ in size
    own = cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")).join(groups.select("lang", "source", "size", "V"), ["lang", "source"]).withColumn("p", _share("n", "size"))
    own = own.join(groups.select("lang", "z").distinct(), "lang").groupBy("lang", "source", "z").agg(_total(F.col("m") * f(F.col("p"), F.col("z"))).alias("up"), _total(F.col("m") * f(F.col("z"), F.col("p"))).alias("down"))
    one = groups.select("lang", "source", F.col("z").alias("za"), F.col("kinds").alias("ka"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zb"), F.col("kinds").alias("kb"), "V")
    pairs = one.join(two, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.join(own.select("lang", "source", F.col("z").alias("zb"), "up"), ["lang", "source", "zb"], "left").join(own.select("lang", F.col("source").alias("item"), F.col("z").alias("za"), "down"), ["lang", "item", "za"], "left")
    none = F.lit(0).cast("decimal(38,0)")
    value = F.coalesce("both", none) + F.coalesce("up", none) + F.coalesce("down", none) + (F.col("V") - F.col("ka") - F.col("kb")).cast("decimal(20,0)") * f(F.col("za"), F.col("zb")).cast("decimal(20,0)")
    return _ranked(pairs.select("lang", "source", "item", F.when(F.col("V") > 0, value.cast("long")).otherwise(0).alias("value")), F.col("value"), "item")


def source_audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank (from 1 per group and part).

    A language keeps the terms in at least ``min_docs`` of its rows.  Part pair has every other source of the language, part
    term the ``top`` terms that a group has more of than its language.
    """
    vectors = term_counts(docs).groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("v"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    vectors = T.stash(vectors.where(F.col("docs") >= min_docs).drop("docs"))
    rows = vectors.select("lang", "term", "total", F.explode("v").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    cells = T.stash(rows.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("m")))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    langs = vectors.groupBy("lang").agg(F.count("*").alias("V"), F.sum("total").alias("lang_n"))
    sizes = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("size"), F.sum("m").alias("kinds"))
    groups = docs.select(name("lang"), name("source")).distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0)
    groups = T.stash(groups.withColumn("none", F.lit(0)).withColumn("z", F.when(F.col("V") > 0, _share("none", "size")).otherwise(1)).drop("none"))
    part = lambda df, what: df.select("lang", "source", F.lit(what).alias("part"), "item", "value", "rank")
    return part(_pair_part(vectors, cells, groups), "pair").unionByName(part(_term_part(rows, cells, groups, top), "term"))
