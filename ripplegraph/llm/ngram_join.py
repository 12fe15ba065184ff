"""N-gram Jaccard join with a token-group matrix.

Texts become sets of hashed word shingles.  Equal sets collapse into one class.  Classes are dealt into
groups of similar sets (same minimum hash, same length band, bounded size), and the matrix stores for each
group the union of its members' signature tokens.  A set links only with sets that share of its first
``n - ceil(t*n) + h`` tokens in a fixed order at h places or more, so only group pairs that meet as often in
the matrix can hold a link.
Each such pair is opened in a task: the overlap of a set with the other group's whole token union bounds its
overlap with every member, sets below the bound are dropped, and the rest is compared exactly with a matrix
product.  A task returns a spanning forest and link counts, never pairs, and distributed connected
components finish the classes.

The order puts tokens that many texts share last; it is looked up in a bitmap of fixed size, and any bitmap
gives right results.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer than
k words are one shingle; a row with a null doc_id takes no part in links and has a null component; rows that
repeat a doc_id are one document for reachability; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Sets of a group.
GROUP_ROWS = 256
#: A token in more sets than this comes late in the order.
COMMON = 32
#: Signature tokens that a linking pair shares at least: each of the first n - ceil(t*n) + HITS has as many in common.
HITS = 4
#: Cells of the bitmap of such tokens: 128 KB, whatever the input.
CELLS = 1 << 20


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n tokens can link with."""
    return -(-percent * n // 100)


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for b in T.pieces(batches):
        words = T.Words(b.column(b.schema.get_field_index("text")))
        first, tokens = T.shingle_sets(words, k)
        yield b, first, tokens


def _marks(first: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of each set: its 128-bit signature, minimum under another hash, and length band."""
    n = np.diff(first)
    sign = np.zeros((len(n), 2), np.uint64)
    least = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        sign[full, 0] = np.add.reduceat(T.mix64(tokens + np.uint64(11)), first[full])
        sign[full, 1] = np.bitwise_xor.reduceat(T.mix64(tokens * np.uint64(0x9E3779B97F4A7C15)), first[full])
        least[full] = np.minimum.reduceat(T.mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)), first[full])
    band = np.floor(np.log(np.maximum(n, 1)) / math.log(100 / percent)).astype(np.int32)
    return pa.array([sign[i].tobytes() if n[i] else None for i in range(len(n))], pa.binary()), least.view(np.int64), band


def _low(first: np.ndarray, tokens: np.ndarray, take: np.ndarray, late: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The first ``take`` tokens of each set in the order (late, token)."""
    doc = np.repeat(np.arange(len(take)), np.diff(first))
    if late is not None:
        cell = (tokens % np.uint64(CELLS)).astype(np.int64)
        order = np.lexsort((tokens, np.unpackbits(late)[cell], doc))
        tokens = tokens[order]
    rank = np.arange(len(tokens)) - first[doc]
    keep = rank < take[doc]
    return np.concatenate([[0], np.cumsum(np.minimum(take, np.diff(first)))]), tokens[keep]


def signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, sig, least, band of each text."""

    def run(batches):
        for b, first, tokens in _sets(batches, k):
            sig, least, band = _marks(first, tokens, percent)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), sig, pa.array(least), pa.array(band)], ["doc_id", "n", "sig", "least", "band"])

    return T.text_frame(docs).mapInArrow(run, "doc_id long, n long, sig binary, least long, band int")


def common_tokens(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """The bitmap of tokens that over COMMON texts have among their lowest."""

    def run(batches):
        for _, first, tokens in _sets(batches, k):
            n = np.diff(first)
            _, low = _low(first, tokens, 2 * (n - _need(n, percent)) + 2, None)
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64))], ["token"])

    often = T.text_frame(docs).mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") > COMMON)
    # unsigned remainder of a power of two, so the low bits
    cells = often.select(F.col("token").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")).distinct().toPandas()["cell"].to_numpy()
    flags = np.zeros(CELLS, bool)
    flags[cells] = True
    return np.packbits(flags)


def prefixes(docs: DataFrame, k: int, percent: int, late: np.ndarray) -> DataFrame:
    """sig, n, least, band and the tokens by which each set can be found."""

    def run(batches):
        for _, first, tokens in _sets(batches, k):
            sig, least, band = _marks(first, tokens, percent)
            n = np.diff(first)
            at, low = _low(first, tokens, np.where(n > 0, n - _need(n, percent) + HITS, 0), late)
            yield pa.RecordBatch.from_arrays([sig, pa.array(n), pa.array(least), pa.array(band), T.list_column(low.view(np.int64), at)], ["sig", "n", "least", "band", "tokens"])

    return T.text_frame(docs.where("doc_id is not null")).mapInArrow(run, "sig binary, n long, least long, band int, tokens array<long>").where("sig is not null")


def _grouped(df: DataFrame, large: DataFrame) -> DataFrame:
    """Adds grp: similar sets, over GROUP_ROWS of them dealt by a hash."""
    deals = F.coalesce(F.col("deals"), F.lit(1))
    return df.join(large, ["least", "band"], "left").withColumn("grp", F.xxhash64("least", "band", F.pmod(F.xxhash64("sig"), deals))).drop("deals")


def compare(a: list[tuple], b: list[tuple] | None, percent: int) -> list[tuple[int, int, int]]:
    """Links between two groups, or within one: (member, head of its forest, links it has). Members are (id, copies, tokens)."""
    inner = b is None
    b = a if inner else b

    def within(side, other):
        union = np.unique(np.concatenate([m[2] for m in other]))
        out = []
        for m in side:
            at = np.minimum(np.searchsorted(union, m[2]), len(union) - 1)
            bound = np.count_nonzero(union[at] == m[2])
            if 100 * bound >= percent * len(m[2]):
                out.append(m)
        return out

    if not inner:
        a = within(a, b)
        b = within(b, a) if a else []
    if not a or not b:
        return []
    na, nb = np.array([len(m[2]) for m in a]), np.array([len(m[2]) for m in b])
    ta, tb = np.concatenate([m[2] for m in a]), np.concatenate([m[2] for m in b])
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    both, seen = np.unique(ta, return_counts=True)
    both = both[seen > 1] if inner else both[np.isin(both, tb)]
    inter = np.zeros((len(a), len(b)), np.float32)
    if len(both):
        ca, cb = (np.minimum(np.searchsorted(both, t), len(both) - 1) for t in (ta, tb))
        ka, kb = both[ca] == ta, both[cb] == tb
        ca, ra, cb, rb = ca[ka], ra[ka], cb[kb], rb[kb]
        for lo in range(0, len(both), 4096):
            width = min(4096, len(both) - lo)
            x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
            s = (ca >= lo) & (ca < lo + width)
            x[ra[s], ca[s] - lo] = 1
            s = (cb >= lo) & (cb < lo + width)
            y[rb[s], cb[s] - lo] = 1
            inter += x @ y.T
    inter = np.rint(inter).astype(np.int64)
    link = 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)
    if inner:
        np.fill_diagonal(link, False)
    wa, wb = np.array([m[1] for m in a]), np.array([m[1] for m in b])
    most = len(a) + len(b)
    la, lb = np.arange(len(a)), np.arange(len(b)) if inner else np.arange(len(b)) + len(a)
    while True:
        ma = np.minimum(la, np.where(link, lb[None, :], most).min(1))
        mb = ma if inner else np.minimum(lb, np.where(link, ma[:, None], most).min(0))
        if (ma == la).all() and (mb == lb).all():
            break
        la, lb = ma, mb
    ids = [m[0] for m in a] + ([] if inner else [m[0] for m in b])
    out = [(a[i][0], ids[la[i]], int(n)) for i, n in enumerate(link @ wb) if n]
    if not inner:
        out += [(b[j][0], ids[lb[j]], int(n)) for j, n in enumerate(wa @ link) if n]
    return out


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of ``docs`` (columns doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their k-word shingle sets.
    component_id is the smallest doc_id reachable by links; n_links counts the linked rows.
    """
    spark = T.session(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marks = T.stash(signed(docs, k, percent))
    classes = marks.where("sig is not null and doc_id is not null").groupBy("sig", "n", "least", "band").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    large = T.stash(classes.groupBy("least", "band").count().where(F.col("count") > GROUP_ROWS).select("least", "band", F.ceil(F.col("count") / GROUP_ROWS).alias("deals")))
    late = common_tokens(docs, k, percent)

    rows = _grouped(prefixes(docs, k, percent, late).dropDuplicates(["sig"]), large).select("grp", F.col("n").cast("int").alias("n"), F.explode("tokens").alias("token"))
    # only tokens of two sets at least can open anything
    shared = T.stash(rows.withColumn("sets", F.count("*").over(Window.partitionBy("token"))).where("sets > 1").drop("sets"))
    matrix = T.stash(shared.groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), (F.count("*") > 1).alias("many")))
    a, b = (matrix.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("grp", "lo", "hi", "many"))) for s in "ab")
    meet = a.join(b, "token").where(f"(grp_a < grp_b and 100 * hi_a >= {percent} * lo_b and 100 * hi_b >= {percent} * lo_a) or (grp_a = grp_b and many_a)")
    # sets of fewer than HITS needed tokens share all that they need
    least = F.least(F.lit(HITS), F.ceil(F.lit(percent) * F.least(F.min("lo_a"), F.min("lo_b")) / 100))
    pairs = T.stash(meet.groupBy("grp_a", "grp_b").agg(F.count("*").alias("hits"), least.alias("least")).where("hits >= least").select("grp_a", "grp_b"))

    opened = pairs.select(F.explode(F.array("grp_a", "grp_b")).alias("grp")).distinct()
    members = T.stash(_grouped(classes, large).join(opened, "grp", "left_semi").select("rep", "sig", "copies", "grp", "n"))
    # the smaller group of a pair goes to the larger one
    weight = members.groupBy("grp").agg(F.sum("n").alias("weight"))
    pairs = pairs.join(weight.select(F.col("grp").alias("grp_a"), F.col("weight").alias("wa")), "grp_a").join(weight.select(F.col("grp").alias("grp_b"), F.col("weight").alias("wb")), "grp_b")
    swap = F.col("wa") > F.col("wb")
    pairs = T.stash(pairs.select(F.when(swap, F.col("grp_b")).otherwise(F.col("grp_a")).alias("grp_a"), F.when(swap, F.col("grp_a")).otherwise(F.col("grp_b")).alias("grp_b")))
    members = members.drop("n")
    groups = T.stash(_packed(docs, members, k))
    side = lambda s: groups.select(F.col("grp").alias(f"grp_{s}"), F.col("members").alias(f"members_{s}"))
    work = pairs.join(side("a"), "grp_a").join(side("b"), "grp_b")

    def run(frames):
        unpack = lambda ms: [(i, c, np.frombuffer(t, np.uint64)) for i, c, t in {(m["rep"], m["copies"], m["tokens"]) for m in ms}]
        for batch in frames:
            for r in batch.to_pylist():
                a = unpack(r["members_a"])
                found = compare(a, None if r["grp_a"] == r["grp_b"] else unpack(r["members_b"]), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["id", "head", "links"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    links = T.stash(work.mapInArrow(run, "id long, head long, links long"))
    T.session(spark)
    joined = T.components(links.select(F.col("id").alias("src"), F.col("head").alias("dst")))
    found = classes.select("sig", "rep", "copies").join(joined.withColumnRenamed("id", "rep"), "rep", "left").join(links.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left")
    found = found.select("sig", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = F.col("sig").isNotNull() & F.col("doc_id").isNotNull()
    return marks.join(found, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(known, F.col("links")).otherwise(F.lit(0)).alias("n_links"))


def _packed(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The members of each opened group with their whole token sets, computed again from the text."""

    def run(batches):
        for b, first, tokens in _sets(batches, k):
            sig, _, _ = _marks(first, tokens, 50)
            blobs = [tokens[first[i] : first[i + 1]].tobytes() for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("doc_id", "grp", "copies", "sig")] + [sig, pa.array(blobs, pa.binary())], ["rep", "grp", "copies", "want", "sig", "tokens"])

    rows = T.thin(T.text_frame(docs), members.withColumnRenamed("rep", "doc_id"), "doc_id").join(members.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "grp", "copies", "sig")
    # rows that repeat a doc_id may have other texts; those with the same text are told apart when a group is opened
    sets = rows.mapInArrow(run, "rep long, grp long, copies long, want binary, sig binary, tokens binary").where("want = sig")
    return sets.groupBy("grp").agg(F.collect_list(F.struct("rep", "copies", "tokens")).alias("members"))
