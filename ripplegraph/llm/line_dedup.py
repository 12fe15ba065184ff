"""Near-duplicate lines by a segment-partition edit join.

A line that allows e edits is cut into ``e + 1`` segments.  Two lines within that edit distance share one segment of the
earlier-or-shorter line at a nearby place in the other, so each line is indexed under (length, segment number,
segment) and probes the substrings of itself that can match a segment of a line as long as itself or up to
``distance`` shorter.  Lines that meet are verified with a banded bit-parallel edit distance.

Rule: lines are ordered by (doc_id, hash of the text, line number).  A line is dropped if an equal line stands earlier, or one
within the edits that both their lengths allow: one for each ``per_edit`` characters of the shorter line, ``distance`` at most.  So
a line of any length is judged, and short ones have to be equal ("yes" and "no" are two edits apart).  Lines without a letter or
a digit (blank ones, rulers, brackets) say nothing and stay.

A first pass over the texts finds the keys under which two different lines stand, with one pre-aggregated row per key.
A second one takes the lines that hold such a key, once each.  Of those, each line is first held against the earliest
line of the key, which settles nearly all lines of a large family; what is left meets every earlier line of the key
block by block (blocks of bounded size, dealt by a hash), where character counts pick the pairs that are verified.

Edge cases: null or empty texts have one empty line and stay; null doc_ids come after all others; rows that
share a doc_id, or have none, are documents of their own if their texts differ, and one document if they are
equal; an empty table gives an empty result; other columns are carried along unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ripplegraph.llm import textkit as T

#: Stands for a null doc_id.
LAST = (1 << 63) - 1
#: Lines of a block.
BLOCK = 512
#: Characters for which the edit distance looks up places at once.
_CHUNK = 512
_BASE = 0x9E3779B97F4A7C15
#: A letter or a digit.
_SAYS = re.compile(r"[^\W_]")
_PLAIN = np.zeros(129, np.int64)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = 1


def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """Start and size of each of distance + 1 near-equal segments; the longer ones come last."""
    parts = distance + 1
    size, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - more)
        out.append((at, n))
        at += n
    return out


def allowed(length: np.ndarray, distance: int, per_edit: int) -> np.ndarray:
    """The edits that lines of these lengths allow."""
    return np.minimum(length // per_edit, distance)


def probes(length: int, distance: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, size) of the substrings that a line of this length looks up.

    For a line d characters shorter, segment i of its start p can only match at p - l .. p + r, where the
    edits left of it and right of it together stay within the distance (the multi-match-aware bounds).
    """
    out = []
    for shorter in range(min(distance, length - distance - 1) + 1):
        for i, (at, size) in enumerate(segments(length - shorter, distance)):
            low = max(0, at - i, at + shorter - (distance - i))
            high = min(length - size, at + i, at + shorter + (distance - i))
            out += [(length - shorter, i, p, size) for p in range(low, high + 1)]
    return out


def within(a: str, b: str, distance: int) -> bool:
    """Whether the edit distance of two strings is at most ``distance``.

    Common ends are cut off; the rest runs bit-parallel down a band of 2 * distance + 1 diagonals: a step for a
    character works on all diagonals at once, in one number per edit.
    """
    if abs(len(a) - len(b)) > distance:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    i = 0
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    if i:
        a, b = a[:-i], b[:-i]
    if not a or not b:
        return len(a) + len(b) <= distance
    # reach[e]: bit k set if, after the rows so far, diagonal k - distance can be reached with e edits
    width = 2 * distance + 1
    full = (1 << width) - 1
    # insertions before the first row
    reach = [sum(1 << k for k in range(distance, min(width, distance + e + 1))) for e in range(distance + 1)]
    for base in range(0, len(a), _CHUNK):
        # where each character stands in the part of b that the band crosses, from position base - distance on
        at: dict[str, int] = {}
        for j in range(max(0, base - distance), min(len(b), base + _CHUNK + distance)):
            at[b[j]] = at.get(b[j], 0) | 1 << (j - base + distance)
        for row, c in enumerate(a[base : base + _CHUNK]):
            same = at.get(c, 0) >> row & full
            old, reach = reach, []
            for e in range(distance + 1):
                now = old[e] & same
                if e:
                    now |= old[e - 1] | (old[e - 1] >> 1) | (reach[e - 1] << 1)
                reach.append(now & full)
            if not any(reach):
                return False
    k = len(b) - len(a) + distance
    return any(r >> k & 1 for r in reach)


def _counts(line: str) -> bytes:
    """How often each of 32 classes of characters occurs, as 16-bit numbers; an edit changes at most two counts by one."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes & 31, minlength=32).astype(np.uint16).tobytes()


def _close(mine: list[dict], others: list[dict], distance: int) -> list[tuple[bytes, bytes]]:
    """(id, other) where other is earlier, one of them is indexed under the key, and the letter counts allow the distance."""
    x, y = (np.frombuffer(b"".join(m["counts"] for m in side), np.uint16).reshape(-1, 32).astype(np.int32) for side in (mine, others))
    at = [(m["d"], m["h"], m["n"]) for m in others]
    out = []
    for m, c in zip(mine, x):
        for j in np.flatnonzero(np.abs(y - c).sum(1) <= 2 * distance):
            if at[j] < (m["d"], m["h"], m["n"]) and (m["role"] == 3 or others[j]["role"] == 3):
                out.append((m["id"], others[j]["id"]))
    return out


class Lines:
    """The lines with a letter or digit of a batch of texts: text, line number, place, length and id of each.

    With ``least`` only those of at least so many characters.
    """

    def __init__(self, texts: list[str], least: int = 1):
        joined = "\n".join(texts)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        many = np.array([t.count("\n") + 1 for t in texts], np.int64)
        doc = np.repeat(np.arange(len(texts)), many)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        ends = np.append(np.flatnonzero(self.codes == 10), len(self.codes))
        starts = np.concatenate([[0], ends[:-1] + 1])
        keep = np.flatnonzero(ends - starts >= least)
        all_ = joined.split("\n")
        # most lines have an ASCII letter or digit; others are looked at one by one
        upto = np.concatenate([[0], np.cumsum(_PLAIN[np.minimum(self.codes, 128)])])
        says = upto[ends[keep]] > upto[starts[keep]]
        rare = np.flatnonzero(~says)
        says[rare] = [_SAYS.search(all_[i]) is not None for i in keep[rare]]
        keep = keep[says]
        self.text = [all_[i] for i in keep]
        self.doc, self.number, self.start, self.length = doc[keep], number[keep], starts[keep], (ends - starts)[keep]
        self.id = b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in self.text)

    def ids(self, at: np.ndarray | slice = slice(None)) -> pa.Array:
        flat = np.frombuffer(self.id, np.uint8).reshape(-1, 16)[at]
        return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, 16 * len(flat) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])

    def short(self) -> np.ndarray:
        """The first half of each id."""
        return np.frombuffer(self.id, "<i8")[::2]

    def once(self) -> np.ndarray:
        """One line of each id."""
        return np.sort(np.unique(self.short(), return_index=True)[1])

    def keys(self, at: np.ndarray, distance: int, per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines at ``at``: place in it, key, and whether the line is indexed under it, for all of its probes.

        What two lines allow is what the shorter one allows, which is the one that is looked up.
        """
        n = len(self.codes)
        with np.errstate(over="ignore"):
            up, down = np.full((2, n + 1), 1, np.uint64)
            up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(T.mix64(self.codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        start, length = self.start[at], self.length[at]
        out = []
        for shorter in range(distance + 1):
            own = length - shorter  # the length of the lines that are looked up
            for edits in range(max(1, shorter), distance + 1):  # without an edit, equal lines are found as such
                some = np.flatnonzero(allowed(own, distance, per_edit) == edits)
                out += [(some[ok], h, own_key) for ok, h, own_key in self._segment_keys(total, down, start[some], length[some], shorter, edits)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(c) for c in zip(*out))

    def _segment_keys(self, total: np.ndarray, down: np.ndarray, start: np.ndarray, length: np.ndarray, shorter: int, edits: int) -> Iterator[tuple]:
        """The probes of lines for lines that are ``shorter`` and allow ``edits``, in the bounds of ``probes``."""
        own, parts = length - shorter, edits + 1
        size, more = own // parts, own % parts
        for i in range(parts):
            place, n_chars = i * size + np.maximum(0, i - (parts - more)), size + (i >= parts - more)
            low = np.maximum(np.maximum(0, place - i), place + shorter - (edits - i))
            high = np.minimum(np.minimum(length - n_chars, place + i), place + shorter + (edits - i))
            for step in range(2 * edits + 1):
                p = low + step
                ok = np.flatnonzero((p <= high) & (own >= parts))
                if not len(ok):
                    break
                a = start[ok] + p[ok]
                with np.errstate(over="ignore"):
                    h = (total[a + n_chars[ok]] - total[a]) * down[a] + T.mix64((own[ok] * parts + i).astype(np.uint64))
                yield ok, T.mix64(h).view(np.int64), (p[ok] == place[ok]) & (shorter == 0)


def _held(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for b in T.pieces(batches):
        yield b, Lines(b.column(1).to_pylist(), least)


def drops(docs: DataFrame, distance: int = 2, per_edit: int = 10) -> DataFrame:
    """Lines to drop: doc_id (null as LAST) and line_no from 0; ``row_drops`` tells rows of one doc_id apart."""
    return row_drops(docs, distance, per_edit).select("doc_id", "line_no")


def row_drops(docs: DataFrame, distance: int = 2, per_edit: int = 10) -> DataFrame:
    """Lines to drop: doc_id (null as LAST), text_hash of the whole text, and line_no from 0."""
    spark = T.session(docs.sparkSession)
    if per_edit < 2:
        raise ValueError("a line has to have two characters at least for each edit")
    text = T.text_frame(docs, T.text_hash().alias("h"))

    def occurrences(batches):
        for b, lines in _held(batches):
            doc = pa.array(lines.doc)
            yield pa.RecordBatch.from_arrays([lines.ids(), b.column(0).fill_null(LAST).take(doc), b.column(2).take(doc), pa.array(lines.number.astype(np.int32))], ["id", "d", "h", "n"])

    def keyed(batches):
        for _, lines in _held(batches, per_edit):
            at = lines.once()
            place, key, own = lines.keys(at, distance, per_edit)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lines.short()[at][place]), pa.array(own)], ["key", "id", "own"])

    lines = T.stash(text.mapInArrow(occurrences, "id binary, d long, h long, n int"))
    first = lines.groupBy("id").agg(F.min(F.struct("d", "h", "n")).alias("first"), F.count("*").alias("times"))
    met = text.mapInArrow(keyed, "key long, id long, own boolean").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.bool_or("own").alias("own"))
    met = T.stash(met.where("own and a <> z").select("key"))
    sieve = spark.sparkContext.broadcast(T.bitmap(met, "key"))

    def takes(batches):
        """A line, its letter counts, and those of its keys that the sieve lets through."""
        for _, lines in _held(batches, per_edit):
            at = lines.once()
            place, key, own = lines.keys(at, distance, per_edit)
            hit = np.flatnonzero(T.in_bitmap(sieve.value, key))
            hit = hit[np.argsort(place[hit], kind="stable")]
            line, many = np.unique(place[hit], return_counts=True)
            cut = np.concatenate([[0], np.cumsum(many)])
            some = at[line]
            texts = [lines.text[i] for i in some]
            yield pa.RecordBatch.from_arrays([lines.ids(some), pa.array(texts, pa.string()), pa.array([_counts(x) for x in texts], pa.binary()), T.list_column(key[hit], cut), T.list_column(own[hit], cut)], ["id", "line", "counts", "keys", "own"])

    known = text.mapInArrow(takes, "id binary, line string, counts binary, keys array<long>, own array<boolean>").dropDuplicates(["id"])
    known = T.stash(known.join(first, "id"))
    posting = known.select("id", "first", "counts", F.explode(F.arrays_zip("keys", "own")).alias("k")).select("id", "first", "counts", F.col("k.keys").alias("key"), F.when(F.col("k.own"), 3).otherwise(1).alias("role"))
    # 1: looks up, 3: looks up and is found
    posting = posting.join(met, "key", "left_semi").groupBy("key", "id").agg(F.max("role").alias("role"), F.first("first").alias("first"), F.first("counts").alias("counts"))
    posting = T.stash(posting)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (id, other), the ids that are within the distance of an other."""
        a = known.select("id", F.col("line").alias("a"))
        b = known.select(F.col("id").alias("other"), F.col("line").alias("b"))

        def run(batches):
            for x in batches:
                ids, left, right = (x.column(x.schema.get_field_index(c)).to_pylist() for c in ("id", "a", "b"))
                yield pa.RecordBatch.from_arrays([pa.array(list({i for i, p, q in zip(ids, left, right) if within(p, q, min(distance, min(len(p), len(q)) // per_edit))}), pa.binary())], ["id"])

        return pairs.join(a, "id").join(b, "other").select("id", "a", "b").mapInArrow(run, "id binary").distinct()

    # 1: every line against the earliest line of the key
    heads = posting.groupBy("key").agg(F.min(F.struct("first", F.col("id").alias("other"))).alias("h"), F.count("*").alias("m")).select("key", F.col("h.first").alias("since"), "h.other", "m")
    heads = T.stash(heads.where("m > 1"))
    near = posting.join(heads, "key").where("first > since").select("id", "other").distinct()
    settled = T.stash(verified(near))

    # 2: what is left, against every line of the key, block by block on letter counts
    def dealt(df, name):
        deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK))
        return df.groupBy("key", deal.alias("deal")).agg(F.collect_list(F.struct("id", F.col("first.d").alias("d"), F.col("first.h").alias("h"), F.col("first.n").alias("n"), "role", "counts")).alias(name)).drop("deal")

    left = posting.join(heads, "key").where("first > since").join(settled, "id", "left_anti")

    def meet(batches):
        for x in batches:
            for mine, all_ in zip(x.column(x.schema.get_field_index("mine")).to_pylist(), x.column(x.schema.get_field_index("all")).to_pylist()):
                found = _close(mine, all_, distance)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["id", "other"])

    busy = left.select("key", "m").distinct()
    rest = dealt(left, "mine").join(dealt(posting.join(busy, "key"), "all"), "key").select("mine", "all").mapInArrow(meet, "id binary, other binary").distinct()
    late = settled.union(verified(rest)).distinct()

    late = late.withColumn("late", F.lit(True))
    judged = first.join(late, "id", "left").where("late or times > 1")
    return lines.join(judged, "id").where("late or d <> first.d or h <> first.h or n <> first.n").select(F.col("d").alias("doc_id"), F.col("h").alias("text_hash"), F.col("n").alias("line_no"))


def line_dedup(docs: DataFrame, distance: int = 2, per_edit: int = 10) -> DataFrame:
    """``docs`` with the column ``text`` rebuilt without dropped lines, and n_lines, n_dropped (long) added.

    A document all of whose lines go has an empty text.  Input columns of these two names are refused.
    """
    T.unclaimed(docs, "n_lines", "n_dropped")
    doc, digest, lost = T.fresh(docs, "_d", "_h", "_gone")
    gone = row_drops(docs, distance, per_edit).groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest)).agg(F.collect_set("line_no").alias(lost))
    gone = T.stash(gone)
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(digest, T.text_hash())
    columns, text = list(docs.columns), docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out, many = [], []
            for t, g in zip(b.column(text).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                lines, g = (t or "").split("\n"), set(g or ())
                many.append((len(lines), len(g)))
                out.append("\n".join(x for i, x in enumerate(lines) if i not in g) if g else t)
            cols = list(b.columns)[:-1]
            cols[text] = pa.array(out, b.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([m[k] for m in many], pa.int64()) for k in range(2))], [*columns, "n_lines", "n_dropped"])

    own = [F.col(f"`{c}`") for c in columns]
    some = T.thin(rows, gone, doc, digest).join(gone, [doc, digest], "left").select(*own, lost)
    schema = StructType([*(StructField(f.name, f.dataType) for f in docs.schema), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    count = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1
    # documents that lose nothing are not shuffled
    same = T.rest(rows, gone, doc, digest).select(*own, F.coalesce(count, F.lit(1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return same.unionByName(some.mapInArrow(cut, schema))
