"""Benchmark decontamination by templates.

Texts become tokens of canonical form: numbers, units after numbers, and names turn into typed placeholders
and keep their value as a slot.  An item's windows of ``window`` canonical words are hash-joined with those
of all documents (an item shorter than that is one window).  A document's windows of one item that lie on one
diagonal, or on others up to ``GAP`` words away that follow, form an alignment: so words that were put in or left out don't end it.  An
alignment counts if it covers at least ``cover`` percent of the item's words
(and its literal words say something: at least ``literal`` of them), and if its slots are consistent: one
value in the item always stands for one value in the document.  So a copy is caught, and a question whose
numbers, units or names were exchanged throughout is caught, while a text that only follows the same pattern
of placeholders with values at odds is not.  An item that is there word by word counts with fewer literal words as well,
if it has ``VERBATIM`` words.  An item's first word is read both as a name and as a plain word, as what stands before it
decides that in a document.

Names are capitalised words inside a sentence; a sentence's first word is literal, as its capital says nothing.

Edge cases: null or empty texts are clean; a null doc_id is reported as null, once for each text that holds
the item; rows that repeat a doc_id are one document, and rows without one are documents of their own; null or empty items match nothing; an empty table gives an empty result; equal items are all
reported; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Windows that are broadcast; beyond that they are joined by a shuffle. 8 bytes each.
BROADCAST_WINDOWS = 1 << 20
#: Words of an item that counts when it is there word by word, however few of them are literal.
VERBATIM = 3
#: Words of an item that counts from end to end with half its words literal, and words put in or left out between two parts of one alignment.
SHORT, GAP = 5, 3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*%?")
#: Unit words, read after a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml l s sec secs min mins h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms liter liters litre litres degree degrees".split())
_EDGE = ".,;:!?\"'()[]"


@lru_cache(maxsize=4)
def canonical(text: str) -> tuple[list[str], list[str]]:
    """Canonical words of a text (placeholders are <n>, <u>, <p>) and the words as they stand."""
    raw = _WORD.findall(text)
    out = []
    start, number = True, False
    for w in raw:
        core = w.strip(_EDGE)
        if _NUMBER.fullmatch(core):
            kind = "<n>"
        elif number and core.lower() in UNITS:
            kind = "<u>"
        elif not start and core[:1].isupper() and core[1:].islower():
            kind = "<p>"
        else:
            kind = core.lower() or w
        number = kind == "<n>"
        start = w[-1] in ".!?:|"
        out.append(kind)
    return out, [w.strip(_EDGE).lower() or w for w in raw]


#: Words held by a worker, and the name under which it holds what it knows of them.
_HELD, _NAME = 500_000, "words"
_N, _U, _P = (np.uint64(xxhash.xxh3_64_intdigest(k)) for k in ("<n>", "<u>", "<p>"))


def _fact(w: str) -> tuple[int, bool, bool, bool, bool]:
    core = w.strip(_EDGE)
    low = core.lower()
    literal, c = low or w, core[:1]
    number = (c.isdecimal() or c in "-+$€£") and _NUMBER.fullmatch(core) is not None
    capital = c != low[:1] and c.isupper() and core[1:].islower()
    return xxhash.xxh3_64_intdigest(literal.encode("utf-8", "surrogatepass")), number, literal in UNITS, capital, w[-1] in ".!?:|"


class _Facts:
    """What is known of words, by the hash of their bytes: the literal's hash; number, unit, capitalised, ends a sentence."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.literal, self.flags = np.zeros(0, np.uint64), np.zeros((0, 4), bool)

    def rows(self, words: T.Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row of each of the distinct ``hashes``, whose words stand at ``at``."""
        if len(self.row) > _HELD:
            self.__init__()
        keys = hashes.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.row]
        if new:
            data = words.data
            found = [_fact(data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "surrogatepass")) for i in at[new]]
            base = len(self.literal)
            self.row.update({keys[k]: base + n for n, k in enumerate(new)})
            self.literal = np.append(self.literal, np.array([f[0] for f in found], np.uint64))
            self.flags = np.concatenate([self.flags, np.array([f[1:] for f in found], bool)])
        return np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))


def templates(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each canonical word of all texts in a row, and how many words each text has."""
    words = T.Words(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()), lower=False)
    count = words.count.astype(np.int64)
    if not len(words.hash):
        return np.zeros(0, np.uint64), count
    facts = T.held(_NAME, _Facts)
    used, first, at = np.unique(words.hash, return_index=True, return_inverse=True)
    row = facts.rows(words, used, first)[at]
    literal = facts.literal[row]
    number, unit, capital, ends = facts.flags[row].T
    begin = np.cumsum(count)[:-1]
    head = np.zeros(len(at), bool)
    head[0] = True
    head[begin[begin < len(at)]] = True
    start = np.concatenate([[True], ends[:-1]]) | head
    after = np.concatenate([[False], number[:-1]]) & ~head
    return np.where(number, _N, np.where(after & unit, _U, np.where(capital & ~start, _P, literal))), count


def windows(hashes: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each window of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    ok = np.flatnonzero(doc[size - 1 :] == doc[:n])
    return doc[ok], T.join_hashes([hashes[i : i + n] for i in range(size)])[ok].view(np.int64)


def consistent(item: list[str], kinds: list[str], doc: list[str]) -> bool:
    """Whether each slot value of the item stands for one value in the document, by type."""
    seen: dict[tuple[str, str], str] = {}
    return all(seen.setdefault((k, a), b) == b for k, a, b in zip(kinds, item, doc) if k in ("<n>", "<u>", "<p>"))


def matches(doc: str, item: str, window: int, cover: int, literal: int) -> tuple[int, int, int, int] | None:
    """The best alignment of an item in a document: (words matched, first word, items' words, slots that differ), or None."""
    dk, dw = canonical(doc)
    ik, iw = canonical(item)
    if not ik:
        return None
    readings = [ik, ["<p>", *ik[1:]]] if _named(item) else [ik]
    found = [m for m in (_aligned(dk, dw, x, iw, window, cover, literal) for x in readings) if m]
    return max(found, key=lambda m: (m[0], -m[1]), default=None)


def _named(item: str) -> bool:
    """Whether the item's first word would be a name inside a sentence."""
    core = (_WORD.findall(item) or [""])[0].strip(_EDGE)
    return core[:1].isupper() and core[1:].islower()


def _pieces(dk: list[str], ik: list[str], size: int) -> list[tuple[int, int, int]]:
    """(document place, item place, words) of the runs that windows of ``size`` words cover, one diagonal each."""
    at = defaultdict(list)
    for i in range(len(ik) - size + 1):
        at[tuple(ik[i : i + size])].append(i)
    open_: dict[int, list[int]] = {}
    out = []
    for j in range(len(dk) - size + 1):
        for i in at.get(tuple(dk[j : j + size]), ()):
            run = open_.get(j - i)
            if run and i <= run[1] + run[2]:
                run[2] = i + size - run[1]
            else:
                run = open_[j - i] = [j, i, size]
                out.append(run)
    return sorted(map(tuple, out))


def _chains(pieces: list[tuple[int, int, int]], n_item: int, gap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Words covered and pairs (item place, document place) of the best chain that ends in each piece.

    A piece may follow one that begins before it in both texts if ``gap`` words at most were put in or left out between
    them.  Only pieces within the item's length and its gaps are looked back at, and each diagonal's last there.
    """
    found: list[tuple[int, list[tuple[int, int]]]] = []
    last: dict[int, int] = {}  # the last piece of a diagonal
    for k, (j, i, n) in enumerate(pieces):
        own = [(i + x, j + x) for x in range(n)]
        best = (n, own)
        for shift in range(j - i - gap, j - i + gap + 1):
            p = last.get(shift)
            if p is None or pieces[p][1] >= i or pieces[p][0] >= j or j - pieces[p][0] > 2 * n_item:
                continue
            end_i, end_j = found[p][1][-1]
            new = [x for x in own if x[0] > end_i and x[1] > end_j]
            if new and new[0][0] - end_i <= gap + 1 + n_item // 4 and found[p][0] + len(new) > best[0]:
                best = (found[p][0] + len(new), found[p][1] + new)
        found.append(best)
        last[j - i] = k
    return found


def _aligned(dk: list[str], dw: list[str], ik: list[str], iw: list[str], window: int, cover: int, literal: int) -> tuple[int, int, int, int] | None:
    best = None
    for n, pairs in _chains(_pieces(dk, ik, min(window, len(ik))), len(ik), GAP):
        said = sum(ik[i][0] != "<" for i, _ in pairs)
        there = n == len(ik) and pairs[-1][1] - pairs[0][1] == n - 1
        whole = there and n >= VERBATIM and all(iw[i] == dw[j] for i, j in pairs)
        # a short item that is there from end to end has to say half of what it says in words
        short = there and n >= SHORT and 2 * said >= n and said >= VERBATIM
        if 100 * n < cover * len(ik) or (said < literal and not whole and not short):
            continue
        if not consistent([iw[i] for i, _ in pairs], [ik[i] for i, _ in pairs], [dw[j] for _, j in pairs]):
            continue
        found = (n, pairs[0][1], len(ik), sum(iw[i] != dw[j] for i, j in pairs if ik[i][0] == "<"))
        if best is None or (found[0], -found[1]) > (best[0], -best[1]):
            best = found
    return best


def _least(item: np.ndarray, key: np.ndarray, words: np.ndarray, size: int, cover: int) -> np.ndarray:
    """For each window, how many different ones of its item an alignment has at least that covers ``cover`` percent of the words.

    An item that has a window twice may be covered by fewer; one is asked of it.
    """
    different = np.bincount(np.unique(np.stack([item, key]), axis=1)[0], minlength=len(words))
    need = np.where(different == np.bincount(item, minlength=len(words)), -(-cover * words // (100 * size)), 1)
    return np.maximum(1, need)[item].astype(np.int64)


def contaminated(docs: DataFrame, items: DataFrame, window: int = 8, cover: int = 50, literal: int = 5) -> DataFrame:
    """doc_id, item_id, n_words (matched), start (first matched word), n_slots_changed: a row for each match."""
    return _matched(docs, items, window, cover, literal).drop("null_hash")


def _matched(docs: DataFrame, items: DataFrame, window: int = 8, cover: int = 50, literal: int = 5) -> DataFrame:
    """The columns of ``contaminated`` and null_hash, the hash of a text without doc_id."""
    spark = T.session(docs.sparkSession)
    items = T.stash(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("item")))

    def item_rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = np.array(b.column(0).fill_null(-1))
            texts = b.column(1).to_pylist()
            hashes, count = templates(texts)
            # the other reading of a first word, as items of their own
            named = np.array([_named(t) for t in texts], bool)
            first = np.cumsum(count) - count
            other = hashes.copy()
            other[first[named]] = _P
            again = np.repeat(named, count)
            hashes, count, ids = np.concatenate([hashes, other[again]]), np.concatenate([count, count[named]]), np.concatenate([ids, ids[named]])
            for size in np.unique(np.minimum(count[count > 0], window)):  # a short item is one window of its own size
                doc, key = windows(hashes, count, int(size))
                own = np.minimum(count[doc], window) == size
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(ids[doc[own]]), pa.array(np.full(int(own.sum()), size, np.int32)), pa.array(_least(doc[own], key[own], count, int(size), cover))], ["key", "item_id", "size", "least"])

    keys = T.stash(items.where("item_id is not null").mapInArrow(item_rows, "key long, item_id long, size int, least long").groupBy("key", "item_id", "size").agg(F.min("least").alias("least")))
    sizes = [r["size"] for r in keys.select("size").distinct().collect()]  # at most ``window`` numbers
    few = keys.select("key").distinct().count() <= BROADCAST_WINDOWS
    known = spark.sparkContext.broadcast(np.sort(keys.select("key").distinct().toPandas()["key"].to_numpy(np.int64))) if few else None

    def doc_rows(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches, holds=_NAME):
            hashes, count = templates(b.column(1))
            for size in sizes:
                doc, key = windows(hashes, count, size)
                if known is not None:
                    at = np.minimum(np.searchsorted(known.value, key), len(known.value) - 1)
                    hit = known.value[at] == key
                    doc, key = doc[hit], key[hit]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), b.column(2).take(pa.array(doc)), pa.array(key)], ["doc_id", "h", "key"])

    text = T.text_frame(docs, T.text_hash().alias("h"))
    hits = text.mapInArrow(doc_rows, "doc_id long, h long, key long").join(keys.select("key", "item_id", "least"), "key").groupBy("doc_id", "h", "item_id").agg(F.count_distinct("key").alias("n"), F.min("least").alias("least"))
    # an alignment covers its words by that many windows at least, so with fewer no text has to travel
    hits = T.stash(hits.where("n >= least").select("doc_id", "h", "item_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d")))
    some = text.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(hits.drop("doc_id"), ["d", "h"]).join(items, "item_id").select("doc_id", "h", "item_id", "text", "item")

    def verify(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for d, h, i, t, x in zip(*(c.to_pylist() for c in b.columns)):
                found = matches(t, x, window, cover, literal)
                if found:
                    rows.append((d, None if d is not None else h, i, found[0], found[1], found[3]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "null_hash", "item_id", "n_words", "start", "n_slots_changed"])

    return some.mapInArrow(verify, "doc_id long, null_hash long, item_id long, n_words long, start long, n_slots_changed long").dropDuplicates(["doc_id", "null_hash", "item_id"])


def decontaminate(docs: DataFrame, items: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    doc, digest = T.fresh(docs, "_d", "_h")
    dirty = T.stash(_matched(docs, items, **how).select(F.col("doc_id").alias(doc), F.col("null_hash").alias(digest)).distinct())
    own = F.when(F.col("doc_id").isNull(), T.text_hash())
    left = T.without(docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(digest, own), dirty, doc, digest)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
