"""Fill-in-middle transformation, with cuts found by rank and select over 64-bit words.

A text is cut into units: runs of ASCII letters, and every other code point alone.  Its UTF-8 bytes are viewed as
uint64, eight bytes a word; arithmetic on whole words marks the bytes that end a unit and those that begin a code
point, bitwise_count and a running sum count them, and a cut at the k-th unit is one binary search for the word and
a select inside it.  No unit is ever materialised, so a text costs the same however it is cut.

Edge cases: a null text is empty; an empty text has no units and stays plain, as does a text that holds a mark already;
a cut may fall before the first unit or after the last, so parts may be empty; a null doc_id draws as an empty number
does; rows that repeat a doc_id are drawn alike, each with its own text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_U = np.uint64
_ONE, _HIGH = _U(0x0101010101010101), _U(0x8080808080808080)


def _every(byte: int) -> np.uint64:
    return _ONE * _U(byte)


def _letters(x: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is an ASCII letter."""
    low = (x | _every(0x20)) & _every(0x7F)
    return (low + _every(0x80 - ord("a"))) & ~(low + _every(0x80 - ord("z") - 1)) & ~x & _HIGH


def _counted(mask: np.ndarray) -> np.ndarray:
    """How many bits are set before each word, and in all."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(np.bitwise_count(mask), dtype=np.int64, out=out[1:])
    return out


def _rank(mask: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marked bytes there are before each byte position."""
    word, inside = at >> 3, (at & 7).astype(_U)
    low = (_U(1) << (inside * _U(8))) - _U(1)
    return before[word] + np.bitwise_count(mask[np.minimum(word, len(mask) - 1)] & low) * (word < len(mask))


def _select(mask: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte position just after the k-th marked byte, k from 1."""
    word = np.searchsorted(before, k, side="left") - 1
    within = (k - before[word]).astype(_U)
    # byte i of the product has the marks in bytes 0 to i; those that reach ``within`` keep their high bit
    upto = (mask[word] >> _U(7)) * _ONE
    reached = ((upto | _HIGH) - within * _ONE) & _HIGH
    return 8 * word + 8 - np.bitwise_count(reached) + 1


class Units:
    """Rank and select over the units of a batch of texts that stand one after the other in ``data``."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        padded = np.zeros(len(data) // 8 * 8 + 8, np.uint8)
        padded[: len(data)] = data
        x = padded.view("<u8").astype(_U, copy=False)
        letter = _letters(x)
        within = x & ~(x << _U(1)) & _HIGH  # continuation bytes
        follows = letter << _U(8)
        follows[1:] |= letter[:-1] >> _U(56)
        begins = _HIGH & ~within & ~(letter & follows)
        ends = begins >> _U(8)
        ends[:-1] |= begins[1:] << _U(56)
        flat = ends.view(np.uint8)
        flat[off[1:][np.diff(off) > 0] - 1] = 0x80  # a text's end ends its last unit
        flat[len(data) :] = 0
        self.ends, self.heads = ends, ~within & _HIGH
        self.before, self.heads_before = _counted(self.ends), _counted(self.heads)
        self.off = off
        first = _rank(self.ends, self.before, off)
        self.first, self.count = first[:-1], np.diff(first)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Where the first k units of each text end."""
        some = k > 0
        out = self.off[:-1].copy()
        out[some] = _select(self.ends, self.before, (self.first + k)[some])
        return out

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between byte positions."""
        return _rank(self.heads, self.heads_before, end) - _rank(self.heads, self.heads_before, start)


def _transform(text: pa.Array, h: list[np.ndarray], plain: int, spm: int, marks: tuple[str, str, str]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch."""
    data, off = T.arrow_bytes(text)
    units = Units(data, off)
    n = units.count
    a, b = (x % (n + 1) for x in h[:2])
    p, m = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
    has = np.zeros(len(n), bool)
    for mark in marks:
        has |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
    form = np.where((n == 0) | has | (h[2] % 100 >= plain), 0, np.where(h[3] % 100 < spm, 2, 1))
    # the three parts are slices of one buffer
    cuts = np.append(np.stack([off[:-1], p, m], 1).ravel(), off[-1:])
    parts = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(i, 3 * len(n), 3))) for i in range(3))
    lead = [pa.scalar(x, pa.large_string()) for x in marks]
    join = lambda *x: pc.binary_join_element_wise(*x, pa.scalar("", pa.large_string()))
    output = pc.choose(pa.array(form), text.cast(pa.large_string()), join(lead[0], prefix, lead[1], suffix, lead[2], middle), join(lead[1], suffix, lead[0], prefix, lead[2], middle))
    cut = form == 0
    chars = [pa.array(units.chars(s, e), pa.int64(), mask=cut) for s, e in ((off[:-1], p), (p, m))]
    return [pa.array(n, pa.int64()), pc.choose(pa.array(form), *map(pa.scalar, ("plain", "psm", "spm"))), *chars, output.cast(pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = 1, transformed: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    ``transformed`` per cent of the documents are cut in three, ``spm`` per cent of these with the suffix first.  What is
    drawn depends on ``seed`` and doc_id alone, so it is the same in any partitioning.
    """
    if len({m[:1] for m in marks}) != 1 or len(set(marks)) != 3 or any(m.count(m[:1]) != 1 for m in marks) or not all(marks):
        # then no mark can begin inside another or across the joint of a part and a mark, and the output can be read back
        raise ValueError("marks have to differ and to begin with one sign that is nowhere else in them")
    T.session(docs.sparkSession)
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches):
            found = _transform(b.column(1), [b.column(i).to_numpy() for i in range(2, 6)], transformed, spm, marks)
            yield pa.RecordBatch.from_arrays([b.column(0), *found], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return T.text_frame(docs, *draws).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text, from an output and its form alone."""
    p, s, m = marks
    middle = F.substring_index(output, m, -1)
    body = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(body, s, 1), p, -1), middle, F.substring_index(body, s, -1))
    spm = F.concat(F.substring_index(body, p, -1), middle, F.substring_index(F.substring_index(body, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
