"""Token ids of whole texts, with a cache of the pieces between white space.

Both public BPE tokenizers used here cut a text at white space before anything else, so a text's ids are the ids of
its pieces in a row.  A piece is a word with the blank before it, or a run of further blanks.  An Arrow batch's
different pieces are found in one dictionary encoding, new ones are encoded once per worker, and the ids of all texts
are gathered by index.  A text that holds white space outside ASCII, a separator control character or an added
token's string is one piece and goes to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ripplegraph.llm import textkit as T

_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: A space and letters that no normal form changes: one word to a tokenizer.
_SIMPLE = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Pieces held by a worker, and the longest that is held.
_HELD, _LONG = 800_000, 60
#: Words that are encoded as one text.
_JOINED = 2000
_MARK, _LETTER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".,!?;:#*$%&", bytes(range(65, 91)) + bytes(range(97, 123))))


def _strings(col: pa.Array) -> list[str]:
    return col.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


class Encoder:
    """Encodes columns of texts as ids of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.drops_blanks = not len(self._whole(" \n"))
        self.folds = self.drops_blanks and self._whole("A") == self._whole("a")
        # tokens at which a word begins (byte level: with its blank) or ends
        self.border = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.endswith("</w>") if self.drops_blanks else token.startswith("Ġ")
        self.breaks = self._whole("\n")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ends: dict[int, int] = {}
        self.pool, self.start, self.size, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0

    def _hold(self, flat: np.ndarray, size: np.ndarray) -> range:
        """Numbers of new id sequences, which stand in a row."""
        n, more = self.used, len(size)
        top = int(self.start[n - 1] + self.size[n - 1]) if n else 0
        while len(self.start) < n + more:
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while len(self.pool) < top + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[top : top + len(flat)] = flat
        self.size[n : n + more] = size
        self.start[n : n + more] = top + np.cumsum(size) - size
        self.used = n + more
        return range(n, self.used)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._batch([text])[0], np.dtype("<u4"))

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces one by one and hold them."""
        found = self._batch(pieces)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.dtype, int(size.sum()))
        self.known.update(zip(pieces, self._hold(flat, size)))

    def _learn_words(self, words: list[str], spaced: bool) -> None:
        """Encode words of letters, all with a space before them or all without, as one text, and hold them."""
        for i in range(0, len(words), _JOINED):
            part = words[i : i + _JOINED]
            sep = "" if spaced else " " if self.drops_blanks else "\n"
            ids = np.array(self._batch([sep.join(part)])[0], self.dtype)
            if self.drops_blanks or spaced:
                cut = np.flatnonzero(self.border[ids])
                cut = np.concatenate([[0], cut[:-1] + 1]) if self.drops_blanks else cut
                size = np.diff(np.append(cut, len(ids)))
            else:
                gap = ids == self.breaks[0]
                cut = np.flatnonzero(gap)
                size = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                ids = ids[~gap]
            if len(size) == len(part):
                self.known.update(zip(part, self._hold(ids, size)))
            else:  # a word that is not one run of letters to this tokenizer
                self._learn(part)

    def _pieces(self, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and how many of them stand before each text (and in all).

        Pieces begin at texts, at the first blank of a run, at the last one if a word follows, after a line break, and at
        marks after a letter that end a word.  A tokenizer that drops blanks has pieces without them.
        """
        data, off = T.arrow_bytes(col)
        if not len(data):
            return pa.array([], pa.string()), np.zeros(len(off), np.int64)
        odd = np.zeros(len(off) - 1, bool)
        for token in self.added:
            odd |= np.array(pc.match_substring(col, token, ignore_case=self.folds))
        total = np.concatenate([[0], np.cumsum((data >= 0x80) | ((data >= 0x1C) & (data <= 0x1F)))])
        for i in np.flatnonzero(total[off[1:]] > total[off[:-1]]):
            odd[i] = odd[i] or bool(_ODD.search(col[int(i)].as_py()))
        whole = np.flatnonzero(odd)
        filled = off[1:] > off[:-1]
        first, last = off[:-1][filled], off[1:][filled] - 1
        blank = T._SPACE[data]
        after = np.append(blank[1:], True)  # a blank, or a text's end, comes next
        after[last] = True
        begin = np.zeros(len(data), bool)
        begin[1:] = ~blank[:-1] & blank[1:] | blank[1:] & ~after[1:]
        if self.drops_blanks:
            begin = np.zeros(len(data), bool)
            begin[1:] = blank[:-1] & ~blank[1:]
        else:
            begin[1:] |= (data[:-1] == 10) & ~after[:-1]
        mark = _MARK[data]
        starts, ends = mark.copy(), mark & after
        starts[1:] &= ~mark[:-1]
        starts[first] = mark[first]
        ends[:-1] |= mark[:-1] & ~mark[1:]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
        starts = starts[after[ends] & (starts > 1)]
        accent = (data[starts - 2] == 0xC3) & (data[starts - 1] != 0x97) & (data[starts - 1] != 0xB7)
        begin[starts[_LETTER[data[starts - 1]] | accent]] = True
        begin[first] = True
        if self.folds:
            plain = T._LOWER[data]
            for i in whole:
                plain[off[i] : off[i + 1]] = data[off[i] : off[i + 1]]
            data = plain
        for i in whole:
            begin[off[i] + 1 : off[i + 1]] = False
        if self.drops_blanks:
            kept = ~blank
            for i in whole:
                kept[off[i] : off[i + 1]] = True
            begin &= kept
            shift = np.concatenate([[0], np.cumsum(kept)])
            data, off = data[kept], shift[off]
            begin = begin[kept]
        cuts = np.flatnonzero(begin)
        pieces = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(cuts, off)

    def __call__(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each text, and where each text's ids begin (and the last end)."""
        if pa.types.is_large_string(col.type) or isinstance(col, pa.ChunkedArray):
            col = pa.array(col.to_pylist(), pa.string())
        if col.null_count:
            col = pc.fill_null(col, "")
        if len(self.known) > _HELD:
            self._clear()
        if end_id not in self.ends:
            self.ends[end_id] = self._hold(np.array([end_id], self.dtype), np.array([1]))[0]
        cut, until = self._pieces(col)
        coded = cut.dictionary_encode()
        pieces = _strings(coded.dictionary)
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(number < 0)
        if len(new):
            some = coded.dictionary.take(pa.array(new))
            simple = pc.match_substring_regex(some, _SIMPLE)
            words = some.filter(simple)
            spaced = pc.starts_with(words, " ")
            self._learn_words(_strings(words.filter(spaced)), True)
            self._learn_words(_strings(words.filter(pc.invert(spaced))), False)
            self._learn(_strings(some.filter(pc.invert(simple))))
            number[new] = np.fromiter(map(self.known.__getitem__, [pieces[i] for i in new]), np.int64, len(new))
        code = number[np.asarray(coded.indices)]
        for i in np.flatnonzero(np.asarray(pc.binary_length(coded.dictionary)) > _LONG):
            del self.known[pieces[i]]
        code = np.insert(code, until[1:], self.ends[end_id])
        size = self.size[code]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = self.pool[np.arange(total[-1]) + np.repeat(self.start[code] - total[:-1], size)]
        return out, total[np.concatenate([[0], until[1:] + np.arange(1, len(until))])]


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file, held under its path."""
    return T.held(path, lambda: Encoder(path))
