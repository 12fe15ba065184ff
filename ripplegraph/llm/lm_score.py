"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

The model predicts a token's class from the two tokens before it, and the token within its class by counts.
The most frequent training tokens are classes of their own; all others, and tokens never seen, belong to
classes by the hash of their last two bytes.  With class vectors r (context) and q (target), a bias b and a
matrix C for each place of the context, the class distribution is softmax(q (C1 r1 + C2 r2) + b).

Texts are read once and kept as blocks: a local vocabulary and a number per token.  Token counts come from
one aggregate over the blocks' vocabularies and go back to the blocks by a join per (block, word), so neither
the driver nor a task holds the whole vocabulary.  Training runs in rounds: each task goes on from the common
parameters over the texts of its blocks, with noise drawn from the class frequencies, and the tasks'
parameters are averaged by an aggregate (their number is fixed).  Each round takes another share of every
block's training texts, so all of them are learnt from.  Scoring normalises with a matrix product over the
different contexts of a block.

Edge cases: a null text is empty and has the end token alone; a null doc_id is scored and never learnt from;
rows that repeat a doc_id are scored, and learnt from, one by one; without training texts every token is
unknown; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Frequent tokens with a class each, classes by ending, and size of a vector.
TOP, ENDINGS, WIDTH = 384, 128, 24
CLASSES = TOP + ENDINGS
#: Texts of a round are those of a block whose place has that remainder.
ROUNDS = 2
BATCH, NOISE, RATE = 2048, 64, 0.08
#: Texts of a block at most, and bytes after which it ends.
BLOCK_ROWS, BLOCK_BYTES = 2000, 8 << 20
_END = np.uint64(0xE4D0F7EC7A3B5C19)


def is_training(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves another remainder than 1 by 5."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 1


def _planes(x: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, the lowest first."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for b in T.pieces(batches, size=BLOCK_BYTES):
        w = T.Words(b.column(1))
        n = len(w.count)
        # an end token after each text
        place = np.arange(len(w.hash)) + w.doc
        tokens = np.full(len(w.hash) + n, _END)
        tokens[place] = w.hash
        last = np.zeros(len(tokens), np.int64)
        if len(w.hash):
            pair = w.data[w.end - 1].astype(np.int64) * 256 + np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0)
            last[place] = pair * 40503 % 65521 % ENDINGS
        vocab, first, local, often = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        # frequent words get small numbers, which compress well
        order = np.argsort(-often, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        vocab, first, local = vocab[order], first[order], number[local]
        ids = b.column(0).to_pylist()
        learn = np.array([is_training(d) for d in ids])
        count = w.count + 1
        seen = np.bincount(local[np.repeat(learn, count)], minlength=len(vocab))
        row = [block, ids, count.tolist(), learn.tolist(), _planes(local), vocab.tobytes(), last[first].astype("<u2").tobytes(), seen.astype("<u4").tobytes()]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["block", "ids", "counts", "learn", "local", "vocab", "ending", "seen"])
        block += 1


def _vocabulary(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for block, vocab, ending, seen in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "vocab", "ending", "seen"))):
        yield block, np.frombuffer(vocab, np.int64), np.frombuffer(ending, "<u2"), np.frombuffer(seen, "<u4")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, vocab, ending, seen in _vocabulary(b):
            k = seen > 0
            yield pa.RecordBatch.from_arrays([pa.array(vocab[k]), pa.array(ending[k].astype(np.int32)), pa.array(seen[k].astype(np.int64))], ["word", "ending", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, vocab, _, _ in _vocabulary(b):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vocab), block)), pa.array(np.arange(len(vocab), dtype=np.int32)), pa.array(vocab)], ["block", "place", "word"])


class Shape:
    """What all tasks know of the training counts; its size is fixed."""

    def __init__(self, total: int, distinct: int, top_count: np.ndarray, rest: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.rest_count, self.rest_words = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for e, (n, v) in rest.items():
            self.rest_count[e], self.rest_words[e] = n, v
        mass = np.full(CLASSES, 1e-9)
        mass[: len(top_count)] = top_count + 0.5
        mass[TOP:] = self.rest_count + 0.5 * (self.rest_words + 1)
        self.share = mass / mass.sum()

    def classes(self, top: np.ndarray, ending: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word (``top`` where it has one of its own, else -1), and log10 of the word's share of it."""
        inner = np.log10((n + 0.5) / (self.rest_count + 0.5 * (self.rest_words + 1))[ending])
        return np.where(top >= 0, top, TOP + ending.astype(np.int64)), np.where(top >= 0, 0.0, inner)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


class LogBilinear:
    """Parameters as one flat array: context vectors, target vectors, biases, and a matrix per context place."""

    SIZE = 2 * CLASSES * WIDTH + CLASSES + 2 * WIDTH * WIDTH

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        a, b = CLASSES * WIDTH, CLASSES
        self.r, self.q = self.flat[:a].reshape(CLASSES, WIDTH), self.flat[a : 2 * a].reshape(CLASSES, WIDTH)
        self.b = self.flat[2 * a : 2 * a + b]
        self.c = self.flat[2 * a + b :].reshape(2, WIDTH, WIDTH)

    @classmethod
    def fresh(cls, share: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(17)
        m = cls(np.zeros(cls.SIZE))
        m.r[:] = rng.normal(0, 0.3, m.r.shape)
        m.q[:] = rng.normal(0, 0.05, m.q.shape)
        m.b[:] = np.log(share)
        m.c[:] = np.eye(WIDTH) * 0.7
        return m

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, share: np.ndarray, pace: LogBilinear, rng: np.random.Generator) -> None:
        """One pass over (two places back, one back, target) with noise shared by a batch; ``pace`` gathers squared steps."""
        ladder = np.cumsum(share)
        shift = (np.log(share) + np.log(NOISE)).astype(np.float32)
        for lo in range(0, len(target), BATCH):
            a, b, t = one[lo : lo + BATCH], two[lo : lo + BATCH], target[lo : lo + BATCH]
            noise = np.minimum(np.searchsorted(ladder, rng.random(NOISE) * ladder[-1]), CLASSES - 1)
            ra, rb = self.r[a], self.r[b]
            h = ra @ self.c[0] + rb @ self.c[1]
            qt, qn = self.q[t], self.q[noise]
            up = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", h, qt) + self.b[t] - shift[t], -30, 30))) - 1
            down = 1 / (1 + np.exp(-np.clip(h @ qn.T + self.b[noise] - shift[noise], -30, 30)))
            gh = up[:, None] * qt + down @ qn
            step = LogBilinear(np.zeros(self.SIZE))
            # dense sums per class through one-hot products would cost more than sorted sums
            for index, rows, into in ((t, up[:, None] * h, step.q), (noise, down.T @ h, step.q), (a, gh @ self.c[0].T, step.r), (b, gh @ self.c[1].T, step.r)):
                order = np.argsort(index, kind="stable")
                head = np.flatnonzero(np.diff(index[order], prepend=-1))
                into[index[order][head]] += np.add.reduceat(rows[order], head)
            step.b[:] = np.bincount(t, up, CLASSES) + np.bincount(noise, down.sum(0), CLASSES)
            step.c[0], step.c[1] = ra.T @ gh, rb.T @ gh
            step.flat /= len(t)
            pace.flat += step.flat**2
            self.flat -= RATE * step.flat / (np.sqrt(pace.flat) + 1e-4)

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each target class."""
        code, back = np.unique(one * CLASSES + two, return_inverse=True)
        h = self.r[code // CLASSES] @ self.c[0] + self.r[code % CLASSES] @ self.c[1]
        norm = np.empty(len(code), np.float32)
        for lo in range(0, len(code), 4096):
            s = h[lo : lo + 4096] @ self.q.T + self.b
            top = s.max(1)
            norm[lo : lo + 4096] = top + np.log(np.exp(s - top[:, None]).sum(1))
        s = np.einsum("ij,ij->i", h[back], self.q[target]) + self.b[target]
        return (s - norm[back]).astype(np.float64) / np.log(10)


def contexts(classes: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places back; before a text stands the end."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    one, two = np.full(len(classes), end), np.full(len(classes), end)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[first] = end
    two[first] = end
    two[(first + 1)[counts > 1]] = end
    return one, two


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    spark = T.session(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    blocks = T.stash(T.text_frame(docs).mapInArrow(_blocks, "block long, ids array<long>, counts array<long>, learn array<boolean>, local binary, vocab binary, ending binary, seen binary"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    words = T.stash(blocks.select("block", "vocab", "ending", "seen").mapInArrow(_words, "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.orderBy(F.desc("n"), "word").limit(TOP).toPandas()
    tops = F.broadcast(spark.createDataFrame([(int(x), i) for i, x in enumerate(top["word"])], "word long, class int"))  # TOP rows
    rest = {r["ending"]: (r["n"], r["v"]) for r in words.join(tops, "word", "left_anti").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    shape = spark.sparkContext.broadcast(Shape(total["n"], total["v"], top["n"].to_numpy(np.float64), rest))

    places = blocks.select("block", "vocab", "ending", "seen").mapInArrow(_places, "block long, place int, word long")
    counts_ = words.join(tops, "word", "left").select("word", "n", F.coalesce("class", F.lit(-1)).cast("short").alias("class"))
    known = places.join(counts_, "word").groupBy("block").agg(*(F.collect_list(c).alias(f"all_{c}") for c in ("place", "n", "class")))

    def coded(batches: Iterator[pa.RecordBatch]):
        s = shape.value
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(b.schema.get_field_index(c))[r]  # noqa: B023, E731
                ids, counts, learn = (get(c).as_py() for c in ("ids", "counts", "learn"))
                local, ending = _numbers(get("local").as_py()), np.frombuffer(get("ending").as_py(), "<u2")
                n, top = np.zeros(len(ending)), np.full(len(ending), -1)
                if get("all_place").is_valid:
                    at = get("all_place").values.to_numpy()
                    n[at], top[at] = get("all_n").values.to_numpy(), get("all_class").values.to_numpy()
                cls, inner = s.classes(top, ending, n)
                first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                sums = [np.add.reduceat(x[local], first) for x in ((n > 0).astype(np.int64), s.base(n), inner)]
                end = int(cls[local[counts[0] - 1]])  # a text's last token
                row = [ids, counts, learn, *(x.tolist() for x in sums), cls[local].astype("<u2").tobytes(), end]
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    names = ["ids", "counts", "learn", "known", "base", "inner", "classes", "end"]
    data = blocks.drop("seen", "vocab").join(known, "block", "left").mapInArrow(coded, "ids array<long>, counts array<long>, learn array<boolean>, known array<long>, base array<double>, inner array<double>, classes binary, end int")
    data = T.stash(data)

    flat = LogBilinear.fresh(shape.value.share).flat
    for k in range(ROUNDS):
        flat = _round(data, shape, spark.sparkContext.broadcast(flat), k)
    params = spark.sparkContext.broadcast(flat)

    def scored(batches: Iterator[pa.RecordBatch]):
        m, n = LogBilinear(params.value), shape.value.total
        for b in batches:
            for r in b.to_pylist():
                counts = np.array(r["counts"])
                cls = np.frombuffer(r["classes"], "<u2").astype(np.int64)
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                s = np.add.reduceat(m.log10(*contexts(cls, counts, r["end"]), cls), first) + np.array(r["inner"])
                held = [d is not None and not is_training(d) for d in r["ids"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(held), pa.array(counts), pa.array(r["known"]), pa.array(np.full(len(counts), n)), pa.array(r["base"]), pa.array(s)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = T.stash(data.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    T.session(spark)
    return out


def _round(data: DataFrame, shape, params, k: int) -> np.ndarray:
    """The tasks' parameters after a pass over the k-th share of the training texts, averaged by their tokens."""

    def run(batches: Iterator[pa.RecordBatch]):
        share = shape.value.share
        m, pace, seen = LogBilinear(params.value.copy()), LogBilinear(np.zeros(LogBilinear.SIZE)), 0
        for b in batches:
            for r in b.to_pylist():
                counts = np.array(r["counts"])
                cls = np.frombuffer(r["classes"], "<u2").astype(np.int64)
                mine = np.array(r["learn"]) & (np.arange(len(counts)) % ROUNDS == k)
                take = np.repeat(mine, counts)
                one, two = contexts(cls, counts, r["end"])
                if take.any():
                    rng = np.random.default_rng(len(cls))
                    order = rng.permutation(int(take.sum()))
                    m.train(one[take][order], two[take][order], cls[take][order], share, pace, rng)
                    seen += int(take.sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(LogBilinear.SIZE, dtype=np.int32)), pa.array(m.flat.astype(np.float64) * seen), pa.array(np.full(LogBilinear.SIZE, seen))], ["at", "value", "weight"])

    # as many groups as parameters, summed before the shuffle
    rows = data.mapInArrow(run, "at int, value double, weight long").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
    if not len(rows):
        return params.value
    out = np.zeros(LogBilinear.SIZE, np.float32)
    out[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return out
