"""Quality classifier by compression with zstandard dictionaries.

Two dictionaries are trained, on good and on bad labelled text.  A text is compressed piece by piece with
both; the difference of its compressed sizes over their sum says which of the two it is like, and a logistic
curve fitted on other labelled rows turns that into the probability of a good text.

What is learnt comes from a bounded sample: of each label the ``sample`` rows with the lowest hash of doc_id,
and of their texts at most ``sample_bytes``.  Every text is scored, in whole.

Edge cases: a null text is empty, and an empty text gets the score at difference 0; a null doc_id is scored
and not held out; labels that are null, or without a document, are not used, and of repeated labels the
lowest counts; without labels of both kinds the score is the share of good ones (0.5 without any); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Bytes of a dictionary, of a piece that is compressed at once, and of a training sample.
DICTIONARY, PIECE, CHUNK = 32_768, 500, 2_000
LEVEL = 3


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, max(1, len(data)), size)]


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary of whole texts, cut to samples."""
    samples = [p for t in texts for p in _cut(t.encode("utf-8", "surrogatepass"), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its own end serves
        return b"".join(samples)[-DICTIONARY:]


class Model:
    """Scores texts; small enough to travel with a task."""

    def __init__(self, good: bytes, bad: bytes, slope: float, base: float):
        self.good, self.bad, self.slope, self.base = good, bad, slope, base
        self._pair: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def differences(self, texts: list[str]) -> np.ndarray:
        if self._pair is None:
            self._pair = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad))
        good, bad = self._pair
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                pieces = _cut(t.encode("utf-8", "surrogatepass"), PIECE)
                g, b = (sum(len(c.compress(p)) for p in pieces) for c in (good, bad))
                out[i] = (b - g) / (b + g)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.base, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton steps with a light pull to zero."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), grad)
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, sample_bytes: int = 6 << 20) -> Model | float:
    """The model, or the one score of all texts if there are not labels of both kinds."""
    labels = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    found = {}
    for q in (0, 1):
        # at most ``sample`` ids, so the join is a broadcast of a known size
        ids = labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        rows = T.text_frame(docs, T.text_hash().alias("h")).join(F.broadcast(ids), "doc_id").withColumn("size", F.octet_length("text"))
        # sizes first, so that no more than ``sample_bytes`` of text ever travels; a text of over a sixteenth of that is no sample
        sizes = rows.where(F.col("size") <= sample_bytes // 16).groupBy("doc_id").agg(F.min(F.struct("h", "size")).alias("x")).select("doc_id", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
        until = int(np.searchsorted(np.cumsum([r.size for r in sizes]), sample_bytes, side="right"))
        chosen = {(r.doc_id, r.h): k for k, r in enumerate(sizes[:until])}
        texts = {}
        if chosen:
            keys = docs.sparkSession.createDataFrame(list(chosen), "doc_id long, h long")
            texts = {chosen[r.doc_id, r.h]: r for r in rows.join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "text").collect()}
        found[q] = [texts[k] for k in sorted(texts)]
    n = {q: len(r) for q, r in found.items()}
    if not n[0] or not n[1]:
        return n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    # every other row of the sample trains the dictionaries, the rest the curve
    half = {q: (r[::2], r[1::2] or r) for q, r in found.items()}
    model = Model(train_dictionary([r.text for r in half[1][0]]), train_dictionary([r.text for r in half[0][0]]), 1.0, 0.0)
    texts = [r.text for q in (0, 1) for r in half[q][1]]
    x = model.differences(texts)
    y = np.repeat([0.0, 1.0], [len(half[0][1]), len(half[1][1])])
    model.slope, model.base = _logistic(x, y)
    # the sample holds as many of each label as it can: move the curve to the labels' own shares
    share = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().where("quality in (0, 1)").collect()}
    model.base += float(np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **how: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    spark = T.session(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches):
            m = model.value
            s = np.full(b.num_rows, m) if isinstance(m, float) else m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    scored = T.text_frame(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
