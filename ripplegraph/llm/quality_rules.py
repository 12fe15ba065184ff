"""Quality rules with risk-controlled thresholds.

Base rules have fixed limits.  The others reject a document when one of its measures exceeds a cutoff, and
the cutoffs are chosen per stratum (language) from labelled documents so that few good ones are lost:

1. labelled documents that pass the base rules are dealt in two by a hash of doc_id, a quarter of them to fit and
   the rest to test, as a certificate takes more labels than a cutoff does;
2. the first part's good documents give candidate cutoffs, one set per level (quantiles of each measure, and
   beyond the largest value by a part of its distance from the median, and then not below the largest value
   over all strata, as a small stratum has seen little);
3. on the other part, each level's false rejections are tested: the level is certified if the exact binomial
   probability of so few of them, at a true rate of ``risk``, is at most ``doubt`` divided by the number of
   strata (Bonferroni).  This is the Clopper-Pearson upper bound at that level.  A level rejects all that a
   looser one rejects, so within a stratum the tests are a fixed sequence from the loosest to the first that
   fails, which needs no further correction;
4. of the certified levels, the loosest that rejects nearly as many bad ones as the best is used.

In a stratum without a certified level of its own only the base rules reject.

Edge cases: null or empty texts have no words and fail the base rules; a null language is a stratum; rows
without a label or doc_id take no part in the choice, and of repeated labels the lowest counts; rows that
repeat a doc_id are judged one by one; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Quantiles of good documents that become cutoffs, and what is added in distances from median to maximum; strictest first.
LEVELS = ((0.98, 0.0), (0.99, 0.0), (0.995, 0.0), (0.998, 0.0), (1.0, 0.0), (1.0, 0.5), (1.0, 1.0))
#: The base rules.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_twins")
#: Measures with a cutoff, as a share of two counts (nothing by nothing is 0) and its sign; high is bad.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1),
    "repeats": ("n_repeat_words", "n_words", 1),
    "upper": ("n_upper", "word_chars", 1),
    "marks": ("n_marks", "n_words", 1),
    "twins": ("n_twins", "n_words", 1),
    "longish": ("word_chars", "n_words", 1),
    "shortish": ("word_chars", "n_words", -1),
}
_SYMBOL, _UPPER, _MARK, _SPACE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b" \t\n\r\x0b\x0c"))


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def counts(col: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text of a column."""
    w = T.Words(col, lower=False)
    data, off = w.data, w.off
    starts = (data & 0xC0) != 0x80
    chars = _per_text(starts & ~_SPACE[data], off)
    dup = np.zeros(len(w.count), np.int64)
    for i, t in enumerate(col.to_pylist()):
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        dup[i] = len(lines) - len(set(lines))
    at, key = w.windows(3)
    order = np.lexsort((key, w.doc[at]))
    d, k = w.doc[at][order], key[order]
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(w.hash) + 3, bool)
    hit = at[order[twice]]
    for i in range(3):
        covered[hit + i] = True
    twin = np.zeros(len(w.hash), bool)
    twin[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return [w.count, chars, _per_text(_SYMBOL[data], off), dup, _per_text(covered[: len(w.hash)], w.first), _per_text(_UPPER[data], off), _per_text(_MARK[data], off), _per_text(twin, w.first)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x.astype(np.int64)) for x in counts(b.column(1)))], ["doc_id", "lang", *COUNTS])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return T.text_frame(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).mapInArrow(run, f"doc_id long, lang string, {kinds}")


def chance(rejected: int, good: int, risk: float) -> float:
    """The exact probability of at most so many rejections of good ones if each is rejected at the rate ``risk``."""
    if good == 0:
        return 1.0
    k = np.arange(rejected + 1)
    ways = math.lgamma(good + 1) - np.array([math.lgamma(i + 1) + math.lgamma(good - i + 1) for i in k])
    return float(min(1.0, np.exp(ways + k * math.log(risk) + (good - k) * math.log1p(-risk)).sum()))


def _measure(m: str) -> Column:
    over, by, sign = MEASURES[m]
    return F.coalesce(F.try_divide(F.lit(float(sign)) * F.col(over), F.col(by).cast("double")), F.lit(0.0)).alias(m)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float, doubt: float) -> DataFrame:
    """stratum, and the cutoff of each measure, of each stratum with a certified level."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    known = rows.where(f"not ({BASE_FAILED})").join(labels, "doc_id").select("doc_id", F.col("lang").alias("stratum"), "good", *map(_measure, MEASURES))
    known = T.stash(known.withColumn("fit", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0))
    fitted = known.where("fit and good").groupBy("stratum").agg(*(F.percentile_approx(m, [q for q, _ in LEVELS] + [0.5], 10_000).alias(m) for m in MEASURES))
    most = known.where("fit and good").agg(*(F.max(m).alias(m) for m in MEASURES)).first()  # one row
    more = F.array(*(F.lit(x) for _, x in LEVELS))
    level = F.explode(F.sequence(F.lit(0), F.lit(len(LEVELS) - 1))).alias("level")

    def cut(m):
        own = F.col(m)[F.col("level")] + more[F.col("level")] * (F.col(m)[len(LEVELS) - 1] - F.col(m)[len(LEVELS)])
        return F.when(more[F.col("level")] > 0, F.greatest(own, F.lit(most[m]).cast("double"))).otherwise(own).alias(f"max_{m}")

    fitted = fitted.select("stratum", level, *MEASURES).select("stratum", "level", *(cut(m) for m in MEASURES))
    fitted = T.stash(fitted)
    over = F.lit(False)
    for m in MEASURES:
        over = over | (F.col(m) > F.col(f"max_{m}"))
    held = known.where("not fit").join(fitted, "stratum")
    tested = held.groupBy("stratum", "level").agg(F.count_if("good").alias("n"), F.count_if(F.col("good") & over).alias("lost"), F.count_if(~F.col("good") & over).alias("caught"))

    def certify(frames):
        for f in frames:
            f["p"] = [chance(int(k), int(n), risk) for k, n in zip(f["lost"], f["n"])]
            yield f

    tested = T.stash(tested.mapInPandas(certify, tested.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",p:double"))
    sure = tested.where(F.col("p") * F.lit(tested.select("stratum").distinct().count()) <= doubt)
    best = F.max("caught").over(Window.partitionBy("stratum"))
    sure = sure.withColumn("best", best).where("caught >= 0.98 * best").groupBy("stratum").agg(F.max("level").alias("level"))
    return sure.join(fitted, ["stratum", "level"]).drop("level")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept of every row of ``docs`` (doc_id, text, lang)."""
    T.session(docs.sparkSession)
    rows = T.stash(measured(docs))
    own = cutoffs(rows, labels, risk, doubt).withColumnRenamed("stratum", "lang")
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(_measure(m) > F.col(f"max_{m}"), F.lit(False))
    out = rows.join(own, "lang", "left")
    return out.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~over).select("doc_id", *COUNTS, "base_failed", "kept")


def filter_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each by its own text and language.

    Rows that may be labelled are measured for the cutoffs; then every row is measured and judged in one pass, and none
    is shuffled.  The cutoffs that travel are one row a certified stratum, each of which took some hundred labels.
    """
    T.session(docs.sparkSession)
    wanted = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    some = T.thin(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), wanted, "doc_id")
    cuts = cutoffs(T.stash(measured(some)), labels, risk, doubt).collect()
    limits = {r.stratum: [r[f"max_{m}"] for m in MEASURES] for r in cuts}
    columns, text = list(docs.columns), docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]):
        for b in T.pieces(batches):
            n = dict(zip(COUNTS, counts(b.column(text))))
            keep = (n["n_words"] >= 50) & (100 * n["n_repeat_words"] <= 50 * n["n_words"])
            lang = b.column(b.num_columns - 1).to_pylist()
            for k, (over, by, sign) in enumerate(MEASURES.values()):
                most = np.array([limits[x][k] if x in limits else np.inf for x in lang])
                keep &= sign * n[over] / np.maximum(n[by], 1) <= most
            yield b.filter(pa.array(keep)).select(columns)

    (stratum,) = T.fresh(docs, "_stratum")
    return docs.withColumn(stratum, F.coalesce(F.col("lang").cast("string"), F.lit(""))).mapInArrow(judge, docs.schema)
