"""Corpus pipeline: quality rules, line dedup, near-duplicate documents, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written
as Parquet and read again.  All stages but the last return the columns of ``documents``, n_chars for the
text as it then is.

1. quality rules: documents that the rules reject go;
2. line dedup: lines that repeat an earlier one go, and documents of which only blanks are left;
3. n-gram Jaccard join (five words, 0.8): of each component the document with the smallest doc_id stays;
4. decontamination: documents that hold a benchmark item go;
5. best-fit packing: a row per piece, with its sequence and place.

Rows with a null doc_id are judged one by one, by their text: none shares the verdict of another.  They come
last in line dedup, and the near-duplicate join leaves them alone.  Rows that repeat a doc_id are judged one by
one in stages 1 and 2, and are one document in 3 and 4: of a near-duplicate component all rows of the smallest
doc_id stay, and all rows of a doc_id go if one holds an item.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import textkit
from ripplegraph.llm.decontam import decontaminate
from ripplegraph.llm.line_dedup import line_dedup
from ripplegraph.llm.ngram_join import ngram_components
from ripplegraph.llm.packing import pack_documents
from ripplegraph.llm.quality_rules import filter_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: None: SQL has no certified cutoffs, banded edit distances, templates or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs, distance=2, per_edit=10)
    gone = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    return out.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_components(docs, k=5, percent=80)
    copies = textkit.stash(found.where("doc_id <> component_id").select("doc_id").distinct())
    return textkit.without(docs, copies, "doc_id").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=8, cover=50, literal=5).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, limit=2048)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; each stage is written and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{textkit.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
