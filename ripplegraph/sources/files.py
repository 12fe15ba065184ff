"""Snapshots of a BI tool and policies, in any store that Spark reads.

A file that is not there, one that can't be read and one of a version that this library doesn't know are told apart: the first is None, the
others are errors, since a broken snapshot must not look like one that reaches nothing.

A snapshot is one JSON document, or a folder that ``dump_snapshot`` wrote: tables of JSON lines in a folder of their own, and a
head that names it.  The head is written last and is what counts, so a writer that fails leaves the snapshot before it in
place; ``load_snapshot`` also counts the rows that the head promises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators.policy import check

#: Versions that can be read; version 1 has no times of change.
VERSIONS = (1, 2)
_COLUMN = "struct<relation:string,column:string,role:string,confidence:string>"
TABLES = {
    "cards": f"card_id long, name string, query_kind string, precision string, collection_id long, archived boolean, database_id long, columns array<{_COLUMN}>, table_relations array<string>, upstream_card_ids array<long>, snippet_ids array<long>, unresolved_reason string, updated_at string",
    "dashboards": "dashboard_id long, name string, collection_id long, url string, card_ids array<long>, meta variant, updated_at string",
    "relations": "relation string, database string, schema string, table string",
}
_HEAD = "schema_version int, sequence long, folder string, counts map<string,long>, provenance variant"


class SnapshotError(ValueError):
    """A snapshot is there and can't be used."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked of the store itself."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _checked(version, where: str) -> None:
    if isinstance(version, bool) or version not in VERSIONS:
        raise SnapshotError(f"version {version!r} of {where} is none of {VERSIONS}")


def _rows_of(schema: str) -> str:
    return "array<struct<" + ",".join(":".join(c.split(" ", 1)) for c in schema.split(", ")) + ">>"


def load_snapshot(spark: SparkSession, path: str | None) -> dict[str, DataFrame] | None:
    """cards, dashboards and relations of a snapshot, and provenance (one row); None without one."""
    if not path or not exists(spark, path):
        return None
    heads = f"{path.rstrip('/')}/heads"
    return _load_folder(spark, path, heads) if exists(spark, heads) else _load_document(spark, path)


def _load_folder(spark: SparkSession, path: str, heads: str) -> dict[str, DataFrame]:
    last = spark.read.schema(_HEAD).json(heads, mode="FAILFAST").orderBy(F.desc("sequence"), "folder").first()
    if last is None:
        raise SnapshotError(f"{heads} has no head")
    _checked(last.schema_version, path)
    out = {name: spark.read.schema(schema).json(f"{path}/{last.folder}/{name}", mode="FAILFAST") for name, schema in TABLES.items()}
    for name, df in out.items():
        if (n := df.count()) != last.counts[name]:
            raise SnapshotError(f"{path}: {name} has {n} rows, the head says {last.counts[name]}")
    return out | {"provenance": spark.createDataFrame([(json.dumps(last.provenance.toPython()) if last.provenance is not None else None,)], "j string").select(F.parse_json("j").alias("provenance"))}


def _load_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    names = ("cards", "dashboards")
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant")).alias(p[2:])
    found = text.select(F.col("v").isNotNull().alias("readable"), kind("$.schema_version"), F.try_variant_get("v", "$.schema_version", "int").alias("version"), *(kind(f"$.{n}") for n in (*names, "relations"))).collect()
    if len(found) != 1 or not found[0].readable:
        raise SnapshotError(f"{path} is no JSON document")
    head = found[0]
    _checked(head.version if head.schema_version == "BIGINT" else head.schema_version, path)
    wrong = [n for n in names if head[n] is not None and not head[n].startswith("ARRAY")] + ["relations"] * (head.relations is not None and not head.relations.startswith("OBJECT"))
    if wrong:
        raise SnapshotError(f"{path}: {', '.join(wrong)} of the wrong shape")
    parsed = lambda n: F.from_json(F.to_json(F.try_variant_get("v", f"$.{n}", "variant")), _rows_of(TABLES[n]))
    out = {n: text.select(F.explode(parsed(n)).alias("r")).select("r.*") for n in names}
    relations = F.from_json(F.to_json(F.try_variant_get("v", "$.relations", "variant")), "map<string,struct<database:string,schema:string,table:string>>")
    out["relations"] = text.select(F.explode(relations).alias("relation", "r")).select("relation", "r.*")
    bad = out["cards"].where("card_id is null").unionByName(out["dashboards"].where("dashboard_id is null"), allowMissingColumns=True)
    if not bad.isEmpty():
        raise SnapshotError(f"{path}: a card or dashboard without a whole id")
    return out | {"provenance": text.select(F.try_variant_get("v", "$.provenance", "variant").alias("provenance"))}


def dump_snapshot(tables: dict[str, DataFrame], path: str, provenance: dict | None = None, version: int = VERSIONS[-1]) -> str:
    """Write cards, dashboards and relations under ``path`` and make them the snapshot there; returns the folder of the data.

    Columns that are missing are null, others are not written.  Writers of one path should take turns.
    """
    _checked(version, path)
    spark = tables["cards"].sparkSession
    path, folder = path.rstrip("/"), f"data-{uuid.uuid4().hex}"
    counts = {}
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        rows = empty.unionByName(tables[name].select(*(c for c in tables[name].columns if c in empty.columns)), allowMissingColumns=True)
        rows.write.json(f"{path}/{folder}/{name}", ignoreNullFields=False)
        counts[name] = spark.read.schema(schema).json(f"{path}/{folder}/{name}").count()
    heads = f"{path}/heads"
    before = spark.read.schema(_HEAD).json(heads).agg(F.max("sequence")).first()[0] if exists(spark, heads) else None
    head = {"schema_version": version, "sequence": (before or 0) + 1, "folder": folder, "counts": counts, "provenance": provenance}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("append").text(heads)
    return folder


def load_policy(spark: SparkSession, path: str | None = None, candidates: tuple[str, ...] = ()) -> dict | None:
    """The policy of a file, checked: the one that is named, which has to be there, else the first candidate that is; None without any.

    JSON, or YAML where its reader is installed.
    """
    if path is not None and not exists(spark, path):
        raise FileNotFoundError(path)
    found = path or next((c for c in candidates if exists(spark, c)), None)
    if found is None:
        return None
    text = spark.read.text(found, wholetext=True).first()
    text = text.value if text else ""
    try:
        try:
            read = json.loads(text)
        except json.JSONDecodeError:
            import yaml

            read = yaml.safe_load(text)
    except ImportError:
        raise ValueError(f"{found} is no JSON, and there is no reader of YAML") from None
    except Exception as e:
        raise ValueError(f"{found} can't be read: {e}") from None
    if not isinstance(read, dict):
        raise ValueError(f"{found} holds no policy")
    return check(read)
