"""Project artifacts (manifest and catalog JSON) as DataFrames.

Readers are tolerant of missing fields and loud about a missing file.  Names are lower-cased; of nodes with
one name the first in the file counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NODE = """struct<name:string,resource_type:string,schema:string,database:string,package_name:string,language:string,path:string,
original_file_path:string,compiled_path:string,compiled_code:string,compiled_sql:string,relation_name:string,description:string,
tags:array<string>,meta:variant,config:variant,columns:map<string,struct<name:string,description:string,meta:variant,config:variant>>,
depends_on:struct<nodes:array<string>,macros:array<string>>,column_name:string,attached_node:string,
test_metadata:struct<name:string,kwargs:struct<column_name:string,to:string,field:string>>>""".replace("\n", "")
_SOURCE = "struct<name:string,source_name:string,identifier:string,schema:string,database:string>"
_EXPOSURE = "struct<name:string,type:string,url:string,description:string,depends_on:struct<nodes:array<string>>,original_file_path:string>"
MANIFEST = f"metadata struct<adapter_type:string,generated_at:string,invocation_id:string>, nodes map<string,{_NODE}>, sources map<string,{_SOURCE}>, macros map<string,struct<original_file_path:string,depends_on:struct<macros:array<string>>>>, exposures map<string,{_EXPOSURE}>"
_ENTRY = "struct<metadata:struct<name:string,schema:string,database:string,type:string>,name:string,columns:map<string,struct<name:string,type:string,index:int,comment:string>>>"
CATALOG = f"metadata struct<generated_at:string,invocation_id:string>, nodes map<string,{_ENTRY}>, sources map<string,{_ENTRY}>"


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.*")


def ref_target(ref: Column) -> Column:
    """The model that a ref() names: its last quoted token, in lower case."""
    quoted = F.regexp_extract_all(ref, F.lit("['\"]([^'\"]+)['\"]"), 1)
    return F.lower(F.when(F.size(quoted) > 0, F.element_at(quoted, -1)))


def sole(deps: Column) -> Column:
    """The only element, or null: never a guess."""
    return F.when(F.size(deps) == 1, F.element_at(deps, 1))


class Project:
    """The tables of a project's manifest and catalog."""

    def __init__(self, spark: SparkSession, manifest: str, catalog: str | None = None):
        self.manifest = _parsed(spark, manifest, MANIFEST)
        self.catalog = _parsed(spark, catalog, CATALOG) if catalog else None

    def nodes(self) -> DataFrame:
        """unique_id, name and the manifest's fields of models, snapshots and seeds; first of a name."""
        n = self.manifest.select(F.posexplode("nodes").alias("at", "unique_id", "n")).select("at", "unique_id", "n.*").withColumn("name", F.lower("name"))
        kept = n.where(F.col("resource_type").isin("model", "snapshot", "seed"))
        first = F.row_number().over(Window.partitionBy("name").orderBy("at"))
        return kept.withColumn("_n", first).where("_n = 1").drop("_n", "at").withColumn("sql", F.coalesce("compiled_sql", "compiled_code"))

    def node_edges(self) -> DataFrame:
        """parent, child: declared dependencies between models, snapshots, seeds and sources (by identifier)."""
        deps = self.manifest.select(F.explode("nodes").alias("id", "n")).where("n.resource_type in ('model', 'snapshot')").select(F.lower("n.name").alias("child"), F.explode("n.depends_on.nodes").alias("dep"))
        names = self.manifest.select(F.explode("nodes").alias("dep", "n")).where("n.resource_type in ('model', 'snapshot', 'seed')").select("dep", F.lower("n.name").alias("parent"))
        sources = self.manifest.select(F.explode("sources").alias("dep", "s")).select("dep", F.lower(F.coalesce("s.identifier", "s.name")).alias("parent"))
        return deps.join(names.union(sources), "dep").select("parent", "child").distinct()

    def columns(self) -> DataFrame:
        """node, column, data_type, description: the catalog's columns; the manifest's description wins unless empty."""
        nodes = self.catalog.select(F.explode("nodes").alias("id", "c")).union(self.catalog.select(F.explode("sources").alias("id", "c")))
        name = F.lower(F.coalesce("c.metadata.name", "c.name", F.element_at(F.split("id", r"\."), -1)))
        cols = nodes.select(name.alias("node"), F.explode("c.columns").alias("k", "v")).select("node", F.lower(F.coalesce("v.name", "k")).alias("column"), F.col("v.type").alias("data_type"), F.col("v.comment").alias("comment"))
        said = self.manifest.select(F.explode("nodes").alias("id", "n")).select(F.lower("n.name").alias("node"), F.explode("n.columns").alias("k", "v")).select("node", F.lower("k").alias("column"), F.nullif(F.col("v.description"), F.lit("")).alias("said"))
        return cols.join(said.dropDuplicates(["node", "column"]), ["node", "column"], "left").select("node", "column", "data_type", F.coalesce("said", "comment").alias("description"))

    def tests(self) -> DataFrame:
        """test_id, test, model, column, ref_model, ref_column of generic tests; a target that isn't certain is null."""
        t = self.manifest.select(F.explode("nodes").alias("test_id", "n")).where("n.resource_type = 'test' and n.test_metadata.name is not null")
        models = F.filter("n.depends_on.nodes", lambda x: F.startswith(x, F.lit("model.")))
        target = F.coalesce(F.col("n.attached_node"), sole(models))
        kw = "n.test_metadata.kwargs"
        return t.select("test_id", F.col("n.test_metadata.name").alias("test"), F.lower(F.element_at(F.split(target, r"\."), -1)).alias("model"), F.lower(F.coalesce("n.column_name", f"{kw}.column_name")).alias("column"), ref_target(F.col(f"{kw}.to")).alias("ref_model"), F.lower(f"{kw}.field").alias("ref_column"))

    def exposures(self) -> DataFrame:
        """exposure, type, node: what each exposure depends on."""
        e = self.manifest.select(F.explode("exposures").alias("id", "e")).select(F.col("e.name").alias("exposure"), F.col("e.type").alias("type"), F.explode("e.depends_on.nodes").alias("dep"))
        return e.select("exposure", "type", F.lower(F.element_at(F.split("dep", r"\."), -1)).alias("node"))

    def macro_edges(self) -> DataFrame:
        """src, dst: a macro and the macro or node that calls it."""
        macros = self.manifest.select(F.explode("macros").alias("dst", "m")).select(F.explode("m.depends_on.macros").alias("src"), "dst")
        nodes = self.manifest.select(F.explode("nodes").alias("dst", "n")).select(F.explode("n.depends_on.macros").alias("src"), "dst")
        return macros.union(nodes)

    def meta(self, path: str, kind: str = "string") -> DataFrame:
        """node, value at a JSON path of the meta data; the config's own wins."""
        get = lambda c: F.try_variant_get(F.col(c), path, kind)
        inner = "$.meta" + path[1:]
        return self.nodes().select(F.col("name").alias("node"), F.coalesce(F.try_variant_get("config", inner, kind), get("meta")).alias("value"))

    def universe(self) -> DataFrame:
        """node, origin, in_catalog: the manifest's nodes, and the catalog's sources that share no name with one."""
        own = self.nodes().select(F.col("name").alias("node"))
        sources = self.manifest.select(F.explode("sources").alias("id", "s")).select(F.lower(F.coalesce("s.identifier", "s.name")).alias("node"))
        return merged_universe(own, sources, self.columns().select("node"))


def compiled_files(spark: SparkSession, target: str) -> DataFrame:
    """path (below ``target``/compiled, or as listed) and sql of every compiled file that has any."""
    files = spark.read.text(f"{target}/compiled", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql")
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"/compiled/(.*)$", 1).alias("path"), F.col("value").alias("sql"))


def resolve_compiled(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(name, sql, origin): the compiled SQL of each node; origin is embedded, path, layout, package or name, null without any.

    ``nodes`` has name, sql (embedded), compiled_path, package_name, original_file_path; ``files`` path below the compiled folder and sql.
    Tried in turn: what the manifest holds; the path that it names; package and original path; the only file of that name in the
    package; the only one anywhere.  Of several files nothing is guessed.
    """
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    named = F.nullif(F.regexp_replace("compiled_path", r"^.*?(?:^|/)compiled/", ""), F.lit(""))
    layout = F.concat_ws("/", "package_name", "original_file_path")
    wanted = nodes.select("name", "sql", F.filter(F.array(F.struct(F.lit(1).alias("rank"), named.alias("path")), F.struct(F.lit(2).alias("rank"), F.when(F.col("package_name").isNotNull() & F.col("original_file_path").isNotNull(), layout).alias("path"))), lambda x: x["path"].isNotNull()).alias("paths"), "package_name", base("original_file_path").alias("file"))
    sole = lambda by: files.select("path", "sql", base("path").alias("file"), F.split("path", "/")[0].alias("package_name")).groupBy(*by).agg(F.count("*").alias("n"), F.max("sql").alias("found")).where("n = 1").drop("n")
    exact = wanted.select("name", F.explode("paths").alias("p")).join(files.withColumnRenamed("sql", "found"), F.col("p.path") == files["path"]).select("name", "p.rank", "found")
    loose = wanted.where("file <> ''").select("name", "package_name", "file")
    scoped = loose.join(sole(["package_name", "file"]), ["package_name", "file"]).select("name", F.lit(3).alias("rank"), "found")
    anywhere = loose.join(sole(["file"]), "file").select("name", F.lit(4).alias("rank"), "found")
    best = exact.unionByName(scoped).unionByName(anywhere).groupBy("name").agg(F.min(F.struct("rank", "found")).alias("b"))
    embedded = F.nullif("sql", F.lit("")).isNotNull()
    rank = F.col("b.rank")
    origin = F.when(rank == 1, "path").when(rank == 2, "layout").when(rank == 3, "package").when(rank == 4, "name")
    return wanted.join(best, "name", "left").select("name", F.when(embedded, F.col("sql")).otherwise(F.col("b.found")).alias("sql"), F.when(embedded, "embedded").otherwise(origin).alias("origin"))


def test_index(tests: DataFrame) -> DataFrame:
    """(model, column, test_id, side): own, referenced (the other side of a relationship), model (no column) or unattributable.

    ``tests`` is what ``Project.tests`` returns.
    """
    known = F.col("model").isNotNull()
    side = F.when(~known, "unattributable").when(F.col("column").isNull(), "model").otherwise("own")
    own = tests.select("model", "column", "test_id", side.alias("side"))
    other = tests.where("ref_model is not null and ref_column is not null").select(F.col("ref_model").alias("model"), F.lower("ref_column").alias("column"), "test_id", F.lit("referenced").alias("side"))
    return own.unionByName(other).distinct()


def merged_universe(own: DataFrame, sources: DataFrame, cataloged: DataFrame) -> DataFrame:
    """node, origin (manifest or source), in_catalog: a source that shares its name with a node is that node."""
    others = sources.select("node").distinct().join(own.select("node"), "node", "left_anti").select("node", F.lit("source").alias("origin"))
    known = cataloged.select("node").distinct().withColumn("in_catalog", F.lit(True))
    both = own.select("node", F.lit("manifest").alias("origin")).unionByName(others)
    return both.join(known, "node", "left").withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))


def saved_changes(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, model, column, kind, detail, semantic of saved changesets in any of the three envelopes."""
    change = "array<struct<model:string,column:string,kind:string,detail:string,semantic:string>>"
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    plain = F.from_json("value", change)
    inner = F.from_json("value", f"changes {change}, changeset struct<changes:{change}>")
    found = F.when(F.ltrim("value").startswith("["), plain).otherwise(F.coalesce(inner["changes"], inner["changeset"]["changes"]))
    checked = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no changes in "), "file"))).otherwise(found)
    return rows.select("file", F.posexplode(checked).alias("ordinal", "c")).select("file", "ordinal", "c.*")
