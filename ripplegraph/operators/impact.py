"""What a change reaches, how sure that is, and what has to be rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the ways in which a change arrives.
MECHANISM = {"derived": "derived_recompute", "filter": "rowset_filter", "renamed": "renamed_passthrough", "direct": "direct_passthrough"}


def mechanism(transformation: Column) -> Column:
    """The label of an edge's transformation; unknown ones stay as they are."""
    out = transformation
    for k, v in MECHANISM.items():
        out = F.when(transformation == k, v).otherwise(out)
    return out


def predicate_only(predicates: DataFrame, values: DataFrame) -> DataFrame:
    """Uses of a column that are in predicates alone: (src, dst) of ``predicates`` without a value edge."""
    return predicates.select("src", "dst").distinct().join(values.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def rowset_dependents(reached: DataFrame, predicates: DataFrame, values: DataFrame) -> DataFrame:
    """(dst, src, n_sources): models whose rows depend on a reached column (column src) while no value of theirs does.

    The first column in order stands for the model.
    """
    uses = predicate_only(predicates, values).join(reached.select("src").distinct(), "src", "left_semi")
    valued = values.join(reached.select("src").distinct(), "src", "left_semi").select("dst").distinct()
    return uses.join(valued, "dst", "left_anti").groupBy("dst").agg(F.min("src").alias("src"), F.count("*").alias("n_sources"))


def rowset_reach(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): models whose rows depend on a change (``direct`` has node), and all that is built from them.

    Other rows in a model are other rows in everything downstream, whichever columns that reads.
    """
    from ripplegraph.operators.graph import bfs_levels

    return bfs_levels(edges, direct.select(F.lit(0).alias("key"), "node")).groupBy("node").agg(F.min("level").alias("level"))


def column_impact(values: DataFrame, rowset: DataFrame, exposures: DataFrame) -> DataFrame:
    """(key, node, mechanism, level): one result for all that a column reaches.

    ``values`` has key, node, level, transformation; ``rowset`` key, node, level; ``exposures`` src, dst.  A node that a
    value reaches is no row-set dependent as well; exposures of any reached node are added one level further.
    """
    v = values.select("key", "node", mechanism(F.col("transformation")).alias("mechanism"), "level")
    r = rowset.join(v.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", F.lit(MECHANISM["filter"]).alias("mechanism"), "level")
    both = v.unionByName(r)
    e = both.join(exposures.select(F.col("src").alias("node"), "dst"), "node").groupBy("key", F.col("dst").alias("node")).agg((F.min("level") + 1).alias("level"))
    return both.unionByName(e.select("key", "node", F.lit("exposure").alias("mechanism"), "level"))


def changeset_impact(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, node, level, transformation): reached nodes with the most severe edge from another reached node."""
    from ripplegraph.operators.graph import severity

    into = edges.join(reached.select("key", F.col("node").alias("src")), "src")
    worst = into.groupBy("key", F.col("dst").alias("node")).agg(F.max_by("transformation", severity(F.col("transformation"))).alias("transformation"))
    return reached.where("level > 0").join(worst, ["key", "node"])


def partition_status(opaque: Column, has_columns: Column, unresolved: Column, catalog: Column, parse_failed: Column) -> Column:
    """opaque, partial_edges, catalog_backed, parsed, parse_failed or no_column_info, the first that holds."""
    return (
        F.when(opaque, "opaque")
        .when(has_columns & unresolved, "partial_edges")
        .when(has_columns & catalog, "catalog_backed")
        .when(has_columns, "parsed")
        .when(parse_failed, "parse_failed")
        .otherwise("no_column_info")
    )


def confidence(resolution: DataFrame, by: list[str], unsure: Column | None = None) -> DataFrame:
    """Counts per status and a level: full if every model is resolved and no logic is ``unsure``, else partial.

    A status that is null or has no name here is not resolved.
    """
    unsure = F.lit(False) if unsure is None else F.coalesce(unsure, F.lit(True))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("catalog_backed", "parsed", "partial_edges", "opaque", "parse_failed", "no_column_info")]
    weak = F.count_if(~F.coalesce(F.col("status").isin("catalog_backed", "parsed"), F.lit(False)) | unsure)
    return resolution.groupBy(*by).agg(*counts, F.count_if(unsure).alias("n_indeterminate_logic"), F.count("*").alias("n_total"), F.when(weak == 0, "full").otherwise("partial").alias("level"))


def selection(edited: DataFrame, reached: DataFrame, unsure: DataFrame, universe: DataFrame, widen: bool) -> DataFrame:
    """(node, status): rebuild or skippable, for every reachable or edited node.

    Edited nodes, those that a change other than an addition reaches, and those that can't be analysed are
    rebuilt; when anything is unproven (``widen``) all are.
    """
    must = edited.select("node").union(reached.where("not additive").select("node")).union(unsure.select("node")).distinct().withColumn("must", F.lit(True))
    all_ = universe.select("node").union(edited.select("node")).distinct()
    status = F.lit("rebuild") if widen else F.when(F.col("must"), "rebuild").otherwise("skippable")
    return all_.join(must, "node", "left").select("node", status.alias("status"))


def ranked_reasons(resolution: DataFrame) -> DataFrame:
    """status, reason, n_models and rank: the most frequent reason of a status first, names decide ties."""
    counted = resolution.groupBy("status", "reason").agg(F.count("*").alias("n_models"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("n_models"), "reason")))


def coverage(nodes: DataFrame, names: int = 25) -> DataFrame:
    """One row: known, catalog-backed and missing nodes, the first missing names, and whether all are there.

    ``nodes`` has name, in_catalog.  The list of names is a report and capped; the counts are not.
    """
    first = [r.name for r in nodes.where("not in_catalog").orderBy("name").limit(names).collect()]
    counts = nodes.agg(F.count("*").alias("n_models"), F.count_if("in_catalog").alias("n_catalog"), F.count_if(~F.col("in_catalog")).alias("n_missing"))
    return counts.withColumn("missing_names", F.lit(",".join(first) or None)).withColumn("complete", F.col("n_missing") == 0)


def reshaped(columns: DataFrame, models: DataFrame, exposures: DataFrame) -> DataFrame:
    """(key, reached_kind, name, column, mechanism): what each change reaches, by name, for rules that ask for it.

    ``columns`` is key, model, column, transformation; ``models`` key, model; ``exposures`` key, exposure.  A model has a row for every
    mechanism by which a column of it is reached, and one with a null mechanism if none is.
    """
    none = F.lit(None).cast("string")
    by = columns.select("key", "model", "column", mechanism(F.col("transformation")).alias("mechanism")).distinct()
    cols = by.select("key", F.lit("column").alias("reached_kind"), F.col("model").alias("name"), "column", "mechanism")
    ways = models.select("key", "model").distinct().join(by.select("key", "model", "mechanism").distinct(), ["key", "model"], "left")
    out = cols.unionByName(ways.select("key", F.lit("model").alias("reached_kind"), F.col("model").alias("name"), none.alias("column"), "mechanism"))
    return out.unionByName(exposures.select("key", F.lit("exposure").alias("reached_kind"), F.col("exposure").alias("name"), none.alias("column"), none.alias("mechanism")).distinct())
