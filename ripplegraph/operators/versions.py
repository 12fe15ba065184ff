"""A changeset over two versions of a project: one search through both graphs at once.

States are (version, node).  A change starts where its column is: a removed one in the base, any other in the head; nothing leads
from one version to the other.  A change whose column is not in its version is unresolved, and is counted and kept, never
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.graph import severity, typed
from ripplegraph.tables import stash

BASE, HEAD = "base", "head"


def side(kind: Column, has_base: bool = True) -> Column:
    """The version in which a change is followed."""
    return F.when(kind == "removed", BASE).otherwise(HEAD) if has_base else F.lit(HEAD)


def starts(changes: DataFrame, nodes: DataFrame, has_base: bool = True) -> DataFrame:
    """``changes`` (key, node, kind, ...) with version and resolved; ``nodes`` is (version, node)."""
    if "node_kind" in changes.columns and "node_kind" in nodes.columns:
        nodes = nodes.where(F.col("node_kind").isin([r.node_kind for r in changes.select("node_kind").distinct().collect()]))
    known = nodes.select("version", "node").distinct().withColumn("resolved", F.lit(True))
    return changes.withColumn("version", side(F.col("kind"), has_base)).join(known, ["version", "node"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def ends(edges: DataFrame) -> DataFrame:
    """(version, node, node_kind) of every end of ``typed`` edges."""
    end = lambda c: edges.select("version", F.col(c).alias("node"), F.col(f"{c}_kind").alias("node_kind"))
    return end("src").unionByName(end("dst"))


def product_reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, version, node, level, severity): what each key's seeds (key, version, node) reach, seeds at level 0.

    ``edges`` is (version, src, dst, transformation); of ``typed`` ones, with seeds that have a ``node_kind``, a round reads those alone that
    lead out of a kind in the frontier.  Every edge out of a reached node is walked once, and the walk itself keeps
    the most severe edge into each node, so edges and results are not joined again afterwards.
    """
    if not typed(edges):
        edges, seeds = edges.withColumns({"src_kind": F.lit("node"), "dst_kind": F.lit("node")}), seeds.withColumn("node_kind", F.lit("node"))
    edges = edges.select("version", "src", "dst", "src_kind", "dst_kind", severity(F.col("transformation")).alias("s"))
    keys = ["key", "version", "node", "node_kind"]
    frontier = stash(seeds.select(*keys).distinct().withColumn("level", F.lit(0)))
    visited, walked, level = frontier, None, 0
    while kinds := [r.node_kind for r in frontier.select("node_kind").distinct().collect()]:
        level += 1
        out = edges.where(F.col("src_kind").isin(kinds))
        step = frontier.select("key", "version", F.col("node").alias("src")).join(out, ["version", "src"])
        step = stash(step.groupBy("key", "version", F.col("dst").alias("node"), F.col("dst_kind").alias("node_kind")).agg(F.max("s").alias("severity")))
        walked = step if walked is None else walked.unionByName(step)
        frontier = stash(step.join(visited, keys, "left_anti").select(*keys, F.lit(level).alias("level")))
        visited = visited.unionByName(frontier)
    visited = visited.drop("node_kind")
    if walked is None:
        return visited.withColumn("severity", F.lit(None).cast("int"))
    worst = walked.groupBy("key", "version", "node").agg(F.max("severity").alias("severity"))
    return visited.join(worst, ["key", "version", "node"], "left")


def changeset_reach(changes: DataFrame, nodes: DataFrame, edges: DataFrame, exposures: DataFrame, has_base: bool = True) -> tuple[DataFrame, DataFrame]:
    """(changes with version and resolved, what they reach).

    The second table is (key, version, node, reached_kind, level, severity): nodes other than the change's own, and exposures one
    level beyond the nearest node (or the change itself) that they show.  ``exposures`` is (version, node, exposure).
    """
    begun = stash(starts(changes, nodes, has_base))
    found = stash(product_reach(edges, begun.where("resolved")))
    inner = found.where("level > 0").select("key", "version", "node", F.lit("node").alias("reached_kind"), "level", "severity")
    shown = found.join(exposures.select("version", "node", "exposure").distinct(), ["version", "node"])
    shown = shown.groupBy("key", "version", F.col("exposure").alias("node")).agg((F.min("level") + 1).alias("level"))
    return begun, inner.unionByName(shown.select("key", "version", "node", F.lit("exposure").alias("reached_kind"), "level", F.lit(None).cast("int").alias("severity")))


def by_change(begun: DataFrame, reached: DataFrame) -> DataFrame:
    """A row per change: resolved, and how many nodes, derived nodes and exposures it reaches (null if unresolved)."""
    counts = reached.groupBy("key").agg(F.count_if(F.col("reached_kind") == "node").alias("n_nodes"), F.count_if(F.col("severity") == 3).alias("n_derived"), F.count_if(F.col("reached_kind") == "exposure").alias("n_exposures"))
    n = lambda c: F.when(F.col("resolved"), F.coalesce(c, F.lit(0))).alias(c)
    return begun.select("key", "kind", "version", "resolved").join(counts, "key", "left").select("key", "kind", "version", "resolved", n("n_nodes"), n("n_derived"), n("n_exposures"))


def affected(reached: DataFrame) -> DataFrame:
    """(reached_kind, node, severity, n_changes): each thing once, whatever the version and number of changes, with its worst edge."""
    return reached.groupBy("reached_kind", "node").agg(F.max("severity").alias("severity"), F.count_distinct("key").alias("n_changes"))
