"""Identity of catalogs, and whether two of them can show a difference at all.

A catalog's digest is the root of a Merkle tree: columns, then nodes, then 65,536 leaves by a hash of the node's name, then 256 branches.
Metadata are VARIANTs, whose objects have their keys in order, so the order of a file does not matter.  Two versions are compared
from the root down, and only nodes under branches that differ are ever joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a name's hash that say its branch and its leaf.
BRANCH, LEAF = 2, 4


def canonical(value: Column) -> Column:
    """A text that is the same for equal metadata: absent differs from null."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("v"), F.to_json(value)))


def _digest(*parts: Column) -> Column:
    # each part's length goes before it, so no two lists read alike
    return F.sha2(F.concat(*(F.concat(F.coalesce(F.length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts)), 256)


def _over(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value)), ","), 256).alias("digest"))


def node_digests(columns: DataFrame) -> DataFrame:
    """node, leaf, digest from node, column, data_type and meta (VARIANT); a node without columns has one row with a null column."""
    each = columns.select("node", _digest(F.col("column"), F.col("data_type"), canonical(F.col("meta"))).alias("d"))
    return _over(each, ["node"], "d").select("node", F.substring(F.sha2("node", 256), 1, LEAF).alias("leaf"), _digest(F.col("node"), F.col("digest")).alias("digest"))


def leaf_digests(nodes: DataFrame) -> DataFrame:
    """leaf, digest."""
    return _over(nodes, ["leaf"], "digest")


def fingerprint(leaves: DataFrame) -> DataFrame:
    """One row: the digest of the whole catalog, null for an empty one, which claims no identity."""
    branches = _over(leaves.withColumn("branch", F.substring("leaf", 1, BRANCH)).withColumn("d", _digest(F.col("leaf"), F.col("digest"))), ["branch"], "d")
    top = branches.agg(F.sort_array(F.collect_list(_digest(F.col("branch"), F.col("digest")))).alias("d"))  # 256 at most
    return top.select(F.when(F.size("d") > 0, F.sha2(F.array_join("d", ","), 256)).alias("fingerprint"))


def changed_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """node, kind (added, removed or changed) between two tables of node digests; nodes under equal leaves are not joined."""
    a, b = leaf_digests(base), leaf_digests(head).withColumnRenamed("digest", "other")
    differ = a.join(b, "leaf", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("leaf")
    x = base.join(differ, "leaf", "left_semi").select("node", F.col("digest").alias("b"))
    y = head.join(differ, "leaf", "left_semi").select("node", F.col("digest").alias("h"))
    kind = F.when(F.col("h").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.col("b") != F.col("h"), "changed")
    return x.join(y, "node", "full_outer").select("node", kind.alias("kind")).where("kind is not null")


def stamp(value: Column) -> Column:
    """A time from an artifact's text; null if it is none."""
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[XXX]")), F.try_to_timestamp(value))


def structural_status(stamps: DataFrame) -> DataFrame:
    """status and reason of a structural diff per row: available, degraded or unavailable.

    ``stamps`` has base_nodes and head_nodes (catalog-backed nodes), base_fingerprint and head_fingerprint, and of the head
    catalog_at, catalog_run, manifest_at, manifest_run.  Without a catalog on each side nothing can be compared; one catalog for both
    sides can show no difference; a head catalog that is older than its manifest and of another run describes an older build.  What
    can't be proven is not claimed.
    """
    c = F.col
    same = c("base_fingerprint").isNotNull() & (c("base_fingerprint") == c("head_fingerprint"))
    one_run = c("catalog_run").isNotNull() & c("catalog_run").eqNullSafe(c("manifest_run"))
    stale = ~one_run & F.coalesce(stamp(c("catalog_at")) < stamp(c("manifest_at")), F.lit(False))
    missing = (F.coalesce("base_nodes", F.lit(0)) == 0) | (F.coalesce("head_nodes", F.lit(0)) == 0)
    reason = F.when(missing, "no catalog on a side").when(F.coalesce(same, F.lit(False)), "identical catalogs").when(stale, "stale head catalog")
    return stamps.withColumn("status", F.when(missing, "unavailable").when(reason.isNotNull(), "degraded").otherwise("available")).withColumn("reason", reason)
