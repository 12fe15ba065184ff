"""A graph laid out in layers: every edge leads to a later layer, and neighbours stand near each other.

A node's layer is the length of the longest way to it.  Layers are peeled off: a round takes the nodes whose parents all have
a layer and sends one message along their edges.  Nodes on one cycle share a layer, and only edges among them don't lead on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.operators.fold import strong_components
from ripplegraph.operators.graph import kind_order, typed
from ripplegraph.tables import stash


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, layer of the nodes that lie on no cycle and behind none; ``edges`` are distinct and without loops."""
    need = edges.groupBy("dst").agg(F.count("*").alias("need"))
    edges = stash(edges.join(need, "dst").select("src", "dst", "need"))
    level = 0
    known = stash(nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(level).alias("layer")))
    done, waiting = known, None
    while not known.isEmpty():
        level += 1
        sent = known.join(edges, known["node"] == edges["src"]).groupBy(F.col("dst").alias("node"), "need").agg(F.count("*").alias("n"))
        met = stash((sent if waiting is None else sent.unionByName(waiting)).groupBy("node", "need").agg(F.sum("n").alias("n")))
        known, waiting = met.where("n = need").select("node", F.lit(level).alias("layer")), met.where("n < need")
        done = done.unionByName(known)
    return done


def _by_kind(edges: DataFrame, order: list[tuple[set[str], set[str], bool]]) -> DataFrame:
    found: list[tuple[set[str], DataFrame]] = []
    for kinds, sources, _ in order:
        rows = edges.where(F.col("src_kind").isin(*kinds)).select(F.col("src").alias("node"), F.lit(0).alias("layer"))
        if feeding := [part for k, part in found if k & sources]:
            known = reduce(DataFrame.unionByName, feeding).withColumnRenamed("node", "src")
            into = edges.where(F.col("dst_kind").isin(*kinds)).select("src", F.col("dst").alias("node"))
            rows = rows.unionByName(into.join(known, "src").select("node", (F.col("layer") + 1).alias("layer")))
        found.append((kinds, stash(rows.groupBy("node").agg(F.max("layer").alias("layer")))))
    return reduce(DataFrame.unionByName, [part for _, part in found])


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, layer) of every node; layer 0 has those without parents.

    Of ``typed`` edges whose kinds lead to later kinds alone, kinds get their layers one after the other, each edge once.
    """
    if nodes is None and typed(edges):
        order = kind_order(edges)
        if not any(inner for _, _, inner in order):
            return _by_kind(edges.where("src is not null and dst is not null"), order)
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    nodes = stash((ends if nodes is None else ends.unionByName(nodes.select("node"))).where("node is not null").distinct())
    plain = edges.where("src <> dst")
    done = stash(_peeled(nodes, plain))
    if done.count() == nodes.count():
        return done
    # what is left lies on or behind cycles, each of which becomes one node
    rest = nodes.join(done, "node", "left_anti")
    inner = plain.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi")
    parts = stash(strong_components(stash(inner)))
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    name = lambda c: F.coalesce(f"{c}_c", c).alias(c)
    merged = plain.join(side("src"), "src", "left").join(side("dst"), "dst", "left").select(name("src"), name("dst")).where("src <> dst").distinct()
    named = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    found = _peeled(named.select(F.col("component").alias("node")).distinct(), merged)
    return named.join(found.withColumnRenamed("node", "component"), "component").select("node", "layer")


def _places(rows: DataFrame) -> DataFrame:
    """layer, node, place (from 0 in each layer, by ``key`` and name), ranked by a range sort, so that no layer has to fit one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(rows.repartitionByRange(n, "layer", "key", "node").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("layer", "part").agg(F.count("*").alias("n"))  # a row for each layer and task
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("layer").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = F.row_number().over(Window.partitionBy("layer", "part").orderBy("key", "node")) - 1
    return stash(dealt.withColumn("here", here).join(before, ["layer", "part"]).select("layer", "node", (F.col("before") + F.col("here")).alias("place")))


def ordered(edges: DataFrame, found: DataFrame, sweeps: int = 2) -> DataFrame:
    """(node, layer, place): nodes of a layer by the median place of their neighbours in earlier layers, then in later ones, and so on.

    Names decide at first and between equals; a node without such neighbours keeps its place.
    """
    found = found.select("node", "layer")
    edges = stash(edges.select("src", "dst").where("src <> dst").distinct())
    placed = _places(found.withColumn("key", F.lit(0.0)))
    for k in range(sweeps):
        a, b = ("src", "dst") if k % 2 == 0 else ("dst", "src")
        near = edges.join(placed.select(F.col("node").alias(a), F.col("place").alias("p")), a).groupBy(F.col(b).alias("node")).agg(F.percentile("p", F.lit(0.5)).alias("m"))
        placed = _places(placed.join(near, "node", "left").select("layer", "node", F.coalesce("m", F.col("place").cast("double")).alias("key")))
    return placed.select("node", "layer", "place")


def assembled(columns: DataFrame, exposures: DataFrame, rowsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a drawing: ``id``, ``type``, ``label``; ``source``, ``target``, ``type``.

    ``columns`` is model, column, src_model, src_column (null for a column without sources); ``exposures`` model, exposure: an exposure
    hangs on every column shown of a model it depends on; ``rowsets`` src_model, src_column, model: a model whose rows alone depend on a
    column has one node, unless a column of it is shown.  Nodes and edges are there once; of two types of one edge lineage
    outweighs rowset, and that exposure.
    """
    column = lambda m, c: F.concat_ws("_", F.lit("col"), F.lower(m), F.lower(c))
    own = columns.select(F.lower("model").alias("model"), column("model", "column").alias("id"), F.lower("column").alias("label"))
    up = columns.where("src_column is not null").select(F.lower("src_model").alias("model"), column("src_model", "src_column").alias("id"), F.lower("src_column").alias("label"))
    shown = own.unionByName(up).distinct()
    rows = rowsets.select(F.lower("model").alias("model"), column("src_model", "src_column").alias("source")).join(shown.select("model").distinct(), "model", "left_anti").join(shown.select(F.col("id").alias("source")), "source", "left_semi")
    hung = shown.join(exposures.select(F.lower("model").alias("model"), "exposure").distinct(), "model")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    nodes = shown.select("id", F.lit("column").alias("type"), "label").unionByName(rows.select(named("rowset_", "model").alias("id"), F.lit("rowset").alias("type"), F.col("model").alias("label"))).unionByName(hung.select(named("exposure_", "exposure").alias("id"), F.lit("exposure").alias("type"), F.col("exposure").alias("label"))).distinct()
    links = columns.where("src_column is not null").select(column("src_model", "src_column").alias("source"), column("model", "column").alias("target"), F.lit(0).alias("r"))
    links = links.unionByName(rows.select("source", named("rowset_", "model").alias("target"), F.lit(1).alias("r"))).unionByName(hung.select(F.col("id").alias("source"), named("exposure_", "exposure").alias("target"), F.lit(2).alias("r")))
    types = F.array(*map(F.lit, ("lineage", "rowset", "exposure")))
    return nodes, links.groupBy("source", "target").agg(F.min("r").alias("r")).select("source", "target", F.element_at(types, F.col("r") + 1).alias("type"))
