"""Reachability over edge tables: breadth-first levels, closures, edge choice and upward folds.

Edges are rows (src, dst); seeds are rows (key, node), so one pass serves any number of starts at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.tables import stash


def _kinds(nodes: DataFrame) -> list[str]:
    """The kinds that are there: a few names."""
    return [r.kind for r in nodes.select("kind").distinct().collect()]


def typed(edges: DataFrame) -> bool:
    """Whether edges say what kinds of node they lead between (``src_kind``, ``dst_kind``).

    Each kind is a constant of a part of the edges (a literal in a union, or a partition column), and a node has one kind, so Spark leaves
    the parts that a round can't use out of its plan.
    """
    return "src_kind" in edges.columns


def kind_order(edges: DataFrame, *more: DataFrame) -> list[tuple[set[str], set[str], bool]]:
    """Of ``typed`` edges: (kinds, kinds that lead into them, whether edges lead from these kinds to themselves), each after what leads into it.

    Kinds that lead to each other stand together.  ``more`` are nodes with a kind.  The driver sees pairs of kinds alone.
    """
    pairs = {(r.src_kind, r.dst_kind) for r in edges.select("src_kind", "dst_kind").distinct().collect()}
    kinds = {k for p in pairs for k in p} | {k for df in more for k in _kinds(df)}
    before = {k: {k} for k in kinds}  # what leads to a kind, itself included
    for _ in kinds:
        for a, b in pairs:
            before[b] |= before[a]
    groups = {frozenset(j for j in before[k] if k in before[j]) for k in kinds}
    out = [(set(g), {a for a, b in pairs if b in g} - g, any(a in g and b in g for a, b in pairs)) for g in groups]
    return sorted(out, key=lambda g: (len(before[min(g[0])]), min(g[0])))


def bfs_levels(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, node, level): every node reachable from a key's seeds, with its least distance; seeds have level 0.

    Each round joins the frontier with the edges and drops what was visited, so cycles end.  Rounds are
    written out, and only the frontier is looked at to decide whether to go on.  Of ``typed`` edges, with seeds that have a ``kind``, a round
    reads those alone that lead out of a kind in the frontier.
    """
    if not typed(edges):
        edges, seeds = edges.select("src", "dst", F.lit("node").alias("src_kind"), F.lit("node").alias("dst_kind")), seeds.withColumn("kind", F.lit("node"))
    frontier = stash(seeds.select("key", "node", "kind").distinct().withColumn("level", F.lit(0)))
    visited = frontier
    level = 0
    while kinds := _kinds(frontier):
        level += 1
        out = edges.where(F.col("src_kind").isin(kinds)).select("src", "dst", "dst_kind")
        step = frontier.select("key", F.col("node").alias("src")).join(out, "src").select("key", F.col("dst").alias("node"), F.col("dst_kind").alias("kind")).distinct()
        frontier = stash(step.join(visited, ["key", "node", "kind"], "left_anti").withColumn("level", F.lit(level)))
        visited = visited.unionByName(frontier)
    return visited.select("key", "node", "level")


def layered_levels(layers: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """``bfs_levels`` for edges that are known to lead from one layer to a later one, given in that order.

    One join per layer, no loop and no test for the end; each layer is written out, so none is made twice.  Where edges have a
    ``weight``, the greatest of those into a node comes along.
    """
    heavy = "weight" in layers[0].columns
    most = [F.max("weight").alias("weight")] if heavy else []
    reached = seeds.select("key", "node").withColumn("level", F.lit(0))
    reached = reached.withColumn("weight", F.lit(None).cast("int")) if heavy else reached
    for edges in layers:
        near = reached.groupBy("key", "node").agg(F.min("level").alias("level"))
        step = near.join(edges, near["node"] == edges["src"]).groupBy("key", F.col("dst").alias("node")).agg((F.min("level") + 1).alias("level"), *most)
        reached = reached.unionByName(stash(step))
    return reached.groupBy("key", "node").agg(F.min("level").alias("level"), *most)


def upstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``bfs_levels`` against the edges' direction."""
    turned = [F.col("dst_kind").alias("src_kind"), F.col("src_kind").alias("dst_kind")] if typed(edges) else []
    return bfs_levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *turned), seeds)


def parse_selector(selector: str) -> tuple[bool, str, bool]:
    """(upstream, node, downstream) of ``[+]node[+]``; without a plus both directions are meant."""
    up, down = selector.startswith("+"), selector.endswith("+")
    node = selector.strip().strip("+")
    if not node:
        raise ValueError(f"selector {selector!r} names no node")
    return (up, node, down) if up or down else (True, node, True)


def select(edges: DataFrame, selector: str) -> DataFrame:
    """(node, side, level): what a selector names; side is self, upstream or downstream."""
    up, node, down = parse_selector(selector)
    seeds = edges.sparkSession.range(1).select(F.lit(0).alias("key"), F.lit(node).alias("node"))
    out = seeds.select("node", F.lit("self").alias("side"), F.lit(0).alias("level"))
    for wanted, side, walk in ((up, "upstream", upstream), (down, "downstream", bfs_levels)):
        if wanted:
            out = out.union(walk(edges, seeds).where("level > 0").select("node", F.lit(side), "level"))
    return out


def parse_column_selector(selector: str) -> tuple[bool, str, str | None, bool]:
    """(upstream, model, column, downstream) of ``[+]model[.column][+]``, in lower case; what follows the first dot is the column."""
    up, node, down = parse_selector(selector)
    model, _, column = node.lower().partition(".")
    if not model or node.endswith("."):
        raise ValueError(f"selector {selector!r} names no model or column")
    return up, model, column or None, down


def column_node(model: Column, column: Column) -> Column:
    """A column as a node: model.column in lower case; columns have no dots, models may."""
    return F.concat_ws(".", F.lower(model), F.lower(column))


def column_upstream(edges: DataFrame, declared: DataFrame, models: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, kind, model, column, level): what columns come from; seeds are (key, model, column).

    ``edges`` is model, column, src_model, src_column.  A source is followed (kind column) only if its model is a declared parent (``declared``:
    parent, child) of the reading one.  A reference without a model is a direct_ref, one to a model that isn't known is a
    source; both end there and are reported for every reached column that has them.
    """
    low = [F.lower(c).alias(c) for c in ("model", "column", "src_model", "src_column")]
    edges = edges.select(*low).distinct()
    parents = declared.select(F.lower("parent").alias("src_model"), F.lower("child").alias("model")).distinct()
    walked = edges.join(parents, ["src_model", "model"], "left_semi").select(column_node(F.col("model"), F.col("column")).alias("src"), column_node(F.col("src_model"), F.col("src_column")).alias("dst"))
    start = seeds.select("key", column_node(F.col("model"), F.col("column")).alias("node"))
    found = stash(bfs_levels(walked, start))
    split = lambda n: (F.regexp_extract(n, r"^(.*)\.[^.]*$", 1).alias("model"), F.regexp_extract(n, r"([^.]*)$", 1).alias("column"))
    followed = found.where("level > 0").select("key", F.lit("column").alias("kind"), *split("node"), "level")
    known = models.select(F.lower("model").alias("src_model")).distinct().withColumn("known", F.lit(True))
    ends = edges.join(known, "src_model", "left").where("known is null").select(column_node(F.col("model"), F.col("column")).alias("node"), "src_model", "src_column")
    hit = found.join(ends, "node").groupBy("key", "src_model", "src_column").agg((F.min("level") + 1).alias("level"))
    kind = F.when(F.col("src_model").isNull(), "direct_ref").otherwise("source")
    return followed.unionByName(hit.select("key", kind.alias("kind"), F.col("src_model").alias("model"), F.col("src_column").alias("column"), "level"))


def select_columns(edges: DataFrame, declared: DataFrame, models: DataFrame, selector: str) -> DataFrame:
    """(side, kind, model, column, level) of ``[+]model[.column][+]`` over columns; a model alone means all its columns."""
    up, model, column, down = parse_column_selector(selector)
    ends = edges.select("model", "column").unionByName(edges.where("src_model is not null").select(F.col("src_model").alias("model"), F.col("src_column").alias("column")))
    mine = (F.lower("model") == model) & (F.lower("column") == column if column else F.lit(True))
    seeds = stash(ends.where(mine).select(F.lit(0).alias("key"), F.lower("model").alias("model"), F.lower("column").alias("column")).distinct())
    out = seeds.select(F.lit("self").alias("side"), F.lit("column").alias("kind"), "model", "column", F.lit(0).alias("level"))
    if up:
        out = out.unionByName(column_upstream(edges, declared, models, seeds).select(F.lit("upstream").alias("side"), "kind", "model", "column", "level"))
    if down:
        ways = edges.where("src_model is not null").select(column_node(F.col("src_model"), F.col("src_column")).alias("src"), column_node(F.col("model"), F.col("column")).alias("dst"))
        found = bfs_levels(ways, seeds.select("key", column_node(F.col("model"), F.col("column")).alias("node"))).where("level > 0")
        out = out.unionByName(found.select(F.lit("downstream").alias("side"), F.lit("column").alias("kind"), F.regexp_extract("node", r"^(.*)\.[^.]*$", 1).alias("model"), F.regexp_extract("node", r"([^.]*)$", 1).alias("column"), "level"))
    return out


def immediate(edges: DataFrame) -> DataFrame:
    """Each node's direct dependents: (src, n_dependents)."""
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n_dependents"))


def severity(transformation: Column) -> Column:
    """How much an edge can change what flows along it: derived over renamed over direct."""
    return F.when(transformation == "derived", 3).when(transformation == "renamed", 2).when(transformation == "direct", 1).otherwise(0)


def transformation(weight: Column) -> Column:
    """The edge that a ``severity`` stands for."""
    return F.when(weight == 3, "derived").when(weight == 2, "renamed").when(weight == 1, "direct")


def choose_edge(edges: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Of the edges into the same ``by``, the most severe; of equal ones the one with the least ``tie``."""
    return edges.groupBy(*by).agg(F.max_by(F.struct("transformation", tie), F.struct(severity(F.col("transformation")), -F.col(tie))).alias("e")).select(*by, "e.transformation", f"e.{tie}")


def model_info(nodes: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per model: what ``nodes`` (node, ...) has, with its columns and direct parents and dependents as sorted lists.

    ``columns`` is node, column; ``edges`` parent, child.  The lists are as long as a model has columns and neighbours.
    """
    listed = lambda df, key, value, name: df.groupBy(F.col(key).alias("node")).agg(F.array_sort(F.collect_set(value)).alias(name))
    out = nodes
    for df, key, value, name in ((columns, "node", "column", "columns"), (edges, "child", "parent", "upstream"), (edges, "parent", "child", "downstream")):
        out = out.join(listed(df, key, value, name), "node", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def column_info(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per column: what ``columns`` (model, column, ...) has, and how many direct sources and dependents it has in ``edges``."""
    low = lambda df, m, c, name: df.where(F.col(m).isNotNull()).groupBy(F.lower(m).alias("_m"), F.lower(c).alias("_c")).agg(F.count_distinct(*name[1]).alias(name[0]))
    up = low(edges.where("src_column is not null"), "model", "column", ("n_sources", [F.coalesce("src_model", F.lit("")), F.col("src_column")]))
    down = low(edges, "src_model", "src_column", ("n_dependents", ["model", "column"]))
    out = columns.withColumn("_m", F.lower("model")).withColumn("_c", F.lower("column"))
    return out.join(up, ["_m", "_c"], "left").join(down, ["_m", "_c"], "left").drop("_m", "_c").fillna(0, ["n_sources", "n_dependents"])
