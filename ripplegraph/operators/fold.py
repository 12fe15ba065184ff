"""Inherited classifications: values folded down a graph that may have cycles.

A node's own value counts as it is.  Any other node has what a rule makes of its parents' values, and is unknown where
it has no parents.  Parents that wait for the node itself can't be told, so a cycle of nodes without own values adds
one unknown to what comes in from outside, and all its nodes have one value.

A level of the graph is folded at a time, each node once all its parents are known.  What is left then
lies on or behind cycles: strongly connected components are found there alone, by colours that run forward and searches
that run back, and the condensed rest is folded in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.graph import bfs_levels, kind_order, typed
from ripplegraph.tables import stash

#: Fixed values of the lattice: proven not set, not provable, set.
LOW, UNKNOWN, HIGH = 0, 1, 2
#: From the numbers of parents at each level to the node's level.
Rule = Callable[[list[Column]], Column]


def most_restrictive(counts: list[Column]) -> Column:
    """The highest level that some parent has."""
    out = F.lit(UNKNOWN)
    for level, n in enumerate(counts):
        out = F.when(n > 0, level).otherwise(out)
    return out


def least_restrictive(counts: list[Column]) -> Column:
    """The lowest level that some parent has: for keys that one parent is enough to clear."""
    out = F.lit(UNKNOWN)
    for level, n in reversed(list(enumerate(counts))):
        out = F.when(n > 0, level).otherwise(out)
    return out


#: What a key folds with; any other key is folded by ``most_restrictive``.
RULES: dict[str, Rule] = {"pii": most_restrictive, "secret": most_restrictive}


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other, named by the largest of them; nodes on no cycle are left out.

    Each round drops nodes without a way in or out, runs the largest name forward until it settles, and searches back from
    each node that kept its own name, within its colour: what that reaches is a component.
    """
    own = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    left, found = stash(edges.where("src <> dst").select("src", "dst").distinct()), []
    while True:
        while True:
            ends = left.select(F.col("dst").alias("node")).distinct().join(left.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
            kept = stash(left.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            before, left = left.count(), kept
            if before == left.count():
                break
        if left.isEmpty():
            break
        colours = stash(left.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour")))
        risen = colours
        while not risen.isEmpty():
            pushed = risen.join(left, risen["node"] == left["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("pushed"))
            now = stash(colours.join(pushed, "node", "left").select("node", F.greatest("colour", "pushed").alias("colour"), F.coalesce(F.col("pushed") > F.col("colour"), F.lit(False)).alias("rose")))
            colours, risen = now.select("node", "colour"), now.where("rose").select("node", "colour")
        side = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = left.join(side("src"), "src").join(side("dst"), "dst").where("src_colour = dst_colour").select("src", "dst")
        roots = colours.where("node = colour").select(F.col("colour").alias("key"), "node")
        component = stash(bfs_levels(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots).select("node", F.col("key").alias("component")))
        found.append(component)
        left = stash(left.join(component.select(F.col("node").alias("src")), "src", "left_anti").join(component.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    out = own
    for f in found:
        out = out.unionByName(f)
    # a node with an edge to itself may lie on a larger cycle too
    return out.groupBy("node").agg(F.max("component").alias("component"))


def _peel(known: DataFrame, held: DataFrame | None, edges: DataFrame, rule: Rule, levels: int) -> DataFrame:
    """(node, value) of ``known`` and of every node all whose parents are known in turn.

    ``edges`` carry in ``need`` how many values their dst waits for; ``held`` are nodes that have some already.  A
    round touches the nodes of the round before, their edges and the nodes that wait with a part of their values.
    """
    names = [f"n{k}" for k in range(levels)]
    zero = known.sparkSession.createDataFrame([], f"node {known.schema['node'].dataType.simpleString()}, need long, " + ", ".join(f"{n} long" for n in names))
    done, waiting = known, held if held is not None else zero
    value = rule([F.col(n) for n in names]).cast("int")
    first = True
    while first or not known.isEmpty():
        first = False
        sent = known.join(edges, known["node"] == edges["src"]).groupBy(F.col("dst").alias("node"), "need").agg(*(F.count_if(F.col("value") == k).alias(n) for k, n in enumerate(names)))
        met = stash(waiting.unionByName(sent).groupBy("node", "need").agg(*(F.sum(n).alias(n) for n in names)))
        full = sum((F.col(n) for n in names[1:]), F.col(names[0])) == F.col("need")
        known, waiting = met.where(full).select("node", value.alias("value")), met.where(~full)
        done = done.unionByName(known)
    return done


def fold(edges: DataFrame, own: DataFrame, rule: Rule = most_restrictive, levels: int = 3) -> DataFrame:
    """(node, value) of every node: its own value, or what ``rule`` makes of its parents' values.

    ``own`` is (node, value), value null where it is to be inherited; a node on an edge that is not in it inherits too, and of
    several own values of a node the highest counts.  Values are whole numbers below ``levels``.  Of ``typed`` edges, with ``own`` that has a
    ``kind``, kinds are folded one after the other, each edge once; levels are peeled only within kinds that lead to each other.
    """
    if not typed(edges):
        return _fold(edges, own, rule, levels)
    own = own.where("node is not null").select("node", F.col("value").cast("int").alias("value"), "kind")
    edges = edges.where("src is not null and dst is not null")
    found: list[tuple[set[str], DataFrame]] = []
    for kinds, sources, inner in kind_order(edges, own):
        into = edges.where(F.col("dst_kind").isin(*kinds)).select("src", "dst")
        mine = own.where(F.col("kind").isin(*kinds)).select("node", "value")
        mine = mine.unionByName(edges.where(F.col("src_kind").isin(*kinds)).select(F.col("src").alias("node"), F.lit(None).cast("int").alias("value")))
        feeding = [part for k, part in found if k & sources]
        known = reduce(DataFrame.unionByName, feeding) if feeding else None
        if inner:
            part = _fold(into, mine if known is None else mine.unionByName(known), rule, levels)
            part = part if known is None else part.join(known.select("node"), "node", "left_anti")
        else:
            part = _folded_once(into, mine, known, rule, levels)
        found.append((kinds, stash(part)))
    return reduce(DataFrame.unionByName, [part for _, part in found]) if found else own.select("node", "value")


def _folded_once(into: DataFrame, mine: DataFrame, known: DataFrame | None, rule: Rule, levels: int) -> DataFrame:
    """(node, value) of ``mine`` and of what ``into`` leads to, where all sources are ``known``."""
    rows = mine.select("node", "value", F.lit(None).cast("int").alias("from"))
    if known is not None:
        # dealt by source, edges are made distinct and joined without a second shuffle
        sent = into.repartition("src").distinct().join(known.select(F.col("node").alias("src"), F.col("value").alias("from")), "src")
        rows = rows.unionByName(sent.select(F.col("dst").alias("node"), F.lit(None).cast("int").alias("value"), "from"))
    counts = [F.count_if(F.col("from") == k).alias(f"n{k}") for k in range(levels)]
    all_ = rows.groupBy("node").agg(F.max("value").alias("value"), *counts)
    return all_.select("node", F.coalesce("value", rule([F.col(f"n{k}") for k in range(levels)]).cast("int")).alias("value"))


def _fold(edges: DataFrame, own: DataFrame, rule: Rule, levels: int) -> DataFrame:
    """``fold`` by peeled levels and strong components."""
    edges = stash(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit(None).cast("int").alias("value"))
    nodes = stash(own.where("node is not null").select("node", F.col("value").cast("int").alias("value")).unionByName(ends).groupBy("node").agg(F.max("value").alias("value")))
    free = nodes.where("value is null").select("node")
    into = edges.join(free.withColumnRenamed("node", "dst"), "dst", "left_semi")
    need = into.groupBy("dst").agg(F.count("*").alias("need"))
    into = stash(into.join(need, "dst").select("src", "dst", "need"))
    none = [F.lit(0)] * levels
    roots = free.join(into.select(F.col("dst").alias("node")), "node", "left_anti").select("node", rule(none).cast("int").alias("value"))
    known = stash(nodes.where("value is not null").unionByName(roots))
    done = _peel(known, None, into, rule, levels)
    done = stash(done)
    rest = stash(nodes.select("node").join(done, "node", "left_anti"))
    if rest.isEmpty():
        return done
    behind = into.join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi")
    parts = stash(strong_components(behind.join(rest.withColumnRenamed("node", "src"), "src", "left_semi")))
    name = lambda c: F.coalesce(f"{c}_c", c).alias(c)
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    inner = behind.select("src", "dst").join(side("src"), "src", "left").join(side("dst"), "dst", "left").select(name("src"), name("dst")).where("src <> dst").distinct()
    cyclic = parts.select(F.col("component").alias("dst")).distinct().withColumn("cycle", F.lit(1))
    need = inner.groupBy("dst").agg(F.count("*").alias("n")).join(cyclic, "dst", "full_outer").select("dst", (F.coalesce("n", F.lit(0)) + F.coalesce("cycle", F.lit(0))).alias("need"), F.col("cycle").isNotNull().alias("cyclic"))
    need = stash(need)
    inner = stash(inner.join(need, "dst").select("src", "dst", "need"))
    held = need.where("cyclic").select(F.col("dst").alias("node"), "need", *(F.lit(int(k == UNKNOWN)).cast("long").alias(f"n{k}") for k in range(levels)))
    at_hand = done.join(inner.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    late = _peel(stash(at_hand), held, inner, rule, levels).withColumnRenamed("node", "component")
    named = rest.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return done.unionByName(named.join(late, "component").select("node", "value"))


def fold_keys(edges: DataFrame, own: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None) -> DataFrame:
    """(key, node, value) for each of ``keys``, folded by its own rule; ``own`` is (key, node, value)."""
    rules = RULES if rules is None else rules
    out = None
    for key in keys:
        part = fold(edges, own.where(F.col("key") == key).drop("key"), rules.get(key.lower(), most_restrictive)).select(F.lit(key).alias("key"), "node", "value")
        out = part if out is None else out.unionByName(part)
    return out
