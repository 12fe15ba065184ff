"""Differences between two versions of a project, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions.text import READINGS, compared, let, same_code, signature, unreadable

#: Which of several changes of one column is reported.
PRIORITY = {"removed": 5, "type_changed": 4, "logic_changed": 3, "added": 1}


def priority(kind: Column) -> Column:
    out = F.lit(0)
    for k, v in PRIORITY.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def keyed_diff(base: DataFrame, head: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, kind, base_value, head_value of every key that is added, removed, or has another value.

    Values differ if both are there and not equal without regard to case.
    """
    b = base.select(*keys, F.col(value).alias("base_value"), F.lit(True).alias("_b"))
    h = head.select(*keys, F.col(value).alias("head_value"), F.lit(True).alias("_h"))
    differ = F.lower("base_value") != F.lower("head_value")
    kind = F.when(F.col("_h").isNull(), "removed").when(F.col("_b").isNull(), "added").when(differ, "type_changed")
    return b.join(h, keys, "full_outer").withColumn("kind", kind).where("kind is not null").drop("_b", "_h")


def dedup_changes(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One change per key: the highest priority, the first recorded among equals."""
    best = F.max_by(F.struct("kind", order), F.struct(priority(F.col("kind")), -F.col(order)))
    return changes.groupBy(*keys).agg(best.alias("c")).select(*keys, "c.kind", f"c.{order}")


def by_kind(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("n_changes"))


def logic_status(base_sql: Column, head_sql: Column, is_model: Column, dialect: str | None = None) -> Column:
    """changed, unchanged or indeterminate: a model without SQL on a side can't be told, other nodes have none.

    What isn't proven to be the same has changed.
    """
    missing = base_sql.isNull() | head_sql.isNull()
    return F.when(missing & is_model, "indeterminate").when(missing, "unchanged").when(same_code(base_sql, head_sql, dialect), "unchanged").otherwise("changed")


def indeterminate_columns(models: DataFrame, columns: DataFrame) -> DataFrame:
    """A logic change per head column of a model that can't be compared, or one on ``*`` if it has no columns."""
    return models.join(columns, "model", "left").select("model", F.coalesce("column", F.lit("*")).alias("column"), F.lit("logic_changed").alias("kind"), F.lit("indeterminate").alias("semantic"))


def signatures(edges: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """keys and sig: the sorted branches of a column's derivation."""
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("sig"))


def changed_signatures(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the head side whose signature differs; base_missing where there was none."""
    b = base.select(*keys, F.col("sig").alias("base_sig"))
    return head.join(b, keys, "left").where(~F.col("sig").eqNullSafe(F.col("base_sig"))).select(*keys, F.col("base_sig").isNull().alias("base_missing"))


def attach_overrides(changes: DataFrame, overrides: DataFrame) -> DataFrame:
    """``changes`` with verb and line of the override that covers them.

    An override without a column covers its whole model.  allow-break outweighs allow-change, else the last
    line counts.
    """
    best = lambda df, keys, name: df.groupBy(*keys).agg(F.max(F.struct((F.col("verb") == "break").alias("b"), "line", "verb")).alias(name))
    whole = best(overrides.where("column is null"), ["model"], "_w")
    own = best(overrides.where("column is not null"), ["model", "column"], "_o")
    # one row of each kind per change, so that a model with many overrides and many changes makes no pairs of them
    out = changes.join(whole, "model", "left").join(own, ["model", "column"], "left").withColumn("o", F.greatest("_w", "_o"))
    return out.withColumn("verb", F.col("o.verb")).withColumn("line", F.col("o.line")).drop("_w", "_o", "o")


def stale_overrides(changes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that cover no change."""
    whole = overrides.where("column is null").join(changes.select("model").distinct(), "model", "left_anti")
    own = overrides.where("column is not null").join(changes.select("model", "column").distinct(), ["model", "column"], "left_anti")
    return whole.unionByName(own).select(*overrides.columns)


def git_scope(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Each changed file as model, macro, logic (touches logic but maps to no node: scoping is off) or ignorable.

    ``files`` has file; ``paths`` has file, node and resource ('model' or 'macro').
    """
    scope = F.when(F.col("resource") == "macro", "macro").when(F.col("resource").isNotNull(), "model").when(F.col("file").rlike(r"\.(sql|py|ya?ml)$"), "logic").otherwise("ignorable")
    return files.join(paths, "file", "left").select("file", "node", scope.alias("scope"))


def compare_expressions(base: Column, head: Column, dialect: str | None = None) -> Column:
    """equivalent, indeterminate or meaning_changed; a side that is empty or unreadable can't be told, nor what readings disagree on.

    Two sides without an expression are equivalent.
    """
    same = compared(F.coalesce(base, F.lit("")), F.coalesce(head, F.lit("")), dialect)
    return let(same, lambda x: F.when(x, "equivalent").when(x.isNull(), "indeterminate").otherwise("meaning_changed"))


def _empty(x: Column) -> Column:
    return F.size(signature(x, READINGS[0])) == 0


def classify_changes(base: DataFrame, head: DataFrame, keys: list[str], expression: str, dialect: str | None = None) -> DataFrame:
    """(keys, semantic) of the keys whose derivation differs between two tables with a row per branch.

    One branch on each side is compared as an expression; an unreadable or missing expression anywhere makes it
    indeterminate; several branches that differ have another meaning.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.coalesce(expression, F.lit("")))).alias(name))
    both = side(base, "_b").join(side(head, "_h"), keys)
    poor = lambda xs: F.exists(xs, lambda x: _empty(x) | unreadable(x, dialect))
    one = (F.size("_b") == 1) & (F.size("_h") == 1)
    # branches in order of their texts: a pair that can't be told is not alike
    pairs = F.zip_with("_b", "_h", lambda x, y: F.coalesce(same_code(x, y, dialect), F.lit(False)))
    alike = (F.size("_b") == F.size("_h")) & F.forall(pairs, lambda x: x)
    semantic = F.when(one, compare_expressions(F.col("_b")[0], F.col("_h")[0], dialect)).when(poor(F.col("_b")) | poor(F.col("_h")), "indeterminate").otherwise("meaning_changed")
    return both.where(~alike | poor(F.col("_b")) | poor(F.col("_h"))).select(*keys, semantic.alias("semantic"))


def unattributed(models: DataFrame, explained: DataFrame, columns: DataFrame) -> DataFrame:
    """Logic changes of models whose SQL changed with no column to explain it: each head column, indeterminate.

    ``models`` has model, base_sql and head_sql; a model whose whole statement reads the same has none.
    """
    same = compare_expressions(F.col("base_sql"), F.col("head_sql")) == "equivalent"
    return indeterminate_columns(models.where(~same).join(explained.select("model").distinct(), "model", "left_anti").select("model"), columns)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def logic_changed_columns(models: DataFrame, columns: DataFrame, base: DataFrame, head: DataFrame, dialect: str | None = None) -> DataFrame:
    """(model, column, semantic): output columns of models whose SQL changed that are derived in another way.

    ``models`` has model; ``columns`` model, column of the head; ``base`` and ``head`` a row per branch: model, column, transformation,
    expression, source.  Of a model that neither side could read, every column is indeterminate.  A column that one side alone
    could read has another meaning, and one that neither could is left out.  Branches are equal if transformation and source are and the
    expressions are the same code; one that can't be read makes its column indeterminate.
    """
    branch = F.struct(F.coalesce("transformation", F.lit("")).alias("t"), F.coalesce("source", F.lit("")).alias("s"), F.coalesce("expression", F.lit("")).alias("x"))
    side = lambda df, name: df.join(models.select("model").distinct(), "model", "left_semi").groupBy("model", "column").agg(F.array_sort(F.collect_list(branch)).alias(name))
    b, h = side(base, "_b"), side(head, "_h")
    read = b.select("model").union(h.select("model")).distinct().withColumn("read", F.lit(True))
    rows = columns.select("model", "column").distinct().join(models.select("model").distinct(), "model", "left_semi").join(read, "model", "left").join(b, ["model", "column"], "left").join(h, ["model", "column"], "left")
    same = F.forall(F.zip_with("_b", "_h", lambda x, y: (x["t"] == y["t"]) & (x["s"] == y["s"]) & F.coalesce(same_code(x["x"], y["x"], dialect), F.lit(False))), lambda x: x)
    alike = (F.size("_b") == F.size("_h")) & same
    poor = lambda c: F.coalesce(F.exists(c, lambda x: _empty(x["x"]) | unreadable(x["x"], dialect)), F.lit(False))
    one = (F.size("_b") == 1) & (F.size("_h") == 1)
    code = compare_expressions(F.col("_b")[0]["x"], F.col("_h")[0]["x"], dialect)
    # the same code from another source or by another way still means something else
    semantic = F.when(F.col("read").isNull(), "indeterminate").when(poor("_b") | poor("_h"), "indeterminate").when(one & (code == "indeterminate"), code).otherwise("meaning_changed")
    none = F.col("_b").isNull() & F.col("_h").isNull() & F.col("read").isNotNull()
    return rows.where(~none & ~F.coalesce(alike, F.lit(False))).select("model", "column", semantic.alias("semantic"))


def git_changeset(scopes: DataFrame, columns: DataFrame) -> DataFrame:
    """(model, column, kind, semantic) from changed files alone, where the base isn't known: nothing of a touched model can be told.

    ``scopes`` is what ``git_scope`` returns.  A model without columns is reported as ``*``; files that map to no node are not lost, they
    are the rows of ``scopes`` with another scope.
    """
    touched = scopes.where("scope = 'model' and node is not null").select(F.col("node").alias("model")).distinct()
    return indeterminate_columns(touched, columns)
