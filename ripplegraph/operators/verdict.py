"""Provable breaks and the ruling on a changeset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def provable_breaks(tests: DataFrame, base_columns: DataFrame, head_columns: DataFrame, head_tests: DataFrame, keys: list[str], referenced: DataFrame | None = None) -> DataFrame:
    """Tests of a column that the base has and the head has not, while the test itself is still in the head.

    ``tests`` and ``head_tests`` have test_id; a test is reported once, for its least column.  ``referenced`` (test_id,
    keys) has the other side of relationship tests; with it there is a column side, own or referenced, and own comes first.
    """
    gone = base_columns.select(*keys).distinct().join(head_columns.select(*keys).distinct(), keys, "left_anti")
    sides = tests.select("test_id", *keys, F.lit("own").alias("side"))
    if referenced is not None:
        sides = sides.union(referenced.select("test_id", *keys, F.lit("referenced")))
    hit = sides.join(gone, keys, "left_semi").join(head_tests.select("test_id").distinct(), "test_id", "left_semi")
    out = hit.groupBy("test_id").agg(F.min(F.struct("side", *keys)).alias("k")).select("test_id", "k.*")
    return out if referenced is not None else out.drop("side")


def verdict(facts: DataFrame, by: list[str]) -> DataFrame:
    """block, review or safe per group.

    ``facts`` has a row per reached thing: is_break, excused (an override allows it), critical and overridden, and may
    have is_filter (rows change), is_exposure and is_shift (the meaning changed or can't be told).  A break without an
    excuse blocks.  A demoted break is reviewed, and so is a critical thing, a filter or an exposure unless every change
    that reaches one is overridden, and a shift that no override covers.  What isn't known counts as the worse: a null is_break is a
    break, a null excuse or override is none, and so is a thing that may be critical, a filter, an exposure or a shift.
    """
    feared = lambda c: F.coalesce(F.col(c), F.lit(True)) if c in facts.columns else F.lit(False)
    proven = lambda c: F.coalesce(F.col(c), F.lit(False))
    unexcused = feared("is_break") & ~proven("excused")
    touchy = feared("critical") | feared("is_filter") | feared("is_exposure")
    review = F.bool_or(feared("is_break")) | F.bool_or((touchy | feared("is_shift")) & ~proven("overridden"))
    return facts.groupBy(*by).agg(F.when(F.bool_or(unexcused), "block").when(review, "review").otherwise("safe").alias("verdict"), F.count_if(unexcused).alias("n_unexcused"))


def override_audit(verb: Column, is_break: Column) -> Column:
    """What an override did: applied, or ineffective on a break that only allow-break excuses."""
    return F.when(verb.isNull(), None).when(F.coalesce(is_break, F.lit(True)) & (verb == "change"), "ineffective").otherwise("applied")


def gate_level(n_breaks: Column, n_exposures: Column, n_critical: Column, n_any: Column) -> Column:
    """The highest level that a changeset trips: tests over exposures over critical over any, or none."""
    return F.when(n_breaks > 0, "tests").when(n_exposures > 0, "exposures").when(n_critical > 0, "critical").when(n_any > 0, "any").otherwise("none")


def gate_exit(level: Column, fail_on: str) -> Column:
    """1 if the level is at or above the one to fail on."""
    rank = {"none": 0, "any": 1, "critical": 2, "exposures": 3, "tests": 4}
    if fail_on == "none":
        return F.lit(0)
    value = F.lit(0)
    for k, v in rank.items():
        value = F.when(level == k, v).otherwise(value)
    return (value >= rank[fail_on]).cast("int")
