"""Replay of a policy over a history of changesets, all points in one plan.

The registry is a table of versions, each valid from its time until the next of its node.  Every change meets the version that was
valid when it was made (an as-of join), and the rules run once over all changes of all points.  A join on the node alone would
put a busy node's changes into one task and try each against each version; here both sides are cut into stretches of time, a version
goes to the stretches that it is valid in, and node and stretch are the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.operators import policy as P


def intervals(history: DataFrame, key: str, at: str, order: str | None = None) -> DataFrame:
    """``history`` with valid_from and valid_to (null for the last version); of versions with one time the last by ``order`` counts."""
    last = history.groupBy(key, at).agg(F.max_by(F.struct(*history.columns), F.col(order or at)).alias("v")).select("v.*") if order else history
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return last.withColumn("valid_from", F.col(at)).withColumn("valid_to", following).drop(at)


def as_of(changes: DataFrame, versions: DataFrame, key: str, at: str, values: list[str], stretch: int = 86400) -> DataFrame:
    """``changes`` with the ``values`` of the version that is valid at their time ``at``; null where there is none yet.

    ``versions`` has key, valid_from, valid_to.  ``stretch`` is in seconds; a version is copied to the stretches between its start and
    its end (or the last change), so it should not be much shorter than versions usually last.
    """
    part = lambda c: F.floor(F.unix_timestamp(c) / stretch).cast("long")
    end = changes.agg(F.max(part(F.col(at))).alias("_end"))
    spans = versions.join(F.broadcast(end), F.lit(True)).withColumn("_from", part(F.col("valid_from"))).withColumn("_to", F.coalesce(part(F.col("valid_to")), "_end"))
    spans = spans.where("_from <= _to").select(key, "valid_from", "valid_to", *values, F.explode(F.sequence("_from", "_to")).alias("_part"))
    left = changes.withColumn("_part", part(F.col(at))).alias("c")
    v = spans.withColumnRenamed(key, "_key").withColumnRenamed("_part", "_p")
    valid = (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")) & (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return left.join(v, valid, "left").drop("_key", "_p", "_part", "valid_from", "valid_to")


def replay(policy: dict, subjects: DataFrame, point: str, keys: list[str]) -> DataFrame:
    """point, keys, rule, outcome, cause, decision of every rule on every change of every point."""
    return P.evaluate(policy, subjects, [point, *keys])


def point_decisions(hits: DataFrame, points: DataFrame, point: str) -> DataFrame:
    """point, decision, n_hits, n_on_unknown of every point, allow where nothing fired."""
    fired = hits.where("outcome = 'fire'").groupBy(point).agg(F.max(P.severity(F.col("decision"))).alias("s"), F.count("*").alias("n_hits"), F.count_if(F.col("cause") != "true").alias("n_on_unknown"))
    name = F.element_at(F.array(*map(F.lit, P.DECISIONS)), F.coalesce("s", F.lit(0)) + 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return points.select(point).distinct().join(fired, point, "left").select(point, name.alias("decision"), zero("n_hits"), zero("n_on_unknown"))


def rule_table(policy: dict, hits: DataFrame, point: str) -> DataFrame:
    """rule, would_block, would_warn (points), fired, fired_on_unknown, matched_zero: every rule of the policy, and others that fired."""
    fires = hits.where("outcome = 'fire'")
    count = lambda d: F.count_distinct(F.when(F.col("decision") == d, F.col(point)))
    stats = fires.groupBy("rule").agg(count("block").alias("would_block"), count("warn").alias("would_warn"), F.count("*").alias("fired"), F.count_if(F.col("cause") != "true").alias("fired_on_unknown"))
    names = hits.sparkSession.createDataFrame([(r["name"],) for r in policy["rules"]], "rule string")
    columns = ("would_block", "would_warn", "fired", "fired_on_unknown")
    return names.join(stats, "rule", "full_outer").fillna(0, list(columns)).select("rule", *columns, (F.col("fired") == 0).alias("matched_zero"))


def selection_table(points: DataFrame) -> DataFrame:
    """One row over points (widened, n_skippable, n_forced): points with a selection, widen rate, median skippable, forced rebuilds."""
    have = points.where("widened is not null")
    rate: Column = F.round(100.0 * F.count_if("widened") / F.count("*"), 1)
    return have.agg(F.count("*").alias("n_points"), F.count_if("widened").alias("n_widened"), rate.alias("widen_rate_pct"), F.median(F.coalesce("n_skippable", F.lit(0))).alias("median_skippable"), F.sum(F.coalesce("n_forced", F.lit(0))).alias("n_forced"))
