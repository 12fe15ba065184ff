"""Reach across the boundary to dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.text import relation_key


def relation_index(relations: DataFrame) -> DataFrame:
    """(name, relation_id): every spelling that names one relation alone.

    ``relations`` has relation_id, database, schema, table.  A full name, schema.table and table are tried;
    one that several relations share names none.
    """
    parts = [relation_key(F.col(c)) for c in ("database", "schema", "table")]
    names = F.array(F.concat_ws(".", *parts), F.concat_ws(".", *parts[1:]), parts[2])
    spelled = relations.select("relation_id", F.explode(names).alias("name")).distinct()
    return spelled.groupBy("name").agg(F.count("*").alias("n"), F.min("relation_id").alias("relation_id")).where("n = 1").select("name", "relation_id")


def model_index(models: DataFrame) -> DataFrame:
    """(name, model): the spellings of a warehouse relation and the model that it is.

    ``models`` has model, relation_name, database, schema.  A model is found by its relation's name and by database.schema.model; of several
    models under one such name the least counts.  schema.table alone names a model only if it is the only one, and no full name.
    """
    plain = F.when(F.col("database").isNotNull() & F.col("schema").isNotNull(), F.concat_ws(".", "database", "schema", "model"))
    full = models.select("model", F.explode(F.array_compact(F.array(F.col("relation_name"), plain))).alias("raw")).select("model", relation_key(F.col("raw")).alias("name")).where("name <> ''")
    exact = full.groupBy("name").agg(F.min("model").alias("model"))
    short = full.where(F.size(F.split("name", r"\.")) == 3).select(F.regexp_extract("name", r"^[^.]*\.(.*)$", 1).alias("name"), "model")
    sole = short.groupBy("name").agg(F.min("model").alias("model"), F.max("model").alias("other")).where("model = other").select("name", "model")
    return exact.unionByName(sole.join(exact.select("name"), "name", "left_anti"))


def join_relations(refs: DataFrame, index: DataFrame) -> DataFrame:
    """``refs`` (relation, ...) with model: by the whole name, else by schema.table; null for a relation of no model."""
    key = relation_key(F.col("relation"))
    by = lambda name: index.select(F.col("name").alias(f"_{name}"), F.col("model").alias(f"_{name}_model"))
    out = refs.withColumn("_full", key).withColumn("_short", F.when(F.size(F.split(key, r"\.")) == 3, F.regexp_extract(key, r"^[^.]*\.(.*)$", 1)))
    out = out.join(by("full"), "_full", "left").join(by("short"), "_short", "left")
    return out.withColumn("model", F.coalesce("_full_model", "_short_model")).drop("_full", "_short", "_full_model", "_short_model")


def dashboard_reach(columns: DataFrame, card_columns: DataFrame, card_tables: DataFrame, dashboard_cards: DataFrame) -> DataFrame:
    """dashboard, precision and n_via: dashboards that changed columns (model, column) reach.

    A card with column references is reached by a column that it names; a card without them by any column of
    a table that it names.  Column precision outweighs table precision; n_via counts the distinct columns.
    """
    columns = columns.select("model", "column").distinct()
    precise = columns.join(card_columns, ["model", "column"]).select("card", "model", "column").distinct()
    precise = precise.join(dashboard_cards, "card").select("dashboard", "model", "column").distinct()
    # a table brings all changed columns of its model along: their number goes on, not the columns
    counts = columns.groupBy("model").agg(F.count_if(F.col("column").isNotNull()).alias("n"))
    coarse = card_tables.join(counts.select("model"), "model", "left_semi").join(card_columns.select("card").distinct(), "card", "left_anti")
    coarse = coarse.select("card", "model").join(dashboard_cards, "card").select("dashboard", "model").distinct()
    within = coarse.select(F.col("dashboard").alias("_d"), F.col("model").alias("_m"))
    more = precise.join(within, F.col("dashboard").eqNullSafe(F.col("_d")) & (F.col("model") == F.col("_m")), "left_anti").select("dashboard", F.lit(0).alias("rank"), F.lit(1).cast("long").alias("n"))
    named = precise.select("dashboard", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n"))
    tables = coarse.join(counts, "model").select("dashboard", F.lit(1).alias("rank"), "n")
    out = named.unionByName(more).unionByName(tables).groupBy("dashboard").agg(F.min("rank").alias("rank"), F.sum("n").alias("n_via"))
    return out.select("dashboard", F.when(F.col("rank") == 0, "column").otherwise("table").alias("precision"), "n_via")


def incremental_reuse(previous: DataFrame, current: DataFrame, key: str, stamp: str) -> DataFrame:
    """key, action: reuse where the stamp is unchanged, fetch where it changed or is new, drop where the object went."""
    p = previous.select(key, F.col(stamp).alias("_p"), F.lit(True).alias("_was"))
    c = current.select(key, F.col(stamp).alias("_c"), F.lit(True).alias("_is"))
    action = F.when(F.col("_is").isNull(), "drop").when(F.col("_was").isNull(), "fetch").when(F.col("_p").eqNullSafe(F.col("_c")), "reuse").otherwise("fetch")
    return p.join(c, key, "full_outer").select(key, action.alias("action"))


def staleness(taken: Column, now: Column, hours: int = 24) -> Column:
    """fresh, stale or unknown (no time)."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(taken)) / 3600
    return F.when(taken.isNull(), "unknown").when(age > hours, "stale").otherwise("fresh")


def reach_confidence(snapshots: DataFrame, reached: DataFrame, keys: list[str], now: Column, hours: float = 24) -> DataFrame:
    """keys, age_hours, stale, n_precise, n_coarse and level (full, partial or absent) of what each snapshot says.

    ``snapshots`` has keys, present and generated_at (a text); ``reached`` keys and precision, a row per dashboard.  A time that can't be read is
    stale.  What a stale snapshot says, or a dashboard reached by a table alone, is partial.
    """
    counts = reached.groupBy(*keys).agg(F.count_if(F.col("precision") == "column").alias("p"), F.count("*").alias("n"))
    age = (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp("generated_at"))) / 3.6e9
    # greatest() passes over nulls, and a time that can't be read is no age
    out = snapshots.join(counts, keys, "left").withColumn("age_hours", F.when(F.col("present") & age.isNotNull(), F.greatest(F.lit(0.0), age)))
    stale = F.col("age_hours").isNull() | (F.col("age_hours") > hours)
    n, p = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))
    level = F.when(~F.coalesce("present", F.lit(False)), "absent").when(stale | (n > p), "partial").otherwise("full")
    return out.select(*keys, "age_hours", stale.alias("stale"), p.alias("n_precise"), (n - p).alias("n_coarse"), level.alias("level"))
