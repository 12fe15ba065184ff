"""What structured cards of a BI tool read: columns with roles, relations, and other cards.

A card's query is a VARIANT of any shape.  All cards are walked at once: a round opens every list and object by one level, and stops
at ``["field", target, ...]``.  A target is the id of a field, or the name of a column of the card that the query level reads;
what a card gets from other cards is found by rounds that hand on new columns and relations alone, so cards that read
each other in a circle end as well, each with what any of them can prove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.meta import lookup
from ripplegraph.tables import stash

#: The clauses of a query in the order in which they are looked at, and the role that each gives.
CLAUSES = (("fields", "field"), ("breakout", "breakout"), ("aggregation", "aggregation"), ("filter", "filter"), ("order-by", "order"), ("expressions", "field"))
JOIN_CLAUSES = (("condition", "join"), ("fields", "field"))
_CARD = r"^card__(\d{1,18})$"


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _int(v: Column) -> Column:
    return F.when(_kind(v) == "BIGINT", _get(v, "$", "bigint"))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", _get(v, "$", "string"))


def _opened(df: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each element of the lists and objects in a column, with its place ``pos``."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer())).drop("key", column).withColumnRenamed("value", name)


def query_levels(cards: DataFrame) -> DataFrame:
    """card, depth, q: the query of each card and those nested in it as sources; 0 is the outermost."""
    inner = F.when(_kind(_get(F.col("query"), "$.query")).startswith("OBJECT"), _get(F.col("query"), "$.query")).otherwise(F.col("query"))
    level = stash(cards.where(_text(lookup(F.col("query"), "type")) == "query").select("card", F.lit(0).alias("depth"), inner.alias("q")))
    out = level
    while True:
        level = stash(level.select("card", (F.col("depth") + 1).alias("depth"), lookup(F.col("q"), "source-query").alias("q")).where(_kind(F.col("q")).startswith("OBJECT")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def _joins(levels: DataFrame) -> DataFrame:
    """card, depth, pos, j: the joins of each level."""
    return _opened(levels.select("card", "depth", lookup(F.col("q"), "joins").alias("js")).where(_kind(F.col("js")).startswith("ARRAY")), "js", "j")


def field_refs(levels: DataFrame) -> DataFrame:
    """card, depth, rank, role, field_id, name: every field that a clause mentions; rank is the place of the clause."""
    clause = lambda src, k, name, role: F.struct(k.alias("rank"), F.lit(role).alias("role"), lookup(F.col(src), name).alias("node"))
    tops = levels.select("card", "depth", F.explode(F.array(*(clause("q", F.lit(k), n, r) for k, (n, r) in enumerate(CLAUSES)))).alias("c"))
    after = len(CLAUSES) + len(JOIN_CLAUSES) * F.col("pos")  # one join after the other
    joined = _joins(levels).select("card", "depth", F.explode(F.array(*(clause("j", after + k, n, r) for k, (n, r) in enumerate(JOIN_CLAUSES)))).alias("c"))
    open_ = stash(tops.unionByName(joined).select("card", "depth", "c.*").where("node is not null"))
    found = None
    while not open_.isEmpty():
        head = F.col("node")
        is_ref = F.coalesce(_kind(head).startswith("ARRAY") & (_text(_get(head, "$[0]")) == "field"), F.lit(False))
        refs = open_.where(is_ref).select("card", "depth", "rank", "role", _int(_get(head, "$[1]")).alias("field_id"), F.lower(_text(_get(head, "$[1]"))).alias("name"))
        found = refs if found is None else found.unionByName(refs)
        open_ = stash(_opened(open_.where(~is_ref & (_kind(head).startswith("ARRAY") | _kind(head).startswith("OBJECT"))), "node", "next").drop("pos").withColumnRenamed("next", "node"))
    if found is None:
        return open_.select("card", "depth", "rank", "role", F.lit(None).cast("long").alias("field_id"), F.lit(None).cast("string").alias("name"))
    return found.where("field_id is not null or name is not null").distinct()


def card_sources(levels: DataFrame) -> DataFrame:
    """card, depth, table_id, upstream, joined: what each level reads, directly or in a join."""
    source = lambda c: lookup(F.col(c), "source-table")
    parts = lambda v: (_int(v).alias("table_id"), F.regexp_extract(_text(v), _CARD, 1).try_cast("long").alias("upstream"))
    own = levels.select("card", "depth", *parts(source("q")), F.lit(False).alias("joined"))
    return own.unionByName(_joins(levels).select("card", "depth", *parts(source("j")), F.lit(True).alias("joined"))).where("table_id is not null or upstream is not null")


def resolve_cards(cards: DataFrame, fields: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, relations, cards): what each structured card reads.

    ``cards`` is card, query (VARIANT); ``fields`` field_id, relation, column; ``tables`` table_id, relation.  Columns are card, relation,
    column, role: of several clauses the first counts, and an inner query's before its outer one's.  Relations are card, relation.
    Cards are card, precision (column, table or none) and reason (null, unknown_field, unknown_table or
    unknown_query_kind).  Of two columns of one name in a source card, the one of the least relation is meant.
    """
    levels = query_levels(cards)
    refs, sources = stash(field_refs(levels)), stash(card_sources(levels))
    place = F.struct((-F.col("depth")).alias("outer"), "rank", "role")
    best = lambda df: df.groupBy("card", "relation", F.lower("column").alias("column")).agg(F.min("place").alias("place"))
    by_id = best(refs.join(fields.select("field_id", "relation", "column"), "field_id").withColumn("place", place))
    # a name is one of the columns of the card that its own level reads
    reads = sources.where("not joined and upstream is not null").select("card", "depth", "upstream")
    asked = stash(refs.where("field_id is null").join(reads, ["card", "depth"]).select("card", "upstream", "name", place.alias("place")))
    columns = stash(by_id)
    new = columns
    while not new.isEmpty():
        given = columns.groupBy(F.col("card").alias("upstream"), F.col("column").alias("name")).agg(F.min("relation").alias("relation"))
        touched = new.select(F.col("card").alias("upstream"), F.col("column").alias("name")).distinct()
        more = best(asked.join(given.join(touched, ["upstream", "name"], "left_semi"), ["upstream", "name"]).withColumn("column", F.col("name")))
        now = stash(columns.withColumn("old", F.lit(True)).unionByName(more.withColumn("old", F.lit(False))).groupBy("card", "relation", "column").agg(F.min("place").alias("place"), F.bool_or("old").alias("old")))
        columns, new = now.drop("old"), now.where("not old").drop("old")
    # relations are handed on from card to card, whether read or joined
    edges = stash(sources.where("upstream is not null").select(F.col("upstream").alias("src"), F.col("card").alias("dst")).distinct())
    own = sources.join(tables.select("table_id", "relation"), "table_id").select("card", "relation").unionByName(columns.select("card", "relation")).where("relation is not null").distinct()
    relations = new = stash(own)
    while not new.isEmpty():
        sent = new.join(edges, new["card"] == edges["src"]).select(F.col("dst").alias("card"), "relation").distinct()
        new = stash(sent.join(relations, ["card", "relation"], "left_anti"))
        relations = relations.unionByName(new)
    columns = columns.select("card", "relation", "column", F.col("place.role").alias("role"))
    return columns, relations, _precision(cards, refs, fields, asked, columns, relations)


def _precision(cards: DataFrame, refs: DataFrame, fields: DataFrame, asked: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    flag = lambda df, name: df.select("card").distinct().withColumn(name, F.lit(True))
    unknown = refs.join(fields.select("field_id"), "field_id", "left_anti").where("field_id is not null").select("card").unionByName(refs.where("field_id is null").select("card"))
    out = cards.select("card", (_text(lookup(F.col("query"), "type")) == "query").alias("structured"))
    for name, df in (("precise", columns), ("coarse", relations), ("unknown", unknown)):
        out = out.join(flag(df, name), "card", "left")
    precision = F.when(F.col("precise"), "column").when(F.col("coarse"), "table").otherwise("none")
    reason = F.when(~F.coalesce("structured", F.lit(False)), "unknown_query_kind").when(precision == "none", "unknown_table").when((precision == "table") & F.coalesce("unknown", F.lit(False)), "unknown_field")
    return out.select("card", precision.alias("precision"), reason.alias("reason"))
