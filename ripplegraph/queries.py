"""The registered queries outside ``llm``: each adapts the given tables to an operator's schema.

The foreign keys region - nation - customer - orders - lineitem, nation - supplier - lineitem and
part - lineitem serve as dependency edges, halves of ``events`` and of ``lineitem`` as two versions of a
project, ``events.props`` as metadata, and ``documents`` with its partial ``labels`` as a catalog with gaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import meta, text, tri
from ripplegraph.operators import bi, cards, diff, fold, graph, identity, impact, layout, policy, replay, verdict, versions
from ripplegraph.sources import artifacts, files
from ripplegraph.tables import shared_folder

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _id(letter: str, *cols: str):
    return F.concat(F.lit(letter), F.concat_ws("-", *cols))


def _layers(t: Tables) -> list[DataFrame]:
    """The dependency edges, by depth."""
    line = _id("l", "l_orderkey", "l_linenumber")
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    return [
        edge(t.nation, _id("r", "n_regionkey"), _id("n", "n_nationkey")),
        edge(t.customer, _id("n", "c_nationkey"), _id("c", "c_custkey")).union(edge(t.supplier, _id("n", "s_nationkey"), _id("s", "s_suppkey"))),
        edge(t.orders, _id("c", "o_custkey"), _id("o", "o_orderkey")),
        edge(t.lineitem, _id("o", "l_orderkey"), line).union(edge(t.lineitem, _id("s", "l_suppkey"), line)).union(edge(t.lineitem, _id("p", "l_partkey"), line)),
    ]


def _edges(t: Tables) -> DataFrame:
    a, b, c, d = _layers(t)
    return a.union(b).union(c).union(d)


def _typed_edges(t: Tables, *more: DataFrame) -> DataFrame:
    """The dependency edges with the kinds that each part leads between."""
    line = _id("l", "l_orderkey", "l_linenumber")
    parts = [
        _part(t.nation, "r", "n_regionkey", "n", _id("n", "n_nationkey")), _part(t.customer, "n", "c_nationkey", "c", _id("c", "c_custkey")), _part(t.supplier, "n", "s_nationkey", "s", _id("s", "s_suppkey")),
        _part(t.orders, "c", "o_custkey", "o", _id("o", "o_orderkey")), *(_part(t.lineitem, k, c, "l", line) for k, c in (("o", "l_orderkey"), ("s", "l_suppkey"), ("p", "l_partkey"))),
    ]
    return reduce(DataFrame.unionByName, [*parts, *more])


def _part(df: DataFrame, a: str, key: str, b: str, node: Column) -> DataFrame:
    return df.select(_id(a, key).alias("src"), node.alias("dst"), F.lit(a).alias("src_kind"), F.lit(b).alias("dst_kind"))


EDGES = """edges as (
  select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation
  union all select 'n' || c_nationkey, 'c' || c_custkey from customer
  union all select 'n' || s_nationkey, 's' || s_suppkey from supplier
  union all select 'c' || o_custkey, 'o' || o_orderkey from orders
  union all select 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber from lineitem
  union all select 's' || l_suppkey, 'l' || l_orderkey || '-' || l_linenumber from lineitem
  union all select 'p' || l_partkey, 'l' || l_orderkey || '-' || l_linenumber from lineitem)"""


def _seeds(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").alias("key"), _id("r", "r_regionkey").alias("node"), F.lit("r").alias("kind"))


# ---- reachability


@_query(f"""with recursive {EDGES},
 w(node, level) as (select 'r0', 0 union select e.dst, w.level + 1 from w join edges e on e.src = w.node)
 select level, count(*) as n_nodes from (select node, min(level) as level from w group by node) group by level""")
def model_reach_from_region(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.bfs_levels(_typed_edges(t), _seeds(t).where("key = 0")).groupBy("level").agg(F.count("*").alias("n_nodes"))


@_query(f"""with recursive {EDGES},
 w(key, node) as (select r_regionkey, 'r' || r_regionkey from region union select w.key, e.dst from w join edges e on e.src = w.node)
 select key, substr(node, 1, 1) as kind, count(*) as n_nodes from w group by 1, 2""")
def multi_source_reach(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.layered_levels(_layers(t), _seeds(t)).groupBy("key", F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n_nodes"))


@_query(f"""with recursive {EDGES},
 w(node, level) as (select 'l' || l_orderkey || '-' || l_linenumber, 0 from lineitem where l_returnflag = 'R'
  union select e.src, w.level + 1 from w join edges e on e.dst = w.node)
 select substr(node, 1, 1) as kind, level, count(*) as n_nodes from (select node, min(level) as level from w group by node) group by 1, 2""")
def upstream_closure(spark, sf_dir):
    t = Tables(spark, sf_dir)
    seeds = t.lineitem.where("l_returnflag = 'R'").select(F.lit(0).alias("key"), _id("l", "l_orderkey", "l_linenumber").alias("node"), F.lit("l").alias("kind"))
    return graph.upstream(_typed_edges(t), seeds).groupBy(F.substring("node", 1, 1).alias("kind"), "level").agg(F.count("*").alias("n_nodes"))


@_query(f"""with {EDGES} select src, count(distinct dst) as n_dependents from edges group by src""")
def immediate_downstream(spark, sf_dir):
    return graph.immediate(_edges(Tables(spark, sf_dir)))


@_query(f"""with recursive {EDGES},
 loops as (select * from edges union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
 w(node) as (select 'r1' union select e.dst from w join loops e on e.src = w.node)
 select substr(node, 1, 1) as kind, count(*) as n_nodes from w group by 1""")
def closure_with_cycle(spark, sf_dir):
    t = Tables(spark, sf_dir)
    loops = _typed_edges(t, _part(t.customer, "c", "c_custkey", "n", _id("n", "c_nationkey")))
    return graph.bfs_levels(loops, _seeds(t).where("key = 1")).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n_nodes"))


def _typed(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "derived").when(F.col("o_orderpriority") == "3-MEDIUM", "renamed").otherwise("direct")
    return t.orders.select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("src"), kind.alias("transformation"))


TYPED = """typed as (select o_custkey as dst, o_orderkey as src, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'derived'
  when o_orderpriority = '3-MEDIUM' then 'renamed' else 'direct' end as transformation,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 3 when o_orderpriority = '3-MEDIUM' then 2 else 1 end as sev from orders)"""


@_query(f"""with {TYPED} select dst, transformation, src from (select *, row_number() over (partition by dst order by sev desc, src) as k from typed) where k = 1""")
def mechanism_edge_choice(spark, sf_dir):
    return graph.choose_edge(_typed(Tables(spark, sf_dir)), ["dst"], "src")


@_query(f"""with {TYPED} select case transformation when 'derived' then 'derived_recompute' when 'renamed' then 'renamed_passthrough' else 'direct_passthrough' end as mechanism,
 count(*) as n_edges, count(distinct dst) as n_nodes from typed group by 1""")
def mechanism_breakdown(spark, sf_dir):
    return _typed(Tables(spark, sf_dir)).groupBy(impact.mechanism(F.col("transformation")).alias("mechanism")).agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_nodes"))


OWN_META = """tag as (select c_custkey as k, c_nationkey as nk, case when c_acctbal < 0 then 2 when c_acctbal > 9000 then 0 end as v from customer),
 rv as (select r_regionkey as k, case when r_name = 'ASIA' then 2 when r_name = 'EUROPE' then 0 else 1 end as v from region),
 nv as (select n_nationkey as k, max(coalesce(rv.v, 1)) as v from nation left join rv on rv.k = n_regionkey group by 1)"""


@_query(f"""with {OWN_META}, cv as (select tag.k, coalesce(tag.v, nv.v, 1) as v from tag left join nv on nv.k = nk),
 sv as (select s_suppkey as k, coalesce(nv.v, 1) as v from supplier left join nv on nv.k = s_nationkey), ov as (select o_orderkey as k, coalesce(cv.v, 1) as v from orders left join cv on cv.k = o_custkey),
 parents as (select l_orderkey, l_linenumber, coalesce(ov.v, 1) as v from lineitem left join ov on ov.k = l_orderkey union all select l_orderkey, l_linenumber, coalesce(sv.v, 1) from lineitem left join sv on sv.k = l_suppkey
  union all select l_orderkey, l_linenumber, 1 from lineitem),
 every as (select 'r' as kind, v from rv union all select 'n', v from nv union all select 'c', v from cv union all select 's', v from sv union all select 'o', v from ov union all select 'p', 1 from part
  union all select 'l', max(v) from parents group by l_orderkey, l_linenumber)
 select kind, v as value, count(*) as n_nodes from every group by 1, 2""")
def inferred_meta_fold(spark, sf_dir):
    t = Tables(spark, sf_dir)
    folded = fold.fold(_typed_edges(t), _own_meta(t))
    return folded.groupBy(F.substring("node", 1, 1).alias("kind"), "value").agg(F.count("*").alias("n_nodes"))


def _own_meta(t: Tables) -> DataFrame:
    own = lambda df, kind, key, v: df.select(_id(kind, key).alias("node"), v.cast("int").alias("value"), F.lit(kind).alias("kind"))
    tags = own(t.region, "r", "r_regionkey", F.when(F.col("r_name") == "ASIA", 2).when(F.col("r_name") == "EUROPE", 0))
    return tags.union(own(t.part, "p", "p_partkey", F.lit(None))).union(own(t.customer, "c", "c_custkey", F.when(F.col("c_acctbal") < 0, 2).when(F.col("c_acctbal") > 9000, 0)))


@_query(f"""with {OWN_META}, back as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'),
 cv as (select tag.k, case when tag.v is not null then tag.v when tag.k in (select k from back) then greatest(1, coalesce(nv.v, 1)) else coalesce(nv.v, 1) end as v from tag left join nv on nv.k = nk)
 select 'c' as kind, v as value, count(*) as n_nodes from cv group by 2 union all select 'o', coalesce(cv.v, 1), count(*) from orders left join cv on cv.k = o_custkey group by 2""")
def inferred_meta_cycles(spark, sf_dir):
    """Urgent orders lead back to their customer: a cycle, unless the customer has a value of its own."""
    t = Tables(spark, sf_dir)
    back = _part(t.orders.where("o_orderpriority = '1-URGENT'"), "o", "o_orderkey", "c", _id("c", "o_custkey"))
    folded = fold.fold(_typed_edges(t, back).where("dst_kind <> 'l'"), _own_meta(t)).where("substring(node, 1, 1) in ('c', 'o')")
    return folded.groupBy(F.substring("node", 1, 1).alias("kind"), "value").agg(F.count("*").alias("n_nodes"))


# ---- differences between two versions


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(user_id, event_type): each user's last event type in the first and in the second half of the month."""
    half = F.col("ts") < F.lit("2024-01-29").cast("timestamp")
    last = lambda df: df.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last(t.events.where(half)), last(t.events.where(~half))


HALVES = """b as (select user_id, arg_max(event_type, (ts, event_id)) as v from events where ts < timestamp '2024-01-29' group by 1),
 h as (select user_id, arg_max(event_type, (ts, event_id)) as v from events where ts >= timestamp '2024-01-29' group by 1),
 d as (select coalesce(b.user_id, h.user_id) as user_id, case when h.user_id is null then 'removed' when b.user_id is null then 'added' when lower(b.v) <> lower(h.v) then 'type_changed' end as kind,
  b.v as base_value, h.v as head_value from b full join h on b.user_id = h.user_id)"""


@_query(f"with {HALVES} select * from d where kind is not null")
def keyed_diff(spark, sf_dir):
    return diff.keyed_diff(*_halves(Tables(spark, sf_dir)), ["user_id"], "event_type")


@_query(f"with {HALVES} select kind, count(*) as n_changes from d where kind is not null group by 1")
def diff_by_kind(spark, sf_dir):
    return diff.by_kind(diff.keyed_diff(*_halves(Tables(spark, sf_dir)), ["user_id"], "event_type"))


KINDS = "case event_type when 'error' then 'removed' when 'purchase' then 'type_changed' when 'click' then 'logic_changed' else 'added' end"


@_query(f"""select user_id, bucket, kind, event_id from (select user_id, bucket, kind, event_id, row_number() over (partition by user_id, bucket
  order by case kind when 'removed' then 5 when 'type_changed' then 4 when 'logic_changed' then 3 else 1 end desc, event_id) as k
  from (select *, {KINDS} as kind, cast(json_extract(props, '$.k') as bigint) as bucket from events)) where k = 1""")
def diff_priority_dedup(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("bucket"), F.expr(KINDS).alias("kind"), "event_id")
    return diff.dedup_changes(rows, ["user_id", "bucket"], "event_id")


def _plain_text() -> Column:
    """A document's text without the signs that begin or end literals and comments."""
    return F.translate("text", "'\"`\\\\$#", "")


@_query("""select source, case when lang = 'es' and source <> 'src0' then 'indeterminate' when lang = 'es' then 'unchanged' when lang = 'de' or doc_id % 2 = 1 then 'changed' else 'unchanged' end as status, count(*) as n_models from documents group by 1, 2""")
def logic_status_three_state(spark, sf_dir):
    """Texts as literals of a statement; the SQL knows what was done to each and reads no text."""
    base = F.concat(F.lit("select '"), _plain_text(), F.lit("' as X"))
    heads = {"more": F.concat(base, F.lit(" where x")), "layout": F.concat(F.lit("SELECT  '"), _plain_text(), F.lit("'\n as x -- said")), "inside": F.concat(F.lit("select '"), _plain_text(), F.lit(" ' as X"))}
    head = F.when(F.col("lang") == "es", None).when(F.col("lang") == "de", heads["more"]).when(F.col("doc_id") % 2 == 0, heads["layout"]).otherwise(heads["inside"])
    status = diff.logic_status(base, head, F.col("source") != "src0")
    return Tables(spark, sf_dir).documents.select("source", status.alias("status")).groupBy("source", "status").agg(F.count("*").alias("n_models"))


@_query("""with e as (select p_partkey as k, case p_partkey % 9 when 3 then 'unequal' when 4 then 'unequal' when 6 then 'unsure' when 7 then 'unsure' when 8 then 'unequal' else 'equal' end as s from part)
 select case s when 'equal' then 'equivalent' when 'unsure' then 'indeterminate' else 'meaning_changed' end as semantic, count(*) as n_columns, min(k) as least from e group by 1""")
def expression_compare(spark, sf_dir):
    """Nine ways to change an expression; the SQL states what each of them is, without reading text."""
    k = F.col("p_partkey")
    make = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    base = make("case when p_size > ", size, " then '", name, "  x' else \"A  b\" end -- note\n + 1")
    heads = [
        make("case  when\np_size>", size, " then '", name, "  x' else \"A  b\" end\n+ 1"),  # layout
        make("case when p_size > ", size, " then '", name, "  x' /* c */ else \"A  b\" end -- note\n + 1"),  # a block comment
        make("case when p_size > ", size, " then '", name, "  x' else \"A  b\" end + -- note\n 1"),  # a comment elsewhere
        make("case when p_size > ", size, " then '", name, " x' else \"A  b\" end -- note\n + 1"),  # space in a literal
        make("case when p_size > ", size, " then '", name, "  x' else \"A  b\" end -- note + 1"),  # the comment takes a term along
        make("case when p_size > ", size, " then '", name, "  x' else \"A  b\" end -- changed note\n + 1"),  # a comment's text
        F.lit("-- nothing"),
        make("case when p_size > (", size, " then '", name, "  x' else \"A  b\" end -- note\n + 1"),  # a bracket without partner
        make("case when p_size > ", size, " then '", name, "  x' else \"A b\" end -- note\n + 1"),  # space in a quoted name
    ]
    head = F.element_at(F.array(*heads), (k % 9 + 1).cast("int"))
    parts = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)  # a small file that takes long to read
    return parts.select(k.alias("k"), diff.compare_expressions(base, head).alias("semantic")).groupBy("semantic").agg(F.count("*").alias("n_columns"), F.min("k").alias("least"))


@_query("""with s as (select l_suppkey as supplier, l_partkey as part, l_linestatus as side, list(case when l_returnflag = 'A' and l_linenumber > 5 then '' else 'sum(' || l_returnflag || ')' end) as xs from lineitem group by 1, 2, 3),
 j as (select b.supplier, list_sort(b.xs) as bx, list_sort(h.xs) as hx from s b join s h using (supplier, part) where b.side = 'O' and h.side = 'F'),
 c as (select supplier, case when list_contains(bx, '') or list_contains(hx, '') then case when len(bx) = 1 and len(hx) = 1 and bx = hx then 'equivalent' else 'indeterminate' end when bx <> hx then 'meaning_changed' end as semantic from j)
 select supplier, semantic, count(*) as n_columns from c where semantic is not null group by 1, 2""")
def change_classes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    poor = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 5)
    rows = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "l_linestatus", F.when(poor, "").otherwise(F.concat(F.lit("sum("), "l_returnflag", F.lit(")"))).alias("x"))
    found = diff.classify_changes(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), ["supplier", "part"], "x")
    return found.groupBy("supplier", "semantic").agg(F.count("*").alias("n_columns"))


@_query("""with s as (select l_suppkey as supplier, l_partkey as part, l_linestatus as side, list_sort(list((l_returnflag, cast(l_quantity as bigint)))) as sig from lineitem group by 1, 2, 3)
 select h.supplier, count(*) as n_changed, count(*) filter (b.sig is null) as n_new from (select * from s where side = 'F') h
 left join (select * from s where side = 'O') b on b.supplier = h.supplier and b.part = h.part where b.sig is null or b.sig <> h.sig group by 1""")
def signature_diff(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "l_linestatus", "l_returnflag", F.col("l_quantity").cast("long").alias("qty"))
    side = lambda s: diff.signatures(rows.where(F.col("l_linestatus") == s), ["supplier", "part"], ["l_returnflag", "qty"])
    return diff.changed_signatures(side("O"), side("F"), ["supplier", "part"]).groupBy("supplier").agg(F.count("*").alias("n_changed"), F.count_if("base_missing").alias("n_new"))


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    cols = ["l_suppkey", "l_partkey"]
    return t.lineitem.where("l_linestatus = 'O'").select(*cols, F.col("l_orderkey").alias("test_id")), t.lineitem.where("l_linestatus = 'F'").select(*cols, F.col("l_orderkey").alias("test_id"))


@_query("""with b as (select distinct l_suppkey as model, l_partkey as col from lineitem where l_linestatus = 'O'), h as (select distinct l_suppkey as model, l_partkey as col from lineitem where l_linestatus = 'F'),
 c as (select coalesce(b.model, h.model) as model, coalesce(b.col, h.col) as col, case when h.model is null then 'removed' else 'added' end as kind from b full join h on b.model = h.model and b.col = h.col where b.model is null or h.model is null),
 o as (select p_partkey % 1000 as model, case when p_size > 25 then p_partkey end as col, case when p_size % 2 = 0 then 'break' else 'change' end as verb, p_partkey as line from part),
 x as (select c.model, c.col, arg_max((o.verb, o.line), (o.verb = 'break', o.line)) as o from c join o on o.model = c.model and (o.col is null or o.col = c.col) group by 1, 2)
 select kind, x.o[1] as verb, count(*) as n_changes from c left join x on x.model = c.model and x.col = c.col group by 1, 2""")
def override_attach(spark, sf_dir):
    t = Tables(spark, sf_dir)
    changes = _pair_changes(t)
    return diff.attach_overrides(changes, _overrides(t)).groupBy("kind", "verb").agg(F.count("*").alias("n_changes"))


def _pair_changes(t: Tables) -> DataFrame:
    b, h = (x.select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("column")).distinct().withColumn("v", F.lit("x")) for x in _sides(t))
    return diff.keyed_diff(b, h, ["model", "column"], "v").select("model", "column", "kind")


def _overrides(t: Tables) -> DataFrame:
    verb = F.when(F.col("p_size") % 2 == 0, "break").otherwise("change")
    return t.part.select((F.col("p_partkey") % 1000).alias("model"), F.when(F.col("p_size") > 25, F.col("p_partkey")).alias("column"), verb.alias("verb"), F.col("p_partkey").alias("line"))


@_query("""with b as (select distinct l_suppkey as model, l_partkey as col from lineitem where l_linestatus = 'O'), h as (select distinct l_suppkey as model, l_partkey as col from lineitem where l_linestatus = 'F'),
 c as (select coalesce(b.model, h.model) as model, coalesce(b.col, h.col) as col from b full join h on b.model = h.model and b.col = h.col where b.model is null or h.model is null),
 o as (select p_partkey % 1000 as model, case when p_size > 25 then p_partkey end as col, case when p_size % 2 = 0 then 'break' else 'change' end as verb, p_partkey as line from part)
 select verb, line from o where not exists (select 1 from c where c.model = o.model and (o.col is null or o.col = c.col))""")
def override_stale(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return diff.stale_overrides(_pair_changes(t), _overrides(t)).select("verb", "line")


@_query("""select doc_id, 1 as line, case when lang = 'en' then 'change' else 'break' end as verb, case when source = 'src1' then lang end as "column", case when source = 'src1' then 'column' else 'model' end as scope, source as reason, null as problem from documents
 union all select doc_id, 3 + length(text) - length(replace(text, chr(10), '')), 'break', 'total_' || lang, 'column', case when lang <> 'fr' then source end, case when lang = 'fr' then 'no reason' end from documents""")
def pragma_scan(spark, sf_dir):
    """A directive for the model, one in a literal, which is none, and one for the column that follows."""
    first = F.concat(F.lit("-- ripple:allow("), F.when(F.col("lang") == "en", "change").otherwise("break"), F.lit(")"), F.when(F.col("source") == "src1", F.concat(F.lit(" column="), "lang")).otherwise(""), F.lit(' reason="'), "source", F.lit('"\n'))
    inner = F.concat(F.lit("select '-- ripple:allow-change reason=x "), _plain_text(), F.lit("' as body,\n"))
    last = F.concat(F.lit("-- ripple:allow-break "), F.when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit("reason='"), "source", F.lit("'"))), F.lit("\n sum(x, y) as total_"), "lang", F.lit(" from t"))
    return Tables(spark, sf_dir).documents.select("doc_id", F.explode(text.pragmas(F.concat(first, inner, last))).alias("d")).select("doc_id", "d.*")


# ---- impact


ROWSET = """v as (select distinct l_partkey as src, l_orderkey as dst from lineitem where l_returnflag = 'N'), p as (select distinct l_partkey as src, l_orderkey as dst from lineitem where l_returnflag = 'R'),
 r as (select p_partkey as src from part where p_type = 'ECONOMY'), u as (select * from p where not exists (select 1 from v where v.src = p.src and v.dst = p.dst) and src in (select src from r)),
 x as (select dst, min(src) as src, count(*) as n_sources from u where dst not in (select dst from v where src in (select src from r)) group by dst)"""


def _rowset(t: Tables) -> DataFrame:
    use = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return impact.rowset_dependents(t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("src")), use("R"), use("N"))


@_query(f"with {ROWSET} select * from x")
def rowset_dependents(spark, sf_dir):
    return _rowset(Tables(spark, sf_dir))


@_query(f"""with {ROWSET}, o as (select distinct dst from x)
 select 0 as level, count(*) as n_nodes from o union all select 1, count(distinct (l_orderkey, l_linenumber)) from lineitem where l_orderkey in (select dst from o)""")
def rowset_transitive(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return impact.rowset_reach(_rowset(t).select(_id("o", "dst").alias("node")), _edges(t)).groupBy("level").agg(F.count("*").alias("n_nodes"))


@_query(f"""with {ROWSET}, w as (select distinct l_orderkey as node, 1 as level from lineitem join part on p_partkey = l_partkey where p_type = 'ECONOMY' and l_returnflag = 'N'),
 b as (select node, 'derived_recompute' as mechanism, level from w union all select dst, 'rowset_filter', 1 from x where dst not in (select node from w)),
 e as (select o_custkey as node, min(level) + 1 as level from b join orders on o_orderkey = b.node group by 1)
 select mechanism, level, count(*) as n_nodes from (select * from b union all select node, 'exposure', level from e) group by 1, 2""")
def column_impact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = F.lit("p_type").alias("key")
    hit = t.lineitem.where("l_returnflag = 'N'").join(t.part.where("p_type = 'ECONOMY'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    values = hit.select(key, F.col("l_orderkey").alias("node"), F.lit(1).alias("level"), F.lit("derived").alias("transformation")).distinct()
    rowset = _rowset(t).select(key, F.col("dst").alias("node"), F.lit(1).alias("level"))
    shown = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return impact.column_impact(values, rowset, shown).groupBy("mechanism", "level").agg(F.count("*").alias("n_nodes"))


@_query(f"""with recursive {EDGES}, d(node) as (select 'o1' union select e.dst from d join edges e on e.src = d.node), u(node) as (select 'o1' union select e.src from u join edges e on e.dst = u.node)
 select node, case when node = 'o1' then 'self' else side end as side from (select node, 'downstream' as side from d union select node, 'upstream' from u where node <> 'o1')""")
def node_selector(spark, sf_dir):
    return graph.select(_edges(Tables(spark, sf_dir)), "o1").select("node", "side")


@_query(f"""with recursive {EDGES}, w(key, node, level) as (select r_regionkey, 'r' || r_regionkey, 0 from region union select w.key, e.dst, w.level + 1 from w join edges e on e.src = w.node),
 m as (select key, node, min(level) as level from w group by 1, 2)
 select key, level, case substr(node, 1, 1) when 'n' then 'direct' when 's' then 'renamed' when 'o' then 'renamed' else 'derived' end as transformation, count(*) as n_nodes from m where level > 0 group by 1, 2, 3""")
def changeset_impact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kind = F.substring("dst", 1, 1)
    way = F.when(kind == "n", "direct").when(kind.isin("s", "o"), "renamed").otherwise("derived")
    reached = graph.layered_levels([e.withColumn("weight", graph.severity(way)) for e in _layers(t)], _seeds(t)).where("level > 0")
    return reached.groupBy("key", "level", graph.transformation(F.col("weight")).alias("transformation")).agg(F.count("*").alias("n_nodes"))


def _resolution(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    n = F.length("text")
    status = impact.partition_status(n < 60, n > 400, F.col("text").contains("###"), F.col("quality").isNotNull(), F.col("lang") == "es")
    return rows.select("doc_id", "source", "lang", status.alias("status"))


RESOLUTION = """res as (select d.doc_id, source, lang, case when length(text) < 60 then 'opaque' when length(text) > 400 and contains(text, '###') then 'partial_edges' when length(text) > 400 and quality is not null then 'catalog_backed'
  when length(text) > 400 then 'parsed' when lang = 'es' then 'parse_failed' else 'no_column_info' end as status from documents d left join labels l on l.doc_id = d.doc_id)"""


@_query(f"with {RESOLUTION} select status, count(*) as n_models from res group by 1")
def reach_partition(spark, sf_dir):
    return _resolution(Tables(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n_models"))


@_query(f"""with {RESOLUTION} select source, count(*) filter (status = 'catalog_backed') as n_catalog_backed, count(*) filter (status = 'parsed') as n_parsed, count(*) filter (status = 'partial_edges') as n_partial_edges, count(*) filter (status = 'opaque') as n_opaque,
 count(*) filter (status = 'parse_failed') as n_parse_failed, count(*) filter (status = 'no_column_info') as n_no_column_info, count(*) filter (lang = 'fr') as n_indeterminate_logic, count(*) as n_total, case when count(*) filter (status not in ('catalog_backed', 'parsed') or lang = 'fr') = 0 then 'full' else 'partial' end as level from res group by 1""")
def confidence_block(spark, sf_dir):
    return impact.confidence(_resolution(Tables(spark, sf_dir)), ["source"], F.col("lang") == "fr")


@_query(f"""with {RESOLUTION} select status, reason, n_models, row_number() over (partition by status order by n_models desc, reason) as rank from (select status, lang as reason, count(*) as n_models from res group by 1, 2)""")
def resolution_ranked_reasons(spark, sf_dir):
    return impact.ranked_reasons(_resolution(Tables(spark, sf_dir)).withColumnRenamed("lang", "reason"))


@_query("""with e as (select 's' || s_suppkey as node from supplier where s_acctbal < 0), r as (select distinct 's' || l_suppkey as node from lineitem where l_returnflag = 'R' and l_discount > 0.09 and l_quantity > 48),
 u as (select 's' || s_suppkey as node from supplier where s_nationkey = 3), m as (select node from e union select node from r union select node from u)
 select node, case when node in (select node from m) then 'rebuild' else 'skippable' end as status from (select 's' || s_suppkey as node from supplier)""")
def rebuild_selection(spark, sf_dir):
    return _chosen(Tables(spark, sf_dir))


def _chosen(t: Tables) -> DataFrame:
    node = _id("s", "s_suppkey").alias("node")
    heavy = (F.col("l_discount") > 0.09) & (F.col("l_quantity") > 48)
    reached = t.lineitem.where(heavy).groupBy(_id("s", "l_suppkey").alias("node")).agg((~F.bool_or(F.col("l_returnflag") == "R")).alias("additive"))
    return impact.selection(t.supplier.where("s_acctbal < 0").select(node), reached, t.supplier.where("s_nationkey = 3").select(node), t.supplier.select(node), widen=False)


@_query("""with n as (select 'd' || d.doc_id as name, l.doc_id is not null as in_catalog from documents d left join labels l on l.doc_id = d.doc_id)
 select count(*) as n_models, count(*) filter (in_catalog) as n_catalog, count(*) filter (not in_catalog) as n_missing,
 (select string_agg(name, ',' order by name) from (select name from n where not in_catalog order by name limit 25)) as missing_names, count(*) filter (not in_catalog) = 0 as complete from n""")
def coverage_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    known = t.labels.select("doc_id", F.lit(True).alias("k"))
    return impact.coverage(t.documents.join(known, "doc_id", "left").select(_id("d", "doc_id").alias("name"), F.coalesce("k", F.lit(False)).alias("in_catalog")))


# ---- verdict


@_query("""with gone as (select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'O' except select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'F'),
 x as (select l_orderkey as test_id, l_suppkey, l_partkey from lineitem where l_linestatus = 'O' and (l_suppkey, l_partkey) in (select (l_suppkey, l_partkey) from gone) and l_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F'))
 select test_id, l_suppkey, l_partkey from (select *, row_number() over (partition by test_id order by l_suppkey, l_partkey) as k from x) where k = 1""")
def provable_breaks(spark, sf_dir):
    b, h = _sides(Tables(spark, sf_dir))
    return verdict.provable_breaks(b, b, h, h, ["l_suppkey", "l_partkey"])


@_query("""with gone as (select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'O' except select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'F'),
 t as (select l_orderkey as test_id, l_suppkey, l_partkey, case when l_linenumber % 2 = 1 then 'own' else 'referenced' end as side from lineitem where l_linestatus = 'O'),
 x as (select * from t where (l_suppkey, l_partkey) in (select (l_suppkey, l_partkey) from gone) and test_id in (select l_orderkey from lineitem where l_linestatus = 'F'))
 select test_id, side, l_suppkey, l_partkey from (select *, row_number() over (partition by test_id order by side, l_suppkey, l_partkey) as k from x) where k = 1""")
def relationship_breaks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b, h = _sides(t)
    tests = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("test_id"), "l_suppkey", "l_partkey", "l_linenumber")
    return verdict.provable_breaks(tests.where("l_linenumber % 2 = 1"), b, h, h, ["l_suppkey", "l_partkey"], tests.where("l_linenumber % 2 = 0"))


@_query("""with f as (select o_custkey as custkey, o_orderstatus = 'P' and o_orderpriority = '1-URGENT' as is_break, o_totalprice < 200000 as excused, o_orderpriority = '2-HIGH' and o_orderstatus = 'O' as critical, o_totalprice < 150000 as overridden,
  o_totalprice > 480000 as fl, o_totalprice between 470000 and 475000 as ex, o_totalprice between 460000 and 462000 as sh from orders)
 select custkey, case when bool_or(is_break and not excused) then 'block' when bool_or(is_break) or (bool_or(critical or fl or ex) and not bool_and(overridden or not (critical or fl or ex))) or bool_or(sh and not overridden) then 'review' else 'safe' end as verdict, count(*) filter (is_break and not excused) as n_unexcused from f group by 1""")
def verdict_rollup(spark, sf_dir):
    c, p, s, price = F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    facts = Tables(spark, sf_dir).orders.select(c.alias("custkey"), ((s == "P") & (p == "1-URGENT")).alias("is_break"), (price < 200000).alias("excused"), ((p == "2-HIGH") & (s == "O")).alias("critical"), (price < 150000).alias("overridden"), (price > 480000).alias("is_filter"), price.between(470000, 475000).alias("is_exposure"), price.between(460000, 462000).alias("is_shift"))
    return verdict.verdict(facts, ["custkey"])


@_query("""with g as (select o_custkey as custkey, count(*) filter (o_orderpriority = '1-URGENT' and o_totalprice > 450000) as b, count(*) filter (o_orderpriority = '2-HIGH' and o_totalprice > 450000) as e, count(*) filter (o_totalprice > 480000) as c, count(*) as n from orders group by 1)
 select level, count(*) as n_customers, sum(case when level in ('tests', 'exposures') then 1 else 0 end) as n_failed from (select case when b > 0 then 'tests' when e > 0 then 'exposures' when c > 0 then 'critical' when n > 0 then 'any' else 'none' end as level from g) group by 1""")
def gate_levels(spark, sf_dir):
    p, price = F.col("o_orderpriority"), F.col("o_totalprice")
    g = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.count_if((p == "1-URGENT") & (price > 450000)).alias("b"), F.count_if((p == "2-HIGH") & (price > 450000)).alias("e"), F.count_if(price > 480000).alias("c"), F.count("*").alias("n"))
    level = verdict.gate_level(F.col("b"), F.col("e"), F.col("c"), F.col("n"))
    return g.select(level.alias("level")).withColumn("f", verdict.gate_exit(F.col("level"), "exposures")).groupBy("level").agg(F.count("*").alias("n_customers"), F.sum("f").alias("n_failed"))


@_query("""select case when v is null then 'none' when b and v = 'change' then 'ineffective' else 'applied' end as audit, count(*) as n_orders from (select case when o_totalprice < 50000 then 'break' when o_totalprice < 120000 then 'change' end as v, o_orderstatus = 'P' as b from orders) group by 1""")
def override_audit(spark, sf_dir):
    v = F.when(F.col("o_totalprice") < 50000, "break").when(F.col("o_totalprice") < 120000, "change")
    return Tables(spark, sf_dir).orders.groupBy(F.coalesce(verdict.override_audit(v, F.col("o_orderstatus") == "P"), F.lit("none")).alias("audit")).agg(F.count("*").alias("n_orders"))


# ---- policy: events are the subjects; k is metadata that is there unless it is a multiple of 3


def _subjects(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", "user_id", "event_type", "value", F.when(k % 3 != 0, k).alias("k"), (k % 10 == 7).alias("malformed"))


SUBJECTS = """s as (select event_id, user_id, event_type, value, case when k0 % 3 <> 0 then k0 end as k, k0 % 10 = 7 as malformed from (select *, cast(json_extract(props, '$.k') as int) as k0 from events))"""

POLICY = {
    "version": 1,
    "defaults": {"on_missing_meta": "fail_closed", "on_error": "skip"},
    "rules": [
        {"name": "large_k", "decision": "block", "when": {"all": [{"field": "k", "op": "ge", "value": 80}, {"field": "event_type", "op": "in", "value": ["error", "click"]}]}},
        {"name": "cheap", "decision": "warn", "when": {"any": [{"field": "value", "op": "lt", "value": 1.0}, {"not": {"field": "k", "op": "le", "value": 90}}]}},
        {"name": "no_k", "decision": "warn", "on_missing_meta": "fail_open", "when": {"all": [{"field": "k", "op": "absent"}, {"field": "event_type", "op": "matches", "value": "pur.*"}]}},
    ],
}

#: value and cause of each rule; a malformed k is no value of the right shape
RULES = """v as (select *, case when not malformed then k end as kv from s),
 r as (select event_id, user_id, 'large_k' as rule, 'block' as decision, 'fail_closed' as miss, (kv >= 80) and event_type in ('error', 'click') as v, malformed as e from v
  union all select event_id, user_id, 'cheap', 'warn', 'fail_closed', (value < 1.0) or not (kv <= 90), malformed from v
  union all select event_id, user_id, 'no_k', 'warn', 'fail_open', (case when not malformed then k is null end) and regexp_full_match(event_type, 'pur.*'), malformed from v),
 c as (select *, case when v then 'true' when not v then 'false' when e then 'error' else 'missing' end as cause from r),
 h as (select *, case when v then 'fire' when not v then 'quiet' when e then 'dropped' when miss = 'fail_closed' and decision = 'block' then 'fire' else 'quiet' end as outcome from c)"""


def _hits(t: Tables) -> DataFrame:
    return policy.evaluate(POLICY, _subjects(t), ["event_id", "user_id"], {"k": F.col("malformed")})


@_query(f"with {SUBJECTS}, {RULES} select rule, outcome, cause, decision, count(*) as n_events from h where outcome <> 'quiet' group by 1, 2, 3, 4")
def fail_safe_resolution(spark, sf_dir):
    return _hits(Tables(spark, sf_dir)).groupBy("rule", "outcome", "cause", "decision").agg(F.count("*").alias("n_events"))


@_query(f"with {SUBJECTS}, {RULES} select event_id, user_id, case max(case decision when 'block' then 2 else 1 end) when 2 then 'block' else 'warn' end as decision, count(*) as n_hits from h where outcome = 'fire' group by 1, 2")
def policy_verdict(spark, sf_dir):
    return policy.combine(_hits(Tables(spark, sf_dir)), ["event_id", "user_id"])


@_query(f"with {SUBJECTS} select event_type, cast(v as varchar) as value, count(*) as n_events from (select event_type, (k > 50 and value > 5) or not (k < 20) as v from s) group by 1, 2")
def kleene_rules(spark, sf_dir):
    leaf = lambda f, op, x: {"field": f, "op": op, "value": x}
    v = policy.compile_predicate({"any": [{"all": [leaf("k", "gt", 50), leaf("value", "gt", 5)]}, {"not": leaf("k", "lt", 20)}]})
    return _subjects(Tables(spark, sf_dir)).groupBy("event_type", v.value.cast("string").alias("value")).agg(F.count("*").alias("n_events"))


@_query(f"""with {SUBJECTS} select event_type, case when v then 'true' when not v then 'false' when malformed then 'error' else 'missing' end as cause, count(*) as n_events
 from (select event_type, malformed, (case when not malformed then k end) > 50 as v from s) group by 1, 2""")
def kleene_cause(spark, sf_dir):
    v = policy.compile_predicate({"field": "k", "op": "gt", "value": 50}, {"k": F.col("malformed")})
    return _subjects(Tables(spark, sf_dir)).groupBy("event_type", v.cause().alias("cause")).agg(F.count("*").alias("n_events"))


@_query("""with g as (select user_id, date_trunc('day', ts) as d, list_sort(list(distinct event_type)) as tags from events group by 1, 2)
 select user_id, count(*) filter (list_has_any(tags, ['error', 'signup'])) as n_intersects, count(*) filter (list_has_all(['click', 'view', 'purchase'], tags)) as n_subset,
 count(*) filter (list_has_all(tags, ['click', 'view'])) as n_superset, count(*) filter (not list_has_all(['click', 'view', 'purchase'], tags)) as n_not_subset from g group by 1""")
def set_operators(spark, sf_dir):
    g = Tables(spark, sf_dir).events.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.collect_set("event_type").alias("tags"))
    arr = lambda *x: F.array(*map(F.lit, x))
    test = lambda op, x: F.count_if(tri.compare(op, F.col("tags"), x))
    return g.groupBy("user_id").agg(test("intersects", arr("error", "signup")).alias("n_intersects"), test("subset_of", arr("click", "view", "purchase")).alias("n_subset"), test("superset_of", arr("click", "view")).alias("n_superset"), test("not_subset_of", arr("click", "view", "purchase")).alias("n_not_subset"))


@_query("""select k, count(*) as n_events, round(avg(value), 6) as mean_value from (select cast(json_extract(props, '$.k') as bigint) as k, value from events) group by 1""")
def dotted_meta_lookup(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy(F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")).agg(F.count("*").alias("n_events"), F.round(F.avg("value"), 6).alias("mean_value"))


#: Metadata of seven shapes: absent, null, text, list, boolean, object, number.
AXES_JSON = """case k % 7 when 0 then '{"m": {}}' when 1 then '{"m": {"k": null}}' when 2 then concat('{"m": {"k": "s', k, '"}}') when 3 then concat('{"m": {"k": ["a', k % 3, '", "b"]}}')
 when 4 then concat('{"m": {"k": ', if(k % 2 = 0, 'true', 'false'), '}}') when 5 then concat('{"m": {"k": {"z": ', k, '}}}') else concat('{"m": {"k": ', k, '}}') end"""
#: operator, operand, and in SQL: when it holds, and for which shapes it has an answer
AXES_OPS = [
    ("exists", None, "s <> 0", "true"), ("absent", None, "s = 0", "true"), ("is_true", None, "s <> 0 and t", "true"), ("is_false", None, "s <> 0 and not t", "true"),
    ("eq", "s9", "s = 2 and k = 9", "s <> 0"), ("ne", "s9", "not (s = 2 and k = 9)", "s <> 0"), ("in", ["s9", "s16", 13], "s = 2 and k in (9, 16) or s = 6 and k = 13", "s <> 0"), ("not_in", ["s9", "s16", 13], "not (s = 2 and k in (9, 16) or s = 6 and k = 13)", "s <> 0"),
    ("matches", "s1.*", "s = 2 and starts_with(k::varchar, '1')", "s in (1, 2, 4, 6)"), ("intersects", ["a1", "c"], "k % 3 = 1", "s = 3"), ("subset_of", ["a1", "b"], "k % 3 = 1", "s = 3"), ("not_subset_of", ["a1", "b"], "k % 3 <> 1", "s = 3"), ("superset_of", ["b"], "true", "s = 3"),
    ("gt", 50, "k > 50", "s = 6"), ("ge", 55, "k >= 55", "s = 6"), ("lt", 20, "k < 20", "s = 6"), ("le", 6.5, "k <= 6.5", "s = 6"),
]


def _axes_sql() -> str:
    rows, sets = [], {"intersects": "false", "subset_of": "true", "not_subset_of": "false", "superset_of": "false"}
    for op, _, holds, fits in AXES_OPS:
        cause = f"case when s = 0 and not ({fits}) then 'missing' when not ({fits}) then 'error' when {holds} then 'true' else 'false' end"
        rows.append(f"select 'meta' as axis, '{op}' as op, {cause} as cause from s")
        empty = f"case when s in (0, 1) then '{sets[op]}' else {cause} end" if op in sets else cause
        rows.append(f"select 'config', '{op}', {empty} from s")
        # the folded value is true, false or unknown where there is no own one
        folded = {"exists": "true", "absent": "false", "is_true": "u = 2", "is_false": "u = 0", "eq": "false", "ne": "true", "in": "false", "not_in": "true", "matches": "false"}.get(op)
        inherited = f"case when {folded} then 'true' else 'false' end" if folded else "'error'"
        rows.append(f"select 'inferred', '{op}', case when s <> 0 then {cause} when u = 1 then 'missing' else {inherited} end from s")
    return " union all ".join(rows)


@_query(f"""with s as (select k, k % 7 as s, user_id % 3 as u, case k % 7 when 1 then false when 4 then k % 2 = 0 else true end as t from (select user_id, cast(json_extract(props, '$.k') as bigint) as k from events))
 select axis, op, cause, count(*) as n_events from ({_axes_sql()}) group by 1, 2, 3""")
def metadata_axes(spark, sf_dir):
    """Every operator on every shape of metadata, on the three axes; the SQL knows the shapes and reads no JSON."""
    shaped = Tables(spark, sf_dir).events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).selectExpr("user_id % 3 as u", f"{AXES_JSON} as json")
    # metadata that is there many times is judged once
    s = shaped.groupBy("u", "json").agg(F.count("*").alias("n")).select("u", F.parse_json("json").alias("m"), "n")
    own, levels = meta.lookup(F.col("m"), "m.k"), F.create_map(F.lit("m.k"), F.col("u").cast("int"))
    axes = (("meta", meta.compare, own), ("config", meta.compare_config, own), ("inferred", meta.compare_inferred, meta.inferred_lookup(F.col("m"), levels, "m.k")))
    found = [F.struct(F.lit(axis).alias("axis"), F.lit(op).alias("op"), compare(op, v, x).cause().alias("cause")) for axis, compare, v in axes for op, x, _, _ in AXES_OPS]
    return s.select("n", F.explode(F.array(*found)).alias("x")).groupBy("x.axis", "x.op", "x.cause").agg(F.sum("n").alias("n_events"))


REACH_POLICY = {
    "version": 1,
    "defaults": {"on_missing_meta": "fail_closed", "on_error": "skip", "on_meaning_changed": "block", "on_indeterminate": "warn"},
    "rules": [
        {"name": "tiers", "decision": "block", "when": {"all": [{"change": {"field": "breaking", "op": "is_true"}}, {"reach": {"kind": "model", "mechanism": ["derived_recompute"], "min_count": 2, "where": {"meta": {"key": "tier", "op": "ge", "value": 3}}}}]}},
        {"name": "shown", "decision": "warn", "when": {"reach": {"kind": "exposure", "where": {"all": [{"meta": {"key": "owner.name", "op": "matches", "value": "c1.*"}}, {"not": {"meta": {"key": "tier", "op": "eq", "value": 0}}}]}}}},
        {"name": "alone", "decision": "warn", "when": {"not": {"structural": {"fact": "reaches_anything"}}}},
    ],
}


@_query("""with c as (select c_custkey as k, case c_custkey % 4 when 0 then 'meaning_changed' when 1 then 'equivalent' when 2 then 'indeterminate' end as semantic, c_custkey % 10 <> 0 as resolved from customer),
 o as (select o_custkey as k, o_orderpriority = '1-URGENT' as shown, o_orderstatus = 'F' as derived, case when o_orderkey % 7 = 0 then 'missing' when o_orderkey % 11 = 0 then 'error' end as bad, o_orderkey % 5 as tier from orders),
 n as (select k, count(*) as n, count(*) filter (not shown and derived and bad is null and tier >= 3) as mt, count(*) filter (not shown and derived and bad is not null) as mu, count(*) filter (not shown and derived and bad = 'error') as me,
   count(*) filter (shown and starts_with(k::varchar, '1') and not (bad is null and tier = 0) and bad is distinct from 'missing') as st, count(*) filter (shown and starts_with(k::varchar, '1') and bad = 'missing') as su from o group by 1),
 j as (select c.*, coalesce(n, 0) as n, coalesce(mt, 0) as mt, coalesce(mu, 0) as mu, coalesce(me, 0) as me, coalesce(st, 0) as st, coalesce(su, 0) as su from c left join n using (k)),
 r as (select 'tiers' as rule, 'block' as decision, case when semantic = 'equivalent' then 'false' when not resolved then 'missing' when mt >= 2 then 'true' when mt + mu < 2 then 'false' when me > 0 then 'error' else 'missing' end as cause from j
  union all select 'shown', 'warn', case when not resolved then 'missing' when st >= 1 then 'true' when su >= 1 then 'missing' else 'false' end from j
  union all select 'alone', 'warn', case when not resolved then 'missing' when n = 0 then 'true' else 'false' end from j)
 select rule, case when cause = 'true' or cause = 'missing' and decision = 'block' then 'fire' when cause = 'error' then 'dropped' end as outcome, cause, decision, count(*) as n_changes from r where cause in ('true', 'error') or cause = 'missing' and decision = 'block' group by all
 union all select 'builtin:on_' || semantic, 'fire', 'true', case semantic when 'indeterminate' then 'warn' else 'block' end, count(*) from c where semantic in ('indeterminate', 'meaning_changed') group by 1, 4""")
def policy_axes(spark, sf_dir):
    """Rules over changes (customers) and what they reach (orders): models with metadata, and exposures with owners."""
    t = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    semantic = F.when(k % 4 == 0, "meaning_changed").when(k % 4 == 1, "equivalent").when(k % 4 == 2, "indeterminate")
    none = F.lit(None).cast("variant")
    tier = F.when(F.col("o_orderkey") % 7 == 0, "{}").when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit('{"tier": "t'), "o_orderkey", F.lit('"}'))).otherwise(F.concat(F.lit('{"tier": '), F.col("o_orderkey") % 5, F.lit("}")))
    shown = F.col("o_orderpriority") == "1-URGENT"
    reached = t.orders.select(F.col("o_custkey").alias("k"), F.when(shown, "exposure").otherwise("model").alias("reached_kind"), F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "derived_recompute").otherwise("direct_passthrough").alias("mechanism"), F.parse_json(tier).alias("meta"))
    reached = reached.select("*", none.alias("config"), F.lit("app").alias("type"), F.parse_json(F.concat(F.lit('{"name": "c'), "k", F.lit('"}'))).alias("owner"), none.alias("dashboard"), F.create_map().cast("map<string,int>").alias("inferred"))
    changes = t.customer.select(k.alias("k"), semantic.alias("semantic"), (k % 10 != 0).alias("resolved"), F.lit("m").alias("model"), F.lit("c").alias("column"), F.lit("logic_changed").alias("kind"))
    subjects = changes.join(reached.groupBy("k").agg(F.count("*").alias("n_reached")), "k", "left")
    hits = policy.evaluate(REACH_POLICY, policy.with_reaches(REACH_POLICY, subjects, reached, ["k"]), ["k"]).unionByName(policy.semantic_default_hits(REACH_POLICY, changes, ["k"]))
    return hits.groupBy("rule", "outcome", "cause", "decision").agg(F.count("*").alias("n_changes"))


@_query(f"""with {SUBJECTS}, n as (select user_id, event_type, count(*) filter (k > 70) as t, count(*) filter (k is null) as u from s group by 1, 2)
 select user_id, event_type, t as n_true, u as n_unknown, case when t >= 5 then 'true' when t + u >= 5 then 'unknown' else 'false' end as holds from n""")
def quantified_reach(spark, sf_dir):
    s = _subjects(Tables(spark, sf_dir))
    keys = ["user_id", "event_type"]
    leaf = policy.compile_predicate({"field": "k", "op": "gt", "value": 70})
    out = policy.with_reach(s.select(*keys).distinct(), s, leaf, keys)
    holds = policy.compile_predicate({"reach": {"min_count": 5}}).value
    return out.select(*keys, "n_true", "n_unknown", F.coalesce(holds.cast("string"), F.lit("unknown")).alias("holds"))


@_query(f"""with {SUBJECTS}, a as (select user_id, case when bool_or(k > 95) then true when bool_or(k > 95 is null) then null else false end as a, case when bool_or(value > 60) then true when bool_or(value > 60 is null) then null else false end as b from s group by 1)
 select user_id, coalesce(cast(a and b as varchar), 'unknown') as holds from a""")
def aggregate_scope_rule(spark, sf_dir):
    s = _subjects(Tables(spark, sf_dir)).groupBy("user_id").agg(policy.aggregate_leaf(F.col("k") > 95).alias("a"), policy.aggregate_leaf(F.col("value") > 60).alias("b"))
    return s.select("user_id", F.coalesce((F.col("a") & F.col("b")).cast("string"), F.lit("unknown")).alias("holds"))


@_query(f"""with {SUBJECTS}, {RULES}, f as (select distinct user_id from h where outcome = 'fire' and rule = 'large_k')
 select distinct 'e' || event_type || '-' || cast(k as varchar) as node from s where event_type in ('view', 'signup') and k is not null and user_id in (select user_id from f)""")
def policy_build_set(spark, sf_dir):
    t = Tables(spark, sf_dir)
    reached = _subjects(t).where("k is not null").select("user_id", F.col("event_type").alias("mechanism"), F.concat(F.lit("e"), "event_type", F.lit("-"), F.col("k").cast("string")).alias("node"))
    return policy.build_set(_hits(t).where("rule = 'large_k'"), reached, ["user_id"], ["view", "signup"])


@_query(f"""with {SUBJECTS}, {RULES}, x as (select h.decision, case when h.event_id % 5 = 0 then 'break' when h.event_id % 5 = 1 then 'change' end as verb, s.value > 20 as provable, h.rule = 'cheap' as agg from h join s using (event_id) where outcome = 'fire')
 select decision, verb, case when agg or verb is null then decision when verb = 'break' and decision = 'block' then 'warn' when verb = 'change' then case when decision = 'block' and provable then 'block' else 'allow' end else decision end as capped, count(*) as n_hits from x group by 1, 2, 3""")
def override_caps(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = _hits(t).where("outcome = 'fire'").join(t.events.select("event_id", "value"), "event_id")
    verb = F.when(F.col("event_id") % 5 == 0, "break").when(F.col("event_id") % 5 == 1, "change")
    capped = policy.cap(F.col("decision"), F.col("verb"), F.col("value") > 20, F.col("rule") == "cheap")
    return x.withColumn("verb", verb).groupBy("decision", "verb", capped.alias("capped")).agg(F.count("*").alias("n_hits"))


@_query("""select distinct replace(replace('{type} of {user}: {other}', '{type}', event_type), '{user}', cast(user_id as varchar)) as message from events where value > 30""")
def notification_interpolation(spark, sf_dir):
    m = text.interpolate("{type} of {user}: {other}", {"type": F.col("event_type"), "user": F.col("user_id")})
    return Tables(spark, sf_dir).events.where("value > 30").select(m.alias("message")).distinct()


ALL_RULES = "(values ('large_k'), ('cheap'), ('no_k'), ('unused')) as n(rule)"


@_query(f"""with {SUBJECTS}, {RULES}, f as (select h.rule, h.cause, date_trunc('day', e.ts) as point from h join events e using (event_id) where outcome = 'fire')
 select n.rule, count(distinct point) as n_points, count(point) as n_hits, count(*) filter (cause <> 'true') as n_unknown,
 case when count(point) = 0 then 'DEAD' when count(point) = count(*) filter (cause <> 'true') then 'FAIL-SAFE ONLY' else '' end as flag from {ALL_RULES} left join f on f.rule = n.rule group by 1""")
def backtest_rule_stats(spark, sf_dir):
    return _stats(Tables(spark, sf_dir), F.lit(True))


def _stats(t: Tables, when) -> DataFrame:
    days = t.events.where(when).select("event_id", F.date_trunc("day", "ts").alias("point"))
    rules = t.spark.sql("select * from values ('large_k'), ('cheap'), ('no_k'), ('unused') as n(rule)")
    return policy.rule_stats(_hits(t).where("outcome = 'fire'").join(days, "event_id"), rules)


@_query(f"""with {SUBJECTS}, {RULES}, f as (select h.rule, e.ts < timestamp '2024-01-15' as old from h join events e using (event_id) where outcome = 'fire')
 select n.rule, count(*) filter (not old) as n_current, count(*) filter (old) as n_baseline, count(*) filter (not old) - count(*) filter (old) as delta from {ALL_RULES} left join f on f.rule = n.rule group by 1""")
def baseline_delta(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return policy.baseline_delta(_stats(t, ~old), _stats(t, old))


@_query("""with p as (select date_trunc('day', ts) as d, count(distinct user_id) filter (value > 20) as r, count(distinct user_id) as n, bool_or(value > 150) as w from events group by 1)
 select count(*) as n_points, count(*) filter (w) as n_widened, round(median(r / n), 6) as median_share, round(avg(r / n), 6) as mean_share from p""")
def backtest_selection_stats(spark, sf_dir):
    points = Tables(spark, sf_dir).events.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count_distinct(F.when(F.col("value") > 20, F.col("user_id"))).alias("n_rebuild"), F.count_distinct("user_id").alias("n_total"), F.bool_or(F.col("value") > 150).alias("widened"))
    return policy.selection_stats(points)


@_query("""with k as (select unnest(json_keys(props)) as key from events) select key, count(*) as n, round(100.0 * count(*) / (select count(*) from events), 4) as pct from k group by 1""")
def meta_key_histogram(spark, sf_dir):
    return policy.key_coverage(Tables(spark, sf_dir).events, "props")


# ---- two versions: orders are in the base unless their key leaves 0 by 4, in the head unless it leaves 1


def _two_versions(t: Tables) -> tuple[DataFrame, ...]:
    version = lambda key: F.explode(F.array_compact(F.array(F.when(F.col(key) % 4 != 0, "base"), F.when(F.col(key) % 4 != 1, "head")))).alias("version")
    kind = F.when(F.col("l_returnflag") == "R", "derived").when(F.col("l_returnflag") == "A", "renamed").otherwise("direct")
    lead = lambda df, key, a, src, b, dst, how: df.select(version(key), _id(a, src).alias("src"), _id(b, dst).alias("dst"), how.alias("transformation"), F.lit(a).alias("src_kind"), F.lit(b).alias("dst_kind"))
    edges = lead(t.orders, "o_orderkey", "c", "o_custkey", "o", "o_orderkey", F.lit("direct")).unionByName(lead(t.lineitem, "l_orderkey", "o", "l_orderkey", "s", "l_suppkey", kind))
    change = F.when(F.col("c_acctbal") < 0, "removed").when(F.col("c_acctbal") > 9000, "added").when(F.col("c_custkey") % 9 == 0, "type_changed")
    changes = t.customer.select(F.col("c_custkey").alias("key"), _id("c", "c_custkey").alias("node"), F.lit("c").alias("node_kind"), change.alias("kind")).where("kind is not null")
    shown = t.supplier.where("s_acctbal > 0").select(F.explode(F.array(F.lit("base"), F.lit("head"))).alias("version"), _id("s", "s_suppkey").alias("node"), _id("n", "s_nationkey").alias("exposure"))
    return changes, versions.ends(edges), edges, shown


TWO_VERSIONS = """c as (select c_custkey as key, case when c_acctbal < 0 then 'removed' when c_acctbal > 9000 then 'added' when c_custkey % 9 = 0 then 'type_changed' end as kind from customer),
 s as (select *, case kind when 'removed' then 'base' else 'head' end as version, case kind when 'removed' then 0 else 1 end as out from c where kind is not null),
 o as (select s.key, s.version, o_orderkey as k from s join orders on o_custkey = s.key and o_orderkey % 4 <> s.out),
 l as (select o.key, o.version, l_suppkey as k, max(case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end) as severity from o join lineitem on l_orderkey = o.k group by 1, 2, 3),
 x as (select distinct key, s_nationkey as k from l join supplier on s_suppkey = l.k where s_acctbal > 0)"""


@_query(f"""with {TWO_VERSIONS}, n as (select key, count(distinct k) as a from o group by 1), m as (select key, count(*) as b, count(*) filter (severity = 3) as d from l group by 1), e as (select key, count(*) as x from x group by 1)
 select s.key, kind, version, a is not null as resolved, a + coalesce(b, 0) as n_nodes, case when a is not null then coalesce(d, 0) end as n_derived, case when a is not null then coalesce(x, 0) end as n_exposures
 from s left join n using (key) left join m using (key) left join e using (key)""")
def two_version_impact(spark, sf_dir):
    begun, reached = versions.changeset_reach(*_two_versions(Tables(spark, sf_dir)))
    return versions.by_change(begun, reached)


@_query(f"""with {TWO_VERSIONS}, a as (select 'node' as reached_kind, 'o' || k as node, 1 as severity, key from o union all select 'node', 's' || k, severity, key from l union all select 'exposure', 'n' || k, null, key from x)
 select reached_kind, node, max(severity) as severity, count(distinct key) as n_changes from a group by 1, 2""")
def two_version_affected(spark, sf_dir):
    return versions.affected(versions.changeset_reach(*_two_versions(Tables(spark, sf_dir)))[1])


# ---- replay: a user's purchases are the versions of their metadata, all other events are changes, days are points


REPLAY_POLICY = {
    "version": 1,
    "defaults": {"on_missing_meta": "fail_closed", "on_error": "skip"},
    "rules": [
        {"name": "high", "decision": "block", "when": {"all": [{"meta": {"key": "k", "op": "ge", "value": 70}}, {"field": "event_type", "op": "in", "value": ["error", "signup"]}]}},
        {"name": "low", "decision": "warn", "when": {"meta": {"key": "k", "op": "lt", "value": 25}}},
        {"name": "never", "decision": "block", "when": {"field": "event_type", "op": "eq", "value": "purchase"}},
    ],
}


def _replayed(t: Tables) -> tuple[DataFrame, DataFrame]:
    buys = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.parse_json("props").alias("model_meta"))
    made = t.events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts", "event_type", F.date_trunc("day", "ts").alias("point"))
    known = replay.as_of(made, replay.intervals(buys, "user_id", "ts", "event_id"), "user_id", "ts", ["model_meta"])
    return made, replay.replay(REPLAY_POLICY, known.withColumn("column_meta", F.lit(None).cast("variant")), "point", ["event_id"])


REPLAYED = """b as (select user_id, ts, arg_max(cast(json_extract(props, '$.k') as bigint), event_id) as k from events where event_type = 'purchase' group by 1, 2),
 e as (select date_trunc('day', ts) as point, event_id, user_id, ts, event_type from events where event_type <> 'purchase'), a as (select e.*, b.k from e asof left join b on e.user_id = b.user_id and e.ts >= b.ts),
 h as (select point, 'high' as rule, 'block' as decision, k is null as unsure from a where event_type in ('error', 'signup') and (k is null or k >= 70) union all select point, 'low', 'warn', false from a where k < 25)"""


@_query(f"""with {REPLAYED} select r.rule, count(distinct h.point) filter (decision = 'block') as would_block, count(distinct h.point) filter (decision = 'warn') as would_warn, count(h.rule) as fired, count(*) filter (unsure) as fired_on_unknown, count(h.rule) = 0 as matched_zero
 from (values ('high'), ('low'), ('never')) as r(rule) left join h on h.rule = r.rule group by 1""")
def replay_rules(spark, sf_dir):
    return replay.rule_table(REPLAY_POLICY, _replayed(Tables(spark, sf_dir))[1], "point")


@_query(f"""with {REPLAYED}, p as (select distinct point from e), g as (select point, bool_or(decision = 'block') as b, count(*) as n, count(*) filter (unsure) as u from h group by 1)
 select p.point, case when g.b then 'block' when g.n > 0 then 'warn' else 'allow' end as decision, coalesce(n, 0) as n_hits, coalesce(u, 0) as n_on_unknown from p left join g using (point)""")
def replay_points(spark, sf_dir):
    made, hits = _replayed(Tables(spark, sf_dir))
    return replay.point_decisions(hits, made, "point")


# ---- identity: brands are nodes and parts their columns; the head writes metadata in another order, and changes some


def _catalog(t: Tables, head: bool) -> DataFrame:
    size = F.when((F.col("p_partkey") % 97 == 0) & F.lit(head), F.col("p_size") + 1).otherwise(F.col("p_size"))
    pair = [F.concat(F.lit('"size": '), size), F.concat(F.lit('"type": "'), "p_type", F.lit('"'))]
    rows = t.part.where("p_partkey % 101 <> 0" if head else "p_partkey % 103 <> 0")
    node = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 40).cast("string"))
    return rows.select(node.alias("node"), F.col("p_partkey").cast("string").alias("column"), F.col("p_type").alias("data_type"), F.parse_json(F.concat(F.lit("{"), F.concat_ws(", ", *(pair[::-1] if head else pair)), F.lit("}"))).alias("meta"))


@_query("""with b as (select p_brand || '/' || (p_partkey // 40) as node, list_sort(list((p_partkey, p_size))) as v from part where p_partkey % 103 <> 0 group by 1),
 h as (select p_brand || '/' || (p_partkey // 40) as node, list_sort(list((p_partkey, case when p_partkey % 97 = 0 then p_size + 1 else p_size end))) as v from part where p_partkey % 101 <> 0 group by 1)
 select coalesce(b.node, h.node) as node, case when h.node is null then 'removed' when b.node is null then 'added' else 'changed' end as kind from b full join h on b.node = h.node where b.v is distinct from h.v""")
def catalog_changes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return identity.changed_nodes(identity.node_digests(_catalog(t, False)), identity.node_digests(_catalog(t, True)))


@_query("""select p_brand as node, case when n = 0 then 'unavailable' when same then 'degraded' when stale then 'degraded' else 'available' end as status, case when n = 0 then 'no catalog on a side' when same then 'identical catalogs' when stale then 'stale head catalog' end as reason
 from (select p_brand, count(*) filter (p_size > 49) as n, sum(p_size) % 3 = 0 as same, count(*) % 2 = 0 and sum(p_size) % 5 <> 0 as stale from part group by 1)""")
def structural_availability(spark, sf_dir):
    size, n = F.sum("p_size"), F.count("*")
    run = F.when(size % 5 == 0, "run1").otherwise("run2")
    g = Tables(spark, sf_dir).part.groupBy(F.col("p_brand").alias("node")).agg(F.count_if(F.col("p_size") > 49).alias("base_nodes"), n.alias("head_nodes"), F.lit("x").alias("base_fingerprint"), F.when(size % 3 == 0, "x").otherwise("y").alias("head_fingerprint"), F.when(n % 2 == 0, "2024-01-01T10:00:00Z").otherwise("2024-01-01T12:00:00.5+00:00").alias("catalog_at"), run.alias("catalog_run"), F.lit("2024-01-01T11:00:00.000001Z").alias("manifest_at"), F.lit("run1").alias("manifest_run"))
    return identity.structural_status(g).select("node", "status", "reason")


# ---- dashboards


@_query("""with r as (select p_partkey as id, '"' || p_brand || '"' as db, '[' || p_type || ']' as sc, p_name || ' ' || (p_partkey % 1500) as tb from part),
 k as (select id, lower(replace(db, '"', '')) as db, lower(replace(replace(sc, '[', ''), ']', '')) as sc, lower(tb) as tb from r),
 n as (select distinct id, unnest([db || '.' || sc || '.' || tb, sc || '.' || tb, tb]) as name from k)
 select name, min(id) as relation_id from n group by name having count(*) = 1""")
def relation_index(spark, sf_dir):
    q = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    rel = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("relation_id"), q('"', "p_brand", '"').alias("database"), q("[", "p_type", "]").alias("schema"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 1500).cast("string")).alias("table"))
    return bi.relation_index(rel)


@_query("""with chg as (select s_suppkey as m, p_partkey as c from supplier join (select distinct l_suppkey, l_partkey as p_partkey from lineitem where l_returnflag = 'R') x on l_suppkey = s_suppkey where s_acctbal < 2000),
 cc as (select l_orderkey as card, l_suppkey as m, l_partkey as c from lineitem where l_tax > 0.04), ct as (select l_orderkey as card, l_suppkey as m from lineitem),
 via as (select card, m, c, 0 as r from chg join cc using (m, c) union select card, m, c, 1 from chg join ct using (m) where card not in (select card from cc))
 select o_custkey as dashboard, case min(r) when 0 then 'column' else 'table' end as precision, count(distinct (m, c)) as n_via from via join orders on o_orderkey = card group by 1""")
def dashboard_reach(spark, sf_dir):
    t = Tables(spark, sf_dir)
    line = t.lineitem.select(F.col("l_orderkey").alias("card"), F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("column"), "l_tax", "l_returnflag")
    cheap = t.supplier.where("s_acctbal < 2000").select(F.col("s_suppkey").alias("model"))
    columns = line.where("l_returnflag = 'R'").select("model", "column").distinct().join(cheap, "model")
    return bi.dashboard_reach(columns, line.where("l_tax > 0.04").select("card", "model", "column"), line.select("card", "model").distinct(), t.orders.select(F.col("o_custkey").alias("dashboard"), F.col("o_orderkey").alias("card")))


@_query(f"with {HALVES} select coalesce(b.user_id, h.user_id) as user_id, case when h.user_id is null then 'drop' when b.user_id is null then 'fetch' when b.v = h.v then 'reuse' else 'fetch' end as action from b full join h on b.user_id = h.user_id")
def incremental_reuse(spark, sf_dir):
    return bi.incremental_reuse(*_halves(Tables(spark, sf_dir)), "user_id", "event_type")


@_query("""select case when epoch(timestamp '2024-01-31') - floor(epoch(m)) > 24 * 3600 then 'stale' else 'fresh' end as state, count(*) as n_users from (select user_id, max(ts) as m from events group by 1) group by 1""")
def snapshot_staleness(spark, sf_dir):
    last = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.max("ts").alias("m"))
    return last.groupBy(bi.staleness(F.col("m"), F.lit("2024-01-31").cast("timestamp")).alias("state")).agg(F.count("*").alias("n_users"))


CARDS = """k as (select o_orderkey as k from orders), f as (select i, 't' || (i % 5) as rel, 'c' || i as col from range(9) r(i)),
 m as (select k, p.rel, p.col, 'breakout' as role, 1 as pr from k join f p on p.i = k % 11 union all select k, q.rel, q.col, 'filter', 2 from k join f q on q.i = k % 12),
 i as (select k, rel, col, arg_min(role, pr) as role from m group by 1, 2, 3),
 n as (select k.k, min(i.rel) as rel, 'c3' as col from k join i on i.k = k.k - 1 and i.col = 'c3' where k.k % 5 = 0 group by 1),
 c as (select k, rel, col, arg_min(role, pr) as role from (select k, rel, col, role, 1 as pr from i union all select k, rel, col, 'filter', 2 from n) group by 1, 2, 3),
 b as (select k, rel from c union select k, 't' || (k % 7) from k where k % 5 <> 0 and k % 7 < 5), r as (select k, rel from b union select k.k, b.rel from k join b on b.k = k.k - 1 where k.k % 5 = 0)"""


@_query(f"""with {CARDS}, x as (select k, count(*) as n, count(*) filter (role = 'breakout') as nb from c group by 1), y as (select k, count(*) as n from r group by 1)
 select k.k as card, case when x.n > 0 then 'column' when y.n > 0 then 'table' else 'none' end as precision, case when x.n > 0 then null when y.n > 0 then 'unknown_field' else 'unknown_table' end as reason, coalesce(x.n, 0) as n_columns, coalesce(x.nb, 0) as n_breakout, coalesce(y.n, 0) as n_relations
 from k left join x on x.k = k.k left join y on y.k = k.k""")
def structured_cards(spark, sf_dir):
    """Orders as cards: every fifth reads the card before it, by a nested query where its key ends in 5."""
    k = F.col("o_orderkey").cast("string")
    n = lambda m: (F.col("o_orderkey") % m).cast("string")
    source = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('"card__'), (F.col("o_orderkey") - 1).cast("string"), F.lit('"'))).otherwise(n(7))
    clauses = F.concat(F.lit('"filter": ["and", ["=", ["field", '), n(12), F.lit(', null], 1], [">", ["field", "C3", {"base-type": "x"}], 2]], "breakout": [["field", '), n(11), F.lit(", null]]"))
    inner = F.concat(F.lit('{"source-table": '), source, F.lit(", "), clauses, F.lit("}"))
    query = F.when(F.col("o_orderkey") % 10 == 5, F.concat(F.lit('{"source-query": '), inner, F.lit("}"))).otherwise(inner)
    t = Tables(spark, sf_dir)
    made = t.orders.select(F.col("o_orderkey").alias("card"), F.parse_json(F.concat(F.lit('{"type": "query", "query": '), query, F.lit("}"))).alias("query"))
    fields = spark.range(9).select(F.col("id").alias("field_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("relation"), F.concat(F.lit("c"), "id").alias("column"))
    columns, relations, rows = cards.resolve_cards(made, fields, spark.range(5).select(F.col("id").alias("table_id"), F.concat(F.lit("t"), "id").alias("relation")))
    counted = columns.groupBy("card").agg(F.count("*").alias("n_columns"), F.count_if(F.col("role") == "breakout").alias("n_breakout"))
    return rows.join(counted, "card", "left").join(relations.groupBy("card").agg(F.count("*").alias("n_relations")), "card", "left").fillna(0, ["n_columns", "n_breakout", "n_relations"])


@_query("""select c_nationkey as dashboard_id, count(*) as n_cards, count(*) filter (c_acctbal < 0) as n_archived, 'n' || c_nationkey as tier, count(distinct c_mktsegment) as n_columns from customer where c_nationkey in (select n_nationkey from nation) group by c_nationkey""")
def bi_snapshot(spark, sf_dir):
    """Customers as cards and nations as dashboards: written as a snapshot, loaded again, and joined."""
    t = Tables(spark, sf_dir)
    column = F.struct(F.lit("customer").alias("relation"), F.lower("c_mktsegment").alias("column"), F.lit("filter").alias("role"), F.lit("high").alias("confidence"))
    made = {
        "cards": t.customer.select(F.col("c_custkey").alias("card_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("archived"), F.array(column).alias("columns")),
        "dashboards": t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").cast("long").alias("dashboard_id")).agg(F.collect_list("c_custkey").alias("card_ids")).withColumn("meta", F.parse_json(F.concat(F.lit('{"tier": "n'), "dashboard_id", F.lit('"}')))),
        "relations": spark.sql("select 'customer' as relation, 'customer' as table"),
    }
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    files.dump_snapshot(made, path, {"by": "bi_snapshot"})
    s = files.load_snapshot(spark, path)
    shown = s["dashboards"].select("dashboard_id", F.try_variant_get("meta", "$.tier", "string").alias("tier"), F.explode("card_ids").alias("card_id")).join(s["cards"], "card_id")
    return shown.groupBy("dashboard_id", "tier").agg(F.count("*").alias("n_cards"), F.count_if("archived").alias("n_archived"), F.count_distinct(F.col("columns")[0]["column"]).alias("n_columns"))


@_query(f"""with recursive {EDGES}, w(node, layer) as (select node, 0 from (select src as node from edges union select dst from edges) where node not in (select dst from edges) union all select e.dst, w.layer + 1 from w join edges e on e.src = w.node)
 select substr(node, 1, 1) as kind, layer, count(*) as n_nodes from (select node, max(layer) as layer from w group by node) group by 1, 2""")
def graph_layers(spark, sf_dir):
    return layout.layers(_typed_edges(Tables(spark, sf_dir))).groupBy(F.substring("node", 1, 1).alias("kind"), "layer").agg(F.count("*").alias("n_nodes"))


def _column_edges(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns of models n, c, o and l; part columns are no declared source of l, priorities are of no known model, segments of none."""
    edge = lambda df, m, c, sm, sc: df.select(F.lit(m).alias("model"), F.col(c).cast("string").alias("column"), F.lit(sm).cast("string").alias("src_model"), F.col(sc).cast("string").alias("src_column"))
    edges = edge(t.customer, "C", "c_custkey", "n", "c_nationkey").unionByName(edge(t.customer, "c", "c_custkey", None, "c_mktsegment")).unionByName(edge(t.orders, "o", "o_orderkey", "c", "o_custkey"))
    edges = edges.unionByName(edge(t.orders, "o", "o_orderkey", "ext", "o_orderpriority")).unionByName(edge(t.lineitem, "l", "l_orderkey", "o", "l_orderkey")).unionByName(edge(t.lineitem, "l", "l_orderkey", "p", "l_partkey"))
    declared = t.spark.sql("select * from values ('n', 'c'), ('c', 'o'), ('o', 'L') as d(parent, child)")
    return edges, declared, t.spark.sql("select * from values ('n'), ('c'), ('o'), ('l'), ('p') as m(model)")


@_query("""with s as (select distinct l_orderkey as k from lineitem where l_quantity > 49), o as (select k, o_custkey as ck, o_orderpriority as p from s join orders on o_orderkey = k),
 c as (select k, ck, c_nationkey as nk, c_mktsegment as seg from o join customer on c_custkey = ck)
 select kind, model, level, count(*) as n_refs from (select 'column' as kind, 'o' as model, 1 as level, k from s union all select 'column', 'c', 2, k from o union all select 'column', 'n', 3, k from c union all select 'source', 'ext', 2, k from o union all select 'direct_ref', null, 3, k from c) group by 1, 2, 3""")
def column_sources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    seeds = t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("key"), F.lit("l").alias("model"), F.col("l_orderkey").cast("string").alias("column")).distinct()
    return graph.column_upstream(*_column_edges(t), seeds).groupBy("kind", "model", "level").agg(F.count("*").alias("n_refs"))


@_query("""with c as (select c_custkey as k from customer where c_nationkey = 3), o as (select o_orderkey as k from orders where o_custkey in (select k from c)), l as (select distinct l_orderkey as k from lineitem where l_orderkey in (select k from o))
 select 'self' as side, 'n' as model, 0 as level, 1 as n_columns union all select 'downstream', 'c', 1, count(*) from c union all select 'downstream', 'o', 2, count(*) from o union all select 'downstream', 'l', 3, count(*) from l""")
def column_selector(spark, sf_dir):
    return graph.select_columns(*_column_edges(Tables(spark, sf_dir)), "N.3+").groupBy("side", "model", "level").agg(F.count("*").alias("n_columns"))


@_query("""with m as (select distinct l_suppkey as model from lineitem where l_suppkey % 4 <> 0), c as (select distinct l_suppkey as model, l_partkey as col from lineitem where l_linestatus = 'F' and l_suppkey % 4 <> 0),
 s as (select l_suppkey as model, l_partkey as col, l_linestatus as side, list_sort(list((case when l_returnflag = 'R' then 'derived' else 'direct' end, l_linenumber, case when l_returnflag = 'A' and l_linenumber > 6 then '' else 'x' || l_linenumber % 3 end))) as v,
   bool_or(l_returnflag = 'A' and l_linenumber > 6) as poor from lineitem where l_suppkey % 5 <> 1 group by 1, 2, 3),
 j as (select c.model, c.col, b.v as bv, h.v as hv, coalesce(b.poor, false) or coalesce(h.poor, false) as poor from c left join s b on b.model = c.model and b.col = c.col and b.side = 'O' left join s h on h.model = c.model and h.col = c.col and h.side = 'F')
 select model, case when model % 5 = 1 or poor then 'indeterminate' else 'meaning_changed' end as semantic, count(*) as n_columns from j where model % 5 = 1 or (bv is not null or hv is not null) and (bv is distinct from hv) group by 1, 2""")
def logic_changed_columns(spark, sf_dir):
    """Suppliers as models and parts as columns; models that leave 1 by 5 could be read on neither side."""
    line = Tables(spark, sf_dir).lineitem.where("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("column"), "l_linestatus", F.when(F.col("l_returnflag") == "R", "derived").otherwise("direct").alias("transformation"), F.col("l_linenumber").cast("string").alias("source"), F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 6), "").otherwise(F.concat(F.lit("x"), F.col("l_linenumber") % 3)).alias("expression"))
    side = lambda s: line.where((F.col("l_linestatus") == s) & (F.col("model") % 5 != 1))
    found = diff.logic_changed_columns(line, line.where("l_linestatus = 'F'"), side("O"), side("F").withColumn("expression", F.concat(F.lit(" "), F.upper("expression"), F.lit(" -- note"))))
    return found.groupBy("model", "semantic").agg(F.count("*").alias("n_columns"))


@_query("""with f as (select doc_id, case when lang = 'en' then 'model' when lang = 'de' then 'macro' when lang = 'fr' then 'logic' else 'ignorable' end as scope, source from documents),
 l as (select doc_id from labels) select source, count(*) as n_changes, count(*) filter (f.doc_id not in (select doc_id from l)) as n_whole from f where scope = 'model' group by 1""")
def git_fallback(spark, sf_dir):
    """Documents as changed files: English ones are models, whose columns are their labels where they have some."""
    t = Tables(spark, sf_dir)
    name = F.concat(F.lit("f"), "doc_id", F.when(F.col("lang").isin("en", "de", "fr"), ".sql").otherwise(".md"))
    docs = t.documents.select("doc_id", "source", "lang", name.alias("file"))
    paths = docs.where("lang in ('en', 'de')").select("file", F.col("doc_id").cast("string").alias("node"), F.when(F.col("lang") == "de", "macro").otherwise("model").alias("resource"))
    columns = t.labels.select(F.col("doc_id").cast("string").alias("model"), F.lit("quality").alias("column"))
    found = diff.git_changeset(diff.git_scope(docs.select("file"), paths), columns).join(docs.select(F.col("doc_id").cast("string").alias("model"), "source"), "model")
    return found.groupBy("source").agg(F.count("*").alias("n_changes"), F.count_if(F.col("column") == "*").alias("n_whole"))


@_query("""with c as (select distinct o_custkey as key, l_suppkey as model, l_partkey as col, case l_returnflag when 'R' then 'derived_recompute' when 'A' then 'renamed_passthrough' else 'direct_passthrough' end as mech from orders join lineitem on l_orderkey = o_orderkey where l_quantity < 30),
 m as (select distinct o_custkey as key, l_suppkey as model from orders join lineitem on l_orderkey = o_orderkey), w as (select distinct m.key, m.model, c.mech from m left join c on c.key = m.key and c.model = m.model)
 select reached_kind, mechanism, count(*) as n_rows from (select 'column' as reached_kind, mech as mechanism from c union all select 'model', mech from w union all select 'exposure', null from (select distinct o_custkey, o_orderpriority from orders)) group by 1, 2""")
def reach_by_name(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kind = F.when(F.col("l_returnflag") == "R", "derived").when(F.col("l_returnflag") == "A", "renamed").otherwise("direct")
    both = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("key"), F.col("l_suppkey").cast("string").alias("model"), F.col("l_partkey").cast("string").alias("column"), kind.alias("transformation"), "l_quantity")
    out = impact.reshaped(both.where("l_quantity < 30"), both, t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("exposure")))
    return out.groupBy("reached_kind", "mechanism").agg(F.count("*").alias("n_rows"))


@_query("""with s as (select c_custkey as k, c_acctbal >= 0 as present, case when c_custkey % 7 = 0 then null else timestamp '2024-01-31' - to_hours((c_custkey % 48)::int) end as tm from customer),
 r as (select o_custkey as k, count(*) filter (o_orderstatus = 'F') as p, count(*) as n from orders where o_orderpriority <> '5-LOW' group by 1)
 select level, stale, count(*) as n_snapshots, sum(p) as n_precise from (select coalesce(p, 0) as p, (not present or tm is null or c > 24) as stale, case when not present then 'absent' when tm is null or c > 24 or coalesce(n, 0) > coalesce(p, 0) then 'partial' else 'full' end as level
  from (select s.*, k % 48 as c, p, n from s left join r using (k))) group by 1, 2""")
def snapshot_confidence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    at = F.when(F.col("c_custkey") % 7 == 0, "no time").otherwise(F.date_format(F.timestamp_seconds(F.lit(1706659200) - F.col("c_custkey") % 48 * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    snapshots = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") >= 0).alias("present"), at.alias("generated_at"))
    reached = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "column").otherwise("table").alias("precision"))
    out = bi.reach_confidence(snapshots, reached, ["k"], F.lit("2024-01-31").cast("timestamp"))
    return out.groupBy("level", "stale").agg(F.count("*").alias("n_snapshots"), F.sum("n_precise").alias("n_precise"))


@_query("""with d as (select doc_id, lang, text, 'p' || doc_id % 3 as pkg, doc_id % 6 as c, 'f' || doc_id as f from documents),
 r as (select lang, case when c = 0 and text <> '' then 'embedded' when c = 1 then 'path' when c = 2 then 'layout' when c = 3 then 'package' when c = 4 then 'name' end as origin, length(text) as n from d)
 select lang, origin, count(*) as n_nodes, sum(case when origin is not null then n end) as n_chars from r group by 1, 2""")
def compiled_sql(spark, sf_dir):
    """Documents as compiled files: embedded, under the named path, in the usual place, moved inside the package, moved out, or there twice."""
    c = F.col("doc_id") % 6
    docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").cast("string").alias("name"), "lang", "text", F.concat(F.lit("p"), F.col("doc_id") % 3).alias("package_name"), c.alias("c"), F.concat(F.lit("m/f"), "doc_id", F.lit(".sql")).alias("original_file_path"))
    nodes = docs.select("name", F.when(F.col("c") == 0, F.col("text")).alias("sql"), F.when(F.col("c") == 1, F.concat(F.lit("target/compiled/x/"), "name", F.lit(".sql"))).alias("compiled_path"), "package_name", "original_file_path")
    base = F.concat(F.lit("f"), "name", F.lit(".sql"))
    paths = F.when(F.col("c") == 1, F.array(F.concat(F.lit("x/"), F.col("name"), F.lit(".sql")))).when(F.col("c") == 2, F.array(F.concat(F.col("package_name"), F.lit("/"), F.col("original_file_path")), F.concat(F.lit("other/"), base)))
    paths = paths.when(F.col("c") == 3, F.array(F.concat(F.col("package_name"), F.lit("/moved/"), base), F.concat(F.lit("other/"), base))).when(F.col("c") == 4, F.array(F.concat(F.lit("other/deep/"), base))).when(F.col("c") == 5, F.array(F.concat(F.lit("a/"), base), F.concat(F.lit("b/"), base)))
    files = docs.select("text", F.explode(paths).alias("path")).select("path", F.col("text").alias("sql"))
    found = artifacts.resolve_compiled(nodes, files).join(docs.select("name", "lang"), "name")
    return found.groupBy("lang", "origin").agg(F.count("*").alias("n_nodes"), F.sum(F.length("sql")).alias("n_chars"))


@_query(f"""with {SUBJECTS}, {RULES}, o as (select event_id, case when event_id % 5 = 0 then 'change' else 'break' end as verb, event_id % 10 = 0 as b from events where event_id % 5 < 2),
 f as (select o.event_id, verb, b, rule, decision as was, case when verb = 'break' then 'warn' when decision = 'block' and b then 'block' else 'allow' end as now from o join h on h.event_id = o.event_id where outcome = 'fire'),
 ap as (select * from f where was <> now), rec as (select o.verb, o.b, ap.rule, ap.was, ap.now from o left join ap on ap.event_id = o.event_id)
 select verb, case when rule is not null then 'applied' else 'ineffective' end as effect, rule, was, now as decision, b as on_break, count(*) as n_records from rec group by all""")
def policy_overrides(spark, sf_dir):
    t = Tables(spark, sf_dir)
    overrides = t.events.where("event_id % 5 < 2").select("event_id", F.when(F.col("event_id") % 5 == 0, "change").otherwise("break").alias("verb"))
    breaks = t.events.where("event_id % 10 = 0").select("event_id")
    capped = policy.apply_overrides(_hits(t).drop("user_id"), overrides, breaks, ["event_id"])
    return policy.override_records(capped, overrides, breaks, ["event_id"]).groupBy("verb", "effect", "rule", "was", "decision", "on_break").agg(F.count("*").alias("n_records"))


@_query("""with m as (select p_partkey as k, 'm' || p_partkey as model, p_partkey % 3 as c, 'db' || p_partkey % 2 as db, 's' || p_partkey % 5 as sch from part),
 n as (select model, db || '.' || sch || '.' || model as name from m where c <> 1 union select model, 'w.x.t' || k // 2 from m where c = 0 or c = 1),
 e as (select name, min(model) as model from n group by 1), s as (select name, min(model) as model from (select model, regexp_replace(name, '^[^.]*[.]', '') as name from n) group by 1 having count(distinct model) = 1),
 r as (select l_partkey as k, case l_linenumber % 3 when 0 then 'w.x.t' || l_partkey // 2 when 1 then 'other.x.t' || l_partkey // 2 else 'db' || l_partkey % 2 || '.s' || l_partkey % 5 || '.m' || l_partkey end as name, l_linenumber % 3 as way from lineitem)
 select way, coalesce(e.model, s.model) is not null as found, coalesce(e.model, s.model) = 'm' || r.k as own, count(*) as n_refs from r left join e on e.name = r.name left join s on s.name = regexp_replace(r.name, '^[^.]*[.]', '') and s.name not in (select name from e) group by 1, 2, 3""")
def relation_models(spark, sf_dir):
    """Parts as models: some with a relation's name (two parts a name), some with database and schema, some with both."""
    t = Tables(spark, sf_dir)
    k = F.col("p_partkey")
    pair = lambda c: F.concat(F.lit("t"), F.floor(F.col(c) / 2).cast("string"))
    models = t.part.select(_id("m", "p_partkey").alias("model"), F.when(k % 3 != 2, F.concat(F.lit('"W"."X"."'), F.upper(pair("p_partkey")), F.lit('"'))).alias("relation_name"), F.when(k % 3 != 1, F.concat(F.lit("DB"), k % 2)).alias("database"), F.concat(F.lit("s"), k % 5).alias("schema"))
    way = F.col("l_linenumber") % 3
    own = F.concat(F.lit("db"), F.col("l_partkey") % 2, F.lit(".s"), F.col("l_partkey") % 5, F.lit(".m"), "l_partkey")
    refs = t.lineitem.select("l_partkey", way.alias("way"), F.when(way == 0, F.concat(F.lit("`w`.x."), pair("l_partkey"))).when(way == 1, F.concat(F.lit("Other.x."), pair("l_partkey"))).otherwise(own).alias("relation"))
    found = bi.join_relations(refs, bi.model_index(models))
    return found.groupBy("way", F.col("model").isNotNull().alias("found"), (F.col("model") == _id("m", "l_partkey")).alias("own")).agg(F.count("*").alias("n_refs"))


# ---- ingest


@_query("""with own as (select distinct doc_id as node from documents), src as (select distinct item_id as node from benchmark where item_id not in (select node from own)), k as (select distinct doc_id as node from labels)
 select node, origin, node in (select node from k) as in_catalog from (select node, 'manifest' as origin from own union all select node, 'source' from src)""")
def catalog_enrichment(spark, sf_dir):
    from ripplegraph.sources.artifacts import merged_universe

    t = Tables(spark, sf_dir)
    return merged_universe(t.documents.select(F.col("doc_id").alias("node")), t.benchmark.select(F.col("item_id").alias("node")), t.labels.select(F.col("doc_id").alias("node")))


@_query(r"""with o as (select l_orderkey as test, list_sort(list(distinct l_suppkey)) as deps, 'ref(''m' || min(l_suppkey) || ''')' as ref from lineitem group by 1)
 select case when len(deps) = 1 then 'attributed' else 'ambiguous' end as state, count(*) as n_tests, count(distinct regexp_extract_all(ref, '''([^'']+)''', 1)[-1]) as n_targets from o group by 1""")
def test_attribution(spark, sf_dir):
    from ripplegraph.sources.artifacts import ref_target, sole

    o = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("deps"), F.concat(F.lit("ref('m"), F.min("l_suppkey"), F.lit("')")).alias("ref"))
    return o.groupBy(F.when(sole(F.col("deps")).isNotNull(), "attributed").otherwise("ambiguous").alias("state")).agg(F.count("*").alias("n_tests"), F.count_distinct(ref_target(F.col("ref"))).alias("n_targets"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
