"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.decontam import contaminated
from ripplegraph.llm.fim import fill_in_middle, restored
from ripplegraph.llm.line_dedup import line_dedup
from ripplegraph.llm.lm_score import score_texts
from ripplegraph.llm.ngram_join import ngram_components
from ripplegraph.llm.packing import pack_documents
from ripplegraph.llm.quality_classifier import classify
from ripplegraph.llm.quality_rules import quality_rules
from ripplegraph.llm.source_audit import source_audit
from ripplegraph.llm.suffix_dedup import repeated_passages
from ripplegraph.llm.token_store import token_store
from ripplegraph.llm.url_filter import judge_urls
from ripplegraph.llm.warc import archived_pages

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8, cover=50, literal=5)


def url_rules(spark: SparkSession) -> DataFrame:
    rows = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rows) + " as t(host, path, verdict)")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), url_rules(spark))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, limit=2048)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), distance=2, per_edit=10)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.crc32(text.cast("binary")).alias("kept_crc32"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), seed=1, transformed=90, spm=20)
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"), least=100).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') as ws from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') as sh
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as c from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 90 * (nx.c + ny.c - i)),
r(doc_id, root) as (select doc_id, doc_id from documents union select l.y, r.root from r join l on l.x = r.doc_id)
select d.doc_id, coalesce(n.c, 0) as n_shingles, m.root as component_id, coalesce(k.c, 0) as n_links
from documents d
left join n on n.doc_id = d.doc_id
left join (select doc_id, min(root) as root from r group by 1) m on m.doc_id = d.doc_id
left join (select x, count(*) as c from l group by 1) k on k.x = d.doc_id
"""


def _op5_sql(rounds: int = 8, damping: float = 0.85, lift: float = 1.0) -> str:
    link = r"""(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    ctes = [
        "rules(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))",
        f"p as (select page_id, {low("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path, html, row_number() over () as rid from pages)",
        "m as (select rid, arg_max((rh || rp, v), (length(rh) + length(rp), v = 'block', rp)) as r from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by rid)",
        "j as (select p.*, m.r[1] as rule, m.r[2] as ruled from p left join m on m.rid = p.rid)",
        "h as (select host, count(*) as urls, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad from j group by 1)",
        f"l as (select host as src, {low("unnest(regexp_extract_all(coalesce(html, ''), '" + link + "', 1))")} as dst from p)",
        "e as (select src, dst, count(*) as n from (select src, dst from l where dst in (select host from h) union all select host, host from h) group by 1, 2)",
        "f as (select src, dst, n / sum(n) over (partition by src) as s from e)",
        "b as (select dst as src, src as dst, n / sum(n) over (partition by dst) as s from e)",
    ]
    for rank, weight, flow in (("t", "good", "f"), ("d", "bad", "b")):
        seed = f"(case when sum({weight}) over () > 0 then {weight} / sum({weight}) over () else 0 end)"
        ctes.append(f"{rank}0 as (select host, {seed} as seed, {seed} as r from h)")
        for k in range(rounds):
            given = f"select dst, sum(r * s) as g from {flow} join {rank}{k} on host = src group by 1"
            ctes.append(f"{rank}{k + 1} as (select host, seed, {1 - damping!r} * seed + {damping!r} * coalesce(g, 0) as r from {rank}{k} left join ({given}) on dst = host)")
    own = f"case when d.r - t.r > {lift!r} * h.urls / (select sum(urls) from h) then 'block' else 'allow' end"
    return f"with {', '.join(ctes)} select page_id, j.host, path, rule, coalesce(ruled, {own}) as verdict from j join h on h.host = j.host join t{rounds} t on t.host = j.host join d{rounds} d on d.host = j.host"


OP8_SQL = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as ws from documents where doc_id is not null),
g as (
  select doc_id, i - 1 as start, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) as k
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as i from w where len(ws) >= 50)),
s as (select k, min(doc_id) as f from g group by k having min(doc_id) <> max(doc_id)),
x as (select doc_id, start, f from g join s using (k)),
n as (select *, case when start - lag(start) over (partition by doc_id order by start) <= 50 then 0 else 1 end as new from x),
i as (select *, sum(new) over (partition by doc_id order by start) as island from n)
select doc_id, min(start) as start, max(start) - min(start) + 50 as n_words, arg_min(f, start) as first_doc_id from i group by doc_id, island
"""


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select *, len(u) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or regexp_matches(t, '<[PSM]>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:n], ''), '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p
"""


OP12_SQL = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
w as (select r, lang, source, unnest(ws) as term from d),
k as (select lang, term, count(*) as c from w group by 1, 2 having count(distinct r) >= 3),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(c) as n from k group by 1),
n as (select lang, source, term, count(*) as c from w join k using (lang, term) group by 1, 2, 3),
t as (select lang, source, sum(c) as n from n group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(n.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(n.c, 0) + 1)) // (coalesce(t.n, 0) + v.v)::hugeint as p,
  1 + (1000000000::hugeint * (k.c + 1)) // (v.n + v.v)::hugeint as q
  from g join k using (lang) join v using (lang) left join t on t.lang = g.lang and t.source = g.source left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
o as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where c > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from o) where part = 'pair' or rank <= 200
"""


OP13_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by 1)
select page_id, n as payload_bytes, p.d as payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type, case when page_id <> first then first end as refers_to
from p left join f on f.d = p.d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_token_store": op3_token_store,
        "op4_decontamination": op4_decontamination,
        "op5_url_filter": op5_url_filter,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_line_dedup": op10_line_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_source_audit": op12_source_audit,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op5_url_filter": _op5_sql(), "op8_suffix_dedup": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_warc": OP13_SQL}
