"""URL filters with link-graph propagation, in DataFrame functions alone.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's;
the longest rule wins.  A url that no rule fits takes its host's verdict: trust flows from urls that rules
allow along the links between hosts (personalised PageRank), distrust flows from urls that rules block along
the reversed links.  A host whose distrust exceeds its trust by more than ``lift`` times its share of all
urls is blocked; every other host is allowed.

Links are the ``href`` values of the page; one without a host stays on its own host, and every host has one
link to itself, so no rank is lost.  Links are counted per pair of hosts before any shuffle.

Edge cases: a null url, or one without ``://``, has empty host and path, which no rule fits; null html has no
links; rows that repeat a page_id are judged one by one; of rules of equal length the one that blocks wins;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute or scheme-relative link.
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))


def by_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and ruled (its verdict), null where none fits. ``rules`` has host, path, verdict."""
    names = rules.select(F.col("host").alias("suffix"), F.struct((F.length("host") + F.length("path")).alias("size"), (F.col("verdict") == "block").alias("block"), "path", "verdict", F.concat("host", "path").alias("rule")).alias("r"))
    hosts = pages.select("host").distinct()
    parts = F.split("host", r"\.")
    suffixes = hosts.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    known = suffixes.join(names, "suffix").groupBy("host").agg(F.collect_list("r").alias("rules"))
    fits = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return pages.join(known, "host", "left").withColumn("best", fits).withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.verdict")).drop("rules", "best")


def _ranks(seeds: DataFrame, edges: DataFrame, tolerance: float, damping: float) -> DataFrame:
    """Personalised PageRank of every host: (host, rank). ``seeds`` has every host and its weight.

    Goes on, four rounds at a time, until the last of them has moved less than ``tolerance`` of all rank.
    """
    total = seeds.agg(F.sum("weight")).first()[0]  # one number
    seeds = T.stash(seeds.select("host", (F.col("weight") / F.lit(float(total or 1))).alias("seed")))
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    flow = T.stash(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")))
    rank = seeds.select("host", F.col("seed").alias("rank"))
    k = 0
    while True:
        k, before = k + 1, rank
        given = flow.join(rank, flow["src"] == rank["host"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        rank = seeds.join(given, seeds["host"] == given["dst"], "left").select("host", ((1 - damping) * F.col("seed") + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if k % 4 == 0:
            moved = rank.select("host", F.col("rank").alias("now")).join(before, "host").select("host", F.col("now").alias("rank"), F.abs(F.col("now") - F.col("rank")).alias("moved"))
            moved = T.stash(moved)
            rank = moved.select("host", "rank")
            if (moved.agg(F.sum("moved")).first()[0] or 0.0) <= tolerance:  # one number
                return rank


def judge_urls(pages: DataFrame, rules: DataFrame, tolerance: float = 1e-6, damping: float = 0.85, lift: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html)."""
    pages = host_and_path(pages.select("page_id", "url", "html"))
    ruled = T.stash(by_rule(pages.select("page_id", "host", "path"), rules))
    hosts = ruled.groupBy("host").agg(F.count("*").alias("urls"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), 1)).alias("to"))
    links = links.groupBy("src", F.translate("to", _UPPER, _LOWER).alias("dst")).agg(F.count("*").alias("links"))
    # only hosts of the table are judged, so links elsewhere carry nothing
    hosts = T.stash(hosts)
    links = links.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst", "links")
    edges = T.stash(links.union(hosts.select("host", "host", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("links").alias("links")))
    trust = _ranks(hosts.select("host", F.col("good").alias("weight")), edges, tolerance, damping)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = _ranks(hosts.select("host", F.col("bad").alias("weight")), back, tolerance, damping)
    share = F.col("urls") / F.lit(float(hosts.agg(F.sum("urls")).first()[0] or 1))  # one number
    verdict = F.when(F.col("distrust") - F.col("trust") > lift * share, "block").otherwise("allow")
    judged = hosts.select("host", "urls").join(trust.withColumnRenamed("rank", "trust"), "host").join(distrust.withColumnRenamed("rank", "distrust"), "host").select("host", verdict.alias("own"))
    return ruled.join(judged, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", "own").alias("verdict"))
