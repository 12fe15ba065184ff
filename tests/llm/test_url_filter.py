from collections import defaultdict

from ripplegraph.llm import url_filter as U
from ripplegraph.llm.queries import url_rules


def brute(pages, rules, rounds=200, damping=0.85, lift=1.0):
    rows, links = [], defaultdict(int)
    for p, url, html in pages:
        u = url or ""
        host = path = ""
        if "://" in u:
            tail = u.split("://", 1)[1]
            cut = min([i for i in map(tail.find, "/?#") if i >= 0], default=len(tail))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in tail[:cut])
            path = tail[cut:]
            path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
        fit = [(len(h + x), v == "block", x, v, h + x) for h, x, v in rules if (host == h or host.endswith("." + h)) and path.startswith(x)]
        rows.append((p, host, path, max(fit)[4] if fit else None, max(fit)[3] if fit else None))
        for part in (html or "").split('href="')[1:]:
            to = part.split('"')[0]
            if "//" in to:
                links[host, to.split("//", 1)[1].split("/")[0].lower()] += 1
    hosts = {r[1] for r in rows}
    edges = defaultdict(int, {(a, b): n for (a, b), n in links.items() if b in hosts})
    for h in hosts:
        edges[h, h] += 1

    def rank(seed, edges):
        total = sum(seed.values())
        s = {h: seed[h] / total if total else 0 for h in hosts}
        out = defaultdict(int)
        for (a, _), n in edges.items():
            out[a] += n
        r = dict(s)
        for _ in range(rounds):
            new = {h: (1 - damping) * s[h] for h in hosts}
            for (a, b), n in edges.items():
                new[b] += damping * r[a] * n / out[a]
            r = new
        return r

    good, bad, urls = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        urls[r[1]] += 1
        good[r[1]] += r[4] == "allow"
        bad[r[1]] += r[4] == "block"
    t, d = rank(good, edges), rank(bad, {(b, a): n for (a, b), n in edges.items()})
    own = {h: "block" if d[h] - t[h] > lift * urls[h] / len(rows) else "allow" for h in hosts}
    return sorted(((p, h, x, r, v or own[h]) for p, h, x, r, v in rows), key=str)


PAGES = [
    (1, "http://A.Example.NET/en/1?x", None), (2, "https://a.example.net/de/2#y", '<a href="https://spam.example.org/x">'), (3, "http://example.com/de/", ""),
    (4, "http://b.example.com", '<a href="http://a.example.net/z"><a href="/local">'), (5, "http://good.org/fr/1", '<a href="//b.example.com/">'), (6, "http://spam.example.org/en/", '<a href="http://a.example.net/">' * 5),
    (7, None, None), (8, "no scheme", None), (9, "ftp://x.net", ""), (10, "http://evilnet/", ""), (10, "http://evilnet/", ""), (None, "http://net/", ""), (11, "a://b://c/d", None), (12, "http://h?q://z/", None),
]


def test_verdicts_match_brute_force(spark):
    rules = [tuple(r) for r in url_rules(spark).collect()]
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("html", "page_id", "url", "'h' as host", "1 as rule", "2 as best")
    got = sorted(map(tuple, U.judge_urls(pages, url_rules(spark)).collect()), key=str)
    assert got == brute(PAGES, rules)
    assert all(r[4] == "allow" for r in got if r[0] in (7, 8))
    assert U.judge_urls(pages.limit(0), url_rules(spark)).collect() == []


def test_ranks_reach_the_end_of_a_long_chain(spark):
    pages = [(i, f"http://h{i:02}.example/", f'<a href="http://h{i + 1:02}.example/">') for i in range(14)] + [(99, "http://bad.net/", None), (98, "http://h14.example/", '<a href="http://bad.net/">')]
    rules = [tuple(r) for r in url_rules(spark).collect()]
    got = sorted(map(tuple, U.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), url_rules(spark), lift=0.0).collect()), key=str)
    assert got == brute(pages, rules, lift=0.0)
    assert {r[4] for r in got} == {"block"}  # distrust flows back over all links of the chain
