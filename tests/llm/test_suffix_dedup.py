import random
from collections import defaultdict

from ripplegraph.llm.suffix_dedup import neighbours, repeated_passages


def brute(rows, n):
    where = defaultdict(set)
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            if d is not None:
                where[tuple(w[i : i + n])].add((d, i))
    starts = defaultdict(dict)
    for at in where.values():
        if len({d for d, _ in at}) > 1:
            for d, i in at:
                starts[d][i] = min(d for d, _ in at)
    out = set()
    for d, s in starts.items():
        run = []
        for i in sorted(s):
            if run and i - run[-1] > n:
                out.add((d, run[0], run[-1] - run[0] + n, s[run[0]]))
                run = []
            run.append(i)
        out.add((d, run[0], run[-1] - run[0] + n, s[run[0]]))
    return out


def test_passages_match_brute_force(spark):
    r = random.Random(9)
    words = ["a", "B", "é"] + [f"w{i}" for i in range(30)]
    say = lambda k: [r.choice(words) for _ in range(k)]
    passages = [say(k) for k in (49, 50, 51, 70, 120)] + [["x"] * 80, say(3) * 30]
    rows = []
    for i in range(60):
        t = []
        for _ in range(r.randrange(1, 4)):
            t += say(r.choice([0, 5, 60]))
            p = r.choice(passages)
            k = r.randrange(len(p)) if r.random() < 0.4 else 0
            t += p[k : k + r.choice([60, 200])]
        rows.append((i, r.choice([" ", "\n"]).join(t)))
    rows += [(None, " ".join(passages[3])), (100, None), (101, ""), (102, "y" * 100_000), (0, rows[1][1]), (103, " ".join(say(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as at", "2 as run")
    assert {tuple(x) for x in repeated_passages(docs, 50).collect()} == brute(rows, 50)
    assert repeated_passages(docs.limit(0), 50).collect() == []


def test_neighbours_match_brute_force_at_all_edges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, small as the rows are
    try:
        _neighbours_at_all_edges(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _neighbours_at_all_edges(spark):
    r = random.Random(4)
    for hot, sort_rows in [(0, 1), (0, 7), (200, 5), (200, 1000), (400, 50)]:
        rows = {(r.randrange(60), r.randrange(3), r.randrange(4), at) for at in range(400)} | {(7, 1, r.randrange(30), 1000 + at) for at in range(hot)}
        rows |= {(99, 0, 5, 2000 + at) for at in range(hot)}
        docs = defaultdict(set)
        for a, b, d, _ in rows:
            docs[a, b].add(d)
        want = {(d, at, min(docs[a, b])) for a, b, d, at in rows if len(docs[a, b]) > 1}
        found = neighbours(spark.createDataFrame(list(rows), "a long, b long, doc_id long, at int"), ["a", "b"], "at", sort_rows)
        got = [tuple(x) for x in found.select("doc_id", "at", "first_doc_id").collect()]
        assert set(got) == want and len(got) == len(want)
