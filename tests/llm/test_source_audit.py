import random
import re
from collections import Counter, defaultdict

from ripplegraph.llm import source_audit as A


def brute(rows, min_docs=3, top=200):
    """Every term of every group, one by one."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w.translate(low) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((w for w, n in docs[lang].items() if n >= min_docs), key=lambda w: w.encode())
        own = {s: c for (g, s), c in groups.items() if g == lang}
        total = Counter()
        for c in own.values():
            total.update(c)

        def share(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted(((sum(f(p[s][w], p[o][w]) for w in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], q[w]), w) for w in kept if own[s][w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("source", "text", "lang", "1 as n", "2 as term", "3 as V", "4 as z").repartition(4)
    got = A.source_audit(docs, **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, **how)


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    words = ["der", "Die", "das", "é", "Éa", "日本", "x1y", "İ", "naïve-té", "🙂", "ﬀ", "a\x00b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for i in range(150):
        lang, source = r.choice(["de", "en", None, ""]), r.choice(["s1", "s2", "é", "~", None, "S"])
        rows.append((" ".join(r.choice(words[: r.choice([5, 40, 92])]) for _ in range(r.randrange(60))), lang, source))
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("...", "fr", "c"), ("solo", "xx", "only")] + [("same same other", "it", "hot")] * 40 + [("y", "it", "z")]
    check(spark, rows)
    check(spark, rows, min_docs=1, top=7)
    monkeypatch.setattr(A, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(A, "PIECE_BYTES", 50)
    check(spark, rows, min_docs=2, top=20)


def test_ties_beyond_the_last_rank_go_by_term(spark):
    tied = " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    check(spark, [(tied, "en", "a")] * 3 + [("other words here", "en", "b")] * 3)
    check(spark, [(tied, "en", "a")] * 3 + [("other words here", "en", "b")] * 3, top=5)


def test_texts_without_terms_and_empty_tables(spark):
    check(spark, [(None, None, None), ("", "a", "b"), ("1 2", "a", "c")])
    assert A.source_audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_a_term_ends_with_its_text(spark):
    check(spark, [("ab", "en", "s"), ("cd", "en", "s"), ("é", "en", "t"), ("é", "en", "t")] * 3)
