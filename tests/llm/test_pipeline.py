import random
from collections import Counter

import corpus_pipeline as P
from ripplegraph.llm import decontam, line_dedup


def corpus():
    r = random.Random(8)
    words = [f"wo{chr(97 + i % 26)}{i}" for i in range(500)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = say(30)
    foot = "all rights of this page are kept by its owner"
    docs = []
    for i in range(120):
        docs.append((i, f"{say(120)}\n{say(90)}\n{foot}"))
    near = docs[5][1].split(" ")
    near[50] = "changed"
    docs += [(200, docs[3][1]), (201, " ".join(near)), (202, f"{say(80)} {item} {say(80)}"), (203, "too short"), (204, None), (205, ""), (206, "### " * 300)]
    docs += [(None, f"{say(120)}")]
    return docs, item


def test_stages_against_what_was_planted(spark, tmp_path):
    docs, item = corpus()
    where = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{where}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, where)
        if k < 4:
            assert out.columns == list(P.COLUMNS)
        out.write.parquet(f"{where}/{name}")
        now = spark.read.parquet(f"{where}/{name}")
        seen.append({r.doc_id: r for r in now.collect()})
    clean = set(range(120)) | {None}
    assert set(seen[0]) == clean | {200, 201, 202}
    gone = {tuple(x) for x in line_dedup.drops(spark.read.parquet(f"{where}/quality_rules")).collect()}
    texts = dict(docs)
    for i, r in seen[1].items():
        key = line_dedup.LAST if i is None else i
        assert r.text == "\n".join(x for n, x in enumerate(texts[i].split("\n")) if (key, n) not in gone)
        assert r.n_chars == len(r.text)
    assert sum("rights of this page" in r.text for r in seen[1].values()) == 1
    assert 200 not in seen[1]  # all its lines stand in an earlier document
    assert set(seen[2]) == set(seen[1]) - {d for d in (201,) if d in seen[1] and decontam and _near(seen[1], 5, 201)}
    assert set(seen[3]) == set(seen[2]) - {202}
    assert clean <= set(seen[3])
    packed = now.collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(list(seen[3]))
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert sorted(map(tuple, P.run(spark, where).drop("sequence_id", "offset").collect()), key=str) == sorted(map(tuple, now.drop("sequence_id", "offset").collect()), key=str)


def _near(rows, a, b):
    def sh(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = sh(rows[a].text), sh(rows[b].text)
    return 100 * len(x & y) >= 80 * len(x | y)
