import random

from ripplegraph.llm import decontam as D


def test_templates_agree_with_canonical_words():
    texts = ["", "Anna has 12 km to go. Then Bob walked 3,5 miles; 7 Apples", "a b", "Übung Macht 100% sure?! Yes | No", "  "]
    hashes, count = D.templates(texts)
    kinds = [D.canonical(t)[0] for t in texts]
    assert count.tolist() == [len(k) for k in kinds]
    flat = [w for k in kinds for w in k]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    assert kinds[1][:5] == ["anna", "has", "<n>", "<u>", "to"]


def test_matches_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([6, 12, 30]))) for i in range(8)] + [
        (100, "A train with Anna leaves at 12 and covers 300 km in 5 hours before it meets 12 others"),
        (101, None),
        (102, ""),
        (103, "short one"),
    ]
    docs = [(i, say(60)) for i in range(10)]
    docs += [(20 + i, f"{say(10)} {t} {say(10)}") for i, t in items if t]
    docs += [
        (200, "say A train with Maria leaves at 45 and covers 720 miles in 9 days before it meets 45 others now"),
        (201, "say A train with Maria leaves at 45 and covers 720 miles in 9 days before it meets 46 others now"),
        (202, None),
        (None, items[2][1] + " x"),
        (20, docs[0][1]),
        (203, say(30_000)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "1 as item_id", "2 as key")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "5 as doc_id")
    got = {(x.doc_id, x.item_id, x.n_words, x.start, x.n_slots_changed) for x in D.contaminated(d, b).collect()}
    want = set()
    for i, t in docs:
        for j, q in items:
            m = D.matches(t or "", q or "", 8, 50, 5)
            if m:
                want.add((i, j, m[0], m[1], m[3]))
    assert got == want
    by = {x[:2] for x in got}
    assert (200, 100) in by and (201, 100) not in by and (120, 100) in by and (None, 2) in by
    assert not any(i is not None and i < 10 for i, _ in by)
    kept = {x.doc_id for x in D.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in by}
    assert D.contaminated(d.limit(0), b).collect() == [] and D.contaminated(d, b.limit(0)).collect() == []


def test_a_dirty_row_without_doc_id_takes_no_clean_one_along(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"so {item} then"), (None, "quite another text"), (None, None), (5, "clean"), (None, f"and {item}")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, (r.text for r in D.decontaminate(docs, items).collect()))) == ["None", "clean", "quite another text"]
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()] == [(None, 1)] * 2


def test_short_items_word_by_word_and_first_words_inside_a_sentence(spark):
    items = spark.createDataFrame([(1, "What is 12 * 7 ?"), (2, "Who wrote Hamlet?"), (3, "Then Alice gave all of her seven old books away"), (4, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "He asks: What is 12 * 7 ? Nobody knows"), (2, "What is 13 * 7 ?"), (3, "in question 12 Who wrote Hamlet?"), (4, "Who wrote Macbeth?"), (5, "and so on Then Alice gave all of her seven old books away again"), (6, "one two three")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(1, 1), (2, 1), (3, 2), (5, 3)}
    assert {r.doc_id for r in D.decontaminate(docs, items).collect()} == {4, 6}


def variants(r, item, names, numbers):
    """Ways in which an item turns up in a text, by name; made without the operator's own reading of words."""
    words = item.split()
    change = {**dict(zip(names, r.sample("Paula Nora Viktor Ida Oskar Rita".split(), len(names)))), **{n: str(1000 + 7 * i) for i, n in enumerate(numbers)}}

    def put(k):
        out = list(words)
        for at in sorted(r.sample(range(3, len(words) - 3), k), reverse=True):
            out.insert(at, r.choice(["really", "then", "so"]))
        return " ".join(out)

    def cut(k):
        gone = set(r.sample(range(3, len(words) - 3), k))
        return " ".join(w for i, w in enumerate(words) if i not in gone)

    return {
        "exact": item, "upper": item[0].lower() + item[1:], "signs": item.replace(",", "").replace(".", " ."), "slots": " ".join(change.get(w.strip(",.?"), w) + ("," if w.endswith(",") else "") for w in words),
        "one in": put(1), "two in": put(2), "three in": put(3), "one out": cut(1), "two out": cut(2), "first half and more": " ".join(words[: len(words) * 2 // 3]), "last half and more": " ".join(words[len(words) // 3 :]),
    }


def test_recall_on_planted_variants_and_clean_texts(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("aeioubdklmnprst") for _ in range(r.randrange(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items, docs, planted = [], [], {}
    for i in range(30):
        names, numbers = ["Anna", "Boris"], [str(r.randrange(10, 99)), str(100 + i)]
        text = f"{say(6).capitalize()} {names[0]} {say(7)} {numbers[0]} {say(6)}, {names[1]} {say(8)} {numbers[1]} {say(7)} {names[0]} {say(5)}."
        items.append((i, text))
        for name, variant in variants(r, text, names, numbers).items():
            planted[len(docs)] = (i, name)
            docs.append((len(docs), f"{say(r.randrange(5, 60))}. {variant} {say(r.randrange(5, 60))}"))
    items.append((30, "What is 12 * 7 ?"))
    planted[len(docs)] = (30, "slots")
    docs.append((len(docs), f"{say(20)}. What is 13 * 8 ? {say(20)}"))
    clean = len(docs)
    docs += [(clean + k, say(r.randrange(30, 120))) for k in range(200)]
    # values at odds: one number of the item has become two
    docs += [(clean + 200 + i, f"{say(9)} {text.replace('Anna', 'Nora', 1)}") for i, (_, text) in enumerate(items[:20])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.contaminated(d, b).collect()}
    hit = {}
    for doc, (item, name) in planted.items():
        hit.setdefault(name, []).append((doc, item) in got)
    assert all(sum(h) >= 0.9 * len(h) for h in hit.values()), {n: sum(h) / len(h) for n, h in hit.items()}
    assert {x for x in got if x[0] >= clean + 0 and x[0] < clean + 200} == set()
    assert all((doc, planted[doc][0]) == (doc, item) for doc, item in got if doc in planted)


def test_columns_of_any_name_come_through(spark):
    docs = spark.createDataFrame([(1, "clean text", 7), (None, "other clean text", 8), (2, "one two three four five six seven eight nine", 9)], "doc_id long, text string, x int")
    names = ["_d", "_h", "_cell", "_word", "_bits", "_gone__d", "key", "item_id"]
    wide = docs.select("doc_id", "text", *(docs["x"].alias(n) for n in names))
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    out = D.decontaminate(wide, items)
    assert out.columns == wide.columns and sorted(r[n] for r in out.collect() for n in names) == [7] * len(names) + [8] * len(names)
