import hashlib
import re

from pyspark.sql import functions as F

from lodestar.llm.decontaminate import decontaminate, proximity_hits

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, body in items:
        b = words(body)
        for k in range(max(1, len(b) - 9)) if b else ():
            p = b[k : k + 10]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "été Σίσυφος"), (10, "ÉTÉ σίσυφος"), (3, None), (4, "..."), (11, "long WORDS long"), (12, "long words long")]


def test_against_brute_force(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = decontaminate(docs, bench).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], ITEMS), r.doc_id


def test_beyond_every_bound(spark, docs, monkeypatch):
    import lodestar.llm.common as c
    import lodestar.llm.decontaminate as d

    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(str, decontaminate(docs, bench).collect()))
    monkeypatch.setattr(c, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(d, "BROADCAST_TERMS", 0)
    assert sorted(map(str, decontaminate(docs, bench).collect())) == whole


def test_random_texts_of_few_words_against_brute_force(spark):
    import random

    pick = random.Random(3)
    draw = lambda n: " ".join(pick.choice("a A b c d".split()) for _ in range(n))
    items = [(i, draw(pick.choice((1, 2, 3, 5, 9, 10, 11, 14)))) for i in range(12)]
    texts = [(i, draw(pick.choice((0, 1, 4, 30, 200)))) for i in range(40)]
    texts += [(100, texts[3][1]), (101, f"x {items[7][1]} y {items[7][1]}"), (102, items[6][1])]
    got = decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=10).collect()
    of = dict(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(of[r.doc_id], items), r.doc_id
    assert len(got) == len(texts)


def test_postings_are_stored_once_and_texts_read_once(spark, docs):
    import lodestar.llm.decontaminate as d

    words = spark.createDataFrame([("mit",), ("one",), ("long",)], "word string")
    index = d.build_index(docs, words)
    assert index.where("n_words IS NOT NULL").count() == docs.count()
    assert {(r.pos, r.n) for r in d.postings(index).where(F.col("term") == F.xxhash64(F.lit("mit"))).groupBy("pos").agg(F.count("*").alias("n")).collect()} == {(1, 3)}
    assert d.postings(index).where(F.col("term") == F.xxhash64(F.lit("long"))).count() == 40_000


def test_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(no_docs, bench).count() == 0
    assert decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta"), (3, "gamma a b c d e f g h i j alpha beta")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, ["alpha", "gamma", "beta"])], "query_id long, words array<string>")
    got = proximity_hits(docs, asked).collect()
    assert [(r.query_id, r.start, r.stop) for r in got] == [(9, 0, 5)]


def test_proximity_looks_beyond_the_nearest_place(spark):
    docs = spark.createDataFrame([(1, "b x x x a y y y c y b")], "doc_id long, text string")
    more = spark.createDataFrame([(2, "b b c c c")], "doc_id long, text string")  # a stays the rarest
    asked = spark.createDataFrame([(9, ["a", "b", "c"])], "query_id long, words array<string>")
    assert [(r.start, r.stop) for r in proximity_hits(docs.union(more), asked).collect()] == [(4, 11)]


def smallest_spans(text, query, slop):
    """For each place of the rarest word, the smallest span with it and all other words, by trying every span."""
    w, n = text.split(), len(set(query))
    rarest = min(set(query), key=lambda x: (w.count(x), x))
    out = set()
    for a in (i for i, x in enumerate(w) if x == rarest):
        fits = [(j - i, i, j) for i in range(a + 1) for j in range(a + 1, len(w) + 1) if j - i <= n + slop and set(query) <= set(w[i:j])]
        if fits:
            out.add(min(fits)[1:])
    return out


def test_proximity_against_every_span(spark):
    import random

    pick = random.Random(8)
    for n in range(6):
        text = " ".join(pick.choice("a b b c c c d d d d e e e e e".split()) for _ in range(60))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        got = {(r.start, r.stop) for r in proximity_hits(docs, spark.createDataFrame([(9, ["a", "b", "c"])], "query_id long, words array<string>"), slop=n).collect()}
        want = smallest_spans(text, ["a", "b", "c"], n)
        assert {(b - a) for a, b in got} == {(b - a) for a, b in want} and len(got) == len(want)
