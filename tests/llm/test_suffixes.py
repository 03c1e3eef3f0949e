import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import suffixes
from lodestar.llm.queries import queries
from lodestar.llm.suffixes import SuffixLevels, without_repeats


def brute(rows, length=100):
    """{(n_bytes, removed spans, kept)} of each row, every window looked up in a dictionary; rows: (doc_id, text), ids that repeat with one text only."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    seen, out = set(), {}
    for n in order:
        text = (rows[n][1] or "").encode()
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            at = gone.find(0, start)
            at = len(gone) if at < 0 else at
            spans.append((start, at))
        out[n] = (rows[n][0], len(text), spans, bytes(b for b, g in zip(text, gone) if not g))
    return [out[n] for n in range(len(rows))]


def key(t):
    return str(t)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=key)


def made(seed=5):
    """Texts over few letters with shared passages of many lengths, periods, copies, and letters of several bytes."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (60, 99, 100, 101, 140, 300, 900)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 150))), p[a : len(p) - rng.randint(0, len(p) // 4)]]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000, "ab" * 400), (1001, "x" * 350), (1002, "x" * 99), (1003, "x" * 100), (1004, rows[3][1]), (1005, rows[3][1]), (None, rows[3][1]), (None, None), (7, None), (8, "")]
    return rows


@pytest.mark.parametrize("length, slice_, crowded", [(100, 1 << 20, 20_000), (100, 250, 20_000), (50, 1 << 20, 0)])
def test_against_every_window(spark, length, slice_, crowded, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", 16)
    monkeypatch.setattr(suffixes, "SORTED", 500)
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(1)).withColumn("key", F.lit("x"))
    assert got(without_repeats(df, length, crowded=crowded)) == sorted(brute(rows, length), key=key)


def test_repeated_rows_ties_long_and_empty(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(without_repeats(docs)) == sorted(brute(rows), key=key)
    assert without_repeats(no_docs).count() == 0
    # rows that share an id: the smaller content key comes first
    passage = "".join(random.Random(1).choices("abcdefgh", k=200))
    two = spark.createDataFrame([(1, "one " + passage), (1, "two " + passage)], "doc_id long, text string")
    first = two.orderBy(F.xxhash64("text")).first().text
    left = {bytes(r.kept) for r in without_repeats(two).collect()}
    assert first.encode() in left and len(left) == 2 and min(map(len, left)) < 10  # the other keeps its own word


def test_query_against_every_window(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = {(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)}
    found = {tuple(r) for r in queries()["op11_suffix_levels"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert found == wanted and any(w[2] for w in wanted)


def test_levels_merge_geometrically_and_find_keys_of_old_batches(spark):
    family = SuffixLevels(4)
    arrays = [spark.createDataFrame([(k, b, 1) for k in (b, 100 + b // 2)], "key long, block long, n int") for b in range(8)]
    found = [{r.key for r in family.add(a).collect()} for a in arrays]
    assert found == [set(), {100}, set(), {101}, set(), {102}, set(), {103}]
    assert [n for n, _ in family.levels] == [4, 2, 1, 1]  # seven were merged as the eighth came
    hit = family.places(spark.createDataFrame([(102,), (7,)], "key long")).collect()
    assert sorted((r.key, r.block) for r in hit) == [(7, 7), (102, 4), (102, 5)]
    family.forget()


def test_stretches_cover_every_window_and_depend_on_the_bytes_alone():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    alone = suffixes.Stretches(text, [3000], 100)
    assert (alone.ends - alone.starts - 99).sum() == 2901
    beside = suffixes.Stretches(b"y" * 777 + text, [777, 3777], 100)
    inside = beside.starts >= 777
    assert (beside.starts[inside] - 777 == alone.starts).all() and (beside.keys[inside] == alone.keys).all()
