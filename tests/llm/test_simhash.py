import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm.common import components
from lodestar.llm.simhash import fingerprint, hex_fingerprint, links, near_duplicates


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def classes(values, max_bits):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= max_bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a B c", "a b c d e f", "x\x1cy z\x0bw é É", "ab " * 40_000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("max_bits, n_segments, max_bucket", [(0, 5, 64), (1, 5, 2), (2, 5, 64), (2, 5, 2), (3, 7, 64), (3, 7, 2), (4, 5, 2)])
def test_links_join_the_same_classes_as_all_pairs(spark, max_bits, n_segments, max_bucket):
    random = np.random.default_rng(3)
    base = [int(x) for x in random.integers(0, 1 << 63, 6)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in random.integers(0, 64, random.integers(1, 6)):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.component for r in components(links(fps, max_bits, n_segments, max_bucket)).collect()}
    root = classes(values, max_bits)
    mine = [got.get(v, v) for v in signed]
    assert len(set(zip(root, mine))) == len(set(root)) == len(set(mine))


def test_chain_of_components(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = components(edges.union(spark.createDataFrame([(1001, 1000), (1000, 1000)], "a long, b long"))).collect()
    assert {r.component for r in got if r.node <= 200} == {0} and {r.component for r in got if r.node > 200} == {1000}


def test_near_duplicates(docs, no_docs):
    got = near_duplicates(docs).select("doc_id", hex_fingerprint(F.col("fp")).alias("h"), "component_id").collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(r.h, 16) == slow_fingerprint(texts[r.doc_id]) for r in got)
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == 1 and of[3] == of[4] == of[5] == 3 and of[None] is None and of[8] == 8
    assert near_duplicates(no_docs).count() == 0
