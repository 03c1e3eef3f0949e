import hashlib
import math
import re
import zlib

import pytest

from lodestar.llm import resampling
from lodestar.llm.resampling import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def grams(text, most):
    words = WORD.findall((text or "").translate(FOLD))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most=1, percent=10, buckets=10_000, least=20):
    """(doc_id, n_features, weight, score) and the number drawn."""

    def count(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, most)[1]:
                out[zlib.crc32(g.encode()) % buckets] += 1
        return out

    s, t = count(d[1] for d in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        n_words, found = grams(text, most)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in found)
        x = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))), n_words))
    return [o[:4] for o in out], percent * sum(o[4] >= least for o in out) // 100


@pytest.mark.parametrize("most", [1, 3])
def test_against_brute_force(spark, sf, docs, most, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 1000)
    monkeypatch.setattr(resampling, "SLICE", 5000)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    every = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id >= 20").select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in every.collect()]
    wanted, draw = brute(rows, [r.text for r in target.collect()], most)
    got = resample(every, target, most=most).collect()
    key = lambda t: str(t)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(wanted, key=key)
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, draw + 1))
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in drawn]
    assert order == sorted(order)
    rest = max(r.score for r in got if not r["rank"] and r.n_features >= 20 * most)
    assert drawn[-1].score >= rest or most > 1


def test_words_of_long_texts_do_not_break_at_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 7)
    text = "abc defghijklmnop\tq\tr" * 9 + "É été " + "x" * 50
    ids = resampling._Words()
    assert [ids.named[w].decode() for w in resampling.word_ids(text, ids)] == WORD.findall(text.translate(FOLD))
    assert len(resampling.word_ids(None, ids)) == len(resampling.word_ids("", ids)) == 0


def test_repeated_rows_are_ranked_each_and_empty_tables(spark, docs, no_docs, sf):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    many = spark.range(100).selectExpr("cast(null as long) doc_id", "repeat('same words again ', 9) text")
    ranks = sorted(r["rank"] for r in resample(many, target, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, 51))
    assert resample(no_docs, target).count() == 0
    assert resample(docs, target.where("false")).count() == docs.count()
