"""Posting blocks: the same rows as the flat index gives, with most blocks unread."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import fulltext, postings
from lodestar.operators import search as S
from lodestar.operators.fulltext import asked_of, lexemes, rank_of
from lodestar.operators.postings import bounds, live_spans, posting_blocks, sorted_blocks

QUESTIONS = [
    "red OR blue OR rare",
    "rare",
    "red_car OR blue OR rare_red",
    '"blue red" OR green -rare',
    "red blue OR car -green",
    "car car OR cars",
    "absent OR nothing",
    "The of",
    "",
    None,
]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(4)
    words = ["red", "blue", "green", "car", "cars", "driving", "x", "y", "z", "of"]
    rows = []
    for i in range(1500):
        n = 1 + int(rng.paretovariate(1.1))
        a = [rng.choice(words) for _ in range(min(n, 40))] + ["rare"] * (i % 211 == 0) * (1 + i % 7)
        b = [rng.choice(words) for _ in range(rng.randint(0, 4))]
        rows.append(("o", "n" if i % 3 else "m", i * 5, " ".join(a), " ".join(b)))
    rows += [("o", "n", 90_000_000_000, "red car", None), ("o", "n", 1, None, "rare"), ("o", "n", 2, "", "")]
    return spark.createDataFrame(rows, "resource_owner string, resource_namespace string, id long, text_exact string, text_semantic string")


def asked(spark, texts=QUESTIONS):
    rows = [(f"q{i}", "o", scope, t) for i, t in enumerate(texts) for scope in ("n",)]
    return spark.createDataFrame(rows, "query_id string, resource_owner string, resource_namespace string, lexical_query string")


@pytest.mark.parametrize("few", [1_000, 0])
def test_blocks_and_flat_index_agree_on_every_question(spark, chunks, few, monkeypatch):
    monkeypatch.setattr(fulltext, "FEW", few)
    flat = lexemes(chunks, [*S.SCOPE, "id"])
    blocks = sorted_blocks(posting_blocks(flat, S.SCOPE), S.SCOPE)
    wanted = sorted(map(tuple, S.lexical_branch(flat, asked(spark), 3).collect()))
    assert sorted(map(tuple, S.lexical_branch(blocks, asked(spark), 3).collect())) == wanted
    assert {w[0] for w in wanted} >= {"q0", "q1", "q2", "q3", "q4", "q5"}


def test_blocks_that_cannot_reach_the_top_are_skipped(spark, chunks):
    blocks = posting_blocks(lexemes(chunks, [*S.SCOPE, "id"]), S.SCOPE)
    for text, share in (("red OR blue OR rare", 0.7), ("red_car OR blue OR rare_red", 0.9)):
        ask = asked_of(asked(spark, [text]), S.SCOPE, "query_id", "lexical_query")
        every = bounds(blocks, ask, S.SCOPE, "query_id").count()
        live = live_spans(blocks, ask, S.SCOPE, "query_id", 5).count()
        assert 0 < live < share * every
    # a span that lacks a word of a group is not even bounded
    ask = asked_of(asked(spark, ["rare red"]), S.SCOPE, "query_id", "lexical_query")
    with_rare = blocks.where("lexeme = 'rare' AND resource_namespace = 'n'").select("block").distinct().count()
    assert bounds(blocks, ask, S.SCOPE, "query_id").count() <= with_rare


def test_stored_blocks_hold_the_flat_index(spark, chunks):
    flat = lexemes(chunks, [*S.SCOPE, "id"])
    blocks = posting_blocks(flat, S.SCOPE)
    rows = blocks.select(*S.SCOPE, "lexeme", "block", F.explode("docs").alias("d")).collect()
    back = set()
    for r in rows:
        code = 0
        for delta in r.d.deltas:
            code += delta
            back.add((r.resource_namespace, (r.block << postings.SPAN_BITS) + r.d["at"], r.lexeme, code // 2, "AB"[code % 2]))
    assert back == {(r.resource_namespace, r.id, r.lexeme, r.pos, r.weight) for r in flat.collect()}
    spans = blocks.groupBy(*S.SCOPE, "lexeme", "block").count().where("count > 1").count()
    assert spans == 0 and blocks.where("size(docs) > 64").count() == 0
    assert posting_blocks(flat.where("false"), S.SCOPE).count() == 0


def test_rank_of_one_document():
    a = lambda *pos: [2 * p - 2 * q for p, q in zip(pos, (0, *pos))]
    assert rank_of([(0, 0, False, 1, 1, 0, a(3, 9))]) == 2
    assert rank_of([(0, 0, False, 2, 1, 0, a(3)), (0, 0, False, 2, 1, 1, a(4))]) == 1
    assert rank_of([(0, 0, False, 2, 1, 0, a(3)), (0, 0, False, 2, 1, 1, a(5))]) is None
    assert rank_of([(0, 0, False, 1, 1, 0, a(3)), (0, 1, True, 1, 1, 0, a(5))]) is None
