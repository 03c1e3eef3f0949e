"""Full-text matching and ranks, fusion and hybrid search on small corpora."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunks as C
from lodestar.operators import search as S
from lodestar.plans import queries as Q
from lodestar.operators.fulltext import lexemes, match, parse_query, parsed_query


def corpus(spark, *rows):
    return spark.createDataFrame([("o", "n", i, a, b) for i, (a, b) in enumerate(rows, 1)], "resource_owner string, resource_namespace string, id long, text_exact string, text_semantic string")


def ranks(spark, chunks, text):
    asked = spark.createDataFrame([(1, "o", "n", text)], "query_id long, resource_owner string, resource_namespace string, q string").withColumn("tsq", parsed_query(F.col("q")))
    return {r.id: round(r.lex_rank, 6) for r in match(lexemes(chunks, [*S.SCOPE, "id"]), asked, S.SCOPE).collect()}


def test_index_positions_and_weights(spark):
    rows = lexemes(corpus(spark, ("Blocked by_legal", "The reviews are stopping it.")), [*S.SCOPE, "id"]).collect()
    assert sorted((r.pos, r.lexeme, r.weight) for r in rows) == [(1, "blocked", "A"), (2, "by", "A"), (3, "legal", "A"), (5, "review", "B"), (7, "stop", "B")]


@pytest.mark.parametrize(
    "text, simple",
    [
        ("a OR b", [(0, [("a", 0)]), (1, [("b", 0)])]),
        ("blocked_by_legal", [(0, [("blocked", 0), ("by", 1), ("legal", 2)])]),
        ('"x y" z', [(0, [("x", 0), ("y", 1)]), (0, [("z", 0)])]),
        ("Café", [(0, [("cafe", 0)])]),
        ("  ", []),
        (None, []),
        ("...", []),
    ],
)
def test_queries_are_read(text, simple):
    got = parse_query(text)
    assert [(g, ls) for g, _, _, ls in got[: len(simple)]] == simple
    assert not simple or any(g > max(g for g, _ in simple) for g, *_ in got) or text == "a OR b"


def test_or_of_words_counts_weighted_positions(spark):
    chunks = corpus(spark, ("legal hold legal", "legal reviews"), ("none", "A review of it"), ("other", "words"))
    assert ranks(spark, chunks, "legal OR review OR absent") == {1: 2.8, 2: 0.4}


def test_phrases_gaps_and_pre_emption(spark):
    chunks = corpus(spark, ("blocked by legal", ""), ("", "blocked by legal"), ("legal by blocked", ""), ("blocked by legal", "legal"))
    assert ranks(spark, chunks, "blocked_by_legal") == {1: 1.0, 2: 0.2, 4: 1.0}
    # a word that stands for itself is its own cover and cuts the phrase
    assert ranks(spark, chunks, "blocked_by_legal OR legal") == {1: 1.0, 2: 0.4, 3: 1.0, 4: 1.4}


def test_and_and_negation(spark):
    chunks = corpus(spark, ("red car", ""), ("red x x car", ""), ("red", ""), ("red car old", ""))
    assert ranks(spark, chunks, "red car -old") == {1: 1.0, 2: round(1 / 3, 6)}


def test_blank_query_still_searches_vectors(spark):
    chunks = corpus(spark, ("a", ""), ("b", "")).withColumn("embedding", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")))
    chunks = chunks.selectExpr("*", "'k' AS chunk_key", "'rule' AS chunk_type", "'t' AS table_name", "'c' AS column_name", "'r' AS rule_id", "'v' AS raw_value", "named_struct('a', 1) AS payload")
    asked = spark.createDataFrame([(1, "o", "n", " ", [1.0, 1.0]), (2, "o", "other", "a", [1.0, 1.0])], "query_id long, resource_owner string, resource_namespace string, lexical_query string, embedding array<float>")
    hits = S.hybrid_search(chunks, lexemes(chunks, [*S.SCOPE, "id"]), asked, 5).orderBy("hit_pos").collect()
    assert [(r.query_id, r.id, r.lex_rank) for r in hits] == [(1, 1, None), (1, 2, None)]
    assert abs(hits[0].score - 1 / 61) < 1e-15 and abs(hits[1].score - 1 / 62) < 1e-15


def test_fusion_ties_and_nulls(spark):
    lexical = spark.createDataFrame([(1, 10, 2.0, 1), (1, 11, 1.0, 2)], "query_id long, id long, lex_rank double, lex_pos int")
    semantic = spark.createDataFrame([(1, 12, 0.1, 1), (1, 13, float("nan"), 2)], "query_id long, id long, semantic_distance double, sem_pos int")
    best = S.top_hits(S.fuse(lexical, semantic), 3).orderBy("hit_pos").collect()
    assert [r.id for r in best] == [10, 12, 11]


def test_pool():
    assert (S.pool_size(1), S.pool_size(10), S.pool_size(24)) == (20, 50, 120)


def test_window_limit_is_pushed_below_the_exchange(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("query_id"), "id", F.rand(1).alias("x"))
    plan = S.position(rows, "query_id", F.col("x"), F.col("id"), name="p", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hash_search_finds_most_of_the_nearest(spark):
    sf = "/root/testdata/sf0.001"
    exact = {(r.query_id, r.id) for r in Q.sem_topn(spark, sf).where("sem_pos <= 10").collect()}
    found = {(r.query_id, r.id) for r in Q.semantic_approximate(spark, sf).where("sem_pos <= 10").collect()}
    assert len(exact) > 10 and len(found & exact) >= 0.9 * len(exact)


def test_ids_of_chunks_follow_the_source_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "RECORDS", 3)
    monkeypatch.setattr(C, "GROUPS", 2)
    places = [(s, g, i) for s, gs in ((0, range(8)), (1, [g << 32 for g in range(5)]), (2, range(4))) for g in gs for i in (range(3) if s == 1 else [0])]
    rows = [("o", n, s, g, i) for n in ("a", "b") for s, g, i in places[: None if n == "a" else 9]]
    chunks = spark.createDataFrame(rows, "resource_owner string, resource_namespace string, section int, group_pos long, item_pos long").withColumn("at", F.struct("section", "group_pos", "item_pos"))
    found = C.number(chunks, chunks.select(*S.SCOPE, "section", "group_pos")).collect()
    for n, of in (("a", places), ("b", places[:9])):
        assert [tuple(r["at"]) for r in sorted((r for r in found if r.resource_namespace == n), key=lambda r: r.id)] == of
        assert sorted(r.id for r in found if r.resource_namespace == n) == list(range(1, len(of) + 1))
