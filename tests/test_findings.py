"""Findings of reviews, each on a small table that showed it."""

import pytest

from lodestar.plans.oracle import oracle_sql
from lodestar.plans.queries import queries
from tests.compare import database, differences


@pytest.fixture
def folder(spark, tmp_path):
    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def _differences(spark, name, sf):
    con = database("/nowhere")
    for table in ("documents", "part", "lineitem", "embeddings"):
        if __import__("os").path.isdir(f"{sf}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    return differences(queries()[name](spark, sf), con, oracle_sql()[name])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_keyword_with_a_space_is_not_found_at_the_end_of_a_text(spark, folder):
    texts = ["ends with ***", "*** begins", "the LICENSE ***", None, "", "***"]
    sf = folder(documents=([(i, t, "en", "web", 1) for i, t in enumerate(texts)], DOCS))
    assert _differences(spark, "keyword_coverage", sf) == ""


def test_blocks_of_chunks_are_those_of_the_flat_index(spark, monkeypatch):
    from lodestar.operators import fulltext
    from lodestar.operators.postings import chunk_blocks, posting_blocks
    from lodestar.operators.search import SCOPE

    texts = [("The Licences, licensed", "Reviews of the licences stop"), ("", "a b"), ("x", None), (None, ""), ("œuvre K9 K9 the", "the of"), ("法律 ÀB", "running runs ran")]
    rows = [(f"o{i % 2}" if i % 5 else None, "n", 60 + i * 3, *texts[i % len(texts)]) for i in range(40)]
    schema = "resource_owner string, resource_namespace string, id long, text_exact string, text_semantic string"
    chunks = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(fulltext, "STRETCH", 50)
    flat = fulltext.lexemes(chunks, [*SCOPE, "id"])
    want, got = posting_blocks(flat, SCOPE), chunk_blocks(chunks.repartition(3), SCOPE)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    names = ["the", "licenc", "k9", "run"]
    few = fulltext.lexemes_of(chunks, [*SCOPE, "id"], names)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, flat.where(flat.lexeme.isin(names)).collect()))
    # rows that share an id, in two tasks, count as one document
    again = chunks.limit(1).unionByName(chunks.limit(1))
    both = chunk_blocks(again, SCOPE).select("lexeme", "max_weight", "max_count").collect()
    assert sorted(both) == sorted(posting_blocks(fulltext.lexemes(again, [*SCOPE, "id"]), SCOPE).select("lexeme", "max_weight", "max_count").collect())


def test_lines_are_dealt_by_question_once(spark):
    from lodestar.session import configured

    with configured(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = queries()["rollup_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of lines and of orders


def test_equal_points_and_intervals_meet_once(spark, monkeypatch):
    from lodestar.operators import intervals

    met, join = [], intervals.in_intervals
    monkeypatch.setattr(intervals, "in_intervals", lambda p, i, *a: met.append((p.count(), i.count())) or join(p, i, *a))
    points = spark.createDataFrame([(x,) for x in [1.0] * 50 + [2.5] * 50 + [None, float("nan")]], "at double")
    spans = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, 2.0), (3, 1.0, 3.0), (4, 9.0, 9.5), (5, None, 3.0)], "i int, low double, high double")
    found = intervals.count_in_intervals(points, spans, "at", "low", "high", 5.0).select("i", "n", "largest").collect()
    assert sorted(map(tuple, found)) == [(1, 50, 1.0), (2, 50, 1.0), (3, 100, 2.5)]
    assert met == [(4, 4)]


def test_a_catalog_in_one_file_is_worked_on_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from lodestar.operators import chunks as C
    from lodestar.operators.search import SCOPE
    from lodestar.sources.shared import dealt, stored

    n = 9000
    rules = stored(spark.range(n).coalesce(1).select(F.lit("o").alias(SCOPE[0]), F.lit("n").alias(SCOPE[1]), F.lit(2).alias("section"), (n - F.col("id")).alias("group_pos"), F.lit(0).alias("item_pos")), "rules")
    assert rules.rdd.getNumPartitions() == 1 and dealt(rules, 4000, "few") is rules
    many = dealt(rules, n, "many")
    assert many.rdd.getNumPartitions() == 3 and many.count() == n
    places = many.select(*SCOPE, "section", "group_pos")
    assert places.select(C._block(F.col("group_pos"))).distinct().count() == 3
    found = C.number(many.withColumn("place", F.col("group_pos")), places)
    assert found.where("id = place").count() == n
    groups = spark.range(1, 1000).select(C._block(F.shiftleft("id", 32)).alias("b"), "id")
    assert groups.groupBy("b").count().count() == 4
