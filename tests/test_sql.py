"""The table functions of SQL give the rows of the DataFrame functions."""

from pyspark.sql import functions as F

from lodestar.operators import search as S
from lodestar.operators.fulltext import lexemes
from lodestar.operators.postings import posting_blocks
from lodestar.plans.sql import register


def test_one_question_and_all_questions(spark):
    texts = [("red car old", "The cars"), ("blue car", "reds"), ("red", None), ("", ""), ("car blue red car", "driving")]
    rows = [("o", "m" if i % 5 == 4 else "n", i, *t, [float(i % 3), 1.0, float(i)] if i % 4 else None) for i, t in enumerate(texts * 6)]
    base = spark.createDataFrame(rows, "resource_owner string, resource_namespace string, id long, text_exact string, text_semantic string, embedding array<float>")
    chunks = base.selectExpr("*", "concat('k', id) AS chunk_key", "'rule' AS chunk_type", "'t' AS table_name", "'c' AS column_name", "'r' AS rule_id", "'v' AS raw_value", "named_struct('a', id) AS payload")
    index = posting_blocks(lexemes(chunks, [*S.SCOPE, "id"]), S.SCOPE)
    asked = [("a", "o", "n", "red_car OR blue -old", [1.0, 0.0, 0.0]), ("b", "o", "n", '"blue red" OR driving', [0.0, 0.0, 0.0]), ("c", "o", "m", None, [1.0, 1.0, 1.0]), ("d", "o", "nowhere", "red", [1.0, 1.0, 1.0]), ("e", "o", "n", "red car", None)]
    questions = spark.createDataFrame(asked, "query_id string, resource_owner string, resource_namespace string, lexical_query string, embedding array<float>")
    register(spark, chunks, index, questions)

    def plain(df):
        return sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in df.collect())

    wanted = S.hybrid_search(chunks, index, questions, 7)
    assert plain(spark.sql("SELECT * FROM hybrid_search_all(7)")) == plain(wanted) and wanted.count() > 20
    for q, owner, namespace, text, vector in asked[:3]:
        literal = f"array({', '.join(f'{x}F' for x in vector)})"
        text = "NULL" if text is None else f"'{text}'"
        got = spark.sql(f"SELECT * FROM hybrid_search({text}, {literal}, '{owner}', '{namespace}', 7)")
        assert plain(got) == plain(wanted.where(F.col("query_id") == q).drop("query_id", "hit_pos"))
        assert list(got.columns) == list(S.HIT_COLUMNS)
    # ten rows by default, and it joins like a table
    joined = spark.sql("SELECT count(*) AS n FROM hybrid_search('red', array(1F, 1F, 1F), 'o', 'n') h JOIN VALUES (1L), (2L), (6L) v(i) ON h.id = v.i").first()
    assert spark.sql("SELECT * FROM hybrid_search('red', array(1F, 1F, 1F), 'o', 'n')").count() == 10 and 0 < joined.n <= 3
