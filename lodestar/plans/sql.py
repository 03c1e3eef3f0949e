"""Hybrid search as table functions of SQL.

    register(spark, chunks, index)
    spark.sql("SELECT * FROM hybrid_search('blocked OR legal', array(0.1, ...), 'demo', 'default', 24)")
    spark.sql("SELECT * FROM hybrid_search_all(24)")      -- every row of the view search_questions

The functions are SQL themselves, so Catalyst plans them with the query that
calls them: scope and lexeme are equi-joins, positions are windows with a
limit below the exchange, and payloads are joined last. A table function in
Python would get a scope's chunks in one task. Only two small helpers are
Python: one reads a question, one ranks a document by its matched positions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.fulltext import QUERY_TYPE, parse_query, rank_of
from lodestar.operators.postings import SPAN_BITS
from lodestar.operators.search import RRF_K

#: What the functions return, in order.
RESULT = """id BIGINT, resource_owner STRING, resource_namespace STRING, chunk_key STRING, chunk_type STRING, table_name STRING, column_name STRING, rule_id STRING,
 raw_value STRING, score DOUBLE, lex_rank DOUBLE, semantic_distance DOUBLE, payload {payload}, text_exact STRING, text_semantic STRING"""
CHUNKS, VECTORS, INDEX, QUESTIONS = "search_chunks", "search_vectors", "search_postings", "search_questions"
#: A few questions, and what is asked and found by them, are sent to the chunks and the index, which stay where they are.
_FEW = {"asked_hint": "/*+ BROADCAST(asked) */", "question_hint": "/*+ BROADCAST(q) */", "hit_hint": "/*+ BROADCAST(b) */"}
FEW = 1_000
_NORM = "sqrt(aggregate({0}, 0D, (s, p) -> s + p * p))"

_BODY = """WITH question AS ({questions}),
asked AS (
  SELECT query_id, resource_owner, resource_namespace, t.grp, t.term, t.negated, size(t.lexemes) AS n_lexemes, size(filter(terms, x -> x.grp = t.grp AND NOT x.negated)) AS needed, l.lexeme, l.offset
  FROM (SELECT *, search_terms(lexical_query) AS terms FROM question WHERE trim(lexical_query) <> '') LATERAL VIEW explode(terms) AS t LATERAL VIEW explode(t.lexemes) AS l
),
matched AS (
  SELECT {asked_hint} query_id, shiftleft(block, {bits}) + d.at AS id, collect_list(struct(grp, term, negated, n_lexemes, needed, offset, d.deltas AS deltas)) AS entries
  FROM {index} AS p JOIN asked USING (resource_owner, resource_namespace, lexeme) LATERAL VIEW explode(docs) AS d GROUP BY query_id, shiftleft(block, {bits}) + d.at
),
ranked AS (SELECT query_id, id, CAST(CAST(search_rank(entries) AS FLOAT) AS DOUBLE) AS lex_rank FROM matched),
lexical AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex_rank DESC, id) AS lex_pos FROM ranked WHERE lex_rank IS NOT NULL)
  WHERE lex_pos <= greatest(5 * {k}, 20)
),
compared AS (
  SELECT {question_hint} query_id, c.id, c.embedding IS NULL OR q.embedding IS NULL AS unknown, transform(c.embedding, x -> CAST(x AS DOUBLE)) AS a, transform(q.embedding, x -> CAST(x AS DOUBLE)) AS b
  FROM {vectors} AS c JOIN question AS q ON c.resource_owner = q.resource_owner AND c.resource_namespace = q.resource_namespace
),
measured AS (
  SELECT query_id, id, CASE WHEN unknown THEN NULL WHEN {norm_a} * {norm_b} = 0 THEN double('NaN') ELSE 1D - aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, v) -> s + v) / ({norm_a} * {norm_b}) END AS semantic_distance
  FROM compared
),
semantic AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_distance NULLS LAST, id) AS sem_pos FROM measured) WHERE sem_pos <= greatest(5 * {k}, 20)
),
fused AS (
  SELECT query_id, id, coalesce(1D / ({rrf} + lex_pos), 0D) + coalesce(1D / ({rrf} + sem_pos), 0D) AS score, lex_rank, semantic_distance
  FROM lexical FULL OUTER JOIN semantic USING (query_id, id)
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lex_rank DESC NULLS LAST, semantic_distance ASC NULLS LAST, id) AS hit_pos FROM fused) WHERE hit_pos <= {k}
),
hit AS (SELECT b.*, q.resource_owner, q.resource_namespace FROM best AS b JOIN question AS q ON b.query_id = q.query_id)
SELECT {hit_hint} {first} c.id, c.resource_owner, c.resource_namespace, c.chunk_key, c.chunk_type, c.table_name, c.column_name, c.rule_id, c.raw_value, score, lex_rank, semantic_distance, c.payload, c.text_exact, c.text_semantic
FROM {chunks} AS c JOIN hit AS b ON c.id = b.id AND c.resource_owner = b.resource_owner AND c.resource_namespace = b.resource_namespace"""


def register(spark: SparkSession, chunks: DataFrame, index: DataFrame, questions: DataFrame | None = None, vectors: DataFrame | None = None) -> None:
    """Make ``hybrid_search`` (and with ``questions`` ``hybrid_search_all``) known to the session's SQL.

    ``chunks`` and ``index`` are a store's tables; ``questions`` has query_id
    (any type), the scope, lexical_query and embedding. ``hybrid_search``
    returns the 15 columns of a hit, the best first under ORDER BY score DESC;
    ``hybrid_search_all`` puts query_id and hit_pos before them. A blank or
    null lexical query is answered by vectors alone. ``vectors``: id, scope and
    embedding of the chunks, where the chunks have none.
    """

    @F.pandas_udf(QUERY_TYPE)
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"grp": g, "term": k, "negated": n, "lexemes": [{"lexeme": x, "offset": o} for x, o in ls]} for g, k, n, ls in parse_query(t)])

    @F.pandas_udf("double")
    def rank(each: pd.Series) -> pd.Series:
        fields = ("grp", "term", "negated", "n_lexemes", "needed", "offset", "deltas")
        return pd.Series([rank_of([tuple(e[f] for f in fields) for e in entries]) for entries in each], dtype="object")

    spark.udf.register("search_terms", terms)
    spark.udf.register("search_rank", rank)
    chunks.createOrReplaceTempView(CHUNKS)
    (chunks if vectors is None else vectors).createOrReplaceTempView(VECTORS)
    index.createOrReplaceTempView(INDEX)
    result = RESULT.format(payload=chunks.schema["payload"].dataType.simpleString())
    common = {"chunks": CHUNKS, "vectors": VECTORS, "index": INDEX, "bits": SPAN_BITS, "rrf": f"{float(RRF_K)}D", "norm_a": _NORM.format("a"), "norm_b": _NORM.format("b")}
    one = "SELECT 1 AS query_id, hybrid_search.owner AS resource_owner, hybrid_search.namespace AS resource_namespace, hybrid_search.lexical_query AS lexical_query, hybrid_search.query_embedding AS embedding"
    body = _BODY.format(questions=one, k="hybrid_search.top_k", first="", **_FEW, **common)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hybrid_search(lexical_query STRING, query_embedding ARRAY<FLOAT>, owner STRING, namespace STRING, top_k INT DEFAULT 10) RETURNS TABLE ({result}) RETURN {body}")
    if questions is not None:
        questions.createOrReplaceTempView(QUESTIONS)
        kind = questions.schema["query_id"].dataType.simpleString()
        hints = _FEW if questions.limit(FEW + 1).count() <= FEW else dict.fromkeys(_FEW, "")
        body = _BODY.format(questions=f"SELECT query_id, resource_owner, resource_namespace, lexical_query, embedding FROM {QUESTIONS}", k="hybrid_search_all.top_k", first="b.query_id, b.hit_pos,", **hints, **common)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hybrid_search_all(top_k INT DEFAULT 10) RETURNS TABLE (query_id {kind}, hit_pos INT, {result}) RETURN {body}")
