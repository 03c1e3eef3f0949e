"""Hybrid search: full-text and vector candidates of a scope, fused by reciprocal rank.

All operators take a table of queries, so one plan answers one question or a
batch. Positions are windows over each query with a limit that the optimizer
pushes below the exchange; payloads are joined last, to the few fused rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.embedding import cosine_distance
from lodestar.operators.fulltext import match
from lodestar.operators.postings import top_matches
from lodestar.operators.vectors import Model, approximate_nearest
from lodestar.sources.shared import stored

RRF_K = 60
SCOPE = ["resource_owner", "resource_namespace"]
HIT_COLUMNS = (
    "id resource_owner resource_namespace chunk_key chunk_type table_name column_name rule_id raw_value score lex_rank semantic_distance payload text_exact text_semantic".split()
)


def pool_size(top_k: int) -> int:
    """Candidates of each branch: five times the limit, 20 at least. It bounds what fusion sees."""
    return max(top_k * 5, 20)


def position(df: DataFrame, query_id: str, *order: Column, name: str, limit: int) -> DataFrame:
    """Rows of each query numbered by ``order``, the first ``limit`` of them."""
    window = Window.partitionBy(query_id).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def reciprocal(position_: Column) -> Column:
    """1 / (60 + position) as a double; 0 without a position."""
    return F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + position_), F.lit(0.0))


def fuse(lexical: DataFrame, semantic: DataFrame, query_id: str = "query_id", doc: str = "id") -> DataFrame:
    """Full outer join of the branches with the fused score."""
    both = lexical.join(semantic, [query_id, doc], "full_outer")
    return both.select(query_id, doc, (reciprocal(F.col("lex_pos")) + reciprocal(F.col("sem_pos"))).alias("score"), "lex_rank", "semantic_distance")


def top_hits(fused: DataFrame, top_k: int, query_id: str = "query_id", doc: str = "id") -> DataFrame:
    """The best ``top_k`` of each query with hit_pos (from 1)."""
    order = (F.col("score").desc(), F.col("lex_rank").desc_nulls_last(), F.col("semantic_distance").asc_nulls_last(), F.col(doc).asc())
    return position(fused, query_id, *order, name="hit_pos", limit=top_k)


def lexical_branch(index: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, id, lex_rank, lex_pos. Blank query texts match nothing.

    ``index``: posting blocks, of which only those are read that can hold one
    of the best, or a flat index, which is read as a whole.
    """
    asked = queries.where(F.length(F.trim(F.coalesce("lexical_query", F.lit("")))) > 0)
    found = top_matches(index, asked, SCOPE, pool_size(top_k)) if "block" in index.columns else match(index, asked, SCOPE, text_col="lexical_query")
    return position(found, "query_id", F.col("lex_rank").desc(), F.col("id").asc(), name="lex_pos", limit=pool_size(top_k))


#: Questions up to this number are sent to the chunks; more are exchanged with them by scope.
BROADCAST = 10_000


def counted(df: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def semantic_branch(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, id, semantic_distance, sem_pos: exact cosine over every chunk of the scope."""
    vectors = chunks.select(*SCOPE, "id", "embedding").join(counted(queries.select("query_id", *SCOPE, F.col("embedding").alias("asked"))), SCOPE)
    distances = vectors.select("query_id", "id", cosine_distance(F.col("embedding"), F.col("asked")).alias("semantic_distance"))
    return position(distances, "query_id", F.col("semantic_distance").asc_nulls_last(), F.col("id").asc(), name="sem_pos", limit=pool_size(top_k))


def hybrid_search(chunks: DataFrame, index: DataFrame, queries: DataFrame, top_k: int = 10, semantic: DataFrame | None = None) -> DataFrame:
    """Hits of each query: query_id, hit_pos and the 15 hit columns.

    ``chunks``: the chunk table (ids are unique in a scope); ``index``: its
    posting blocks, or its lexemes with scope and id; ``queries``: query_id, scope, lexical_query and
    embedding. ``semantic``: the semantic branch, if it is made already; then
    ``chunks`` need no embedding.
    """
    lexical = lexical_branch(index, queries, top_k).select("query_id", "id", "lex_rank", "lex_pos")
    semantic = (semantic_branch(chunks, queries, top_k) if semantic is None else semantic).select("query_id", "id", "semantic_distance", "sem_pos")
    best = stored(top_hits(fuse(lexical, semantic), top_k).join(queries.select("query_id", *SCOPE), "query_id"), "best-hits")
    best = counted(best, BROADCAST)  # few hits go to the chunks: their texts stay where they are
    rows = chunks.select("id", *SCOPE, "chunk_key", "chunk_type", "table_name", "column_name", "rule_id", "raw_value", "payload", "text_exact", "text_semantic")
    return best.join(rows, [*SCOPE, "id"]).select("query_id", "hit_pos", *HIT_COLUMNS)


def approximate_branch(chunks: DataFrame, codes: DataFrame, model: Model, queries: DataFrame, top_k: int, probes: int = 32, rerank: int | None = None) -> DataFrame:
    """The semantic branch by the vector index: an opt-in for scopes too large to scan. The exact branch stays the contract.

    ``codes`` and ``model``: the index of the chunks' vectors
    (:mod:`lodestar.operators.vectors`). No more than ``rerank`` chunks of a
    question (ten for each row of the pool) have their vectors read.
    """
    return approximate_nearest(chunks, codes, queries, model, SCOPE, pool_size(top_k), probes, rerank).select("query_id", "id", "semantic_distance", "sem_pos")
