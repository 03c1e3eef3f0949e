"""The core operators over the driver's tables. The same queries in SQL are in :mod:`lodestar.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import embedding as E
from lodestar.functions import metrics as M
from lodestar.functions import text as T
from lodestar.functions.unaccent import unaccented
from lodestar.operators import chunks as C
from lodestar.operators import profile as P
from lodestar.operators import rollup as R
from lodestar.operators import search as S
from lodestar.operators import vectors as V
from lodestar.operators.fulltext import lexemes_of, match, parse_query, parsed_query
from lodestar.operators.difference import difference
from lodestar.operators.integrity import duplicates, orphans
from lodestar.operators.intervals import as_of, count_in_intervals
from lodestar.operators.keys import keep_first, mark_duplicates, resolve_identity, split_reference, unique_match
from lodestar.operators.postings import chunk_blocks, sorted_blocks
from lodestar.operators.sessions import sessions, trailing_sum
from lodestar.plans.answer import retrieval_inputs
from lodestar.plans.sql import register
from lodestar.sources.catalog_json import conform, parse_columns, parse_rules, parse_values, records, register_adapter
from lodestar.sources.schemas import COLUMNS, ISSUES, VALUES, Catalog
from lodestar.sources.schemas import RULES as RULE_SCHEMA
from lodestar.sources.shared import spread, stored
from lodestar.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
#: Words that the lexical queries ask for.
ASKED = ("license", "apache", "gnu", "version", "reserved")
#: What the phrase query asks for.
PHRASES = '"apache license" or mit licenses or reserved -version or en'
TOP_K = 10
LIMIT = 25
WEIGHTS = Settings().chunk_type_weights
#: (table, column, description) of the catalog that is profiled from the driver's tables.
CATALOG = (
    ("part", "p_brand", "Brand of the part. Twenty-five brands exist."),
    ("part", "p_type", "Type of the part, such as its finish"),
    ("part", "p_name", "Name of the part!  It is shown to buyers."),
    ("orders", "o_orderpriority", "Priority of the order for shipping and early access"),
    ("orders", "o_orderstatus", "Status of the order: not blocked, under review or closed"),
    ("customer", "c_mktsegment", "Market segment of the customer in Europe"),
)
REF = ["table_name", "column_name"]
#: Records of drifting shape; @t and @c stand for a known table and column, @i for the row's key, @s for a text that repeats.
PAYLOADS = ('[{"a":1},5]', '{"@w":[{"a":1},"x",[]]}', '{"other":1}', "5", '{"@w":7}', "[]", "null")
VALUE_GROUPS = (
    '{"table_name":"@t"}',
    '{"column_key":"@c","values":[{"raw_value":"u"}]}',
    '{"column_name":"shared"}',
    '{"table":"a::b","column_name":"@c"}',
    '{"table_name":"@t","column_name":"nowhere","values":[1,2]}',
    '{"table_name":"@t","column_name":"@c","values":{"no":1}}',
    '{"table_name":"@t","column_name":"@c","values":null}',
    '{"table_name":"@t","column_name":"@c","values":[5,"x"]}',
    '{"table_name":"@t","column_name":"@c","values":[{"raw_value":""},{"raw_value":null}]}',
    '{"column_key":"@t::@c","values":[{"raw_value":"v@i","value_gloss":3,"synonyms":{"a":1},"business_tags":"x"}]}',
    '{"source_table":" @t ","column_name":"@c","values":[{"raw_value":"@s"},{"raw_value":"@s"},{"raw_value":true,"value_description":" told "}]}',
)
RULE_RECORDS = (
    '{"description":"d"}',
    '{"rule_id":"k@i","candidate_columns":"@t.@c","priority":" +7_0 "}',
    '{"rule_id":"k@i","candidate_columns":123,"priority":2.7}',
    '{"rule_id":"k@i","candidate_columns":[5,null]}',
    '{"rule_id":"k@i","candidate_columns":["bare","@t::@c","@t.@c"],"priority":true}',
    '{"rule_id":"k@i","candidate_columns":["@t.nope","@t.@c"]}',
    '{"rule_id":"k@i","candidate_columns":[{"table_name":"@t"},"@t.@c"]}',
    '{"rule_id":"k@i","priority":"high"}',
    '{"rule_id":"k@i","trigger_terms":" x ","rule_text":5}',
    '{"rule_id":"k@i","candidate_columns":["@t.nope"]}',
    '{"rule_id":"k@i","candidate_columns":{"table_name":"@t","column_name":"@c"},"description":"a","text_semantic":"b"}',
    '{"rule_id":"same@s","candidate_columns":["@t.nope"]}',
    '{"rule_id":"same@s","trigger_terms":["p","q","p",""]}',
)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


# --- text -----------------------------------------------------------------------------------


def prepare_rewrites(spark, sf):
    p = T.prepare(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.md5(p).alias("digest"), F.length(p).cast("long").alias("n"))


def unaccent_docs(spark, sf):
    """Every text with some of its letters made into ones that stand for several, without accents."""
    odd = F.replace(F.replace(F.replace("text", F.lit("th"), F.lit("œ")), F.lit("an"), F.lit("ł")), F.lit("on"), F.lit("Æ"))
    plain = unaccented(odd)
    return _t(spark, sf, "documents").select("doc_id", F.md5(plain).alias("digest"), F.length(plain).cast("long").alias("n"))


def tokenize_docs(spark, sf):
    found = _t(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def alias_expand(spark, sf):
    """Tokens with embedding families of the whole text of every document."""
    return _t(spark, sf, "documents").select("doc_id", F.array_join(E.expanded_tokens(F.col("text")), " ").alias("expanded"))


def dedupe_terms(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    return rows.select("doc_id", F.size(T.dedupe_terms(F.col("w"))).cast("long").alias("n_distinct"), F.size("w").cast("long").alias("n_words"))


def compact_sentence(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.compact_sentence(F.col("text")).alias("sentence"))


def description_keywords(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(T.description_keywords(F.col("text")), " ").alias("keywords"))


def build_text_exact(spark, sf):
    parts = T.exact_text(F.array("p_brand", "p_type", "p_name"))
    return _t(spark, sf, "part").select("p_partkey", parts.alias("text_exact"))


def text_metrics(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in M.text_metrics(F.col("text")).items()])


def estimate_tokens(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", M.estimate_tokens(F.col("text")).alias("tokens"))


def collection_summary(spark, sf):
    return M.collection_summary(_t(spark, sf, "documents"), "text")


def count_by_key(spark, sf):
    return M.count_by_key(_t(spark, sf, "documents"), "source")


def retrieval_inputs_batch(spark, sf):
    rows = _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("raw_query"))
    return retrieval_inputs(rows).select("item_id", "normalized_query", "lexical_query", "semantic_query", F.array_join("keywords", " ").alias("keywords"))


# --- embeddings -----------------------------------------------------------------------------


def hash_embedding_tokens(spark, sf):
    tokens = _t(spark, sf, "part").select(F.explode(T.tokens(F.col("p_name"))).alias("token")).distinct()
    return tokens.select("token", F.posexplode(E.token_vector(F.col("token"))).alias("i", "x")).select("token", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def embed_text_docs(spark, sf):
    """The vector of the whole text of every document, one row for each dimension."""
    rows = _t(spark, sf, "documents").select("doc_id", F.posexplode(E.embed_text(F.col("text"))).alias("i", "x"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


# --- search ---------------------------------------------------------------------------------


def _corpus(spark, sf) -> DataFrame:
    """Documents as chunks of one scope for each source, their vectors where they have one."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("resource_owner"), F.lit("all").alias("resource_namespace"), "lang", "text")
    return docs


def _questions(spark, sf) -> DataFrame:
    """A question for each source: the same words, and the vector of its first document that has one."""
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    first = _corpus(spark, sf).join(vectors, "id").groupBy("resource_owner", "resource_namespace").agg(F.min_by("embedding", "id").alias("embedding"))
    return first.select(F.col("resource_owner").alias("query_id"), "resource_owner", "resource_namespace", "embedding", F.lit(" OR ".join(ASKED)).alias("lexical_query"))


def _index(spark, sf) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")  # dealt by ids, so not spread before
    docs = docs.select(F.col("source").alias("resource_owner"), F.lit("all").alias("resource_namespace"), F.col("doc_id").alias("id"), F.col("text").alias("text_exact"), F.lit("").alias("text_semantic"))
    return chunk_blocks(docs, S.SCOPE)


_INDEXES: dict[tuple, DataFrame] = {}


def _stored_index(spark, sf) -> DataFrame:
    """The posting blocks of the documents, built once for a session and these very files."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    jvm = spark.sparkContext._jvm
    found = []
    for file in sorted(docs.inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(file)
        status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        found.append((file, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(found))
    if key not in _INDEXES:
        _INDEXES[key] = stored(sorted_blocks(_index(spark, sf), S.SCOPE), "posting-blocks")
    return _INDEXES[key]


def scope_filter_count(spark, sf):
    return _t(spark, sf, "documents").groupBy(F.col("source").alias("resource_owner"), F.col("lang").alias("resource_namespace")).agg(F.count("*").alias("n"))


def _lexical(spark, sf) -> DataFrame:
    return S.lexical_branch(_stored_index(spark, sf), _questions(spark, sf), TOP_K)


def _semantic(spark, sf) -> DataFrame:
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.semantic_branch(_corpus(spark, sf).join(vectors, "id"), _questions(spark, sf), TOP_K)


def lex_topn(spark, sf):
    return _lexical(spark, sf).select("query_id", "id", F.round("lex_rank", 6).alias("lex_rank"), F.col("lex_pos").cast("long").alias("lex_pos"))


def sem_topn(spark, sf):
    return _semantic(spark, sf).select("query_id", "id", F.round("semantic_distance", 6).alias("semantic_distance"), F.col("sem_pos").cast("long").alias("sem_pos"))


def _vector_index(spark, sf) -> tuple[DataFrame, DataFrame, V.Model]:
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    chunks = stored(_corpus(spark, sf).join(vectors, "id").select("id", *S.SCOPE, "embedding"), "vectors")
    model = V.fit(chunks)
    return chunks, V.coded(chunks, model, [*S.SCOPE, "id"]), model


def _positions(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", F.round("semantic_distance", 6).alias("semantic_distance"), F.col("sem_pos").cast("long").alias("sem_pos"))


def semantic_approximate(spark, sf):
    """The semantic branch by the vector index; a test holds it against :func:`sem_topn`."""
    return _positions(S.approximate_branch(*_vector_index(spark, sf), _questions(spark, sf), TOP_K, rerank=S.pool_size(TOP_K)))


def semantic_index_full(spark, sf):
    """The same with every cell probed and every candidate re-ranked, which is exact."""
    chunks, codes, model = _vector_index(spark, sf)
    return _positions(S.approximate_branch(chunks, codes, model, _questions(spark, sf), TOP_K, probes=V.CELLS, rerank=chunks.count()))


def rrf_full_outer(spark, sf):
    fused = S.fuse(_lexical(spark, sf).select("query_id", "id", "lex_rank", "lex_pos"), _semantic(spark, sf).select("query_id", "id", "semantic_distance", "sem_pos"))
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), F.round("lex_rank", 6).alias("lex_rank"), F.round("semantic_distance", 6).alias("semantic_distance"))


def hybrid_rrf_topk(spark, sf):
    """The best documents of each source by fused position, with their late-joined text lengths."""
    fused = S.fuse(_lexical(spark, sf).select("query_id", "id", "lex_rank", "lex_pos"), _semantic(spark, sf).select("query_id", "id", "semantic_distance", "sem_pos"))
    best = S.top_hits(fused, TOP_K)
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return best.join(rows, "id").select(
        "query_id", F.col("hit_pos").cast("long").alias("hit_pos"), "id", F.round("score", 9).alias("score"), F.round("lex_rank", 6).alias("lex_rank"), F.round("semantic_distance", 6).alias("semantic_distance"), "lang", "n_chars"
    )


def _chunks_and_questions(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as chunks, their vectors apart (null where a document has none: texts are not moved for them), and each source's question twice: with its words, and blank, which vectors alone answer."""
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    none = F.lit(None).cast("string")
    chunks = _corpus(spark, sf).select(
        "id", *S.SCOPE, F.concat(F.lit("doc::"), F.col("id").cast("string")).alias("chunk_key"), F.lit("rule").alias("chunk_type"), none.alias("table_name"), none.alias("column_name"),
        F.col("id").cast("string").alias("rule_id"), none.alias("raw_value"), F.struct("lang").alias("payload"), F.col("text").alias("text_exact"), F.lit("").alias("text_semantic"),
    )
    asked = stored(_questions(spark, sf), "asked-vectors")
    blank = asked.withColumn("query_id", F.concat("query_id", F.lit("?"))).withColumn("lexical_query", F.lit("  "))
    return chunks, _corpus(spark, sf).select("id", *S.SCOPE).join(vectors, "id", "left"), asked.unionByName(blank)


def _rounded_hits(hits: DataFrame) -> DataFrame:
    rounded = {"score": F.round("score", 9), "lex_rank": F.round("lex_rank", 6), "semantic_distance": F.round("semantic_distance", 6)}
    return hits.withColumns(rounded | {"hit_pos": F.col("hit_pos").cast("long"), "payload": F.col("payload.lang")})


def hybrid_search_hits(spark, sf):
    """All columns of the hits of each source's question, and of a blank question."""
    chunks, vectors, asked = _chunks_and_questions(spark, sf)
    return _rounded_hits(S.hybrid_search(chunks, _stored_index(spark, sf), asked, TOP_K, semantic=S.semantic_branch(vectors, asked, TOP_K)))


def hybrid_search_sql(spark, sf):
    """The same by the table function of SQL."""
    chunks, vectors, asked = _chunks_and_questions(spark, sf)
    register(spark, chunks, _stored_index(spark, sf), stored(asked, "questions"), vectors)
    return _rounded_hits(spark.sql(f"SELECT * FROM hybrid_search_all({TOP_K})"))


def fts_rank_phrase(spark, sf):
    """Phrases, AND and negation with stems of the texts (B part), and a word of the language codes (A part)."""
    docs = _corpus(spark, sf).select("resource_owner", "resource_namespace", "id", F.col("lang").alias("text_exact"), F.col("text").alias("text_semantic"))
    asked = _questions(spark, sf).withColumn("tsq", parsed_query(F.lit(PHRASES)))
    names = sorted({lexeme for *_, found in parse_query(PHRASES) for lexeme, _ in found})
    return match(lexemes_of(docs, [*S.SCOPE, "id"], names), asked, S.SCOPE).select("query_id", "id", F.round("lex_rank", 5).alias("lex_rank"))


# --- catalog and chunks ---------------------------------------------------------------------


def _scoped(df: DataFrame) -> DataFrame:
    return df.withColumn("resource_owner", F.lit("tpch")).withColumn("resource_namespace", F.lit("main"))


def catalog_columns(spark, sf) -> DataFrame:
    rows = [(i, t, c, None, d, [c.split("_", 1)[1]], "string") for i, (t, c, d) in enumerate(CATALOG)]
    return _scoped(spark.createDataFrame(rows, "pos long, table_name string, column_name string, raw_column_name string, description string, aliases array<string>, data_type string"))


def catalog_values(spark, sf) -> DataFrame:
    """The distinct values of the catalog's columns, with glosses made of them."""
    parts = []
    for i, (table, column, _) in enumerate(CATALOG):
        rows = _t(spark, sf, table).select(F.col(column).cast("string").alias("raw_value")).where("raw_value IS NOT NULL").distinct()
        parts.append(rows.select(F.lit(i).alias("at"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "raw_value"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    nth = F.row_number().over(Window.partitionBy("at").orderBy("raw_value"))
    gloss = F.concat(F.lit("The value "), F.col("raw_value"), F.lit(" of the column. More follows."))
    return _scoped(
        every.select(
            (F.col("at").cast("long") * 1_000_000_000 + nth).alias("pos"), *REF, "raw_value", gloss.alias("value_gloss"), F.array(F.lower("raw_value")).alias("synonyms"), F.array(F.lit("pilot")).alias("business_tags")
        )
    )


def catalog_rules(spark, sf) -> DataFrame:
    """A rule for each supplier, about one or two columns of the catalog."""
    refs = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c, _ in CATALOG])
    key, nth = F.col("s_suppkey"), (F.col("s_nationkey") % len(CATALOG)).cast("int")
    both = F.array_compact(F.array(F.get(refs, nth), F.when(key % 2 == 0, F.get(refs, (nth + 1) % len(CATALOG)))))
    terms = F.when(key % 3 == 0, F.array(F.lit("exec sign off"), F.col("s_name"))).otherwise(F.array(F.lit("beta")))
    rules = _t(spark, sf, "supplier").select(
        key.alias("pos"), F.concat(F.lit("r-"), key.cast("string")).alias("rule_id"), F.concat("s_name", F.lit(" needs approval. Ask legal.")).alias("description"), both.alias("candidate_columns"),
        terms.alias("trigger_terms"), F.lit(None).cast("string").alias("intent"), F.col("s_nationkey").cast("int").alias("priority"), F.lit(None).cast("string").alias("rule_text"),
    )
    return _scoped(rules)


_CHUNK = ["chunk_key", "chunk_type", *REF, "rule_id", "raw_value", "text_exact", "text_semantic"]


def column_definition_chunks(spark, sf):
    columns, values = catalog_columns(spark, sf), catalog_values(spark, sf)
    found = C.column_chunks(C.with_policy(columns, C.cardinality(values, LIMIT)))
    return found.select(*_CHUNK, F.col("payload.value_cardinality").cast("long").alias("value_cardinality"), F.col("payload.mandatory_description_in_prompt").alias("mandatory"))


def value_definition_chunks(spark, sf):
    columns, values = catalog_columns(spark, sf), catalog_values(spark, sf)
    return C.value_chunks(values, columns, C.cardinality(values, LIMIT)).select(*_CHUNK)


def rule_chunks(spark, sf):
    return C.rule_chunks(catalog_rules(spark, sf)).select(*_CHUNK, F.size("payload.candidate_columns").cast("long").alias("n_columns"))


def chunk_union(spark, sf):
    every, _ = C.project(catalog_columns(spark, sf), catalog_values(spark, sf), catalog_rules(spark, sf), LIMIT, lambda c: F.length(c))
    return every.select("id", "chunk_key", "chunk_type")


def rule_catalog(spark, sf):
    rows = C.rule_catalog(catalog_rules(spark, sf))
    return rows.select("rule_id", "text_exact", "text_semantic", F.col("priority").cast("long").alias("priority"), F.size("payload.trigger_terms").cast("long").alias("n_triggers"))


def value_cardinality(spark, sf):
    found = C.cardinality(catalog_values(spark, sf), LIMIT)
    return found.select(*REF, F.col("value_cardinality").cast("long").alias("n"), "indexed", "mandatory")


def _profiled(spark, sf) -> DataFrame:
    """Every value of a few dozen columns of the driver's tables, in three loads."""
    parts = []
    for table, key in (("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("nation", "n_nationkey"), ("documents", "doc_id")):
        df = _t(spark, sf, table)
        texts = {f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType.simpleString() in ("string", "int", "double") and f.name not in ("text", "props")}
        odd = {f"{key}_mod_{m}": (F.col(key) % m).cast("string") for m in (24, 25, 26, 49, 53)} | {f"{key}_none": F.lit(None).cast("string")}
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), c.alias("raw_value")) for n, c in (texts | odd).items()]))
        parts.append(df.select(F.lit(table).alias("table_name"), (F.col(key) % 3).alias("load"), pairs.alias("p")).select("table_name", "load", "p.*"))
    return reduce(DataFrame.unionByName, parts)


def policy_from_sketches(spark, sf):
    """The cardinality policy of columns from merged profiles of three loads, with the values' counts."""
    values = _profiled(spark, sf)
    loads = [values.where(F.col("load") == n).drop("load") for n in range(3)]
    states = stored(reduce(DataFrame.unionByName, [P.profile(v) for v in loads]), "profiles")
    whole = stored(P.merged(states), "merged-profiles")
    found = P.policy(whole, loads, LIMIT)
    return found.join(whole.select(*REF, "n", "n_null"), REF).select(*REF, "n", "n_null", "indexed", "mandatory")


def mandatory_columns(spark, sf):
    flagged = C.with_policy(catalog_columns(spark, sf), C.cardinality(catalog_values(spark, sf), LIMIT))
    return flagged.where("mandatory_description_in_prompt").select(*REF, F.col("value_cardinality").cast("long").alias("n"))


def value_indexing_summary(spark, sf):
    found = C.indexing_summary(catalog_values(spark, sf), catalog_columns(spark, sf), LIMIT)
    return found.withColumn("mandatory_description_labels", F.array_join("mandatory_description_labels", ","))


# --- time and intervals ---------------------------------------------------------------------


def asof_orders(spark, sf):
    """For each event, with a day made of its id, the user's last order until then."""
    events = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("c"), (F.col("event_id") * 7 % 2400).alias("day"))
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long").alias("day"), "o_orderkey", "o_orderstatus")
    found = as_of(events, orders, ["c"], "day", ["o_orderkey", "o_orderstatus"], ["o_orderkey"], stretch=F.floor(F.col("day") / 365))
    return found.select("event_id", F.col("asof_o_orderkey").alias("o_orderkey"), F.col("asof_o_orderstatus").alias("o_orderstatus"))


def price_bands(spark, sf):
    """How many unit prices of lines lie in the price band of each part that has any, and their largest."""
    low = F.col("p_retailprice") * F.col("p_size")
    bands = _t(spark, sf, "part").select("p_partkey", low.alias("low"), (low + F.when(F.col("p_size") == 50, 2000.0).otherwise(F.col("p_size") / 4)).alias("high"))
    prices = _t(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    found = count_in_intervals(prices, bands, "price", "low", "high", 5.0)
    return found.groupBy("p_partkey").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))


GAP_HOURS, FRAME_HOURS = 8, 48


def user_sessions(spark, sf):
    """Events of each user by sessions, and what their values of the last two days sum up to."""
    events = _t(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    hour = 3_600_000_000
    found = sessions(events, ["user_id"], F.col("us"), "event_id", GAP_HOURS * hour, 72 * hour)
    found = trailing_sum(found, ["user_id"], F.col("us"), "value", FRAME_HOURS * hour, "recent")
    return found.select("event_id", "user_id", "session", "session_start", F.round("recent", 4).alias("recent"))


# --- keys and references --------------------------------------------------------------------


def first_wins_dedup(spark, sf):
    return keep_first(_t(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


#: Event time may run back by this much; a stretch of days comes as one file, and every 97th event one file later.
DELAY_HOURS, STRETCH_DAYS, BEHIND = 36, 6, 97


def first_wins_stream(spark, sf):
    """The first event of each user and type, from a stream of files with late events in a side output."""
    from lodestar.sources.shared import new_path
    from lodestar.streaming.first_wins import first_wins, start

    events = _t(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    begin, end = events.agg(F.min("ts"), F.max("ts")).first()
    folder, out, checkpoint, arrivals = (new_path(spark, name) for name in ("event-files", "first-events", "first-events-checkpoint", "arrivals"))
    stretch = F.floor(F.datediff("ts", F.lit(begin)) / STRETCH_DAYS) + (F.col("event_id") % BEHIND == 0).cast("long")
    events.where("ts IS NOT NULL").withColumn("stretch", stretch).write.partitionBy("stretch").parquet(arrivals)
    arriving = spark.read.parquet(arrivals)
    stretches = sorted(r.stretch for r in arriving.select("stretch").distinct().collect())  # one for each few days
    # an event from the far future lets the watermark pass all others
    last = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(-1).cast("long").alias("event_id"), F.lit(end + timedelta(days=365)).alias("ts"))
    # one stretch after the other, as they would come: each is a batch, of as many files as tasks wrote
    for files in (*(arriving.where(F.col("stretch") == n).drop("stretch") for n in stretches), last):
        files.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        found = first_wins(stream, ["user_id", "event_type"], "ts", F.col("event_id"), f"{DELAY_HOURS} hours")
        start(spark, found, out, checkpoint, available_now=True).awaitTermination()
    rows = spark.read.schema("user_id long, event_type string, at long, tie long, body string, kind string").parquet(out)
    return rows.select("kind", "user_id", "event_type", F.col("tie").alias("event_id"), (F.get_json_object("body", "$.event_id").cast("long") == F.col("tie")).alias("whole"))


def rule_dedup_stateful(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").alias("dropped"))
    marked = mark_duplicates(rows, "rule_id", "pos", F.col("dropped"))
    return marked.groupBy("rule_id").agg(F.count_if("duplicate").alias("n_duplicates"), F.count_if(F.col("dropped") & ~F.col("duplicate")).alias("n_dropped"))


def infer_table_name(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("column_name"), F.col("c_mktsegment").alias("table_name"))
    every = rows.unionByName(_t(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("column_name"), F.col("s_name").alias("table_name")))
    return unique_match(every, "column_name", "table_name")


def candidate_ref_parse(spark, sf):
    table, column = split_reference(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", table.alias("table_name"), column.alias("column_name"))


def resolve_column_identity(spark, sf):
    key = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("::"), "p_name")).otherwise(F.col("p_name"))
    table = F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    column = F.when(F.col("p_size") % 5 == 0, F.col("p_name"))
    t, c = resolve_identity(table, column, key)
    return _t(spark, sf, "part").select("p_partkey", t.alias("table_name"), c.alias("column_name"))


def unknown_refs_anti(spark, sf):
    """Customers without an order under way."""
    waiting = _t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return orphans(_t(spark, sf, "customer"), waiting, ["c_custkey"]).select("c_custkey", "c_mktsegment")


def known_refs_semi(spark, sf):
    known = _t(spark, sf, "customer").join(_t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return known.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def key_violations(spark, sf):
    return duplicates(_t(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey", "n")


def foreign_key_orphans(spark, sf):
    vectors = _t(spark, sf, "labels").select("doc_id", "quality")
    return orphans(_t(spark, sf, "documents").select("doc_id", "lang"), vectors, ["doc_id"]).groupBy("lang").agg(F.count("*").alias("n"))


def issues_histogram(spark, sf):
    """Issues of column records made of parts, with drifting types, absent names and repeated keys."""
    p = _t(spark, sf, "part")
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = F.concat_ws(
        ",",
        F.when(F.col("p_size") % 7 != 0, field("table_name", quoted(F.col("p_brand")))),
        F.when(F.col("p_size") % 11 != 0, field("column_name", quoted(F.col("p_name")))),
        F.when(F.col("p_size") % 13 == 0, field("column_key", F.lit("5"))),
        field("description", F.when(F.col("p_size") % 5 == 0, F.lit("12")).otherwise(quoted(F.col("p_type")))),
        field("aliases", F.when(F.col("p_size") % 3 == 0, quoted(F.col("p_name"))).when(F.col("p_size") % 4 == 0, F.lit('["a",1,null]')).otherwise(F.lit("[]"))),
    )
    rows = p.select(F.col("p_partkey").alias("pos"), F.parse_json(F.concat(F.lit("{"), body, F.lit("}"))).alias("rec"))
    _, issues = parse_columns(rows)
    return issues.groupBy("issue_type", "action").agg(F.count("*").alias("n"))


def _record(templates: tuple[str, ...], key: Column, **texts: Column) -> Column:
    """The template that the key picks, with its places filled, as a VARIANT."""
    text = F.element_at(F.array(*[F.lit(x) for x in templates]), (key % len(templates) + 1).cast("int"))
    for name, value in texts.items():
        text = F.replace(text, F.lit(f"@{name}"), value.cast("string"))
    return F.parse_json(text)


def _known(spark, sf) -> DataFrame:
    """A column for each nation in the table of its region, and one that every region has."""
    own = _t(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("table_name"), F.col("n_name").alias("column_name"))
    return own.unionByName(_t(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("table_name"), F.lit("shared").alias("column_name")))


def _counted(issues: DataFrame) -> DataFrame:
    fields = ["issue_type", "entity_key", "action", "details"]
    return issues.groupBy(*fields).agg(F.count("*").alias("n"))


def issues_payloads(spark, sf):
    """Issues of payloads that are wrapped, of the wrong type, or hold records of the wrong type."""
    every = None
    for name, wrappers in (("columns", ("columns",)), ("value_groups", ("value_groups", "values")), ("rules", ("rules",))):
        docs = _t(spark, sf, "customer").select(_record(PAYLOADS, F.col("c_custkey"), w=F.lit(wrappers[-1])).alias("doc"))
        _, found = records(docs, name, wrappers)
        every = found.select("i.*") if every is None else every.unionByName(found.select("i.*"))
    return _counted(every)


def _parsed_values(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers as groups of values of their nation's column."""
    rows = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rec = _record(VALUE_GROUPS, F.col("c_custkey"), t=F.concat(F.lit("r"), "n_regionkey"), c=F.col("n_name"), i=F.col("c_custkey"), s=F.col("c_mktsegment"))
    return parse_values(rows.select(F.col("c_custkey").alias("pos"), rec.alias("rec")), _known(spark, sf))


def issues_values(spark, sf):
    """Issues of value groups, their columns, values and keys."""
    return _counted(_parsed_values(spark, sf)[1])


def fatal_issues(spark, sf):
    """Issues of value groups that keep a catalog from being loaded."""
    from lodestar.plans.load import fatal

    return _counted(fatal(_parsed_values(spark, sf)[1]))


def parsed_values(spark, sf):
    """Values that are kept of groups with drift: the first of each key."""
    found = _parsed_values(spark, sf)[0]
    return found.select(*REF, "raw_value", "value_gloss", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("business_tags", ",").alias("tags"))


def _parsed_rules(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Orders as rules about the columns of the nation that their key picks."""
    rows = _t(spark, sf, "orders").join(F.broadcast(_t(spark, sf, "nation")), F.col("o_orderkey") % 25 == F.col("n_nationkey"))
    rec = _record(RULE_RECORDS, F.col("o_orderkey"), t=F.concat(F.lit("r"), "n_regionkey"), c=F.col("n_name"), i=F.col("o_orderkey"), s=F.col("o_custkey"))
    return parse_rules(rows.select(F.col("o_orderkey").alias("pos"), rec.alias("rec")), _known(spark, sf))


def issues_rules(spark, sf):
    """Issues of rules, their candidate columns and ids."""
    return _counted(_parsed_rules(spark, sf)[1])


def parsed_rules(spark, sf):
    """Rules that are kept: of those that share an id, the first with a known column or without candidates."""
    found = _parsed_rules(spark, sf)[0]
    refs = F.array_join(F.transform("candidate_columns", lambda r: T.label(r["table_name"], r["column_name"])), ",")
    return found.select("rule_id", "description", refs.alias("refs"), F.array_join("trigger_terms", ",").alias("triggers"), F.col("priority").cast("long").alias("priority"))


# --- rollup ---------------------------------------------------------------------------------


def _hits(spark, sf) -> DataFrame:
    """Line items as hits: an order is a question, a line a hit that names flags as its column."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "rule").when(F.col("l_linenumber") % 3 == 1, "value_definition").otherwise("column_definition")
    ref = F.struct(F.col("l_returnflag").alias("table_name"), F.col("l_linestatus").alias("column_name"))
    other = F.struct(F.lit("X").alias("table_name"), F.col("l_linestatus").alias("column_name"))
    nobody = F.struct(F.lit("").alias("table_name"), F.col("l_linestatus").alias("column_name"))
    value = F.concat(F.lit("v"), (F.col("l_suppkey") % 6).cast("string"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    # bare lines are dealt by question once; what is made of them, and joins and groups by question, follow without an exchange
    lines = _t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "query_id").withColumn("place", place)
    return lines.select(
        "query_id",
        F.col("place").cast("long").alias("hit_pos"),
        kind.alias("chunk_type"),
        F.concat(F.lit("k"), (F.col("l_partkey") % 50).cast("string")).alias("chunk_key"),
        F.when(kind != "rule", F.col("l_returnflag")).alias("table_name"),
        F.when(kind != "rule", F.col("l_linestatus")).alias("column_name"),
        F.when(kind == "rule", F.concat(F.lit("r"), (F.col("l_suppkey") % 4).cast("string"))).alias("rule_id"),
        F.when(kind == "value_definition", value).alias("raw_value"),
        (F.lit(1.0) / (F.col("l_quantity") + 60)).alias("score"),
        F.concat(F.lit("open "), F.lower("l_returnflag"), F.lit(" lines")).alias("text_exact"),
        F.concat(F.lit("Rule "), (F.col("l_partkey") % 9).cast("string")).alias("text_semantic"),
        C.payload(
            value_gloss=F.concat(F.lit("Gloss "), F.col("l_linenumber").cast("string"), F.lit(". More")),
            synonyms=F.array(F.lit("syn")),
            candidate_columns=F.when(kind == "rule", F.array(ref, other, nobody)),
        ).alias("payload"),
    )


def _parts(spark, sf) -> DataFrame:
    hits = _hits(spark, sf)
    keywords = F.array(*[F.lit(w) for w in ("open", "line", "syn", "a lines", "zzz")])
    asked = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), keywords.alias("keywords"))
    return R.contributions(hits, asked, WEIGHTS)


def keyword_coverage(spark, sf):
    """Keywords that each document covers, documents taken as hits."""
    asked = F.array(*[F.lit(w) for w in ("license", "the", "ation", "src", "*** ", "zzz")])
    none = F.lit(None).cast("string")
    rows = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("text_exact"), F.lit("").alias("text_semantic"), *[none.alias(c) for c in ("table_name", "column_name", "rule_id", "raw_value")], C.payload().alias("payload"))
    return rows.select("doc_id", F.array_join(R.keyword_hits(asked, gaps=False), ",").alias("covered"))


def rollup_scores(spark, sf):
    found = R.column_scores(_parts(spark, sf))
    return found.select("query_id", *REF, F.round("score", 9).alias("score"), F.array_join("coverage_terms", ",").alias("coverage"))


def rule_bonus(spark, sf):
    rules = _parts(spark, sf).where("chunk_type = 'rule'")
    return rules.groupBy(*REF, "rule_id").agg(F.count("*").alias("n"), F.round(F.sum("points"), 6).alias("bonus"))


def _exploded(df: DataFrame, name: str, *fields: str) -> DataFrame:
    rows = df.select("query_id", *REF, F.posexplode(name).alias("nth", "v"))
    return rows.select("query_id", *REF, F.col("nth").cast("long").alias("nth"), *[(F.round(f"v.{f}", 9) if f == "score" else F.col(f"v.{f}")).alias(f) for f in fields])


def matched_values_top4(spark, sf):
    return _exploded(R.matched_values(_parts(spark, sf)), "matched_values", "raw_value", "score", "value_gloss")


def matched_rules_top4(spark, sf):
    return _exploded(R.matched_rules(_parts(spark, sf)), "matched_rules", "rule_id", "score", "text_semantic")


def supporting_top6(spark, sf):
    return _exploded(R.supporting_chunks(_parts(spark, sf)), "supporting_chunks", "chunk_key", "chunk_type", "score")


def candidate_top5(spark, sf):
    found = R.rank_columns(R.column_scores(_parts(spark, sf)), 5)
    return found.select("query_id", *REF, F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def _candidates(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits = _hits(spark, sf)
    keywords = F.array(*[F.lit(w) for w in ("open", "line")])
    asked = _scoped(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), keywords.alias("keywords"), F.lit("q").alias("raw_query"), F.lit("q").alias("normalized_query")))
    rows = [("A", "F", None, "Alpha first. Rest.", ["a"], "string", 30, True), ("R", "F", None, "", [], "string", 3, False), ("M", "M", "raw", "Always shown", [], None, 99, True)]
    details = _scoped(
        spark.createDataFrame(
            rows, "table_name string, column_name string, raw_column_name string, description string, aliases array<string>, data_type string, value_cardinality int, mandatory_description_in_prompt boolean"
        )
    )
    return hits, asked, R.candidate_columns(hits, asked, details, WEIGHTS, 2)


def mandatory_injection(spark, sf):
    _, _, found = _candidates(spark, sf)
    return found.select(
        "query_id", F.col("section").cast("long").alias("section"), F.col("rank").cast("long").alias("rank"), *REF, "short_description", F.col("value_cardinality").cast("long").alias("n"), "mandatory_description_in_prompt", "injection_source"
    )


def prompt_projection(spark, sf):
    hits, asked, found = _candidates(spark, sf)
    prompts = R.prompt_bundles(hits, found, asked)
    return prompts.select(
        "query_id",
        F.size("candidate_columns").cast("long").alias("n_columns"),
        F.array_join(F.transform("candidate_columns", lambda c: T.label(c["table_name"], c["column_name"])), ",").alias("columns"),
        F.array_join(F.transform("matched_rules", lambda r: r["rule_id"]), ",").alias("rules"),
    )


def retrieval_summary(spark, sf):
    hits, asked, found = _candidates(spark, sf)
    s = R.retrieval_summary(hits, found, asked)
    return s.select(
        "query_id", "hit_count", F.array_join(F.transform(F.map_entries("chunk_type_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("kinds"), F.array_join("top_hit_chunk_keys", ",").alias("keys"), F.array_join("top_hit_columns", ",").alias("columns"), "candidate_column_count", "matched_value_count", "matched_rule_count", "mandatory_injected_columns"
    )


class DriverTables:
    """An adapter for catalogs that are made of the driver's tables; ``root`` is their folder and the catalog's name."""

    def load(self, spark: SparkSession, root: str, owner: str, namespace: str) -> Catalog:
        sf, name = root.rsplit("#", 1)
        made = (catalog_columns(spark, sf), catalog_values(spark, sf), catalog_rules(spark, sf)) if name == "profiled" else _part_catalog(spark, sf, int(name))
        scoped = [conform(df.withColumns({"resource_owner": F.lit(owner), "resource_namespace": F.lit(namespace)}), kind) for df, kind in zip(made, (COLUMNS, VALUES, RULE_SCHEMA))]
        return Catalog(owner, namespace, *scoped, spark.createDataFrame([], ISSUES), {"columns": name, "values": None, "rules": None}, {})


def _part_catalog(spark, sf, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brands as tables, names as their columns, types as values, suppliers as rules; version 2 differs in some of a hundred."""
    later = F.lit(version == 2)
    in_hundred = lambda c, n: later & (c % 100 == n)
    p = _t(spark, sf, "part").groupBy(F.col("p_brand").alias("table_name"), F.col("p_name").alias("column_name"), "p_type").agg(F.min("p_partkey").alias("pos"))
    columns = p.groupBy(*REF).agg(F.min("pos").alias("pos"))
    told = F.concat(F.when(in_hundred(F.col("pos"), 7), "Formerly ").otherwise("Parts "), "column_name", F.lit(" of "), "table_name")
    columns = columns.select("pos", *REF, F.lit(None).alias("raw_column_name"), told.alias("description"), F.array().cast("array<string>").alias("aliases"), F.lit("string").alias("data_type"))
    values = p.where(~in_hundred(F.col("pos"), 13)).select("pos", *REF, F.col("p_type").alias("raw_value"))
    values = values.unionByName(p.where(in_hundred(F.col("pos"), 29)).select("pos", *REF, F.concat("p_type", F.lit(" more")).alias("raw_value")))
    none = F.array().cast("array<string>")
    values = values.select("*", F.concat(F.lit("Type "), "raw_value").alias("value_gloss"), none.alias("synonyms"), none.alias("business_tags"))
    key = F.col("s_suppkey")
    rules = _t(spark, sf, "supplier").where(~in_hundred(key, 3)).select(
        key.alias("pos"), F.concat(F.lit("s"), key.cast("string")).alias("rule_id"), F.concat(F.lit("Ask "), F.when(in_hundred(key, 5), "nobody").otherwise(F.col("s_name"))).alias("description"),
        F.array().cast("array<struct<table_name: string, column_name: string>>").alias("candidate_columns"), none.alias("trigger_terms"), F.lit(None).alias("intent"), F.lit(0).alias("priority"), F.lit(None).alias("rule_text"),
    )
    return columns, values, rules


def namespace_replace(spark, sf):
    """A scope loaded twice and another one beside it: the second load replaces the first, and nothing else."""
    from lodestar.plans.load import load_namespace
    from lodestar.sources.shared import new_path

    register_adapter("driver_tables", DriverTables)
    store = Store(spark, new_path(spark, "store"))
    for namespace, limit in (("main", 3), ("other", 0), ("main", LIMIT)):
        load_namespace(spark, store, f"{sf}#profiled", "tpch", namespace, Settings(source_adapter="driver_tables", value_cardinality_limit=limit))
    assert store.count("chunks", "tpch", "other") < store.count("chunks", "tpch", "main")
    return store.table("chunks", "tpch", "main").groupBy("chunk_type").agg(F.count("*").alias("n"))


def namespace_merge(spark, sf):
    """A catalog and then its second version, merged by rows: chunks as they are now, and whether they kept their ids."""
    from lodestar.plans.merge import merge_namespace
    from lodestar.sources.shared import new_path

    register_adapter("driver_tables", DriverTables)
    store, config = Store(spark, new_path(spark, "store")), Settings(source_adapter="driver_tables")
    merge_namespace(spark, store, f"{sf}#1", "tpch", "parts", config)
    before = store.table("chunks", "tpch", "parts").select("chunk_key", F.col("id").alias("was"))
    merge_namespace(spark, store, f"{sf}#2", "tpch", "parts", config)
    now = store.table("chunks", "tpch", "parts").join(before, "chunk_key", "left")
    indexed = store.table("index", "tpch", "parts").select(F.explode("docs").alias("d"), "block").select((F.col("block") * 64 + F.col("d.at")).alias("id")).distinct()
    now = now.join(indexed.withColumn("indexed", F.lit(True)), "id", "left")
    return now.select("chunk_type", "chunk_key", "text_semantic", F.coalesce(F.col("was") == F.col("id"), F.lit(False)).alias("kept_id"), F.coalesce("indexed", F.lit(False)).alias("indexed"))


def catalog_difference(spark, sf):
    """What a second version changes in three tables of repeated keys: rows go, come, change, move and occur once more."""

    def versions(name: str, key: str, number: str, *others: str) -> DataFrame:
        before = _t(spark, sf, name).select(F.col(key).cast("string").alias("key"), *others, F.col(number).alias("pos"))
        n = F.col("pos")
        after = before.where(n % 97 != 0).withColumn(others[0], F.when(n % 89 == 0, "other").otherwise(F.col(others[0]))).withColumn("at", F.when(n % 79 == 0, -n).otherwise(n))
        again = after.where(n % 83 == 0)
        found = difference(before.withColumn("at", F.col("pos")).drop("pos"), after.unionByName(again).drop("pos"), ["key"], "at")
        return found.select(F.lit(name).alias("name"), "key", "change", "n")

    tables = (("part", "p_brand", "p_partkey", "p_type", "p_size"), ("customer", "c_nationkey", "c_custkey", "c_mktsegment"), ("orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"))
    return reduce(DataFrame.unionByName, [versions(*t) for t in tables])


_ALL: tuple[Query, ...] = (
    hybrid_rrf_topk, lex_topn, sem_topn, semantic_approximate, semantic_index_full, rrf_full_outer, hybrid_search_hits, hybrid_search_sql, fts_rank_phrase, scope_filter_count, prepare_rewrites, unaccent_docs, tokenize_docs, alias_expand, dedupe_terms, compact_sentence,
    description_keywords, build_text_exact, text_metrics, estimate_tokens, collection_summary, count_by_key, retrieval_inputs_batch, hash_embedding_tokens, embed_text_docs,
    column_definition_chunks, value_definition_chunks, rule_chunks, chunk_union, rule_catalog, value_cardinality, policy_from_sketches, mandatory_columns, value_indexing_summary, first_wins_dedup, first_wins_stream,
    rule_dedup_stateful, infer_table_name, candidate_ref_parse, resolve_column_identity, unknown_refs_anti, known_refs_semi, key_violations, foreign_key_orphans, issues_histogram,
    issues_payloads, issues_values, fatal_issues, parsed_values, issues_rules, parsed_rules,
    keyword_coverage, rollup_scores, rule_bonus, matched_values_top4, matched_rules_top4, supporting_top6, candidate_top5, mandatory_injection, prompt_projection, retrieval_summary,
    namespace_replace, namespace_merge, catalog_difference, asof_orders, price_bands, user_sessions,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}
