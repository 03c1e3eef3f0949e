"""Catalog tables to retrieval chunks, and the cardinality policy of values.

A catalog is four tables with the columns of ``sources.schemas``; each row has
``pos``, its place in the source, which fixes every order here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.embedding import HashEmbedder
from lodestar.operators.search import SCOPE

REF = ["table_name", "column_name"]
COLUMN, VALUE, RULE = "column_definition", "value_definition", "rule"
_STRINGS = "array<string>"
_REFS = "array<struct<table_name: string, column_name: string>>"

#: One typed payload for all chunk types; fields that a type lacks are null.
PAYLOAD = (
    ("resource_owner", "string"), ("resource_namespace", "string"), ("table_name", "string"), ("column_name", "string"), ("parent_column", "string"),
    ("raw_column_name", "string"), ("description", "string"), ("aliases", _STRINGS), ("data_type", "string"), ("value_cardinality", "int"),
    ("mandatory_description_in_prompt", "boolean"), ("raw_value", "string"), ("value_gloss", "string"), ("synonyms", _STRINGS), ("business_tags", _STRINGS),
    ("candidate_columns", _REFS), ("intent", "string"), ("priority", "int"), ("trigger_terms", _STRINGS), ("rule_text", "string"),
)


def payload(**given: Column) -> Column:
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in PAYLOAD])


def cardinality(values: DataFrame, limit: int) -> DataFrame:
    """scope, table, column, value_cardinality, indexed (at most ``limit`` values), mandatory, first_pos."""
    counted = values.groupBy(*SCOPE, *REF).agg(F.count("*").cast("int").alias("value_cardinality"), F.min("pos").alias("first_pos"))
    return counted.withColumn("indexed", F.col("value_cardinality") <= limit).withColumn("mandatory", F.col("value_cardinality") > limit)


def with_policy(columns: DataFrame, policy: DataFrame) -> DataFrame:
    """Columns with value_cardinality (0 without values) and mandatory_description_in_prompt."""
    joined = columns.join(policy.select(*SCOPE, *REF, "value_cardinality", "mandatory"), [*SCOPE, *REF], "left")
    return joined.withColumn("value_cardinality", F.coalesce("value_cardinality", F.lit(0))).withColumn(
        "mandatory_description_in_prompt", F.coalesce("mandatory", F.lit(False))
    ).drop("mandatory")


def _chunk(kind: str, key: Column, exact: Column, semantic: Column, body: Column, table=None, column=None, rule=None, value=None, order=()) -> list[Column]:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    section, group, place = order
    return [
        *[F.col(c) for c in SCOPE],
        key.alias("chunk_key"),
        F.lit(kind).alias("chunk_type"),
        text(table).alias("table_name"),
        text(column).alias("column_name"),
        text(rule).alias("rule_id"),
        text(value).alias("raw_value"),
        exact.alias("text_exact"),
        semantic.alias("text_semantic"),
        body.alias("payload"),
        F.lit(section).alias("section"),
        group.cast("long").alias("group_pos"),
        place.cast("long").alias("item_pos"),
    ]


def column_chunks(columns: DataFrame) -> DataFrame:
    """A chunk for each column (with its policy)."""
    c = {n: F.col(n) for n in ("resource_owner", "resource_namespace", "table_name", "column_name", "raw_column_name", "description", "data_type", "value_cardinality", "mandatory_description_in_prompt")}
    exact = T.exact_text(F.array(c["table_name"], c["column_name"]), F.col("aliases"), T.description_keywords(c["description"]))
    body = payload(**c, aliases=T.dedupe_terms(F.col("aliases")))
    key = F.concat(F.lit(f"{COLUMN}::"), T.label(c["table_name"], c["column_name"]))
    return columns.select(*_chunk(COLUMN, key, exact, T.compact_sentence(c["description"]), body, c["table_name"], c["column_name"], order=(0, F.col("pos"), F.lit(0))))


def _indexed(values: DataFrame, columns: DataFrame, policy: DataFrame) -> DataFrame:
    """Values of known columns whose values are indexed, with raw_column_name and first_pos of the column."""
    known = columns.select(*SCOPE, *REF, "raw_column_name").join(policy.where("indexed").select(*SCOPE, *REF, "first_pos"), [*SCOPE, *REF])
    return values.join(known, [*SCOPE, *REF])


def value_chunks(values: DataFrame, columns: DataFrame, policy: DataFrame) -> DataFrame:
    """A chunk for each value of a known column whose values are indexed."""
    rows = _indexed(values, columns, policy)
    c = {n: F.col(n) for n in ("resource_owner", "resource_namespace", "table_name", "raw_column_name", "raw_value", "value_gloss")}
    column = F.col("column_name")
    exact = T.exact_text(F.array(c["table_name"], column, c["raw_value"]), F.col("synonyms"), F.col("business_tags"), T.description_keywords(c["value_gloss"], 6))
    semantic = F.concat(F.lit("For "), c["table_name"], F.lit("."), column, F.lit(", "), c["raw_value"], F.lit(" means "), T.compact_sentence(c["value_gloss"]))
    body = payload(**c, parent_column=column, synonyms=T.dedupe_terms(F.col("synonyms")), business_tags=T.dedupe_terms(F.col("business_tags")))
    key = F.concat(F.lit(f"{VALUE}::"), T.label(c["table_name"], column), F.lit("::"), c["raw_value"])
    return rows.select(*_chunk(VALUE, key, exact, semantic, body, c["table_name"], column, None, c["raw_value"], order=(1, F.col("first_pos"), F.col("pos"))))


def _rule_exact() -> Column:
    labels = F.transform("candidate_columns", lambda r: T.label(r["table_name"], r["column_name"]))
    return T.exact_text(F.array("rule_id"), F.col("trigger_terms"), labels)


def rule_chunks(rules: DataFrame) -> DataFrame:
    """A chunk for each rule; its columns are in the payload, not in the chunk's own."""
    c = {n: F.col(n) for n in ("resource_owner", "resource_namespace", "candidate_columns", "intent", "priority", "rule_text")}
    body = payload(**c, trigger_terms=T.dedupe_terms(F.col("trigger_terms")))
    key = F.concat(F.lit("rule::"), F.col("rule_id"))
    return rules.select(*_chunk(RULE, key, _rule_exact(), T.compact_sentence(F.col("description")), body, rule=F.col("rule_id"), order=(2, F.col("pos"), F.lit(0))))


def rule_catalog(rules: DataFrame) -> DataFrame:
    """The stored form of rules: texts computed, a payload of triggers, columns and rule text."""
    body = F.struct(*SCOPE, "trigger_terms", "candidate_columns", "rule_text")
    return rules.select(*SCOPE, "rule_id", _rule_exact().alias("text_exact"), T.compact_sentence(F.col("description")).alias("text_semantic"), "candidate_columns", "intent", "priority", body.alias("payload"))


#: Source places in a block of ids: of records, and of groups of values (whose place is in the upper 32 bits).
#: A block is numbered, embedded and indexed by one task.
RECORDS, GROUPS = 1 << 12, 1 << 8


def _block(group_pos: Column) -> Column:
    """The block of a place in the source; blocks are in the order of places."""
    high = F.shiftright(group_pos, 32)
    return F.when(high == 0, F.floor(group_pos / RECORDS)).otherwise(F.lit(1 << 32) + F.floor(high / GROUPS))


def number(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """Chunks with ids from 1 in insertion order: columns, values by group, rules; for each scope.

    ``places`` has the scope, section and group_pos of the same chunks without
    their texts. Blocks of places are counted first, so a scope of any size
    is numbered by many tasks, each with the chunks before its block.
    """
    key = [*SCOPE, "section", "block"]
    sizes = places.groupBy(*SCOPE, "section", _block(F.col("group_pos")).alias("block")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*SCOPE).orderBy("section", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("group_pos", "item_pos"))
    placed = chunks.withColumn("block", _block(F.col("group_pos"))).join(first, key)
    return placed.withColumn("id", (F.col("before") + inside).cast("long")).drop("section", "group_pos", "item_pos", "block", "before")


def unnumbered(columns: DataFrame, values: DataFrame, rules: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with their places but without ids and embeddings, columns with their policy)."""
    policy = cardinality(values, limit)
    with_flags = with_policy(columns, policy)
    return column_chunks(with_flags).unionByName(value_chunks(values, columns, policy)).unionByName(rule_chunks(rules)), with_flags


def project(columns: DataFrame, values: DataFrame, rules: DataFrame, limit: int, embed=None) -> tuple[DataFrame, DataFrame]:
    """(chunks with ids and embeddings, columns with their policy)."""
    policy = cardinality(values, limit)
    every, with_flags = unnumbered(columns, values, rules, limit)
    places = [
        rows.select(*SCOPE, F.lit(section).alias("section"), F.col(pos).cast("long").alias("group_pos"))
        for section, (rows, pos) in enumerate(((columns, "pos"), (_indexed(values, columns, policy), "first_pos"), (rules, "pos")))
    ]
    return number(every, places[0].unionByName(places[1]).unionByName(places[2])).withColumn("embedding", (embed or HashEmbedder())(F.col("text_semantic"))), with_flags


def indexing_summary(values: DataFrame, columns: DataFrame, limit: int) -> DataFrame:
    """One row of counters, and the labels of mandatory columns in order."""
    policy = cardinality(values, limit).join(columns.select(*SCOPE, *REF).withColumn("known", F.lit(True)), [*SCOPE, *REF], "left")
    chosen = F.col("indexed") & F.coalesce("known", F.lit(False))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return policy.agg(
        F.count_if(chosen).alias("indexed_value_groups"),
        n(F.when(chosen, F.col("value_cardinality"))).alias("indexed_values"),
        F.count("*").alias("total_value_groups"),
        n(F.col("value_cardinality")).alias("total_values"),
        F.count_if("mandatory").alias("mandatory_description_columns"),
        F.array_sort(F.collect_list(F.when(F.col("mandatory"), T.label(F.col("table_name"), F.col("column_name"))))).alias("mandatory_description_labels"),
    )
