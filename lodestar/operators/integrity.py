"""Constraints of the stored tables, checked before a snapshot becomes visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.search import SCOPE

REF = ["table_name", "column_name"]
PRIMARY_KEYS = {"columns": [*SCOPE, *REF], "values": [*SCOPE, *REF, "raw_value"], "rules": [*SCOPE, "rule_id"], "chunks": [*SCOPE, "id"]}
UNIQUE = {"chunks": [*SCOPE, "chunk_key"]}
CHUNK_TYPES = ("column_definition", "value_definition", "rule")
NOT_NULL = {
    "columns": ["table_name", "column_name", "description", "aliases", "value_cardinality", "mandatory_description_in_prompt"],
    "values": ["table_name", "column_name", "raw_value", "value_gloss", "synonyms", "business_tags"],
    "rules": ["rule_id", "text_exact", "text_semantic", "candidate_columns", "priority", "payload"],
    "chunks": ["chunk_key", "chunk_type", "text_exact", "text_semantic", "payload", "embedding"],
}
#: (child, its columns, parent, its columns); a null in the child's columns is not checked.
FOREIGN_KEYS = (
    ("values", [*SCOPE, *REF], "columns"),
    ("chunks", [*SCOPE, *REF], "columns"),
    ("chunks", [*SCOPE, "rule_id"], "rules"),
)


class IntegrityError(ValueError):
    """A table breaks a constraint; nothing was stored."""


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``child`` whose key, if it has no null, ``parent`` lacks."""
    whole = child
    for c in key:
        whole = whole.where(F.col(c).isNotNull())
    return whole.join(parent.select(*key).distinct(), key, "left_anti")


def violations(tables: dict[str, DataFrame], dim: int) -> DataFrame:
    """(rule, n): every constraint that is broken and how often, in one pass over each table."""
    found = []
    for name, key in [*PRIMARY_KEYS.items(), *UNIQUE.items()]:
        found.append(duplicates(tables[name], key).agg(F.lit(f"{name}: unique {', '.join(key)}").alias("rule"), F.count("*").alias("n")))
    for name, columns in NOT_NULL.items():
        broken = [F.count_if(F.col(c).isNull()) for c in columns]
        found.append(tables[name].agg(F.lit(f"{name}: not null").alias("rule"), sum(broken[1:], broken[0]).alias("n")))
    chunks = tables["chunks"]
    found.append(chunks.agg(F.lit("chunks: type").alias("rule"), F.count_if(~F.col("chunk_type").isin(*CHUNK_TYPES)).alias("n")))
    found.append(chunks.agg(F.lit(f"chunks: embedding of {dim}").alias("rule"), F.count_if(F.size("embedding") != dim).alias("n")))
    for child, key, parent in FOREIGN_KEYS:
        found.append(orphans(tables[child], tables[parent], key).agg(F.lit(f"{child}: {', '.join(key)} in {parent}").alias("rule"), F.count("*").alias("n")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.where("n > 0")


def check(tables: dict[str, DataFrame], dim: int) -> None:
    broken = violations(tables, dim).collect()  # a row for each constraint at most
    if broken:
        raise IntegrityError("; ".join(f"{r.rule} ({r.n})" for r in broken))
