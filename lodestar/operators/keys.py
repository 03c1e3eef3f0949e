"""Keys and references: first-wins selection, unique matches, splitting of qualified names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth(keys: list[str | Column], *order: str | Column) -> Column:
    """The place of a row among those of its key, from 1."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nth", nth(keys, *order)).where("_nth = 1").drop("_nth")


def mark_duplicates(df: DataFrame, key: str, order: str, dropped: Column, name: str = "duplicate") -> DataFrame:
    """Rows after the first one of their key that is not dropped; dropped rows don't hold a key."""
    holder = F.min(F.when(~dropped, F.col(order))).over(Window.partitionBy(key))
    return df.withColumn(name, F.coalesce(F.col(order) > holder, F.lit(False)))


def unique_match(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def split_reference(text: Column) -> tuple[Column, Column]:
    """(table, column) of ``t::c`` (split at the first) or ``t.c`` (split at the last dot); nulls for a bare name."""
    colons, last = F.contains(text, F.lit("::")), F.substring_index(text, ".", -1)
    dot = F.contains(text, F.lit("."))
    table = F.when(colons, F.substring_index(text, "::", 1)).when(dot, F.substring(text, F.lit(1), F.length(text) - F.length(last) - 1))
    column = F.when(colons, F.substring(text, F.instr(text, "::") + 2, F.length(text))).when(dot, last)
    return table, column


def resolve_identity(table: Column, column: Column, key: Column) -> tuple[Column, Column]:
    """An explicit column wins; else the key names it, with its table before ``::`` unless one is given."""
    use_key = F.coalesce(column, F.lit("")) == ""
    split = F.contains(key, F.lit("::"))
    tail = F.when(split, F.substring(key, F.instr(key, "::") + 2, F.length(key))).otherwise(key)
    head = F.when(split, F.substring_index(key, "::", 1))
    return F.when(use_key & split, F.coalesce(F.nullif(table, F.lit("")), head)).otherwise(table), F.when(use_key & key.isNotNull(), tail).otherwise(column)
