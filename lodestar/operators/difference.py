"""The difference of two versions of a table: rows that were added, removed, changed or moved.

Rows are compared by a digest of all their columns but the place, as multisets:
a row that occurs three times and then twice was removed once. Of the rows of
one key, as many as came and went count as changed, the rest as added or
removed. Rows that stayed but for their place (their position in the source)
count as moved. Everything is sums over partial aggregates, so neither a key
nor a row that is very common meets in one task.

Null keys are a key. A table that lacks rows altogether is all removed (or
added). Arrays and structures are compared by their values in order, maps as
they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("added", "removed", "changed", "moved")


def row_digest(columns: list[str]) -> list[Column]:
    """128 bits of a row as two longs, ``d1`` and ``d2``: of its columns by name, nulls included, as JSON."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2")]


def difference(before: DataFrame, after: DataFrame, key: list[str], place: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``key``, change (one of KINDS) and n, for every key with a change.

    ``place``: the column of a row's position, if moves are of interest;
    ``ignore``: columns that don't count.
    """
    compared = [c for c in before.columns if c not in (place, *ignore)]

    def side(df: DataFrame, n_before: int) -> DataFrame:
        at = F.lit(None).cast("string") if place is None else F.col(place).cast("string")
        names = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
        return df.select(*names, *row_digest(compared), at.alias("at"), F.lit(n_before).alias("b"), F.lit(1 - n_before).alias("a"))

    keys = [f"k{i}" for i in range(len(key))]
    at_place = side(before, 1).unionByName(side(after, 0)).groupBy(*keys, "d1", "d2", "at").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    rows = at_place.groupBy(*keys, "d1", "d2").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum(F.least("b", "a")).alias("still"))
    counts = rows.groupBy(*keys).agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("gone"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("come"), F.sum(F.least("b", "a") - F.col("still")).alias("moved"))
    changed = F.least("gone", "come")
    found = {"added": F.col("come") - changed, "removed": F.col("gone") - changed, "changed": changed, "moved": F.col("moved")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("change"), c.cast("long").alias("n")) for k, c in found.items()]))
    return counts.select(*[F.col(k).alias(name) for k, name in zip(keys, key)], each.alias("c")).select(*key, "c.change", "c.n").where("n > 0")
