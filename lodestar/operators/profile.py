"""Profiles of columns that merge across loads, and the cardinality policy from them.

A column's profile is one row, whatever its size: how many values and nulls, a
HyperLogLog sketch of the distinct ones and a KLL sketch of their lengths.
Profiles of two loads merge into that of both without the values being read
again, so a catalog can keep one for each column and snapshot.

The policy asks whether a column has more than ``limit`` distinct values. A
sketch cannot say so exactly near the limit, so columns whose estimate comes
close to it (within MARGIN times) are counted; their distinct values are few,
whatever the number of rows. All others go by the sketch, whose error there
would have to be many times its bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** LG_K registers: a relative standard error of about 1.04 / 2 ** (LG_K / 2), 1.6 %.
LG_K = 12
#: KLL's parameter: ranks are off by about 1.33 % at most, at 99 % confidence.
KLL_K = 200
#: Estimates up to this many times the limit are counted.
MARGIN = 2.0
REF = ["table_name", "column_name"]


def profile(values: DataFrame, keys: list[str] | None = None, value: str = "raw_value") -> DataFrame:
    """``keys``, n, n_null, distinct_sketch and length_sketch of each column of ``values`` (``keys``, ``value``: text or null)."""
    text = F.col(value).cast("string")
    return values.groupBy(*(keys or REF)).agg(
        F.count("*").alias("n"), F.count_if(text.isNull()).alias("n_null"), F.hll_sketch_agg(text, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_bigint(F.length(text).cast("long"), KLL_K).alias("length_sketch")
    )


def merged(profiles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One profile for each of ``keys`` from any number of them."""
    return profiles.groupBy(*(keys or REF)).agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("length_sketch").alias("length_sketch")
    )


def estimates(profiles: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Profiles with n_distinct (estimated) and the lengths at ``quantiles`` (null without values)."""
    filled = F.col("n") > F.col("n_null")
    lengths = [F.when(filled, F.kll_sketch_get_quantile_bigint("length_sketch", F.lit(q))).alias(f"length_{round(100 * q)}") for q in quantiles]
    kept = [c for c in profiles.columns if not c.endswith("_sketch")]
    return profiles.select(*kept, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), *lengths)


def policy(profiles: DataFrame, values: list[DataFrame], limit: int, keys: list[str] | None = None, value: str = "raw_value") -> DataFrame:
    """``keys``, indexed (1 to ``limit`` distinct values), mandatory (more) and counted (whether values had to be read).

    ``values``: the rows behind the profiles, of which those of columns near the
    limit are counted; partial aggregation leaves few of them to exchange.
    """
    keys = keys or REF
    known = profiles.select(*keys, F.hll_sketch_estimate("distinct_sketch").alias("n"))
    near = known.where((F.col("n") > 0) & (F.col("n") <= MARGIN * limit))
    rows = reduce(DataFrame.unionByName, [v.select(*keys, F.col(value).cast("string").alias("_value")) for v in values]).where("_value IS NOT NULL")
    exact = rows.join(near.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count_distinct("_value").alias("exact"))
    n = F.coalesce("exact", "n")
    return known.join(exact, keys, "left").select(*keys, (n.between(1, limit)).alias("indexed"), (n > limit).alias("mandatory"), F.col("exact").isNotNull().alias("counted"))
