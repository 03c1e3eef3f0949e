"""Profiles: merged states against whole ones, error bounds, the policy against exact counts."""

from pyspark.sql import functions as F

from lodestar.operators import profile as P


def values(spark, *columns):
    """(table, column, value): a column of n distinct values, each some times, for each n."""
    rows = None
    for n, times in columns:
        one = spark.range(n * times).select(F.lit("t").alias("table_name"), F.lit(f"c{n}").alias("column_name"), F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias("raw_value"), (F.col("id") % 3).alias("load"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def test_merged_profiles_are_those_of_all_rows_within_the_bounds(spark):
    rows = values(spark, (1, 5), (25, 40), (1000, 3), (200_000, 1))
    parts = None
    for n in range(3):
        part = P.profile(rows.where(F.col("load") == n))
        parts = part if parts is None else parts.unionByName(part)
    got = {r.column_name: r for r in P.estimates(P.merged(parts)).collect()}
    for n, times in ((1, 5), (25, 40), (1000, 3), (200_000, 1)):
        r = got[f"c{n}"]
        assert r.n == n * times and r.n_null == 0
        assert abs(r.n_distinct - n) <= (0 if n <= 25 else 5 * 0.016 * n)
    assert got["c25"].length_50 in (2, 3) and got["c200000"].length_95 == 7


def test_policy_is_exact_around_the_limit(spark):
    counts = (1, 24, 25, 26, 27, 40, 50, 51, 60, 5000)
    rows = values(spark, *[(n, 30) for n in counts])
    nothing = spark.createDataFrame([("t", "none", None, 0)] * 3, "table_name string, column_name string, raw_value string, load long")
    rows = rows.unionByName(nothing)
    found = {r.column_name: r for r in P.policy(P.profile(rows), [rows.where("load < 2"), rows.where("load = 2")], 25).collect()}
    for n in counts:
        r = found[f"c{n}"]
        assert (r.indexed, r.mandatory) == (n <= 25, n > 25)
    assert found["c26"].counted and not found["c5000"].counted and not found["c60"].counted
    assert (found["none"].indexed, found["none"].mandatory) == (False, False)
    assert P.policy(P.profile(rows.where("false")), [rows.where("false")], 25).count() == 0
