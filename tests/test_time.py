"""As-of joins, interval joins, sessions and frames against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators.intervals import as_of, in_intervals
from lodestar.operators.sessions import sessions, trailing_sum


def events(seed, n=400):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    return [(i, key(), rng.choice([None, *range(0, 300)]) if rng.random() < 0.1 else rng.randint(0, 300), rng.random()) for i in range(n)]


LEFT = "id long, k string, t long, x double"


@pytest.mark.parametrize("stretch", [None, 25, 1])
def test_as_of(spark, stretch):
    left, right = events(1), events(2, 300)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, LEFT)
    cut = None if stretch is None else F.floor(F.col("t") / stretch)
    got = {r.id: (r.asof_id, r.asof_x) for r in as_of(a, b, ["k"], "t", ["id", "x"], ["id"], cut).collect()}
    want = {}
    for i, k, t, _ in left:
        known = [(t2, j, x) for j, k2, t2, x in right if k is not None and k == k2 and t is not None and t2 is not None and t2 <= t]
        want[i] = max(known)[1:] if known else (None, None)
    assert got == want and len(got) == len(left) and any(v[0] is None for v in want.values())
    assert as_of(a, b.where("false"), ["k"], "t", ["id"], ["id"], cut).where("asof_id IS NOT NULL").count() == 0
    assert as_of(a.where("false"), b, ["k"], "t", ["id"], ["id"], cut).count() == 0


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_intervals_of_all_widths(spark, width):
    rng = random.Random(3)
    bands = [(i, s, s + rng.choice([0.0, 0.1, 3.0, 40.0, 2000.0, -5.0])) for i in range(80) for s in [rng.uniform(-100, 100)]] + [(900, None, 5.0), (901, -1e4, 1e4), (902, 2.0, 2.0), (903, float("nan"), 1.0)]
    points = [(i, rng.choice([rng.uniform(-150, 150), bands[i % 80][1], bands[i % 80][2]])) for i in range(300)] + [(800, None), (801, float("nan"))]
    b = spark.createDataFrame(bands, "band long, low double, high double")
    p = spark.createDataFrame(points, "id long, at double")
    got = sorted((r.id, r.band) for r in in_intervals(p, b, "at", "low", "high", width).collect())
    want = sorted((i, n) for i, x in points for n, s, e in bands if x is not None and s is not None and s <= x < e)
    assert got == want and len(want) > 500
    assert in_intervals(p, b.where("false"), "at", "low", "high", width).count() == 0


def test_sessions_and_frames(spark):
    rows = events(4)
    df = spark.createDataFrame(rows, LEFT).withColumn("_k0", F.lit("mine")).withColumn("_cut", F.lit(1))
    for stretch in (7, 10_000):
        found = sessions(df, ["k"], F.col("t"), "id", 3, stretch)
        assert found.columns == [*df.columns, "session", "session_start"]
        got = {r.id: (r.session, r.session_start) for r in found.collect()}
        want = {i: (None, None) for i, _, t, _ in rows if t is None}
        for key in {r[1] for r in rows}:
            n, last = 0, None
            for t, i in sorted((t, i) for i, k, t, _ in rows if k == key and t is not None):
                opens = last is None or t - last > 3
                n, last = n + opens, t
                want[i] = (n, opens)
        assert got == want
    got = {r.id: r.recent for r in trailing_sum(df, ["k"], F.col("t"), "x", 20, "recent").collect()}
    for i, k, t, _ in rows:
        want = None if t is None else sum(x for _, k2, t2, x in rows if k2 == k and t2 is not None and t - 20 <= t2 <= t)
        assert got[i] == want or abs(got[i] - want) < 1e-9
    assert sessions(df.where("false"), ["k"], F.col("t"), "id", 3, 7).count() == 0


def test_a_key_of_a_long_history_is_many_tasks(spark):
    """Windows are dealt by key and stretch: of one key's rows no partition holds most."""
    one = spark.range(4000).select(F.col("id"), F.when(F.col("id") >= 0, "hot").alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    plan = trailing_sum(one, ["k"], F.col("t"), "x", 50, "recent")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k0" in plan and "_cut" in plan.split("hashpartitioning(", 1)[1][:60]
    assert trailing_sum(one, ["k"], F.col("t"), "x", 50, "recent").agg(F.max("recent")).first()[0] == 51
