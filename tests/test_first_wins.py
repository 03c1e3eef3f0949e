"""First-wins de-duplication over micro-batches: order, late rows, restarts, odd rows."""

import json

from pyspark.sql import functions as F

from lodestar.streaming.first_wins import first_wins, start

SCHEMA = "table_name string, column_name string, ts timestamp, pos long, description string"


def put(spark, folder, *rows):
    df = spark.createDataFrame([(t, c, None if s is None else float(s), p, d) for t, c, s, p, d in rows], "table_name string, column_name string, s double, pos long, description string")
    df = df.select("table_name", "column_name", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "pos", "description")
    df.coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, forget_after_ms=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = first_wins(stream, ["table_name", "column_name"], "ts", F.col("pos"), "10 seconds", forget_after_ms)
    start(spark, found, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r.kind, str(r.table_name), json.loads(r.body)["description"]) for r in rows)


def test_catalog_records_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    put(spark, str(tmp_path / "in"), ("t", "c", 100, 2, "second"), ("t", "c", 99.5, 3, "earliest"), ("u", "c", 100, 1, "tie b"), ("u", "c", 100, 0, "tie a"), (None, "c", 101, 0, "no table"))
    put(spark, str(tmp_path / "in"), ("t", "c", 95, 9, "out of order, yet in time"), ("v", "c", 120, 1, "later"), ("w", "c", None, 1, "no time"))
    first = run(spark, tmp_path)
    assert ("first", "t", "out of order, yet in time") in first and ("first", "u", "tie a") in first and ("first", "None", "no table") in first
    assert ("late", "w", "no time") in first and len(first) == 4  # v waits
    # a new run goes on from the checkpoint: done keys stay done, rows behind the watermark are set aside
    put(spark, str(tmp_path / "in"), ("t", "c", 119, 1, "duplicate"), ("u", "c", 20, 1, "late one"), ("v", "c", 115, 1, "earlier"), ("x", "c", 50, 1, "late, never seen"))
    put(spark, str(tmp_path / "in"), ("end", "c", 1000, 1, "end"))
    second = run(spark, tmp_path)
    assert set(second) - set(first) == {("first", "v", "earlier"), ("late", "u", "late one"), ("late", "x", "late, never seen")} and len(second) == len(first) + 3
    assert run(spark, tmp_path) == second


def test_marks_are_forgotten_after_a_time(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    put(spark, str(tmp_path / "in"), ("t", "c", 100, 1, "one"))
    put(spark, str(tmp_path / "in"), ("end", "c", 200, 1, "end"))
    for time in (210, 220):  # a batch's timers see the watermark that the batch before it left
        put(spark, str(tmp_path / "in"), ("end", "c", time, 1, "end"))
    put(spark, str(tmp_path / "in"), ("t", "c", 300, 1, "anew"), ("end", "c", 500, 1, "end"))
    put(spark, str(tmp_path / "in"), ("end", "c", 900, 1, "end"))
    found = run(spark, tmp_path, forget_after_ms=50_000)
    assert [d for k, t, d in found if t == "t"] == ["anew", "one"]


def test_state_is_held_by_buckets_of_keys(spark, tmp_path, monkeypatch):
    from lodestar.streaming import first_wins as module

    monkeypatch.setattr(module, "BUCKETS", 4, raising=False)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    big = 2**53
    at = lambda s: F.timestamp_micros((F.lit(1_000_000) * s).cast("long"))
    n = F.col("id")
    keys = [F.when(n % 50 != 7, n % 50 + big).alias("a"), F.when(n < 100, -0.0).otherwise(0.0).alias("b"), at(n % 50 + 1 / 8).alias("c"), F.encode((n % 50).cast("string"), "utf-8").alias("d"), F.concat(F.lit('"\\,é'), (n % 50).cast("string")).alias("e")]
    spark.range(200).select(*keys, at(F.lit(1000) - n).alias("ts"), n.alias("pos")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    found = first_wins(stream, list("abcde"), "ts", F.col("pos"), "1 seconds")
    query = start(spark, found, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.a, r.b, r.d, r.e, r.us): r.tie for r in rows.select("*", F.unix_micros("c").alias("us")).collect()}
    assert got == {(None if k == 7 else k + big, 0.0, str(k).encode(), f'"\\,é{k}', k * 1_000_000 + 125_000): k + 150 for k in range(50)}
