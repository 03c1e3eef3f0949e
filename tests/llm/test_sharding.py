import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import sharding
from lodestar.llm.queries import op3_histogram_shards
from lodestar.llm.sharding import histogram_shards


def shards(df):
    rows = df.collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows, sizes


def test_near_equal_bytes_and_whole_groups(spark):
    pick = random.Random(5)
    rows = [(i, "x" * pick.randint(0, 900) + str(i // 3)) for i in range(6000)]
    got, sizes = shards(histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8))
    mean = sum(sizes.values()) / 8
    assert len(got) == 6000 and sorted(sizes) == list(range(8)) and all(abs(s - mean) < 0.02 * mean for s in sizes.values())


def test_one_text_or_one_row_in_all_rows(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("copy " * 20).alias("text"))
    for df in (same, same.withColumn("doc_id", F.lit(1).cast("long"))):
        _, sizes = shards(histogram_shards(df, 8))
        mean = sum(sizes.values()) / 8
        assert all(abs(s - mean) < 0.05 * mean for s in sizes.values())


def test_edges(docs, no_docs):
    out = histogram_shards(docs, 8)
    rows, _ = shards(out)
    assert len(rows) == docs.count() and all(0 <= r.shard < 8 and r.size == len((r.text or "").encode()) + 1 for r in rows)
    assert {"digit", "range", "first", "prefix", "k1"} <= set(out.columns) and all(r.digit == 7 for r in rows)
    assert histogram_shards(no_docs, 8).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["_text_key", "_range", "_k1", "_k2", "__bucket", "_digit", "_ends", "_first", "_ahead", "size", "shard"]
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), *[F.lit(f"own {n}").alias(n) for n in names])
    out = histogram_shards(docs, 3)
    assert sorted(out.columns) == sorted({*docs.columns, "size", "shard", "slot"})
    assert all(r[n] == f"own {n}" for r in out.collect() for n in names[:-2])


def test_driver_counts_do_not_follow_the_number_of_buckets(spark, monkeypatch):
    rows, seen = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text")), []
    count = sharding._count
    monkeypatch.setattr(sharding, "_count", lambda *a: seen.append(sum(map(len, (g := count(*a)).values()))) or g)
    _, sizes = shards(histogram_shards(rows, 4, per_shard=400))
    assert max(seen) <= 3 * 4096 and max(sizes.values()) < 1.02 * min(sizes.values())


@pytest.mark.parametrize("copies", [0, 3000])
def test_query_against_brute_force(spark, tmp_path, copies):
    pick = random.Random(1)
    rows = [(i, pick.choice((None, "", "copy", "\u00e9" * pick.randint(1, 50), f"text {i} " * pick.randint(1, 30)))) for i in range(2000)] + [(9000 + i, "hot text " * 9) for i in range(copies)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_histogram_shards(spark, str(tmp_path)).collect()
    raw = {i: (t or "").encode() for i, t in rows}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(b) + 1, zlib.crc32(b)) for i, b in raw.items())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    total, sizes, homes = sum(len(b) + 1 for b in raw.values()), [0] * 8, {}
    for r in got:
        sizes[r.shard] += r.size
        homes.setdefault(raw[r.doc_id], set()).add(r.shard)
    assert all(abs(s - total / 8) <= 0.02 * total / 8 for s in sizes)
    for n in range(8):
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got)))
    # only a text that an end of a shard falls into is in two shards, and only a hot one in more
    split = [t for t, h in homes.items() if len(h) > 1]
    assert len(split) <= 7 and all(len(homes[t]) <= 2 + len(t) * sum(b == t for b in raw.values()) * 8 // total for t in split)
