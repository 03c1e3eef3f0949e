"""Places in a total order over a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import stored

_WITHIN = (1 << 33) - 1


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """``df``, written down, with its place (from 0) by ``order`` in the column ``rank``.

    One exchange by ranges, a sort inside each, and a count of each range on
    the driver, which are as many as there are partitions. Equal rows keep
    apart only as far as ``order`` tells them apart, so it should end in
    something that differs for them.
    """
    spark = df.sparkSession
    ordered = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(rank, F.monotonically_increasing_id()), name)
    sizes = ordered.groupBy(F.shiftright(rank, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    rows, before = [], 0
    for r in sizes:
        rows.append((r.part, before))
        before += r.n
    part, offset = "_part_of_" + rank, "_before_" + rank
    offsets = spark.createDataFrame(rows, f"{part} long, {offset} long")
    placed = ordered.withColumn(part, F.shiftright(rank, 33)).join(F.broadcast(offsets), part)
    return placed.withColumn(rank, F.col(rank).bitwiseAND(F.lit(_WITHIN)) + F.col(offset)).drop(part, offset)
