"""Joins by time: as of a moment, and into intervals.

An as-of join finds for each row the last row of another table at or before it.
Both tables are put under one another and the last one seen is carried along, in
one pass over each key's rows in order. A key of very many rows is cut into
stretches of its order column by boundaries that are drawn from counted ranges,
so that no key is one task; what a stretch begins with is carried over from the
last filled stretch before it.

An interval join finds for each point the intervals that hold it. The order
column is cut into buckets of one width; an interval is put into every bucket
that it reaches, at most MOST_BUCKETS of them, wider ones at a coarser level of
buckets (each level FACTOR times as wide); a point looks into its bucket of
each level that occurs. Every pair is met in exactly one bucket, an equi-join
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.shared import stored

#: Buckets that an interval is written to at most, and how much wider a bucket of the next level is.
MOST_BUCKETS, FACTOR = 8, 8


def as_of(left: DataFrame, right: DataFrame, by: list[str], order: str, carry: list[str], tie: list[str], stretch: Column | None = None) -> DataFrame:
    """``left`` with ``carry`` (renamed ``asof_*``) of the last row of ``right`` with the same ``by`` and an ``order`` not after its own.

    ``tie``: columns of ``right`` that decide between rows of one time (the
    largest wins, nulls first, then a hash of what is carried). A row of
    ``right`` at the very time of one of ``left`` counts. Null keys match
    nothing, nor do rows without a time. ``stretch``: a monotone function of
    ``order`` (a day, say): rows of one key are then one task for each stretch,
    not one for each key.
    """
    cut = (F.lit(0) if stretch is None else stretch).cast("long")
    body = F.struct(*[F.col(c) for c in carry])
    usable = F.col(order).isNotNull()
    for c in by:
        usable = usable & F.col(c).isNotNull()
    ties = F.struct(*[F.col(c) for c in tie], F.xxhash64(F.to_json(body)).alias("_hash"))
    common = [*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(order).alias("_at"), cut.alias("_cut")]
    keys = [f"_k{i}" for i in range(len(by))]
    other = right.where(usable).select(*common, F.lit(0).alias("_side"), ties.alias("_tie"), body.alias("_body"))
    mine = left.where(usable).select(*common, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rows = mine.unionByName(other, allowMissingColumns=True)
    if stretch is None:
        rows = rows.withColumn("_carried", F.lit(None).cast(other.schema["_body"].dataType))
    else:  # what each stretch ends with, carried over the stretches after it: a row for each key and stretch, no more
        ends = rows.groupBy(*keys, "_cut").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_body")), F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "_cut", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        rows = rows.join(stored(carried, "carried"), [*keys, "_cut"])
    seen = Window.partitionBy(*keys, "_cut").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_found", F.coalesce(F.last("_body", ignorenulls=True).over(seen), F.col("_carried"))).where("_side = 1")
    names = [f"asof_{c}" for c in carry]
    out = found.select("_row.*", *[F.col(f"_found.{c}").alias(n) for c, n in zip(carry, names)])
    rest = left.where(~usable)
    return out.unionByName(rest.select("*", *[F.lit(None).cast(out.schema[n].dataType).alias(n) for n in names]))


def in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Every pair of a point and an interval with ``start`` <= ``at`` < ``stop`` (numbers) and equal ``by``: the columns of both.

    ``width``: of a bucket, best about that of a typical interval. Nulls, NaN
    and intervals that are empty or turned round match nothing. The intervals'
    columns must not have names of the points'.
    """
    by = by or []
    wide = intervals.where(F.col(start) < F.col(stop))
    span = (F.col(stop) - F.col(start)) / F.lit(width)
    level = F.greatest(F.lit(0), F.ceil(F.log(span / (MOST_BUCKETS - 1)) / F.log(F.lit(float(FACTOR))))).cast("int")
    size = lambda n: F.lit(width) * F.pow(F.lit(float(FACTOR)), n)
    place = lambda x, n: F.floor(x / size(n)).cast("long")
    placed = wide.withColumn("_level", level)
    last = place(F.col(stop), F.col("_level"))
    reached = F.sequence(place(F.col(start), F.col("_level")), last)
    placed = stored(placed.withColumn("_bucket", F.explode(reached)), "intervals")
    levels = [r._level for r in placed.select("_level").distinct().collect()]  # a handful: the logarithm of the widest
    if not levels:
        return points.join(placed.drop("_level", "_bucket"), F.lit(False))
    looks = points.where(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double")))
    looks = looks.withColumn("_look", F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), place(F.col(at), F.lit(n)).alias("_bucket")) for n in sorted(levels)])))
    looks = looks.select(*points.columns, "_look.*")
    met = looks.join(placed, [*by, "_level", "_bucket"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop))).drop("_level", "_bucket")


def count_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, width: float) -> DataFrame:
    """``intervals`` that hold any point, with ``n`` points and the ``largest`` of them.

    Equal points are counted first and equal intervals are met once, so what
    meets in a bucket does not grow with their repeats.
    """
    distinct = points.groupBy(at).agg(F.count("*").alias("_n"))
    spans = intervals.select(start, stop).distinct()
    met = in_intervals(distinct, spans, at, start, stop, width).groupBy(start, stop).agg(F.sum("_n").alias("n"), F.max(at).alias("largest"))
    return intervals.join(met, [start, stop])
