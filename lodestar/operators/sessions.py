"""Sessions and frames over long histories: gaps and islands, with a carry-over between stretches.

A user's events fall into sessions, parted by gaps of more than some time. One
user may have very many events, so the rows of a key are cut into stretches of
time (days, say), each of which is a task of its own; what passes from one
stretch to the next is one row for each key and stretch: where it begins and
ends, and how many sessions it opens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.shared import stored


def sessions(events: DataFrame, by: list[str], at: Column, tie: str, gap: int, stretch: int, name: str = "session") -> DataFrame:
    """``events`` with ``name`` (from 1 for each key, in order) and ``name``_start (true for a session's first event).

    ``at``: the time as a whole number, in whose unit ``gap`` and ``stretch``
    are given; a session ends where the next event comes more than ``gap``
    later. ``tie`` orders events of one time. ``stretch``: what one task of a
    key holds. Events without a time have no session (null); a null key is a
    key.
    """
    cut = F.floor(F.col("_at") / stretch).cast("long")
    timed = stored(events.withColumn("_at", at.cast("long")).withColumn("_cut", cut), "timed-events")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    rows = timed.where("_at IS NOT NULL").select(*keys, "_cut", "_at", F.struct(*events.columns).alias("_row"), F.col(tie).alias("_tie"))
    inside = Window.partitionBy(*names, "_cut").orderBy("_at", "_tie")
    opened = rows.withColumn("_before", F.lag("_at").over(inside))
    # within a stretch, all but its first event know what came before
    opened = stored(opened.withColumn("_opens", F.when(F.col("_before").isNull(), F.lit(0)).otherwise((F.col("_at") - F.col("_before") > gap).cast("int"))), "opened")
    each = opened.groupBy(*names, "_cut").agg(F.min("_at").alias("_begin"), F.max("_at").alias("_end"), F.sum("_opens").alias("_inner"))
    along = Window.partitionBy(*names).orderBy("_cut")
    previous = F.lag("_end").over(along)
    first = F.when(previous.isNull() | (F.col("_begin") - previous > gap), 1).otherwise(0)
    each = each.withColumn("_first", first)
    done = F.coalesce(F.sum(F.col("_first") + F.col("_inner")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_done", done + F.col("_first")).select(*[F.col(n).alias(f"{n}_") for n in names], F.col("_cut").alias("_cut_"), "_first", "_done")
    same = F.col("_cut") == F.col("_cut_")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    joined = opened.join(each, same)
    running = F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.when(F.col("_before").isNull(), F.col("_first") == 1).otherwise(F.col("_opens") == 1)
    found = joined.select("_row.*", (F.col("_done") + running).cast("long").alias(name), starts.alias(f"{name}_start"))
    untimed = timed.where("_at IS NULL").select(*events.columns, F.lit(None).cast("long").alias(name), F.lit(None).cast("boolean").alias(f"{name}_start"))
    return found.unionByName(untimed)


def trailing_sum(events: DataFrame, by: list[str], at: Column, value: str, span: int, name: str) -> DataFrame:
    """``events`` with ``name``: the sum of ``value`` over the key's events of the last ``span`` (in the unit of ``at``), its own time included.

    Rows are cut into stretches of ``span``, and each is also given to
    the stretch after it, which is all that a frame of ``span`` can reach; so
    a key's history is many tasks, and every row is read twice at most.
    Events without a time get null.
    """
    cut = F.floor(F.col("_at") / span).cast("long")
    timed = events.withColumn("_at", at.cast("long"))
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    rows = timed.where("_at IS NOT NULL").select(*keys, "_at", F.col(value).alias("_value"), F.struct(*events.columns).alias("_row"), F.explode(F.array(F.struct(cut.alias("_cut"), F.lit(True).alias("_own")), F.struct((cut + 1).alias("_cut"), F.lit(False).alias("_own")))).alias("_c"))
    rows = rows.select(*names, "_at", "_value", F.when(F.col("_c._own"), F.col("_row")).alias("_row"), "_c._cut", "_c._own")
    frame = Window.partitionBy(*names, "_cut").orderBy("_at").rangeBetween(-span, 0)
    found = rows.withColumn("_sum", F.sum("_value").over(frame)).where("_own").select("_row.*", F.col("_sum").alias(name))
    untimed = timed.where("_at IS NULL").select(*events.columns)
    return found.unionByName(untimed.withColumn(name, F.lit(None).cast(found.schema[name].dataType)))
