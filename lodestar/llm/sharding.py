"""Sharding by histogram sort: exact byte counts below candidate keys, refined until splitters fit.

The sort key of a row is (hash of the text, hash of the id, place). A round
counts, over all partitions, the exact bytes and rows in the cells of a grid
over the key range; a round refines only the cells that the end of a shard
falls into, for all ends at once, until every cell left is within the
tolerance (a share of a shard's bytes). The driver sees 4,096 counts for each
end of a shard, however many partitions or rows there are. Then rows are
exchanged once: a shard is dealt into fine buckets by a hash of the key, each
bucket is placed on a partition of its own, and rows are numbered by bucket
and, in it, in key order.

Equal texts are neighbours in this order. An end that can be moved to the
edge of their group within the tolerance leaves the group whole; a group that
is larger than that is split, since shards must come out near equal in bytes.
Only where an end falls among rows that repeat both text and id does their
place count; the rows are then written down once with it, so that no later
step can number them anew.

Defined cases: a null text has no bytes (size 1 for its row) and is grouped
with the empty text; null ids hash like any value; repeated rows can be split;
an empty table gives no rows; columns called size, shard or slot are replaced,
all others are kept, whatever their names. ``docs`` must give the same rows
each time it is read (files do, an unordered sample does not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, fresh, stored, text_or_empty

_BITS = 12  # bits of the key that a round refines: a grid of 4,096 cells
_ROUNDS = 6  # rounds that refine one of the three parts of a key


def _keyed(docs: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    first, second, _ = names
    return docs.withColumn(first, F.xxhash64(text)).withColumn(second, F.xxhash64(F.col(id_col).cast("string"))).withColumn("size", F.octet_length(text).cast("long") + 1)


def _shift(level: int) -> int:
    return max(0, 64 - _BITS * (level % _ROUNDS + 1))


def _digit(names: list[str], level: int) -> Column:
    """The digit of a key that a level refines; the sign bit is flipped, so digits keep the order of signed keys."""
    shift = _shift(level)
    width = _BITS if shift else 64 - _BITS * (_ROUNDS - 1)
    flipped = F.col(names[level // _ROUNDS]).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


Grid = dict[tuple[int, ...], list[tuple[int, int, int]]]


def _count(rows: DataFrame, names: list[str], cells: list[tuple[int, ...]]) -> Grid:
    """For each open cell, a key prefix: (digit, bytes, rows) of its sub-cells, exact and in order."""
    level = len(cells[0])
    if level:
        wanted = rows.sparkSession.createDataFrame([(list(c),) for c in cells], "prefix array<int>")
        rows = rows.withColumn("prefix", F.array(*[_digit(names, i) for i in range(level)])).join(F.broadcast(wanted), "prefix")  # a cell for each end at most
    else:
        rows = rows.withColumn("prefix", F.array().cast("array<int>"))
    counted = rows.groupBy("prefix", _digit(names, level).alias("digit")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    out: Grid = {}
    for r in counted.collect():  # 4,096 counts for each end of a shard at most
        out.setdefault(tuple(r.prefix), []).append((r.digit, r.b, r.n))
    return {k: sorted(v) for k, v in out.items()}


class _Splitters:
    """The ends of all shards but the last: key prefixes where the bytes below come nearest to equal parts."""

    def __init__(self, n_shards: int, tolerance: float):
        self.n_shards, self.tolerance, self.total = n_shards, tolerance, 0
        self.done: dict[int, tuple[int, ...]] = {}
        self.open: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(1, n_shards)))}

    def refine(self, rows: DataFrame, names: list[str], levels: int) -> None:
        """Rounds over ``rows`` until every end is settled or ``levels`` digits are used up."""
        while self.open and len(next(iter(self.open))) < levels:
            grids = _count(rows, names, list(self.open))
            if () in self.open:
                self.total = sum(b for _, b, _ in grids.get((), []))
            after: dict[tuple[int, ...], tuple[int, list[int]]] = {}
            for prefix, (below, wanted) in self.open.items():
                grid, i, b = grids.get(prefix, []), 0, below
                for end in wanted:
                    target = self.total * end / self.n_shards
                    while i < len(grid) and b + grid[i][1] <= target:
                        b, i = b + grid[i][1], i + 1
                    if i == len(grid):
                        self.done[end] = prefix + (grid[-1][0] + 1,) if grid else prefix
                        continue
                    digit, size, _ = grid[i]
                    low, high = target - b, b + size - target
                    if min(low, high) <= self.total / self.n_shards * self.tolerance or len(prefix) + 1 == 3 * _ROUNDS:
                        self.done[end] = prefix + (digit,) if low <= high else prefix + (digit + 1,)
                    else:
                        after.setdefault(prefix + (digit,), (b, []))[1].append(end)
            self.open = after

    def bounds(self) -> list[tuple[int, int, int]]:
        """The smallest key, as signed numbers, of each shard but the first."""
        out = []
        for end in range(1, self.n_shards):
            value = sum(d << (128 - 64 * (level // _ROUNDS) + _shift(level)) for level, d in enumerate(self.done[end]))
            value = min(value, (1 << 192) - 1)  # a last digit may run over
            out.append(tuple((value >> s & ((1 << 64) - 1)) - (1 << 63) for s in (128, 64, 0)))
        return out


def histogram_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, per_shard: int | None = None) -> DataFrame:
    """``docs`` with size, shard (0 to ``n_shards`` - 1) and slot (gapless from 0 in each shard).

    ``per_shard``: fine buckets of a shard, so many tasks share its rows.
    """
    spark = docs.sparkSession
    if per_shard is None:
        per_shard = max(2, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    docs = docs.drop("size", "shard", "slot")
    *names, digit, ahead, ends, bucket, first = fresh(docs, "text_key", "id_key", "place_key", "digit", "ahead", "ends", "bucket", "first")
    keyed, keys = _keyed(docs, names, id_col, text_col), names[:2]
    # the counts need keys and sizes alone: a narrow table instead of a text scan for each round
    narrow = stored(keyed.select(*keys, "size"), "keys")
    cuts = _Splitters(n_shards, tolerance)
    cuts.refine(narrow, names, 2 * _ROUNDS)
    if cuts.open:
        keys = names
        keyed = stored(keyed.withColumn(names[2], F.xxhash64(F.monotonically_increasing_id())), "placed")
        narrow = keyed.select(*keys, "size")
        cuts.refine(narrow, names, 3 * _ROUNDS)
    bounds = cuts.bounds() if cuts.total else []
    # the ends in the grid cell of a row's key are compared with it; those of the cells before are counted ahead
    by_digit: dict[int, list[tuple[int, int, int]]] = {}
    for b in bounds:
        by_digit.setdefault((b[0] + (1 << 63)) >> (64 - _BITS), []).append(b)
    cells, before = [], 0
    for d in range(1 << _BITS):
        cells.append((d, before, by_digit.get(d, [])))
        before += len(cells[-1][2])
    table = F.broadcast(spark.createDataFrame(cells, f"{digit} int, {ahead} int, {ends} array<struct<a: long, b: long, c: long>>"))  # 4,096 rows
    lowest = F.lit(-(1 << 63))
    me = F.struct(*[(F.col(k) if k in keys else lowest).alias(n) for k, n in zip(names, "abc")])

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(digit, _digit(names, 0)).join(table, digit)
        rows = rows.withColumn("shard", F.col(ahead) + F.size(F.filter(ends, lambda x: x <= me))).drop(digit, ahead, ends)
        return rows.withColumn(bucket, (F.col("shard") * per_shard + F.pmod(F.xxhash64(*keys), F.lit(per_shard))).cast("int"))

    counts = stored(dealt(narrow).groupBy("shard", bucket).count(), "buckets")
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select(bucket, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(first)), "offsets")
    order = Window.partitionBy(bucket).orderBy(*keys)
    placed = dealt(keyed).repartitionById(n_shards * per_shard, F.col(bucket)).withColumn("slot", F.row_number().over(order) - 1)
    placed = placed.join(bounded(offsets, n_shards * per_shard, 500_000), bucket)
    return placed.withColumn("slot", F.col("slot") + F.col(first)).drop(bucket, first, *names)
