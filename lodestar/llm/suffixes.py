"""Removal of repeated passages: a logarithmic family of suffix arrays over the bytes of all texts.

A window is a run of ``length`` bytes. Each window has one anchor, the place
in it whose next ANCHOR bytes have the least hash (the leftmost of equals), so
equal windows have equal anchors, and a few places in a hundred are anchors.
Suffix arrays are sparse: they hold the suffixes that begin at anchors, each
under a key of its first three bytes and a hash of its first ANCHOR bytes, in
the order of keys, once for each block of texts.

:class:`SuffixLevels` takes the arrays of one batch after the other. A new
array is scanned together with the levels that exist, in step, for keys they
share: only where a key occurs twice can there be a match that is long enough.
Two levels that hold the same number of batches are merged into one before
the next batch comes, so there are only logarithmically many. Arrays are
bucketed by key and levels are joined bucket by bucket, without an exchange.

:func:`repeated_spans` then looks at the bytes behind shared keys. All windows
of one anchor form a stretch of text. A stretch that is the same, to 128 bits
of hash, as an earlier one repeats as a whole. Stretches that share a key but
differ (the ends of passages) are compared byte by byte: their windows are
sorted into a suffix array of their own, and every window but the first of
each run of equals is repeated. Keys with very many different stretches send
their windows, hashed, through an aggregation instead, so that no key meets in
one task.

Windows never cross texts. The first of equal windows is that with the
smallest id, then the smallest content key, then the earliest place; null ids
count as the largest. Copies of a text, repeated rows included, repeat it as a
whole from the second on. Null and empty texts and those shorter than a window
lose nothing. An empty table returns no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, content_key, forget, stored, text_or_empty
from lodestar.sources.shared import bucketed

LENGTH, ANCHOR = 100, 32
#: Bytes that are hashed at a time; a longer text is read in overlapping slices.
SLICE = 1 << 20
#: Texts of a block, the unit that is read together.
BLOCK_ROWS = 8192
#: Keys with more different stretches than this are compared by hashed windows.
CROWDED = 20_000
#: Windows that are sorted at a time; a key's windows stay together.
SORTED = 300_000
_PLACE_BITS = 21
_U = np.uint64


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd base and of its inverse."""
    table = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    powers = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        powers.append(np.cumprod(p))
    return table, powers[0], powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class Stretches:
    """The stretches of several texts (or slices of them) that lie side by side in ``data``.

    ``starts`` and ``ends`` (in ``data``) and ``keys`` have one entry for each
    stretch; a stretch's windows begin at ``starts`` to ``ends - length``.
    """

    def __init__(self, data: bytes, stops: list[int], length: int, limits: list[int] | None = None):
        self.bytes = np.frombuffer(data, np.uint8)
        self.length, n = length, len(data)
        table, powers, self._inverse = _powers(2 * SLICE)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.bytes] * powers[:n], out=self._sums[1:])
        places = np.arange(max(n - ANCHOR + 1, 0), dtype=np.uint64)
        hashes = self.hashes(places.astype(np.int64), places.astype(np.int64) + ANCHOR)
        # the least of a window's hashes, by doubling; the place is packed into the low bits
        low, reach = (hashes >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | places, 1
        width = length - ANCHOR + 1
        while 2 * reach <= width and len(low) > reach:
            low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
        if reach < width and len(low) > width - reach:
            low = np.minimum(low[: reach - width], low[width - reach :])
        whole = np.zeros(n + 1, bool)
        begin = 0
        for stop, limit in zip(stops, limits or stops):
            whole[begin : max(min(stop - length + 1, limit), begin)] = True
            begin = stop
        windows = np.flatnonzero(whole[: n + 1])
        if not len(windows):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.int64)
            return
        anchors = (low[windows] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        cuts = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(windows) != 1)) + 1
        self.starts = windows[np.r_[0, cuts]]
        self.ends = windows[np.r_[cuts - 1, len(windows) - 1]] + length
        at = anchors[np.r_[0, cuts]]
        head = (self.bytes[at].astype(np.uint64) << _U(16)) | (self.bytes[at + 1].astype(np.uint64) << _U(8)) | self.bytes[at + 2].astype(np.uint64)
        key = (head << _U(40)) | (_mixed(hashes[at] + _U(1)) >> _U(24))  # hashed anew: anchors have small hashes
        self.keys = (key ^ _U(1 << 63)).view(np.int64)  # signed numbers in the order of bytes

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[stops] - self._sums[starts]) * self._inverse[starts])

    def second(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64 more bits, with the length."""
        return _mixed(self.hashes(starts, stops) + (stops - starts).astype(np.uint64))


def slices(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[bytes, list[int], list[int], list[tuple[int, int]]]]:
    """Buffers of about SLICE bytes: data, where each part stops, where its windows stop beginning, and (number, place in its text) of each part."""
    data, stops, limits, parts = bytearray(), [], [], []
    for number, text in texts:
        for at in range(0, max(len(text) - length + 1, 0), SLICE):
            part = text[at : at + SLICE + length - 1]
            if data and len(data) + len(part) > 2 * SLICE:
                yield bytes(data), stops, limits, parts
                data, stops, limits, parts = bytearray(), [], [], []
            parts.append((number, at - len(data)))
            limits.append(len(data) + SLICE)
            data += part
            stops.append(len(data))
    if data:
        yield bytes(data), stops, limits, parts


def _texts(block: pa.Table, skipped: set[int]) -> Iterator[tuple[int, bytes]]:
    rows, texts = block.column("rid").to_pylist(), block.column("text")
    for n, rid in enumerate(rows):
        if rid not in skipped:
            yield n, texts[n].as_py()


def _skipped(other: pa.Table) -> set[int]:
    return {r for r in other.column("copy").to_pylist() if r is not None}


class SuffixLevels:
    """The family of sorted arrays (key, block, n); n is how often the key occurs in the block, 2 for more than once."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, array: DataFrame, name: str = "suffixes") -> DataFrame:
        """Take the array of a new batch; the keys that it repeats, of its own or of the levels'."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, later), (_, earlier) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, bucketed(earlier.unionByName(later), f"{name}-merged", self.buckets, "key")))
            forget(later)
            forget(earlier)
        new = bucketed(array, name, self.buckets, "key")
        found = new.groupBy("key").agg(F.sum("n").alias("n"))
        for i, (_, level) in enumerate(self.levels):
            known = level.groupBy("key").agg(F.lit(1).alias(f"in{i}"))
            found = found.join(known, "key", "left")
        old = [F.col(f"in{i}").isNotNull() for i in range(len(self.levels))]
        shared = F.col("n") > 1
        for o in old:
            shared = shared | o
        self.levels.append((1, new))
        return found.where(shared).select("key")

    def places(self, keys: DataFrame) -> DataFrame:
        """(key, block) wherever one of ``keys`` occurs in any level."""
        out = None
        for _, level in self.levels:
            hit = level.join(keys, "key", "left_semi").select("key", "block")
            out = hit if out is None else out.unionByName(hit)
        return out

    def forget(self) -> None:
        for _, level in self.levels:
            forget(level)
        self.levels = []


def _array(blocks, length: int) -> DataFrame:
    """(key, block, n) of the texts of ``blocks``, a pair of tables grouped by block."""

    def run(texts: pa.Table, copies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})
        found = [Stretches(data, stops, length, limits).keys for data, stops, limits, _ in slices(_texts(texts, _skipped(copies)), length)]
        keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        block = np.full(len(keys), texts.column("block")[0].as_py(), np.int64)
        return pa.table({"key": keys, "block": block, "n": np.minimum(counts, 2).astype(np.int32)})

    return blocks.applyInArrow(run, "key long, block long, n int")


def _stretches(blocks, length: int) -> DataFrame:
    """The stretches whose keys are wanted: key, h1, h2 (the bytes, and in the last eight bits the number of windows), ord, ck1, rid, start, stop.

    Only the first of equal stretches of a block has a key: the later ones
    repeat as a whole, and come as merged runs.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("key", "h1", "h2", "ord", "ck1", "rid", "start", "stop")])

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        keys = np.unique(np.array([k for k in wanted.column("key").to_pylist() if k is not None], np.int64))
        if not texts.num_rows or not len(keys):
            return schema.empty_table()
        about, found = [texts.column(c).to_numpy() for c in ("ord", "ck1", "rid")], []
        for data, stops, limits, parts in slices(_texts(texts, _skipped(wanted)), length):
            s = Stretches(data, stops, length, limits)
            at = np.searchsorted(keys, s.keys)
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == s.keys)
            starts, ends = s.starts[hit], s.ends[hit]
            part = np.searchsorted(np.array(stops), starts, side="right")
            number, shift = np.array([p[0] for p in parts], np.int64)[part], np.array([p[1] for p in parts], np.int64)[part]
            second = (s.second(starts, ends) << _U(8) | (ends - starts - length).astype(np.uint64)).view(np.int64)
            found.append(np.stack([s.keys[hit], s.hashes(starts, ends).view(np.int64), second, *[a[number] for a in about], starts + shift, ends + shift]))
        rows = np.concatenate(found, axis=1) if found else np.zeros((8, 0), np.int64)
        rows = rows[:, np.lexsort(rows[[6, 4, 3, 2, 1, 0]])]
        later = np.r_[False, (rows[:3, 1:] == rows[:3, :-1]).all(axis=0)][: rows.shape[1]]
        first, rest = rows[:, ~later], rows[:, later]
        rest = rest[:, np.lexsort(rest[[6, 5]])]
        cuts = np.r_[True, (rest[5, 1:] != rest[5, :-1]) | (rest[6, 1:] > rest[7, :-1])][: rest.shape[1]]
        at = np.flatnonzero(cuts)
        stop = rest[7, np.r_[at[1:] - 1, rest.shape[1] - 1]] if len(at) else at
        out = [pa.array(np.r_[first[k], np.zeros(len(at), np.int64)], mask=np.r_[np.zeros(first.shape[1], bool), np.ones(len(at), bool)]) for k in range(5)]
        out += [pa.array(np.r_[first[5], rest[5, at]]), pa.array(np.r_[first[6], rest[6, at]]), pa.array(np.r_[first[7], stop])]
        return pa.table(out, schema=schema)

    return blocks.applyInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def _bytes_of(blocks) -> DataFrame:
    """The wanted stretches (rid, start, stop and more) with their bytes."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        if texts.num_rows and wanted.num_rows:
            row = {r: n for n, r in enumerate(texts.column("rid").to_pylist())}
            column, held, last = texts.column("text"), [], (None, b"")
            for rid, start, stop in sorted(zip(*[wanted.column(c).to_pylist() for c in ("rid", "start", "stop")])):
                if last[0] != rid:
                    last = (rid, column[row[rid]].as_py())
                held.append(last[1][start:stop])
            wanted = wanted.sort_by([("rid", "ascending"), ("start", "ascending"), ("stop", "ascending")]).append_column("bytes", pa.array(held, pa.binary()))
        else:
            wanted = wanted.slice(0, 0).append_column("bytes", pa.array([], pa.binary()))
        return wanted.select(["key", "ord", "ck1", "rid", "start", "bytes", "crowded"])

    return blocks.applyInArrow(run, "key long, ord long, ck1 long, rid long, start long, bytes binary, crowded boolean")


def _later_windows(length: int):
    """A function of batches, sorted by key: the windows that equal an earlier one of their key, as (rid, start, stop) of merged runs."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (r[0], r[1], r[3]))  # in the order of places
        data = b"".join(r[4] for r in rows)
        sizes = np.array([len(r[4]) for r in rows], np.int64)
        begin = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)[begin[row] + within]
        windows = np.ascontiguousarray(windows).view(f"V{length}").ravel()
        suffixes = np.argsort(windows, kind="stable")  # equal windows stay in the order of places
        ordered = windows[suffixes]
        later = suffixes[1:][ordered[1:] == ordered[:-1]]
        later.sort()
        rid, first = np.array([r[2] for r in rows], np.int64)[row[later]], np.array([r[3] for r in rows], np.int64)[row[later]] + within[later]
        cuts = np.flatnonzero((np.diff(row[later]) != 0) | (np.diff(first) != 1)) + 1
        at, to = (np.r_[0, cuts], np.r_[cuts - 1, len(first) - 1]) if len(first) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(first[at]), pa.array(first[to] + length)], names=["rid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, windows, key = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "ord", "ck1", "rid", "start", "bytes")]
            for k, *rest in zip(*columns):
                if k != key and windows >= SORTED:
                    yield found(rows)
                    rows, windows = [], 0
                key = k
                rows.append(tuple(rest))
                windows += len(rest[-1]) - length + 1
        if rows:
            yield found(rows)

    return run


def _crowded_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many stretches: hashed windows, the first of each by an aggregation, joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            about = [batch.column(c).to_pylist() for c in ("ord", "ck1", "rid", "start", "bytes")]
            for o, c, r, start, data in zip(*about):
                s = Stretches(data, [len(data)], length)
                at = np.arange(len(data) - length + 1)
                w1, w2 = s.hashes(at, at + length).view(np.int64), s.second(at, at + length).view(np.int64)
                same = [np.full(len(at), x, np.int64) for x in (o, c, r)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, *same, at + start)], names=["w1", "w2", "ord", "ck1", "rid", "start"])

    windows = stored(rows.mapInArrow(run, "w1 long, w2 long, ord long, ck1 long, rid long, start long"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("ord", "ck1", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["w1", "w2"]).where(F.struct("ord", "ck1", "start") > F.col("first"))
    return later.select("rid", "start", (F.col("start") + length).alias("stop"))


def _cut(blocks) -> DataFrame:
    """The rows of each block with their spans merged and cut out."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        copies, spans = set(), {}
        for rid, start, stop in zip(*[marks.column(c).to_pylist() for c in ("rid", "start", "stop")]):
            if stop is None:
                copies.add(rid)
            else:
                spans.setdefault(rid, []).append((start, stop))
        out, column, least = [], texts.column("text"), int(marks.column("length")[0].as_py()) if marks.num_rows else 0
        for n, (rid, doc_id) in enumerate(zip(texts.column("rid").to_pylist(), texts.column("doc_id").to_pylist())):
            text = column[n].as_py()
            merged: list[list[int]] = []
            if rid in copies:
                merged = [[0, len(text)]] if len(text) >= least else []
            for start, stop in sorted(spans.get(rid, [])):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            kept, at = [], 0
            for start, stop in merged:
                kept.append(text[at:start])
                at = stop
            kept.append(text[at:])
            out.append({"doc_id": doc_id, "n_bytes": len(text), "spans": [{"start": a, "stop": b} for a, b in merged], "kept": b"".join(kept)})
        return pa.Table.from_pylist(out, schema=schema)

    return blocks.applyInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, batches: int = 4, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal, in bytes) and ``kept`` (the other bytes) of every row of ``docs``.

    ``batches`` of about equally many ids come one after the other.
    """
    if not ANCHOR <= length < ANCHOR + 255:
        raise ValueError(f"length must be {ANCHOR} at least and less than {ANCHOR + 255}")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty("text")
    ck1, ck2 = content_key(text)
    last = F.lit((1 << 63) - 1)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), ck1, ck2, F.coalesce(F.col("doc_id").cast("long"), last).alias("ord"))
    keyed = keyed.withColumn("rid", F.monotonically_increasing_id())
    blocked = bucketed(keyed.withColumn("block", F.floor(F.col("rid") / BLOCK_ROWS).cast("long")), "texts", buckets, "block")
    by_block = blocked.groupBy("block")

    # copies: all rows of a text but the first
    several = blocked.groupBy("ck1", "ck2").agg(F.count("*").alias("n"), F.min(F.struct("ord", "rid")).alias("first")).where("n > 1")
    several = stored(several.select("ck1", "ck2", F.col("first.rid").alias("kept")), "several")
    copies = blocked.select("ck1", "ck2", "rid", "block").join(bounded(several), ["ck1", "ck2"]).where("rid <> kept")
    copies = stored(copies.select("block", F.col("rid").alias("copy")), "copies")

    # the arrays of one batch after the other
    shares = [n / batches for n in range(1, batches)]
    cuts = (blocked.select(F.percentile_approx("ord", shares, F.lit(1000)).alias("cuts")).first().cuts or []) if shares else []
    bounds = [None, *sorted(set(cuts)), None]
    family, shared = SuffixLevels(buckets), []
    for low, high in zip(bounds, bounds[1:]):
        inside = (F.lit(True) if low is None else F.col("ord") > low) & (F.lit(True) if high is None else F.col("ord") <= high)
        batch = blocked.where(inside).select("block", "rid", "text").groupBy("block").cogroup(copies.groupBy("block"))
        shared.append(stored(family.add(_array(batch, length)), "shared-keys"))
    keys = shared[0]
    for more in shared[1:]:
        keys = keys.unionByName(more)
    wanted = family.places(keys.distinct())

    # the stretches behind shared keys
    sides = wanted.select("block", "key", F.lit(None).cast("long").alias("copy")).unionByName(copies.select("block", F.lit(None).cast("long").alias("key"), "copy"))
    stretches = stored(_stretches(by_block.cogroup(sides.groupBy("block")), length), "stretches")
    for df in shared:
        forget(df)
    family.forget()
    kinds = stretches.where("key IS NOT NULL")
    classes = kinds.groupBy("key", "h1", "h2").agg(F.min(F.struct("ord", "ck1", "start", "rid")).alias("first"), F.count("*").alias("n"))
    classes = stored(classes, "classes")
    # a stretch that equals an earlier one repeats as a whole
    repeated = classes.where("n > 1").select("key", "h1", "h2", F.col("first.rid").alias("r"), F.col("first.start").alias("s"))
    whole = kinds.join(repeated, ["key", "h1", "h2"]).where("rid <> r OR start <> s").select("rid", "start", "stop")
    whole = whole.unionByName(stretches.where("key IS NULL").select("rid", "start", "stop"))
    # the first of each kind is compared with the others of its key
    many = classes.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    stop = F.col("first.start") + length + F.col("h2").bitwiseAND(255)
    unlike = classes.join(many, "key").select("key", "first.*", stop.alias("stop"), (F.col("kinds") > crowded).alias("crowded")).withColumn("block", F.floor(F.col("rid") / BLOCK_ROWS).cast("long"))
    unlike = stored(_bytes_of(by_block.cogroup(unlike.groupBy("block"))), "unlike")
    near = unlike.where("NOT crowded").drop("crowded").repartition("key").sortWithinPartitions("key").mapInArrow(_later_windows(length), "rid long, start long, stop long")
    far = _crowded_windows(unlike.where("crowded"), length) if not unlike.where("crowded").isEmpty() else None
    spans = whole.unionByName(near) if far is None else whole.unionByName(near).unionByName(far)
    spans = spans.withColumn("block", F.floor(F.col("rid") / BLOCK_ROWS).cast("long"))
    marks = spans.unionByName(copies.select(F.col("copy").alias("rid"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), "block"))
    marks = marks.withColumn("length", F.lit(length))
    return _cut(by_block.cogroup(marks.groupBy("block")))
