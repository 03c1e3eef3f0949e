"""Importance resampling towards a target distribution, over hashed n-grams.

Inside each task, texts become runs of word ids; a suffix array of these ids
(ordered up to the longest n-gram) brings equal n-grams together, the longest
common prefixes of neighbours cut it into one run for each distinct n-gram,
each run is hashed once and its bucket is scattered back to all the run's
occurrences. What leaves the task is two bytes for each feature. Buckets are
counted over all documents and all of the target, and a document's weight is
the sum of its features' gains. The draw is by Gumbel noise that depends on
the id alone.

Null and empty texts have no features and weigh 0. A null id's noise is that
of an empty id; ties in score go to the smaller id, nulls last, then to the
smaller digest of the text; repeated rows are drawn each. An empty table draws
nothing; with an empty target all target counts are 0. Other columns of the
tables are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.llm.common import stored, text_or_empty
from lodestar.llm.ranks import ranked

BUCKETS = 10_000
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Texts are cut into words this many bytes at a time, and suffix arrays hold about so many words.
PIECE, SLICE = 1 << 20, 1 << 20
#: A task forgets its words beyond so many, to bound its memory; ids only have to be the same within one suffix array.
VOCABULARY = 500_000


class _Words(dict):
    """Ids of words in the order in which they are first met."""

    def __init__(self):
        super().__init__()
        self.named: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.named)
        self.named.append(word)
        return out


def word_ids(text: str | None, ids: _Words) -> np.ndarray:
    """The words of a text, A-Z alone lower-cased, as ids; long texts are read piece by piece."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z have a lower case
    parts, at = [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            # a piece ends after its last separator; one without a separator is part of a word and grows
            while (cut := max((raw.rfind(s, at, end) for s in (b" ", b"\n", b".", b",")), default=-1)) < 0 and end < len(raw):
                end = min(2 * end - at, len(raw))
            end = cut + 1 if cut >= 0 else end
        found = WORDS.findall(raw, at, end)
        parts.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def run_buckets(words: np.ndarray, ends: np.ndarray, named: list[bytes], most: int, buckets: int) -> list[np.ndarray]:
    """For n = 1 to ``most``: the bucket of the n-gram that begins at each word, -1 where it would leave its text.

    ``words``: the ids of several texts in a row; ``ends``: for each word, where its text ends.
    """
    size = len(words)
    place = np.arange(size)
    # column k holds the word k places on, -1 beyond the text
    ahead = [np.where(place + k < ends, words[np.minimum(place + k, size - 1)], -1) for k in range(most)]
    suffixes = np.lexsort(ahead[::-1]) if most > 1 else np.argsort(words, kind="stable")
    common = np.zeros(size, np.int64)  # longest common prefix with the suffix before, up to ``most``
    same = np.ones(max(size - 1, 0), bool)
    for column in ahead:
        ordered = column[suffixes]
        same &= (ordered[1:] == ordered[:-1]) & (ordered[1:] >= 0)
        common[1:] += same
    out = []
    for n in range(1, most + 1):
        within = (suffixes + n <= ends[suffixes]) if size else np.zeros(0, bool)
        begins = (common < n) & within
        first = suffixes[begins]
        hashed = np.fromiter((zlib.crc32(b" ".join([named[w] for w in words[i : i + n]])) % buckets for i in first), np.int64, len(first))
        bucket = np.full(size, -1, np.int64)
        bucket[suffixes[within]] = hashed[np.cumsum(begins)[within] - 1]
        out.append(bucket)
    return out


def features(docs: DataFrame, keys: list[str], most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``keys``, n_words, n_features and ``buckets``: two bytes for the bucket of each n-gram of 1 to ``most`` words, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Words()

        def flush(rows: list[list], texts: list[np.ndarray]) -> pa.RecordBatch:
            words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            stops = np.cumsum(sizes)
            found = run_buckets(words, np.repeat(stops, sizes), ids.named, most, buckets)
            held = []
            for stop, n in zip(stops, sizes):
                each = np.concatenate([f[stop - n : stop] for f in found])
                held.append(each[each >= 0].astype("<u2"))
            columns = [list(c) for c in zip(*rows)]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays += [pa.array(sizes), pa.array([len(h) for h in held], pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n_words", "n_features", "buckets"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            held = [batch.column(k).to_pylist() for k in keys]
            rows, texts, size = [], [], 0
            for n, text in enumerate(batch.column("text")):
                rows.append([h[n] for h in held])
                texts.append(word_ids(text.as_py(), ids))
                size += len(texts[-1])
                if size >= SLICE:
                    yield flush(rows, texts)
                    rows, texts, size = [], [], 0
            if rows:
                yield flush(rows, texts)
            if len(ids.named) > VOCABULARY:
                ids = _Words()

    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit two bytes")
    wanted = docs.select(*keys, "text")
    schema = StructType([f for f in wanted.schema if f.name in keys])
    return wanted.mapInArrow(run, schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary"))


def bucket_counts(found: DataFrame, count: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ``count``) over all rows of ``found``: no more rows leave a task than there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_py(), "<u2"), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(count))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = 1000) -> DataFrame:
    """(bucket, gain) of every bucket: the smoothed log ratio of its share in the target to its share in the source, times ``scale``, rounded down."""
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(source, "bucket", "left").join(target, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float((total.S or 0) + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float((total.T or 0) + buckets)))
    return both.select("bucket", F.floor(scale * F.log(ratio)).alias("gain"))


def weights(found: DataFrame, gain: dict[int, int], buckets: int = BUCKETS) -> DataFrame:
    """``found`` with the sum of the gains of its features instead of ``buckets``. ``gain`` holds a number for each bucket."""
    table = np.zeros(buckets, np.int64)
    for b, g in gain.items():
        table[b] = g
    others = [c for c in found.columns if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(table[np.frombuffer(b.as_py(), "<u2")].sum()) for b in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(weight, pa.int64())], names=[*others, "weight"])

    return found.mapInArrow(run, StructType([f for f in found.schema if f.name in others]).add("weight", "long"))


def noise(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """Standard Gumbel noise times ``scale``, rounded down, from the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, most: int = 1, buckets: int = BUCKETS, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null: not drawn) of every row of ``docs``.

    ``percent`` of the documents with at least ``least_words`` words are drawn, those with the highest scores.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(text_or_empty("text")).alias("tie"))
    found = stored(features(keyed, ["doc_id", "tie"], most, buckets), "features")
    wanted = stored(features(target.select("text"), [], most, buckets), "target-features")
    gain = {r.bucket: r.gain for r in gains(bucket_counts(found, "s", buckets), bucket_counts(wanted, "t", buckets), buckets).collect()}  # a row for each bucket
    scored = weights(found, gain, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    drawable = F.col("n_words") >= least_words
    order = [drawable.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    placed = ranked(stored(scored, "scored"), order, "place", "scored-ranked")
    draw = percent * found.where(drawable).count() // 100
    rank = F.when(F.col("place") < draw, F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
