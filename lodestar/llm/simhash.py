"""SimHash near-duplicates: pigeonring filtering of fingerprints before the Hamming check.

A fingerprint of 64 bits is cut into a ring of ``n_segments`` segments. If two
fingerprints differ in at most ``max_bits`` bits, some segment starts a chain
around the ring in which the first ``l`` segments differ in at most
``l * max_bits / n_segments`` bits, for every ``l`` (Qin and Xiao, 2018). The
segments at the start of such a chain whose budget is below one bit are equal,
so they serve as a hash-join key; the longer budgets prune the pairs that
share a key, and only what is left gets the full Hamming check.

Copies of a text share a fingerprint, so links are sought between distinct
fingerprints. A key that more than ``max_bucket`` of them share is not paired:
in it, two fingerprints differ in at most ``max_bits`` bits exactly if some
form of the first with half as many bits flipped (rounded down) is a form of
the second with half as many flipped (rounded up). So each sends its flipped
forms (of the bits outside the key), and all that send a form are linked to
the smallest that reaches it by the smaller half. That loses no link between
components and is linear in the bucket.

Defined cases: a null or empty text has fingerprint zero and is linked like
any other; repeated rows are in one component; rows with a null id get a
component but do not name it unless the component has no other id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_ROWS, components, content_key, stored, text_or_empty

_BIT = 1 << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; one is set if it is set in over half the hashes of the shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join  # a digest is big-endian: bit 63 comes first
    counts, n = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, n, 1 << 15):  # very long texts in blocks
        upto = min(start + (1 << 15), n)
        grams = zip(*[words[start + i : upto + i] for i in range(shingle)]) if len(words) > shingle else [words]
        hashes = b"".join([digest(g, seed) for g in map(join, grams)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(_BIT[counts * 2 > n].sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(id, fp: signed long) for every row, with ck1 and ck2 if ``keyed``; batch by batch, so memory is that of one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            got = np.array([fingerprint(texts[i].as_py()) for i in range(len(texts))], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64()), *batch.columns[2:]], names=[id_col, "fp", "ck1", "ck2"][: batch.num_columns])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("t"), *(content_key(text_or_empty(text_col)) if keyed else [])).mapInArrow(run, f"`{id_col}` {kind}, fp long" + ", ck1 long, ck2 long" * keyed)


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, mask) of each segment of the ring, as nearly equal as can be."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(cuts[i], (1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(n_segments: int, max_bits: int) -> list[list[int]]:
    """For each start of the ring: the mask of its first 1, 2, ... segments, as signed longs."""
    segments = _segments(n_segments)
    out = []
    for i in range(n_segments):
        mask, row = 0, []
        for step in range(n_segments):
            shift, width = segments[(i + step) % n_segments]
            mask |= width << shift
            row.append(_signed(mask))
        out.append(row)
    return out


def links(fps: DataFrame, max_bits: int = 2, n_segments: int = 5, max_bucket: int = 64) -> DataFrame:
    """Links (a < b, distinct fingerprints) whose components are those of Hamming distance <= ``max_bits``.

    ``fps``: distinct longs, column ``fp``. All pairs within a key of at most
    ``max_bucket`` fingerprints are checked; larger keys are linked by flipped
    forms: 65 for ``max_bits`` of two, 2,081 for four or three and their halves
    above. The ring should have over ``max_bits`` segments; keys are longest
    where a few segments have a budget just under one bit.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits is 0 to 4")
    masks = _masks(n_segments, max_bits)
    equal = max(1, next(n for n in range(n_segments, -1, -1) if n * max_bits < n_segments or n == 0))  # segments whose budget is under one bit
    keys = [(i, row[equal - 1]) for i, row in enumerate(masks)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in keys])).alias("k")).select("fp", "k.ring", "k.key")
    hot = stored(keyed.groupBy("ring", "key").agg(F.count("*").alias("size")).where(F.col("size") > max_bucket), "hot-keys")
    n_hot = hot.count()
    hot_side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    cold = keyed.join(hot_side, ["ring", "key"], "left_anti") if n_hot else keyed

    def chained(x: Column, ring: Column) -> Column:
        """Every prefix of the chain that starts at ``ring`` keeps its budget."""
        test = F.lit(False)
        for i, row in enumerate(masks):
            budget = [F.bit_count(x.bitwiseAND(F.lit(m))) <= (n + 1) * max_bits // n_segments for n, m in enumerate(row)]
            whole = budget[0]
            for b in budget[1:]:
                whole = whole & b
            test = test | ((ring == i) & whole)
        return test

    small = cold.groupBy("ring", "key").agg(F.array_sort(F.collect_list("fp")).alias("all")).where("size(all) > 1")
    pairs = (
        small.select("ring", "all", F.posexplode("all").alias("at", "a"))
        .select("ring", "a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"))
        .where(chained(F.col("a").bitwiseXOR(F.col("b")), F.col("ring")))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    if not n_hot:
        return pairs.distinct()
    short, long = max_bits // 2, (max_bits + 1) // 2
    flips = [{"n": n, "flip": _signed(sum(1 << b for b in bits))} for n in range(long + 1) for bits in combinations(range(64), n)]  # 2,081 at most
    flips = F.from_json(F.lit(json.dumps(flips)), "array<struct<n: int, flip: bigint>>")
    inside = F.expr("CASE ring " + " ".join(f"WHEN {i} THEN {m}L" if m >= 0 else f"WHEN {i} THEN ({m}L)" for i, m in keys) + " END")
    forms = keyed.join(hot_side, ["ring", "key"]).select("ring", "fp", inside.alias("inside"), F.explode(flips).alias("f"))
    forms = forms.where(F.col("f.flip").bitwiseAND(F.col("inside")) == 0).select("ring", "fp", "f.n", F.col("fp").bitwiseXOR(F.col("f.flip")).alias("form"))
    least = forms.groupBy("ring", "form").agg(F.min(F.when(F.col("n") <= short, F.col("fp"))).alias("a"), F.count("*").alias("all")).where("a IS NOT NULL AND all > 1").drop("all")
    starred = forms.join(least, ["ring", "form"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred).distinct()


def _reached(prints: DataFrame, id_col: str, **options) -> DataFrame:
    """(fp, least: smallest id, component) for every distinct fingerprint."""
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = components(links(classes.select("fp"), **options))
    return classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: id, fp (signed long), component_id (smallest id reachable)."""
    prints = stored(with_fingerprints(docs, id_col, text_col), "fingerprints")
    reached = _reached(prints, id_col, **options)
    named = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = reached.join(named, "component").select("fp", "component_id")
    return prints.join(of_class, "fp").select(id_col, "fp", "component_id")


def superseded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """What to take out so that one row of each component is left: id, ck1, ck2, once.

    The row that stays has the smallest id, nulls last, then the smallest
    content key. Rows of all others are listed with ``once`` false; where rows
    repeat both id and text of the one that stays, it is listed with ``once``
    true. Rows that are not listed stay. An id alone names neither a row nor a
    component: it may be null, or shared by texts of different components.
    """
    prints = stored(with_fingerprints(docs, id_col, text_col, keyed=True), "fingerprints")
    rows = prints.groupBy(id_col, "ck1", "ck2", "fp").agg(F.count("*").alias("copies"))
    me = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), "ck1", "ck2")
    least = prints.groupBy("fp").agg(F.min(me).alias("r"))
    classes = stored(least.join(_reached(prints, id_col, **options), "fp").select("fp", "component", "r"), "classes")
    stays = classes.groupBy("component").agg(F.min("r").alias("stays"))
    of_print = stored(classes.join(stays, "component").select("fp", "stays"), "stays")  # a stored side lets a join on a hot text be split
    marked = rows.join(of_print, "fp").withColumn("once", F.col("stays").eqNullSafe(me))
    return marked.where("NOT once OR copies > 1").select(id_col, "ck1", "ck2", "once")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
