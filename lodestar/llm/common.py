"""Helpers that several operators share: content keys, shared storage, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shared import forget, new_path, stored

__all__ = ["ascii_folded", "bounded", "components", "content_key", "folded", "forget", "fresh", "new_path", "stored", "text_or_empty", "word_array"]

#: Everything but 0-9, A-Z, a-z and the characters from U+0080 upwards separates words.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only if it holds no more rows than this (some MB).
BROADCAST_ROWS = 50_000


def bounded(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """``df`` (written down, or of ``rows`` rows) as a side to broadcast if it has at most ``most`` rows (BROADCAST_ROWS)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= (BROADCAST_ROWS if most is None else most) else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a prefix that no column of ``df`` begins with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + n for n in names]


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def content_key(text: Column) -> list[Column]:
    """128 bits of ``text`` as two longs, ``ck1`` and ``ck2``.

    Results that depend on the text alone are made once for each text and
    joined back on these, so repeated or null ids do no harm.
    """
    return [F.xxhash64(text).alias("ck1"), F.xxhash64(F.lit(7), text).alias("ck2")]


def folded(text: Column) -> Column:
    """``text`` lower-cased in the JVM so that equal A-Z-folded words stay equal.

    ``lower`` also folds other letters. The Kelvin sign is the one further
    character that would fold into a-z, and capital sigma folds by its
    neighbours; both are set apart first. On words of a-z and 0-9 alone the
    result is exactly the A-Z fold.
    """
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("Σ"), F.lit("σ")))


def ascii_folded(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased, exactly."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SEPARATORS), "")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long).

    The component is its smallest node. Alternating large-star and small-star
    steps (Kiveris et al., 2014) need a logarithmic number of rounds on long
    chains; each step is a partial minimum for each node and a join that
    adaptive execution can split, so no node's neighbours meet in one task.
    Every round is a written table.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    for _ in range(max_rounds):
        # large star: each node links its larger neighbours to its smallest one (itself included)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node links its smaller neighbours and itself to the smallest
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = stored(small, name)
        # done once every node points at one root and no root points further
        roots = after.select("b").distinct()
        state = after.groupBy("a").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("b", "a").withColumn("is_root", F.lit(1)), "a", "left")
        open_nodes = state.where("n > 1 OR is_root = 1").limit(1).count()
        forget(current)
        current = after
        if not open_nodes:
            break
    else:
        raise RuntimeError(f"{name}: no fixed point after {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
