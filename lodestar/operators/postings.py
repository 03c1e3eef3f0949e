"""The stored inverted index: blocks of postings, and a top-k search that reads only blocks that can matter.

A block holds the postings of one lexeme for SPAN consecutive ids of a scope:
for each document its place in the span, how often the lexeme occurs in its A
and B parts, and its positions, each as the difference to the one before. Next
to them stand the block's largest weight and count.

A search first reads these heads alone. All lexemes' blocks of one span of ids
line up, so the sum of their largest weights bounds the rank of any document
in the span from above, and the largest of them bounds the best document's
rank from below. Spans that cannot reach the k-th best lower bound, or that
lack a word that a group needs, are skipped; the postings of the others are
read and ranked exactly. Skipping never changes the first k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.fulltext import WEIGHT_A, WEIGHT_B, Asked, asked_of, occurrences, rank_matches, rank_words, worded
from lodestar.sources.shared import stored

#: A span is two to this power of ids.
SPAN_BITS = 6
#: Bounds are sums of doubles; what lies this close to the limit is read.
SLACK = 1 + 1e-9
#: Spans to read are broadcast up to this number.
BROADCAST = 100_000


def posting_blocks(index: DataFrame, scope: list[str], doc: str = "id") -> DataFrame:
    """The blocks of a flat index (``scope``, ``doc``, lexeme, pos, weight).

    ``scope``, lexeme, block, max_weight, max_count and docs, an array of
    (at, a, b, deltas) in the order of ids. A position's code is twice its
    number, plus one in the B part; deltas are the differences of codes.
    """
    code = F.col("pos").cast("int") * 2 + (F.col("weight") == "B").cast("int")
    keys = [*scope, "lexeme", "block"]
    ids = F.col(doc).cast("long")
    rows = index.select(*scope, "lexeme", F.shiftright(ids, SPAN_BITS).alias("block"), ids.bitwiseAND((1 << SPAN_BITS) - 1).cast("int").alias("at"), code.alias("code"))
    # one exchange for both groups: a lexeme is split by spans, so a common one is many tasks
    each = rows.repartition(*keys).groupBy(*keys, "at").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    deltas = F.transform("codes", lambda c, i: c - F.coalesce(F.get("codes", i - 1), F.lit(0)))
    b = F.size(F.filter("codes", lambda c: c % 2 == 1))
    each = each.select(*keys, "at", (F.size("codes") - b).alias("a"), b.alias("b"), deltas.alias("deltas"))
    weight = F.col("a") * WEIGHT_A + F.col("b") * WEIGHT_B
    return each.groupBy(*keys).agg(F.max(weight).alias("max_weight"), F.max(F.col("a") + F.col("b")).alias("max_count"), F.array_sort(F.collect_list(F.struct("at", "a", "b", "deltas"))).alias("docs"))


def chunk_blocks(chunks: DataFrame, scope: list[str], doc: str = "id", exact_col: str = "text_exact", semantic_col: str = "text_semantic") -> DataFrame:
    """:func:`posting_blocks` of the texts of ``chunks``, without a row for each word.

    Texts are dealt by span of ids, so one task groups all words of a span and
    its blocks need no other exchange. Chunks without an id are not found.
    """
    ids = F.col(doc).cast("long")
    keyed = chunks.where(ids.isNotNull()).select(*scope, ids.alias("id"), exact_col, semantic_col)
    span = [*scope, F.shiftright("id", SPAN_BITS)]
    dealt = worded(keyed.repartition(*span).sortWithinPartitions(*span), [*scope, "id"], exact_col, semantic_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in occurrences(batches, lambda rows: _runs(rows, len(scope))):
            if len(found[-1]):
                yield _grouped(scope, *found)

    kinds = ", ".join(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in scope)
    return dealt.mapInArrow(run, f"{kinds}, lexeme string, block long, max_weight double, max_count int, docs array<struct<at: int, a: int, b: int, deltas: array<int>>>")


def _places(rows: pa.RecordBatch, n: int) -> np.ndarray:
    """A number for each row's scope, the first ``n`` columns."""
    place = np.zeros(rows.num_rows, dtype=np.int64)
    for i in range(n):
        each = rows.column(i).dictionary_encode()
        place = place * (len(each.dictionary) + 1) + each.indices.fill_null(len(each.dictionary)).to_numpy(zero_copy_only=False)
    return place


def _runs(rows: pa.RecordBatch, n: int) -> np.ndarray:
    """Rows next to each other of one scope and span have one number."""
    place, block = _places(rows, n), rows.column(n).to_numpy() >> SPAN_BITS
    return np.cumsum((np.diff(place, prepend=-1) != 0) | (np.diff(block, prepend=block[:1]) != 0))


def _grouped(scope: list[str], rows: pa.RecordBatch, names: pa.Array, lexeme: np.ndarray, row: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """Occurrences by scope, lexeme and span of ids, with the documents of each in order."""
    ids = rows.column(len(scope)).to_numpy()
    place = _places(rows, len(scope))
    _, rank = np.unique(np.rec.fromarrays([place, ids]), return_inverse=True)
    key = lexeme * len(ids) + rank[row]
    order = np.lexsort((code, key))
    key, lexeme, row, code = key[order], lexeme[order], row[order], code[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of each document's postings of a lexeme
    deltas = np.diff(code, prepend=0)
    deltas[first] = code[first]
    b = np.add.reduceat(code % 2, first)
    size = np.diff(first, append=len(code))
    lexeme, row = lexeme[first], row[first]
    block = ids[row] >> SPAN_BITS
    new = np.ones(len(row), dtype=bool)
    new[1:] = (np.diff(lexeme) != 0) | (np.diff(place[row]) != 0) | (np.diff(block) != 0)
    begin = np.flatnonzero(new)
    ints = lambda x: pa.array(x, "int32")
    docs = pa.StructArray.from_arrays(
        [ints(ids[row] & ((1 << SPAN_BITS) - 1)), ints(size - b), ints(b), pa.ListArray.from_arrays(ints(np.append(first, len(code))), ints(deltas))], names=["at", "a", "b", "deltas"]
    )
    weight = np.maximum.reduceat((size - b) * WEIGHT_A + b * WEIGHT_B, begin)
    one = pa.array(row[begin])
    return pa.RecordBatch.from_arrays(
        [*[rows.column(i).take(one) for i in range(len(scope))], names.take(pa.array(lexeme[begin])), pa.array(block[begin]), pa.array(weight), ints(np.maximum.reduceat(size, begin)), pa.ListArray.from_arrays(ints(np.append(begin, len(row))), docs)],
        names=[*scope, "lexeme", "block", "max_weight", "max_count", "docs"],
    )


def sorted_blocks(blocks: DataFrame, scope: list[str]) -> DataFrame:
    """Blocks sorted by lexeme in each file, so that a scan for a few lexemes reads few pages of it.

    They stay in the partitions in which they were grouped: ranges would need a
    sample first, which works out every block once more.
    """
    return blocks.sortWithinPartitions("lexeme", *scope, "block")


def bounds(blocks: DataFrame, asked: Asked, scope: list[str], query_id: str) -> DataFrame:
    """(query, block, upper, lower) of every span of ids in which some group may match."""
    terms = asked.lexemes.where("NOT negated").select(query_id, *scope, "grp", "term", "needed", "n_lexemes", "kinds", "lexeme").distinct()
    heads = asked.filtered(blocks).select(*scope, "lexeme", "block", "max_weight", "max_count").join(asked.side(terms), [*scope, "lexeme"])
    by_term = heads.repartition(query_id, "block").groupBy(query_id, "block", "grp", "needed", "kinds", "n_lexemes", "term").agg(
        F.count("*").alias("got"), F.min("max_count").alias("least"), F.sum("max_count").alias("all"), F.max("max_weight").alias("weight")
    )
    # a word counts its weights, a phrase at most one for each start, a cover of several terms at most one for each entry
    word = (F.col("needed") == 1) & (F.col("n_lexemes") == 1)
    upper = F.when(word, F.col("weight")).when(F.col("needed") == 1, F.col("least").cast("double")).otherwise(F.col("all").cast("double"))
    by_group = by_term.where("got = kinds").groupBy(query_id, "block", "grp", "needed").agg(
        F.count("*").alias("terms"), F.sum(upper).alias("upper"), F.max(F.when(word, F.col("weight")).otherwise(0.0)).alias("lower")
    )
    # a negated term may refuse the very document that stands behind the lower bound
    lower = F.lit(0.0) if asked.negations else F.max("lower")
    return by_group.where("terms = needed").groupBy(query_id, "block").agg(F.sum("upper").alias("upper"), lower.alias("lower"))


def live_spans(blocks: DataFrame, asked: Asked, scope: list[str], query_id: str, k: int) -> DataFrame:
    """The (query, block) that must be read for the best ``k`` of each query, written down."""
    every = bounds(blocks, asked, scope, query_id)
    nth = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("lower").desc()))
    limit = every.where("lower > 0").withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).select(query_id, F.col("lower").alias("limit"))
    live = every.join(limit, query_id, "left").where(F.col("limit").isNull() | (F.col("upper") * SLACK >= F.col("limit")))
    return stored(live.select(query_id, "block"), "live-spans")


def top_matches(blocks: DataFrame, queries: DataFrame, scope: list[str], k: int, query_id: str = "query_id", text_col: str = "lexical_query", doc: str = "id") -> DataFrame:
    """query_id, ``doc``, lex_rank: the best ``k`` of each query, ties included, and maybe more."""
    asked = asked_of(queries, scope, query_id, text_col)
    live = live_spans(blocks, asked, scope, query_id, k)
    columns = ["lexeme"] if asked.plain else [c for c in asked.lexemes.columns if c not in (query_id, *scope)]
    wanted = live.join(asked.side(asked.lexemes.select(query_id, *scope, *columns).distinct()), query_id)
    wanted = F.broadcast(wanted) if asked.small and live.count() <= BROADCAST else wanted
    found = asked.filtered(blocks).select(*scope, "lexeme", "block", "docs" if not asked.plain else F.transform("docs", lambda d: F.struct(d["at"].alias("at"), d["a"].alias("a"), d["b"].alias("b"))).alias("docs"))
    rows = found.join(wanted, [*scope, "lexeme", "block"]).withColumn("d", F.explode("docs"))
    rows = rows.withColumn(doc, F.shiftleft("block", SPAN_BITS) + F.col("d.at"))
    if asked.plain:
        return rank_words(rows, query_id, doc, F.col("d.a"), F.col("d.b"))
    return rank_matches(rows.withColumn("deltas", F.col("d.deltas")), query_id, doc)
