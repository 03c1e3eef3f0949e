"""Full-text search: an inverted index of weighted lexemes, web-style queries, cover-density rank.

A document has an A part (exact text: lower-cased words) and a B part
(semantic text: English stems without stop words, which still take up
positions) whose positions follow those of A. The index is one row for each
lexeme and position, so matching is a join on the lexeme. What is stored are
blocks of it (:mod:`lodestar.operators.postings`).

A query is read in two ways, as plain words and as English stems, and the two
are OR-ed. Words may be joined by ``or``, quoted into phrases or negated by
``-``; words side by side are AND-ed. A word with an underscore is a phrase of
its parts.

Host-like tokens (``a.b``) are split at the dot; a full-text parser with host
rules would keep them whole.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions.stemming import stem, stem_column
from lodestar.functions.unaccent import unaccent
from lodestar.functions.vocabulary import ENGLISH_STOPWORDS
from lodestar.sources.shared import stored

SEPARATORS = r"[^\p{L}\p{N}]+"
WEIGHT_A, WEIGHT_B = 1.0, 0.4
QUERY_TYPE = "array<struct<grp: int, term: int, negated: boolean, lexemes: array<struct<lexeme: string, offset: int>>>>"


def words(c: str) -> Column:
    """The lower-cased words of a text column."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), SEPARATORS), "")


def worded(chunks: DataFrame, keys: list[str], exact_col: str = "text_exact", semantic_col: str = "text_semantic") -> DataFrame:
    """``keys`` and the words of both parts, as arrays ``a`` and ``b``."""
    none = F.array().cast("array<string>")
    return chunks.select(*keys, words(exact_col).alias("a"), F.when(F.length(semantic_col) > 0, words(semantic_col)).otherwise(none).alias("b"))


#: Words of chunks that are grouped at a time.
STRETCH = 1 << 19


@lru_cache(1 << 17)
def _semantic(word: str) -> str | None:
    return None if word in ENGLISH_STOPWORDS else stem(word)


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The items of all lists, the row of each and its place from 1."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    items = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return items, rows, np.arange(len(items)) - (offsets[:-1] - offsets[0])[rows] + 1


def _stretches(batches: Iterator[pa.RecordBatch], run_of: Callable[[pa.RecordBatch], np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Rows with about STRETCH words at a time; rows next to each other of one run stay together."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        first = np.arange(held.num_rows) if run_of is None else np.flatnonzero(np.diff(run_of(held), prepend=-1))
        upto = held.num_rows if batch is None or run_of is None else int(first[-1])  # the last run may go on
        sizes = np.cumsum([len(a) + len(b) for a, b in zip(*(held.column(held.schema.get_field_index(c)) for c in "ab"))])
        cuts = first[1:][np.diff(sizes[first] // STRETCH) > 0]
        cuts = [0, *cuts[cuts < upto].tolist(), upto]
        yield from (held.slice(i, j - i) for i, j in itertools.pairwise(cuts) if j > i)
        held = held.slice(upto)


def occurrences(batches: Iterator[pa.RecordBatch], run_of: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows as :func:`worded` makes them, some at a time: the rows, their lexemes, and for each occurrence its lexeme, row and code.

    A code is twice the position, plus one in the B part. ``run_of``: a number
    for each row; rows next to each other with the same one come together.
    """
    for some in _stretches(batches, run_of):
        (a, row_a, at_a), (b, row_b, at_b) = (_flat(some.column(some.schema.get_field_index(c))) for c in "ab")
        a, b = a.dictionary_encode(), b.dictionary_encode()
        stems = [_semantic(w) for w in b.dictionary.to_pylist()]
        every = pa.concat_arrays([a.dictionary.cast("string"), pa.array(stems, "string")]).dictionary_encode()
        found = every.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lex_a, lex_b = found[: len(a.dictionary)][a.indices.to_numpy()], found[len(a.dictionary) :][b.indices.to_numpy()]
        shift = np.bincount(row_a, minlength=some.num_rows)
        kept = lex_b >= 0  # stop words take up places alone
        row_b, at_b = row_b[kept], at_b[kept]
        yield some, every.dictionary, np.concatenate([lex_a, lex_b[kept]]), np.concatenate([row_a, row_b]), np.concatenate([at_a * 2, (shift[row_b] + at_b) * 2 + 1])


def lexemes_of(chunks: DataFrame, keys: list[str], names: list[str], exact_col: str = "text_exact", semantic_col: str = "text_semantic") -> DataFrame:
    """:func:`lexemes` of these names alone: other words never leave the task that reads them."""
    asked = pa.array(names, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, every, lex, row, code in occurrences(batches):
            kept = np.isin(lex, np.flatnonzero(pc.is_in(every, asked)))
            lex, row, code = lex[kept], row[kept], code[kept]
            yield pa.RecordBatch.from_arrays(
                [*[some.column(i).take(pa.array(row)) for i in range(len(keys))], every.take(pa.array(lex)), pa.array(code // 2, "int32"), pa.array(np.where(code % 2, "B", "A"), "string")], names=[*keys, "lexeme", "pos", "weight"]
            )

    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return worded(chunks, keys, exact_col, semantic_col).mapInArrow(run, f"{kinds}, lexeme string, pos int, weight string")


def lexemes(chunks: DataFrame, keys: list[str], exact_col: str = "text_exact", semantic_col: str = "text_semantic") -> DataFrame:
    """``keys``, lexeme, pos (from 1), weight (``A`` or ``B``): the inverted index of ``chunks``."""
    # outer: else the optimizer would add a filter that splits each text twice
    exact = chunks.select(*keys, F.posexplode_outer(words(exact_col)).alias("i", "lexeme")).where("lexeme IS NOT NULL")
    exact = exact.select(*keys, "lexeme", (F.col("i") + 1).alias("pos"), F.lit("A").alias("weight"))
    both = chunks.where(F.length(semantic_col) > 0).select(*keys, F.size(words(exact_col)).alias("shift"), words(semantic_col).alias("b"))
    semantic = both.select(*keys, "shift", F.posexplode_outer("b").alias("i", "word")).where("word IS NOT NULL")
    semantic = semantic.where(~F.col("word").isin(*sorted(ENGLISH_STOPWORDS)))
    # the stemmer sees each distinct word once
    stems = semantic.select("word").distinct().withColumn("lexeme", stem_column(F.col("word")))
    semantic = semantic.join(stems, "word").select(*keys, "lexeme", (F.col("shift") + F.col("i") + 1).alias("pos"), F.lit("B").alias("weight"))
    return exact.unionByName(semantic)


def parse_query(text: str | None) -> list[tuple[int, int, bool, list[tuple[str, int]]]]:
    """(group, term, negated, lexemes with offsets): groups are OR-ed, terms of a group AND-ed."""
    trimmed = (text or "").strip(" ")
    if not trimmed:
        return []
    pieces = re.findall(r'(-?)"([^"]*)"|(-?)([^\s"]+)', unaccent(trimmed).lower())
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus_q, quoted, minus, word in pieces:
        if word == "or" and not minus:
            groups.append([])
            continue
        parts = re.findall(r"[^\W_]+", quoted or word)
        if parts:
            groups[-1].append((bool(minus_q or minus), parts))
    out, number = [], 0
    for english in (False, True):
        for group in groups:
            terms = []
            for negated, parts in group:
                kept = [(stem(p) if english else p, i) for i, p in enumerate(parts) if not (english and p in ENGLISH_STOPWORDS)]
                if kept:
                    first = kept[0][1]
                    terms.append((negated, [(lexeme, i - first) for lexeme, i in kept]))
            if any(not negated for negated, _ in terms):
                out += [(number, k, negated, kept) for k, (negated, kept) in enumerate(terms)]
                number += 1
    return out


def parsed_query(texts: Column) -> Column:
    """:func:`parse_query` for a column of questions."""

    @F.pandas_udf(QUERY_TYPE)
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: [{"grp": g, "term": k, "negated": n, "lexemes": [{"lexeme": x, "offset": o} for x, o in ls]} for g, k, n, ls in parse_query(t)])

    return run(texts)


def _cover_rank(entries: list[tuple[int, int, float]], n_terms: int) -> float:
    """Sum over minimal covers of ``n_terms`` terms of (size / sum of 1 / weight) / (1 + gaps). entries: (pos, term, weight)."""
    entries = sorted(set(entries))
    total, begin, held = 0.0, 0, {}
    for end, (_, term, _) in enumerate(entries):
        held[term] = held.get(term, 0) + 1
        if len(held) < n_terms:
            continue
        while held[entries[begin][1]] > 1:
            held[entries[begin][1]] -= 1
            begin += 1
        cover = entries[begin : end + 1]
        span = cover[-1][0] - cover[0][0]
        gaps = max(span - (len(cover) - 1), 0)
        total += len(cover) / sum(1 / w for _, _, w in cover) / (1 + gaps)
        del held[entries[begin][1]]
        begin += 1
    return total


#: Questions up to this number are read on the driver and joined as a local table.
FEW = 1_000
#: Asked lexemes up to this number are a filter of the scan of the index, and asked rows up to the other a broadcast.
FILTERED, BROADCAST = 1_000, 100_000


@dataclass
class Asked:
    """What a table of questions asks for, one row for each lexeme of each term.

    ``lexemes``: query, scope, grp, term, negated, n_lexemes, kinds (different
    lexemes of the term), needed (terms that the group must have), lexeme and
    offset. ``names``: all lexemes, if they are few. ``plain``: words that are
    OR-ed and nothing else.
    """

    lexemes: DataFrame
    names: list[str] | None
    small: bool
    plain: bool
    negations: bool

    def filtered(self, index: DataFrame) -> DataFrame:
        return index if self.names is None else index.where(F.col("lexeme").isin(*self.names))

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def asked_of(queries: DataFrame, scope: list[str], query_id: str, text_col: str | None = None, parsed_col: str | None = None) -> Asked:
    """Questions as text or as parsed queries. They are evaluated once: few are read on the driver, many are written down."""
    held = queries.select(query_id, *scope, F.col(text_col or parsed_col).alias("asks"))
    few = held.limit(FEW + 1).collect()
    if len(few) <= FEW:
        rows = []
        for r in few:
            terms = parse_query(r.asks) if text_col else [(t.grp, t.term, t.negated, [(x.lexeme, x.offset) for x in t.lexemes]) for t in r.asks or []]
            needed = Counter(g for g, _, negated, _ in terms if not negated)
            rows += [(*r[:-1], g, k, n, len(ls), len({x for x, _ in ls}), needed[g], x, o) for g, k, n, ls in terms for x, o in ls]
        schema = StructType([f for f in held.schema if f.name != "asks"])
        for name, kind in (("grp", "integer"), ("term", "integer"), ("negated", "boolean"), ("n_lexemes", "integer"), ("kinds", "integer"), ("needed", "integer"), ("lexeme", "string"), ("offset", "integer")):
            schema = schema.add(name, kind)
        at = len(scope) + 1
        names = sorted({r[at + 6] for r in rows})
        plain = all(r[at + 3] == 1 and r[at + 5] == 1 and not r[at + 2] for r in rows)
        lexemes = queries.sparkSession.createDataFrame(rows, schema)
        return Asked(lexemes, names if len(names) <= FILTERED else None, len(rows) <= BROADCAST, plain, any(r[at + 2] for r in rows))
    parsed = held.select(query_id, *scope, (parsed_query(F.col("asks")) if text_col else F.col("asks")).alias("q"))
    needed = F.size(F.filter("q", lambda x: (x["grp"] == F.col("t.grp")) & ~x["negated"]))
    terms = parsed.select("*", F.explode("q").alias("t")).select(query_id, *scope, "t.grp", "t.term", "t.negated", F.size("t.lexemes").alias("n_lexemes"), F.size(F.array_distinct("t.lexemes.lexeme")).alias("kinds"), needed.alias("needed"), F.explode("t.lexemes").alias("x"))
    lexemes = stored(terms.select(query_id, *scope, "grp", "term", "negated", "n_lexemes", "kinds", "needed", "x.lexeme", "x.offset"), "asked")
    names = [r.lexeme for r in lexemes.select("lexeme").distinct().limit(FILTERED + 1).collect()]
    every = lexemes.agg(F.count("*").alias("n"), F.max((F.col("n_lexemes") > 1) | (F.col("needed") != 1) | F.col("negated")).alias("other"), F.max("negated").alias("negated")).first()
    return Asked(lexemes, names if len(names) <= FILTERED else None, every.n <= BROADCAST, not every.other, bool(every.negated))


def rank_of(entries: list[tuple[int, int, bool, int, int, int, list[int]]]) -> float | None:
    """The rank of one document, None if it does not match.

    entries: group, term, negated, number of lexemes, needed terms, offset,
    and the differences of the codes of the positions (see
    :mod:`lodestar.operators.postings`) at which one asked lexeme occurs. The
    rank of OR-ed single words is the sum of the weights of the distinct
    positions that match; a phrase counts the harmonic mean of its words'
    weights over one plus its gaps, unless one of its words also stands for
    itself; groups of several terms count their minimal covers, the best group
    counts.
    """
    starts: dict[tuple, dict[int, tuple[int, float]]] = defaultdict(dict)
    sizes, needs, negations = {}, {}, set()
    for grp, term, negated, n_lexemes, needed, offset, deltas in entries:
        sizes[grp, term], needs[grp] = n_lexemes, needed
        if negated:
            negations.add((grp, term))
        for code in accumulate(deltas):
            starts[grp, term, code // 2 - offset][offset] = (code // 2, WEIGHT_B if code % 2 else WEIGHT_A)
    # an occurrence of a term: all its lexemes at their offsets from one start
    found: dict[tuple[int, int], set[tuple]] = defaultdict(set)
    for (grp, term, _), at in starts.items():
        if len(at) == sizes[grp, term]:
            found[grp, term].add(tuple(sorted(at.values())))
    refused = {g for g, t in found if (g, t) in negations}
    present = Counter(g for g, t in found if (g, t) not in negations)
    groups = {g for g, n in present.items() if n == needs[g] and g not in refused}
    if not groups:
        return None
    single, phrases, covers = set(), set(), defaultdict(set)
    for (grp, term), places in found.items():
        if grp not in groups or (grp, term) in negations:
            continue
        if needs[grp] > 1:
            covers[grp] |= {(pos, term, w) for at in places for pos, w in at}
        elif sizes[grp, term] > 1:
            phrases |= places
        else:
            single |= {p for at in places for p in at}
    total = sum(w for _, w in sorted(single))
    cut = {pos for pos, _ in single}
    for at in sorted(phrases):  # those that no single word cuts short
        if not any(pos in cut for pos, _ in at):
            total += len(at) / sum(1 / w for _, w in at) / (1 + at[-1][0] - at[0][0] - (len(at) - 1))
    return total + max((_cover_rank(list(e), needs[g]) for g, e in covers.items()), default=0.0)


def rank_matches(rows: DataFrame, query_id: str, doc: str) -> DataFrame:
    """query, ``doc``, lex_rank of every document that matches; rows: query, ``doc`` and the fields of :func:`rank_of`'s entries."""
    fields = ["grp", "term", "negated", "n_lexemes", "needed", "offset", "deltas"]

    @F.pandas_udf("double")
    def run(each: pd.Series) -> pd.Series:
        return pd.Series([rank_of([tuple(e[f] for f in fields) for e in es]) for es in each], dtype="float64")

    entries = rows.groupBy(query_id, doc).agg(F.collect_list(F.struct(*fields)).alias("entries"))  # of one document
    ranked = entries.select(query_id, doc, run("entries").alias("lex_rank")).where("lex_rank IS NOT NULL AND NOT isnan(lex_rank)")
    return ranked.select(query_id, doc, F.col("lex_rank").cast("float").cast("double").alias("lex_rank"))


def rank_words(rows: DataFrame, query_id: str, doc: str, a: Column, b: Column) -> DataFrame:
    """The same for OR-ed words alone: every occurrence of an asked lexeme counts its weight. rows: one for each lexeme of a query and document."""
    both = rows.groupBy(query_id, doc).agg(F.sum(a).alias("a"), F.sum(b).alias("b"))
    return both.select(query_id, doc, (F.col("a") * WEIGHT_A + F.col("b") * WEIGHT_B).cast("float").cast("double").alias("lex_rank"))


def match(index: DataFrame, queries: DataFrame, scope: list[str], query_id: str = "query_id", parsed_col: str | None = "tsq", doc: str = "id", text_col: str | None = None) -> DataFrame:
    """query_id, ``doc``, lex_rank of every document of the query's scope that matches, by the flat index.

    ``queries``: query_id, ``scope`` columns and the query, parsed or as text.
    """
    asked = asked_of(queries, scope, query_id, text_col, None if text_col else parsed_col)
    if asked.plain:  # a lexeme that is asked for twice counts once
        found = asked.filtered(index).join(asked.side(asked.lexemes.select(query_id, *scope, "lexeme").distinct()), [*scope, "lexeme"])
        first = (F.col("weight") == "A").cast("long")
        return rank_words(found, query_id, doc, first, 1 - first)
    found = asked.filtered(index).join(asked.side(asked.lexemes), [*scope, "lexeme"])
    code = F.col("pos").cast("int") * 2 + (F.col("weight") == "B").cast("int")
    return rank_matches(found.withColumn("deltas", F.array(code)), query_id, doc)
