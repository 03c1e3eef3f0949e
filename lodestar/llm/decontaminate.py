"""Benchmark decontamination by a distributed positional inverted index, on DataFrame operations alone.

1. One scan of the training texts stores the index: a posting (text, term,
   place) for every word that the test set holds, in the order of the texts,
   and beside them one narrow row for each document. Nothing else reads texts.
2. The lists' lengths come from the index. Each test window is matched from
   its rarest terms: a posting of the rarest at place ``p``, which stands at
   offset ``o`` of the window, says that the window may start at ``p - o``;
   these starts are intersected with the offset-adjusted list of the next
   rarest term, and what is left with the lists of all other terms.
3. The starts that every list confirms are the exact phrase matches.
   Proximity matches come from the same postings.

Lists are intersected by equi-joins on (text, term, place) after a partial
aggregation on the same keys, so copies of a text count once and a text or a
term that a third of all rows hold is many keys. Test terms, windows and
texts with matches are broadcast only up to counted bounds; beyond them the
same joins shuffle, and with more test terms than ``BROADCAST_TERMS`` every
word of the texts gets a posting.

Defined cases: words are those of the exact A-Z fold; null and empty texts
have no words and are never hit; items without words have no windows; an item
without an id is found but not named; repeated rows each get their text's
result; null ids are carried through; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import ascii_folded, bounded, content_key, stored, text_or_empty, word_array

#: Test terms that may be broadcast (some 100 bytes each).
BROADCAST_TERMS = 500_000
TEXT = ["ck1", "ck2"]
PLACE = [*TEXT, "term", "pos"]


def build_index(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``docs`` for the words of ``words`` (word, distinct).

    Columns id, n_words, ck1, ck2, pos, term (64-bit hash of the word). A row
    with n_words stands for a document, a row with a term for a posting; the
    row of a text's first word may be both.
    """
    text = text_or_empty(text_col)
    split = docs.select(F.col(id_col).alias("id"), *content_key(text), word_array(ascii_folded(text)).alias("words"))
    # outer: each document keeps a row, and the optimizer adds no filter that would split each text twice
    placed = split.select("id", *TEXT, F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "word"))
    if words.count() <= BROADCAST_TERMS:
        placed = placed.join(F.broadcast(words.withColumn("term", F.xxhash64("word"))), "word", "left")
    else:
        placed = placed.withColumn("term", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    document = F.coalesce(F.col("pos"), F.lit(0)) == 0
    rows = placed.where(document | F.col("term").isNotNull())
    return stored(rows.select(F.when(document, F.col("id")).alias("id"), F.when(document, F.col("n")).alias("n_words"), *TEXT, "pos", "term"), "index")


def postings(index: DataFrame) -> DataFrame:
    return index.where("term IS NOT NULL").select(*PLACE)


def frequencies(index: DataFrame) -> DataFrame:
    """term, count: the length of each list."""
    return stored(index.where("term IS NOT NULL").groupBy("term").count(), "frequencies")


def test_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows of each item: item, wid, exact (words)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), word_array(ascii_folded(text_or_empty(text_col))).alias("w")).where("size(w) > 0")
    starts = items.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("at"))
    windows = starts.select("item", F.slice("w", F.col("at") + 1, width).alias("exact")).distinct()
    return windows.select("item", F.xxhash64("exact").alias("wid"), "exact")


def _rarest_first(windows: DataFrame, lengths: DataFrame) -> DataFrame:
    """wid, n, lists (term, offset; rarest first) of each distinct window whose words all occur."""
    distinct = windows.select("wid", "exact").dropDuplicates(["wid"])
    spread = distinct.select("wid", F.size("exact").alias("n"), F.posexplode("exact").alias("offset", "word")).select("wid", "n", "offset", F.xxhash64("word").alias("term"))
    ranked = spread.join(bounded(lengths), "term").groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))).alias("lists"))
    return stored(ranked.where(F.size("lists") == F.col("n")), "lists")


def _gathered(starts: DataFrame, *carried: str) -> DataFrame:
    """Wanted places (text, term, pos), each once, with what waits for them."""
    return starts.groupBy(*PLACE).agg(F.collect_set(F.struct(*carried)).alias("waiting"))


def _confirmed(wanted: DataFrame, lists: DataFrame, *carried: str) -> DataFrame:
    """What waits at places that ``lists`` holds."""
    met = _gathered(wanted, *carried).join(lists.groupBy(*PLACE).agg(F.lit(1).alias("_")), PLACE)
    return met.select(*TEXT, F.explode("waiting").alias("w")).select(*TEXT, *[f"w.{c}" for c in carried])


def phrase_hits(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences of ``windows`` (wid, exact): ck1, ck2, wid, start, n (words), each once."""
    asked = _rarest_first(windows, frequencies(index))
    part = lambda i, name: F.get("lists", i)[name]
    entry = asked.select("wid", "n", part(0, "term").alias("term"), part(0, "offset").alias("o"), part(1, "term").alias("next"), (part(1, "offset") - part(0, "offset")).alias("step"))
    n_asked = asked.count()
    first = postings(index).join(bounded(entry, n_asked), "term").withColumn("start", F.col("pos") - F.col("o")).where("start >= 0")
    alone = first.where("next IS NULL").select(*TEXT, "wid", "start", "n").distinct()
    seconds = stored(entry.where("next IS NOT NULL").select(F.col("next").alias("term")).distinct(), "seconds")
    wanted = first.where("next IS NOT NULL").select(*TEXT, F.col("next").alias("term"), (F.col("pos") + F.col("step")).alias("pos"), "wid", "start", "n")
    both = stored(_confirmed(wanted, postings(index).join(bounded(seconds), "term", "left_semi"), "wid", "start", "n"), "starts")
    # the other lists, in the texts that have starts left
    texts = stored(both.where("n > 2").select(*TEXT).distinct(), "texts")
    rest = postings(index).join(bounded(texts), TEXT, "left_semi")
    others = both.where("n > 2").join(bounded(asked.select("wid", "lists"), n_asked), "wid").select(*TEXT, "wid", "start", "n", F.explode(F.expr("slice(lists, 3, n)")).alias("l"))
    others = others.select(*TEXT, "wid", "start", "n", F.col("l.term").alias("term"), (F.col("start") + F.col("l.offset")).alias("pos"), F.col("l.offset").alias("o"))
    whole = _confirmed(others, rest, "wid", "start", "n", "o").groupBy(*TEXT, "wid", "start", "n").agg(F.count("*").alias("found")).where("found = n - 2").drop("found")
    return stored(alone.unionByName(both.where("n = 2")).unionByName(whole), "matches")


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int = 5) -> DataFrame:
    """Texts that hold all words of a query, in any order, within its length plus ``slop`` words.

    ``queries``: query_id, words (array of words of the A-Z fold). Returns ck1,
    ck2, query_id, start, stop: for each occurrence of the rarest word, the
    smallest span that holds it and every other word, if it is short enough.
    Places are compared within neighbouring buckets of a span's length, so an
    occurrence meets a bounded number of others however often a text repeats.
    """
    wanted = queries.select("query_id", F.size(F.array_distinct("words")).alias("n"), F.explode(F.array_distinct("words")).alias("word"))
    wanted = stored(wanted.select("query_id", "n", F.xxhash64("word").alias("term"), (F.col("n") + slop).alias("span")), "proximity")
    n_wanted = wanted.count()
    lists = postings(index).distinct().join(bounded(wanted, n_wanted), "term")
    lists = stored(lists.select(*TEXT, "query_id", "n", "term", "pos", "span", F.floor(F.col("pos") / F.col("span")).alias("bucket")), "lists")
    counts = lists.groupBy("query_id", "n", "term").count()
    rarest = counts.groupBy("query_id", "n").agg(F.count("*").alias("terms"), F.min_by("term", F.struct("count", "term")).alias("term")).where("terms = n").select("query_id", "term")
    rarest = stored(rarest, "rarest")
    anchors = lists.join(bounded(rarest), ["query_id", "term"]).select(*TEXT, "query_id", F.col("pos").alias("anchor"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = lists.join(anchors, [*TEXT, "query_id", "bucket"]).where(F.abs(F.col("pos") - F.col("anchor")) < F.col("span"))
    # the smallest span around an anchor starts at one of the places: for each start, the first place of each word from there on
    at = [*TEXT, "query_id", "n", "span", "anchor"]
    starts = near.where(F.col("pos") <= F.col("anchor")).select(*at, F.col("pos").alias("start")).distinct()
    ahead = near.select(*at, "term", "pos").join(starts, at).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("span")))
    each = ahead.groupBy(*at, "start", "term").agg(F.min("pos").alias("pos"))
    spans = each.groupBy(*at, "start").agg(F.count("*").alias("found"), (F.greatest(F.max("pos"), F.col("anchor")) + 1).alias("stop"))
    spans = spans.where((F.col("found") == F.col("n")) & (F.col("stop") - F.col("start") <= F.col("span")))
    best = spans.groupBy(*at).agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("length"), "start", "stop")).alias("s"))
    return best.select(*TEXT, "query_id", "s.start", "s.stop").distinct()


def proximity_hits(docs: DataFrame, queries: DataFrame, text_col: str = "text", id_col: str = "doc_id", slop: int = 5) -> DataFrame:
    """:func:`proximity_matches` of ``queries`` in ``docs``, by an index made for them."""
    words = stored(queries.select(F.explode("words").alias("word")).distinct(), "words")
    return proximity_matches(build_index(docs, words, id_col, text_col), queries, slop)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
) -> DataFrame:
    """One row for each row of ``docs``: id, ck1, ck2, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it stands inside any occurrence of a window of ``width``
    consecutive words of an item (a shorter item is one window).
    """
    windows = stored(test_windows(benchmark, item_col, item_text_col, width), "windows")
    words = stored(windows.select(F.explode("exact").alias("word")).distinct(), "words")
    index = build_index(docs, words, id_col, text_col)
    hits = phrase_hits(index, windows)
    # words under a union of windows: sorted by start, each adds what the ones before it leave
    spans = hits.groupBy(*TEXT, "start").agg(F.max(F.col("start") + F.col("n")).alias("stop"))
    upto = F.max("stop").over(Window.partitionBy(*TEXT).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(upto, F.lit(0))), F.lit(0))
    covered = spans.withColumn("added", added).groupBy(*TEXT).agg(F.sum("added").alias("hit"))
    named = hits.select(*TEXT, "wid").distinct().join(bounded(stored(windows.select("wid", "item"), "items")), "wid").groupBy(*TEXT).agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_text = covered.join(named, TEXT).select(*TEXT, "hit", F.size("items").cast("long").alias("found"), F.sha2(F.array_join("items", ","), 256).alias("digest"))
    by_text = stored(by_text, "hits")  # a stored side lets a join on a hot text be split
    rows = index.where("n_words IS NOT NULL").select(F.col("id").alias(id_col), *TEXT, F.col("n_words").cast("long").alias("n_words"))
    return rows.join(bounded(by_text), TEXT, "left").select(
        id_col,
        *TEXT,
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("found", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"),
    )
