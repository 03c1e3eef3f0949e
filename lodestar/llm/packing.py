"""Packing of tokenised documents into sequences by length patterns and non-negative least squares.

1. Every text is tokenised whole, ended by an end id and cut into pieces of at
   most ``max_len`` ids.
2. The histogram of piece lengths (at most ``max_len`` counts, whatever the
   corpus holds) goes to the driver. Patterns of up to three lengths that fill
   a sequence are enumerated, and repeat counts for them are fitted to the
   histogram by non-negative least squares (as in Krell et al., 2021).
3. The counts are rounded down to what the histogram allows; the pieces that
   are left are packed best fit, longest first, on counts of equal sequences.
4. The plan says which ranks of each length go to which sequences. Pieces are
   ranked in buckets of each length, so one very common length is many tasks.

Defined cases: null and empty texts are one piece that holds the end id alone;
repeated rows are packed like any other; null ids are carried through; an
empty table gives no pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored, text_or_empty

TOKENIZER = "word_bpe_49k.json"
#: The plan is broadcast only if it holds no more runs than this.
BROADCAST_RUNS = 200_000

# Within these characters NFC changes nothing and words can be encoded one by one.
_PLAIN = re.compile("[^\t\n\r -~¡-ɏ‐-‧]")
#: Words that each of the two generations of an encoder's memory holds.
_WORDS_KEPT = 400_000


def _word_pattern() -> re.Pattern:
    plain = [chr(c) for c in (*range(0x20, 0x250), 0x307, *range(0x2010, 0x2028))]
    letters = "".join(c for c in plain if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in plain if unicodedata.category(c)[0] == "N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^ \t\n\r{letters}{numbers}]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printing else next(others)) for b in range(256)}


class WordEncoder(dict):
    """Ids of a text as little-endian 32-bit bytes; words seen before are looked up.

    The tokenizer lower-cases, drops white space and encodes each word alone,
    so joining the words' ids gives those of the text. New words go straight
    to its merge model. Texts with other characters, or with a special token's
    string, are encoded whole, and so is every text if the file turns out to
    be of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}  # full once; words used again move to the newer generation
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.words = _word_pattern()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = "It's 12½ ÉTÉ-straße, naïve… o'clock!! x_y  Z"
        self.by_word = self.joined(probe) == self.whole(probe)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            written = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
            ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
            if len(word) > 40:
                return ids
        if len(self) >= _WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def joined(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        if not self.by_word or "<|" in text and any(s in text for s in self.special) or not (text.isascii() and text.isprintable()) and _PLAIN.search(text):
            return self.whole(text)
        return self.joined(text)


def _encoder(path: str | None) -> WordEncoder:
    """One for each worker process: it hangs on a module, since this function may arrive anew with each task."""
    import tokenizers

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    assert array("I").itemsize == 4
    kept = tokenizers.__dict__.setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces: id, piece, start, length, ids_crc32 and, if ``with_ids``, ids (array of int)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * max_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path).ids
        for batch in batches:
            texts = batch.column(1)
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i in range(len(texts)):
                raw = encode(texts[i].as_py()) + end
                for n, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("t")).mapInArrow(run, schema)


def _patterns(present: np.ndarray, max_len: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill ``max_len`` exactly, of lengths that occur."""
    rows = [np.array([[max_len, 0, 0]])] if present[max_len] else []
    lengths = np.flatnonzero(present)
    lengths = lengths[(lengths > 0) & (lengths < max_len)]
    pair = lengths[present[max_len - lengths] & (lengths <= max_len - lengths)]
    rows.append(np.stack([max_len - pair, pair, 0 * pair], 1))
    for a in lengths[lengths <= max_len // 3]:
        b = lengths[(lengths >= a) & (2 * lengths <= max_len - a)]
        b = b[present[max_len - a - b]]
        rows.append(np.stack([max_len - a - b, b, 0 * b + a], 1))
    return np.concatenate(rows) if rows else np.empty((0, 3), dtype=int)


def fit_repeats(counts: np.ndarray, patterns: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - counts|: A[l, p] is how often pattern p holds length l.

    Multiplicative updates keep x non-negative and need two sparse products a round.
    """
    size, target = len(counts), counts.astype(float)
    target[0] = 0
    flat = patterns.ravel()

    def spread(x: np.ndarray) -> np.ndarray:  # A x
        got = np.bincount(flat, np.repeat(x, 3), size)
        got[0] = 0
        return got

    def gather(r: np.ndarray) -> np.ndarray:  # A' r
        return r[patterns].sum(axis=1)

    uses = np.maximum(np.bincount(flat, minlength=size), 1)
    x = np.where(patterns > 0, (target / uses)[patterns], np.inf).min(axis=1)
    goal = gather(target)
    for _ in range(rounds):
        x *= goal / np.maximum(gather(spread(x)), 1e-12)
    return x


def plan(counts: np.ndarray, max_len: int) -> list[tuple[int, list[int]]]:
    """Groups (repeats, lengths in their order): how ``counts[l]`` pieces of each length l fill sequences."""
    left = counts.astype(np.int64).copy()
    groups: list[tuple[int, list[int]]] = []
    patterns = _patterns(left > 0, max_len)
    if len(patterns):
        x = fit_repeats(left, patterns)
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 0.5:
                break
            lengths = [int(v) for v in patterns[p] if v]
            most = min(int(left[v]) // lengths.count(v) for v in lengths)
            n = min(int(x[p] + 0.5), most)
            if n:
                groups.append((n, lengths))
                for v in lengths:
                    left[v] -= n
    # best fit, longest first; open_: sorted (free, number of the group) of equal sequences
    open_: list[tuple[int, int]] = []
    made: list[list] = []

    def add(n: int, lengths: list[int]) -> None:
        made.append([n, lengths])
        free = max_len - sum(lengths)
        if free:
            insort(open_, (free, len(made) - 1))

    for length in range(max_len, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(open_, (length, -1))
            if at == len(open_):
                each = max_len // length
                if n >= each:
                    add(n // each, [length] * each)
                if n % each:
                    add(1, [length] * (n % each))
                n = 0
                continue
            _, g = open_.pop(at)
            m, lengths = made[g]
            take = min(n, m)
            made[g] = [0, lengths]
            if m > take:
                add(m - take, lengths)
            add(take, lengths + [length])
            n -= take
    return groups + [(n, lengths) for n, lengths in made if n]


def _runs(groups: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, lengths in groups:
        offset = 0
        for v in lengths:
            first = used.get(v, 0)
            out.append((v, first, first + n, sequence, offset))
            used[v] = first + n
            offset += v
        sequence += n
    return out


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", max_len: int = 2048, buckets: int = 64) -> DataFrame:
    """``pieces`` (written down already: they are read three times) with sequence_id and offset."""
    spark = pieces.sparkSession
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = stored(bucketed.groupBy("length", "bucket").count(), "lengths")  # max_len * buckets rows at most
    counts = np.zeros(max_len + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect():  # max_len rows at most
        counts[r.length] = r.n
    runs = _runs(plan(counts, max_len))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    table = pa.table({k: pa.array([r[i] for r in runs], pa.int64()) for i, k in enumerate(("length", "low", "high", "base", "offset"))})
    by_length = spark.createDataFrame(table).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "base", "offset"))).alias("runs"))
    order = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = bucketed.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(first), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("first", "bucket")
    ranked = ranked.join(F.broadcast(by_length) if len(runs) <= BROADCAST_RUNS else by_length, "length")
    run = F.get(F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), 0)
    placed = ranked.withColumn("run", run)
    return placed.withColumn("sequence_id", F.col("run.base") + F.col("rank") - F.col("run.low")).withColumn("offset", F.col("run.offset")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = stored(token_pieces(docs, id_col, text_col, max_len, tokenizer_path, end_id, with_ids), "pieces")
    return pack_pieces(pieces, id_col, max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a packed table that carries ids: at most ``max_len`` ids each."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
