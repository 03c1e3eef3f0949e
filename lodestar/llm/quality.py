"""A quality classifier made of two zstandard dictionaries.

One dictionary is trained on texts labelled good, one on texts labelled bad. A
text is compressed with each; the normalised difference of the two sizes says
which class it looks like. A logistic curve over that difference, the two
sizes for each byte and the logarithm of the length, fitted on out-of-fold
compressions, turns it into a probability: the sizes tell texts that both
dictionaries shrink to nothing (endless repeats), the length how far a
difference of a few bytes can be trusted.

Training uses a bounded sample: at most ``per_class`` labelled rows of each
class, those with the smallest hash of their id, of at most ``max_train_chars``
characters each (longer ones are passed over, not cut). Every text is scored
whole.

Defined cases: a null or empty text scores the share of class 1 among the
labels; labels that are null or neither 0 nor 1 are passed over; without two
classes in the sample every text gets that share (0.5 without any label); a
text labelled twice counts once for each class; repeated rows and null ids are
scored like any other row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_or_empty

_BLOCK = 1 << 20  # very long texts are compressed in blocks of so many bytes


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the measures of a text
    offset: float
    prior: float
    level: int = 3

    def scorer(self):
        if not self.good or not self.bad:
            return lambda text: self.prior
        sizes = [_sizer(d, self.level) for d in (self.good, self.bad)]

        def score(text: str) -> float:
            if not text:
                return self.prior
            z = self.offset + sum(w * x for w, x in zip(self.weights, _measures(text, *sizes)))
            return 1 / (1 + math.exp(-min(max(z, -35.0), 35.0)))

        return score


def _sizer(dictionary: bytes, level: int):
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(raw: bytes) -> int:
        return sum(len(packer.compress(raw[i : i + _BLOCK])) for i in range(0, max(1, len(raw)), _BLOCK))

    return size


def _measures(text: str, good, bad) -> tuple[float, float, float, float]:
    """The normalised difference of the sizes (above 0: the good dictionary makes the text smaller), both for each byte, the log length."""
    raw = text.encode("utf-8", "surrogatepass")
    g, b = good(raw), bad(raw)
    return (b - g) / max(b, g), g / len(raw), b / len(raw), math.log(len(raw))


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, raw)) // 8)), raw).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(raw)[-size:] or b"\n"


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> tuple[tuple[float, ...], float]:
    """Weights and offset by Newton's method on standardised columns, with a weak ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, penalty = np.zeros(design.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, design.T @ (p - y) + penalty * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / spread
    return tuple(weights.tolist()), float(w[-1] - weights @ mean)


def fit_texts(good: list[str], bad: list[str], prior: float | None = None, dict_bytes: int = 112_640, level: int = 3, folds: int = 3) -> QualityModel:
    """The model of two lists of texts. ``prior``: the share of class 1, where it isn't that of the lists."""
    if prior is None:
        prior = len(good) / (len(good) + len(bad)) if good or bad else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not good or not bad:
        return QualityModel(b"", b"", (), 0.0, prior, level)
    x, y = [], []
    for k in range(folds):  # measures of texts that the dictionaries haven't seen
        rest = [[t for i, t in enumerate(texts) if i % folds != k] or texts for texts in (good, bad)]
        sizes = [_sizer(_dictionary(t, dict_bytes), level) for t in rest]
        for label, texts in ((1.0, good), (0.0, bad)):
            held = texts[k::folds]
            x += [_measures(t, *sizes) for t in held]
            y += [label] * len(held)
    weights, offset = _logistic(np.array(x), np.array(y))
    offset += math.log(prior / (1 - prior)) - math.log(len(good) / len(bad))
    return QualityModel(_dictionary(good, dict_bytes), _dictionary(bad, dict_bytes), weights, offset, prior, level)


def training_row(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for rows that may be learnt from: crc32 of the id as text, modulo ``folds``, is not 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds != 0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 3_000,
    max_train_chars: int = 20_000,
    **options,
) -> QualityModel:
    """The model of the labelled rows of ``docs`` that :func:`training_row` allows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(training_row("id"))
    chosen = None
    for y in (0, 1):  # a bounded sample: TakeOrdered keeps per_class rows of each task
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    counts = dict(known.groupBy("y").count().collect())
    text = text_or_empty(text_col)
    rows = (
        docs.select(F.col(id_col).alias("id"), text.alias("t"))
        .join(F.broadcast(chosen), "id")  # 2 * per_class rows at most
        .where(F.length("t") <= max_train_chars)
        .orderBy(F.xxhash64("id"), "id", "t")
        .limit(2 * per_class)
        .collect()
    )
    good, bad = [r.t for r in rows if r.y == 1 and r.t], [r.t for r in rows if r.y == 0 and r.t]
    total = sum(counts.values())
    return fit_texts(good, bad, counts.get(1, 0) / total if total else None, **options)


def with_scores(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col`` (0 to 1, higher: class 1 likelier)."""
    spark = docs.sparkSession
    # two dictionaries of at most dict_bytes each; plain values, since a broadcast is pickled by reference
    shared = spark.sparkContext.broadcast((model.good, model.bad, model.weights, model.offset, model.prior, model.level))
    state: dict = {}

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = state.get("run") or state.setdefault("run", QualityModel(*shared.value).scorer())
        for texts in batches:
            yield pd.Series([run(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, score(text_or_empty(text_col)))


def accepted(score: Column, threshold: float = 0.3) -> Column:
    return score >= threshold
