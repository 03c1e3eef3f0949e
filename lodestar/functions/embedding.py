"""A deterministic hash embedding as a column expression, and the protocol of other embedders."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import let, tokens, with_canonical
from lodestar.functions.vocabulary import EMBEDDING_DIM, EMBEDDING_TERMS


class Embedder(Protocol):
    """Turns a text column into an array<float> column of a fixed length."""

    dim: int

    def __call__(self, text: Column) -> Column: ...


def expanded_tokens(text: Column) -> Column:
    """Tokens of the text, each followed by the canonical term for embeddings."""
    return with_canonical(tokens(text), EMBEDDING_TERMS)


def _normalised(vector: Column) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.when(n == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / n)))

    return let(vector, scaled)


def token_vector(token: Column, dim: int = EMBEDDING_DIM) -> Column:
    """The unit vector of a token: component i is made of the first 32 bits of SHA-256 of ``token:i``."""

    def component(i: Column) -> Column:
        head = F.substring(F.sha2(F.concat(token, F.lit(":"), i.cast("string")), 256), 1, 8)
        return F.conv(head, 16, 10).cast("double") / F.lit(2147483648.0) - F.lit(1.0)

    return _normalised(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component))


@lru_cache(1 << 16)
def _token_vector(token: str, dim: int) -> np.ndarray:
    """:func:`token_vector` of one token; a task works a common token out once."""
    vector = [int(hashlib.sha256(f"{token}:{i}".encode()).hexdigest()[:8], 16) / 2147483648.0 - 1.0 for i in range(dim)]
    norm = math.sqrt(sum(x * x for x in vector))
    return np.array([x / norm if norm else 0.0 for x in vector])


def embed_text(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Weighted sum of the token vectors, of length one; without tokens all zero (array<double>)."""

    @F.pandas_udf("array<double>")
    def total(texts: pd.Series) -> pd.Series:
        def of(tokens: np.ndarray) -> np.ndarray:
            weights = Counter(tokens)
            if not weights:
                return np.zeros(dim)
            vectors = np.stack([_token_vector(t, dim) for t in weights])
            return (vectors * np.array(list(weights.values()), dtype=float)[:, None]).sum(axis=0)

        return texts.map(of)

    return _normalised(total(expanded_tokens(text)))


def stored_vector(vector: Column) -> Column:
    """The vector as it is stored: eight decimals, single precision."""
    return F.transform(vector, lambda x: F.round(x, 8).cast("float"))


class HashEmbedder:
    dim = EMBEDDING_DIM

    def __call__(self, text: Column) -> Column:
        return stored_vector(embed_text(text, self.dim))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; NaN if either vector is all zero (NaN sorts after every number)."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p)
    norm = F.sqrt(square(x)) * F.sqrt(square(y))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot / norm)
