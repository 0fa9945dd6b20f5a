"""Vectors: cosine distance, score, codec and the offline embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import column, keywords


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, in double precision; null for a zero vector."""
    a, b = column(a), column(b)
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def relevance(distance: Column | str) -> Column:
    """Cosine distance 0..2 as a score 1..0."""
    return F.lit(1.0) - column(distance) / 2


def to_bytes(c: Column | str) -> Column:
    """Little-endian float32 bytes of a vector."""

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return encode(column(c))


def from_bytes(c: Column | str) -> Column:
    @F.pandas_udf("array<float>")
    def decode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return decode(column(c))


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """Feature hashing of the keywords: each adds 1 or -1 at a place, both from its md5.  No model is needed.

    A text without a keyword is the zero vector, a null text none.
    """

    @F.pandas_udf("array<float>")
    def embed(words: pd.Series) -> pd.Series:
        import hashlib

        def one(ws):
            if ws is None:
                return None
            h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in ws], np.int64)
            return np.bincount(h % dim, np.where(h // dim % 2 == 0, 1.0, -1.0), dim).astype(np.float32)

        return words.map(one)

    return embed(keywords(text))
