"""Vector columns: ``array<float|double>`` in, arithmetic in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from .. import settings as S
from .binding import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def scale(v: Column, factor: Column | float) -> Column:
    return F.transform(as_double(v), lambda x: x * factor)


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    divide = lambda d, n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)
    return let(as_double(v), lambda d: let(norm(d), lambda n: divide(d, n)))


def combine(shape: Column, colour: Column, weight: float = S.HSV_WEIGHT) -> Column:
    """Shape vector followed by the weighted colour vector, as one unit vector."""
    return l2_normalize(F.concat(as_double(shape), scale(colour, weight)))


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of unit vectors, kept within [0, 2]."""
    return F.least(F.greatest(F.lit(1.0) - dot(a, b), F.lit(0.0)), F.lit(2.0))


def hamming(a: Column, b: Column, words: int = S.PHASH_BITS // 64) -> Column:
    """Differing bits of two hashes stored as ``array<bigint>``, in compiled code."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i)))
    return total


@F.pandas_udf(ArrayType(FloatType()))
def decode(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector; empty or torn blobs give NULL."""

    def one(raw):
        if raw is None or len(raw) == 0 or len(raw) % 4:
            return None
        return np.frombuffer(raw, dtype="<f4")

    return blob.map(one)


@F.pandas_udf(BinaryType())
def encode(v: pd.Series) -> pd.Series:
    """Vector to little-endian float32 bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


def check_dim(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has ``dim`` entries, and the rejected rest."""
    ok = F.coalesce(F.size(vector) == dim, F.lit(False))
    return df.where(ok), df.where(~ok)


def drop_zero(df: DataFrame, vector: str, floor: float = S.ZERO_NORM) -> DataFrame:
    """Keep vectors with a norm above ``floor``."""
    return df.where(norm(F.col(vector)) > floor)
