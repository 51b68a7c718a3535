"""Functions on embeddings as arrays of doubles."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, size_b: Column | None = None) -> Column:
    """Cosine similarity, 0 if a vector is zero; ``size_b`` is the norm of ``b`` where it is known."""
    size = norm(a) * (norm(b) if size_b is None else size_b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def hash_vector(text: str, width: int = 8) -> list[float]:
    """Unit vector from the digest of a text: the offline stand-in for an embedding model."""
    raw = hashlib.sha256(text.encode()).digest()
    v = np.array(struct.unpack("<8I", raw)[:width], dtype=float) / 2**31 - 1
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


@pandas_udf(ArrayType(DoubleType()))
def embed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hash_vector(t or ""))
