"""Vector expressions: similarity, normal form and the byte form used for exchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Products in the element type, summed as doubles from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different lengths or without length."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def normalize(v: Column) -> Column:
    """v by its length; a vector without length stays."""
    norm = F.sqrt(dot(v, v)).cast("float")
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))


@pandas_udf(BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@pandas_udf(ArrayType(FloatType()))
def from_bytes(b: pd.Series) -> pd.Series:
    """Floats of the whole four-byte groups; bytes left over are ignored."""
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4", len(x) // 4))


def local_embedding(text: Column, dimension: int = 384) -> Column:
    """The offline embedding: the bytes of the text's SHA-256 by 255, then zeros."""
    h = F.sha2(text, 256)
    head = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") / 255).cast("float"))
    return F.concat(head, F.array_repeat(F.lit(0.0).cast("float"), dimension - 32))
