"""Name vectors without a trained model: hashed character n-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name_vector(name: str | None, dim: int = 64) -> list[float]:
    """Unit vector of signed counts of hashed 3-grams; zero for null and empty names."""
    v = np.zeros(dim)
    text = f" {name.lower()} " if name else ""
    for i in range(len(text) - 2):
        h = zlib.crc32(text[i : i + 3].encode("utf-8", "replace"))
        v[h % dim] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def name_vectors(column: Column, dim: int = 64) -> Column:
    return F.pandas_udf(lambda names: pd.Series([name_vector(x, dim) for x in names]), T.ArrayType(T.DoubleType()))(column)
