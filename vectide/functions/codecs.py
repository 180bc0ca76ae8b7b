"""Vectors as packed little-endian bytes and back, a batch at a time. Only exchange with other systems needs them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import vectors as vf

_KINDS = {"float": ("<f4", T.FloatType()), "int": ("<i4", T.IntegerType()), "short": ("<i2", T.ShortType())}


def vec_to_bytes(vector: Column | str, kind: str = "float") -> Column:
    """A float, int or short array as its elements' bytes."""
    dtype = _kind(kind)[0]

    @F.pandas_udf(T.BinaryType())
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype).tobytes())

    return pack(vector)


def read_bytes(data: Column | str, kind: str = "float") -> Column:
    """The array that vec_to_bytes has packed."""
    dtype, element = _kind(kind)

    @F.pandas_udf(T.ArrayType(element))
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, dtype))

    return unpack(data)


# The vector functions on packed floats: unpacked, computed in DOUBLE, and packed again where a vector comes out.


def cosine_similarity_bytes(a: Column | str, b: Column | str) -> Column:
    return vf.cosine_similarity(read_bytes(a), read_bytes(b))


def vec_minus_bytes(a: Column | str, b: Column | str) -> Column:
    return vec_to_bytes(vf.vec_minus(read_bytes(a), read_bytes(b)))


def vec_plus_bytes(a: Column | str, b: Column | str) -> Column:
    return vec_to_bytes(vf.vec_plus(read_bytes(a), read_bytes(b)))


def vec_normalize_bytes(a: Column | str) -> Column:
    """In one function, as Spark takes no Python function inside the lambda of vec_normalize; a vector of length 0 stays."""

    @F.pandas_udf(T.BinaryType())
    def unit(v: pd.Series) -> pd.Series:
        rows = v.map(lambda x: None if x is None else np.frombuffer(x, "<f4").astype(np.float64))
        return rows.map(lambda x: None if x is None else (x / (np.linalg.norm(x) or 1.0)).astype("<f4").tobytes())

    return unit(a)


def grouped_centroid_bytes(rows: DataFrame, keys: list[str], data: str, dims: int, out: str = "vector") -> DataFrame:
    """The mean of each group's packed vectors, packed."""
    means = vf.grouped_centroid(rows.select(*keys, read_bytes(data).alias("_v")), keys, "_v", dims, "_mean")
    return means.select(*keys, vec_to_bytes("_mean").alias(out))


def _kind(kind: str):
    if kind not in _KINDS:
        raise ValueError(f"elements are {', '.join(_KINDS)}, not {kind}")
    return _KINDS[kind]
