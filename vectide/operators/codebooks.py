"""Quantizers: codebooks from seeds or training, and the codes of vectors.

A codebook is rows (pos, code, vector, count): for each of m positions, the slices of a vector, k centroids. It has
k times the vector's length numbers, so it goes to every task whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import FINE, vec_minus

CODEBOOK = "pos int, code int, vector array<double>, count long"
#: Distances that are computed at once.
CELLS = 2_000_000


def slices(vectors: DataFrame, m: int, dims: int, keep: list[str]) -> DataFrame:
    """A row (pos, vector) for each of m slices; the number of dimensions must be a multiple of m."""
    if dims % m:
        raise ValueError(f"{dims} dimensions don't divide into {m} slices")
    each = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.slice(F.col("vector"), p * (dims // m) + 1, dims // m))
    return vectors.select(*keep, F.posexplode(each).alias("pos", "slice")).select(*keep, "pos", F.transform("slice", lambda x: x.cast("double")).alias("vector"))


def seeded_codebook(vectors: DataFrame, m: int, k: int, dims: int) -> DataFrame:
    """The slices of the vectors of id 0 to k - 1 as centroids: the same everywhere, no training."""
    seeds = vectors.where(F.col("id").between(0, k - 1))
    return slices(seeds, m, dims, ["id"]).select("pos", F.col("id").cast("int").alias("code"), "vector", F.lit(0).cast("long").alias("count"))


def trained_codebook(vectors: DataFrame, m: int, k: int, dims: int, seed: int = 1, sample: int = 100_000, rounds: int = 10) -> DataFrame:
    """K-means of each slice by itself, on a sample of about so many vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample / max(1, vectors.count()))
    some = vectors.sample(share, seed) if share < 1 else vectors
    parts = slices(some, m, dims, []).withColumn("features", array_to_vector("vector")).cache()
    rows = []
    for p in range(m):
        model = KMeans(k=k, seed=seed + p, maxIter=rounds).fit(parts.where(F.col("pos") == p))
        rows += [(p, c, [float(x) for x in v], 0) for c, v in enumerate(model.clusterCenters())]
    parts.unpersist()
    return vectors.sparkSession.createDataFrame(rows, CODEBOOK)


def tensor(codebook: DataFrame) -> np.ndarray:
    """A codebook as an array by position, code and dimension; it is bounded by its own sizes, not by the data."""
    rows = codebook.select("pos", "code", "vector").collect()
    m, k = 1 + max(r[0] for r in rows), 1 + max(r[1] for r in rows)
    out = np.full((m, k, len(rows[0][2])), np.inf)
    for p, c, v in rows:
        out[p, c] = v
    return out


def nearest_codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The code of each slice of each vector; of equal distances the lowest code."""
    m, k, d = book.shape
    step = max(1, CELLS // (m * k * d))
    out = np.empty((len(x), m), dtype=np.int64)
    for a in range(0, len(x), step):
        part = x[a : a + step].reshape(-1, m, 1, d)
        with np.errstate(invalid="ignore"):
            dist = ((part - book[None]) ** 2).sum(axis=3)
        out[a : a + step] = np.round(dist, FINE).argmin(axis=2)
    return out


def encode(vectors: DataFrame, codebook: DataFrame, keep: tuple[str, ...] = ("id",), out: str = "codes") -> DataFrame:
    """keep columns and the codes (array of smallint) of each row's vector."""
    book = vectors.sparkSession.sparkContext.broadcast(tensor(codebook))
    rows = vectors.select(*keep, "vector")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = book.value.shape[0]
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                codes = nearest_codes(x, book.value).astype(np.int16)
                ends = pa.array(np.arange(0, codes.size + 1, m, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=[*keep, out])

    return rows.mapInArrow(work, f"{schema}, {out} array<smallint>")


def code_counts(codes: DataFrame, m: int, k: int) -> DataFrame:
    """pos, code, count of all codes, 0 for those that no vector has."""
    spark = codes.sparkSession
    used = codes.select(F.posexplode("codes").alias("pos", "code")).groupBy("pos", F.col("code").cast("int").alias("code")).count()
    every = spark.range(m * k).select((F.col("id") / k).cast("int").alias("pos"), (F.col("id") % k).cast("int").alias("code"))
    return every.join(F.broadcast(used), ["pos", "code"], "left").select("pos", "code", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def assign(vectors: DataFrame, coarse: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep columns, coarse_id of the nearest coarse centroid (coarse_id, vector) and the residual as vector."""
    book = coarse.select(F.lit(0).alias("pos"), F.col("coarse_id").alias("code"), "vector")
    near = encode(vectors.select(*keep, "vector", F.col("vector").alias("whole")), book, (*keep, "whole"), "cell")
    near = near.select(*keep, "whole", F.col("cell")[0].cast("int").alias("coarse_id"))
    centre = coarse.select("coarse_id", F.col("vector").alias("centre"))
    return near.join(F.broadcast(centre), "coarse_id").select(*keep, "coarse_id", vec_minus("whole", "centre").alias("vector"))


def moved(codebook: DataFrame, added: DataFrame, dims: int) -> DataFrame:
    """The codebook after vectors (pos, code, vector) have joined its codes: running means and counts."""
    d = dims
    sums = added.groupBy("pos", "code").agg(F.count("*").alias("new"), *[F.sum(F.col("vector")[j].cast("double")).alias(f"_{j}") for j in range(d)])
    sums = sums.select("pos", "code", "new", F.array(*[F.col(f"_{j}") for j in range(d)]).alias("sum"))
    both = codebook.join(F.broadcast(sums), ["pos", "code"], "left")
    mean = F.zip_with("vector", "sum", lambda c, s: (c * F.col("count") + s) / (F.col("count") + F.col("new")))
    return both.select("pos", "code", F.when(F.col("new").isNull(), F.col("vector")).otherwise(mean).alias("vector"), (F.col("count") + F.coalesce("new", F.lit(0))).alias("count"))
