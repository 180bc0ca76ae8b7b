"""Search in inverted lists of residual codes.

The index is rows (id, word, coarse_id, codes), written by coarse_id, so that a search reads the lists of a few cells
only. Cells are visited from near to far, w at a time, until they hold as many rows as are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import FINE, squared_distance, vec_minus
from vectide.operators.codebooks import assign, encode
from vectide.operators.knn import top
from vectide.operators.pq import distance, lookup_tables, verified


def build(vectors: DataFrame, coarse: DataFrame, residual_codebook: DataFrame) -> DataFrame:
    """The index of vectors (id, word, vector)."""
    return encode(assign(vectors, coarse, ("id", "word")), residual_codebook, ("id", "word", "coarse_id"))


def visited(queries: DataFrame, coarse: DataFrame, counts: DataFrame, n: int, w: int) -> DataFrame:
    """qid, coarse_id, vector (the query's residual) of the cells that each query looks into."""
    each = queries.select("qid", F.col("vector").alias("q")).crossJoin(F.broadcast(coarse.select("coarse_id", F.col("vector").alias("centre"))))
    each = each.withColumn("d", F.round(squared_distance("q", "centre"), FINE))
    each = each.join(F.broadcast(counts.select("coarse_id", F.col("count").alias("rows"))), "coarse_id", "left")
    by = Window.partitionBy("qid").orderBy("d", "coarse_id")
    each = each.withColumn("turn", F.floor((F.row_number().over(by) - 1) / w))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("qid").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("before", before).where(F.col("before") < n).select("qid", "coarse_id", vec_minus("q", "centre").alias("vector"))


def cell_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("coarse_id").count()


def ivfadc_search(index: DataFrame, coarse: DataFrame, residual_codebook: DataFrame, queries: DataFrame, n: int, m: int, k: int, dims: int, w: int, counts: DataFrame | None = None) -> DataFrame:
    """qid, id, word, distance of the n nearest to each query; with w = 1 one cell a round, as the batch form has it.

    counts (coarse_id, count) of a stored index spare a pass over it, so that only the cells looked into are read.
    """
    cells = visited(queries, coarse, counts if counts is not None else cell_counts(index), n, w)
    keyed = cells.withColumn("key", F.struct("qid", "coarse_id"))
    luts = lookup_tables(keyed.select("key", "vector"), residual_codebook, m, dims, "key").select(F.col("key.qid"), F.col("key.coarse_id"), "lut")
    near = index.join(luts, "coarse_id").select("qid", "id", "word", distance("lut", "codes", k).alias("distance"))
    return top(near, ["qid"], [F.col("distance"), F.col("id")], n)


def ivfadc_search_verified(vectors: DataFrame, index: DataFrame, coarse: DataFrame, residual_codebook: DataFrame, queries: DataFrame, n: int, m: int, k: int, dims: int, w: int, pvf: int) -> DataFrame:
    found = ivfadc_search(index, coarse, residual_codebook, queries, n * pvf, m, k, dims, w)
    return verified(found, vectors, queries, n)
