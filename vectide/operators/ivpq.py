"""Nearest-neighbour joins on an inverted multi-index.

A cell is a pair of codes of two half vectors. Cells are visited from near to far. From the share of the target
column's rows in each cell, the chance is estimated that the cells visited so far hold enough targets; a query stops
when it reaches the wanted confidence. A query that then has too few is repeated with the wanted number doubled, which
here is one plan: the number of cells of every doubling is computed, and the first that suffices is used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import FINE, PLACES, dot, erf, squared_distance
from vectide.operators.codebooks import encode, slices
from vectide.operators.knn import top, within
from vectide.operators.pq import distance, lookup_tables, verified

PQ, EXACT, VERIFIED = 0, 1, 2
_TINY = 1e-12


def build(vectors: DataFrame, multi: DataFrame, codebook: DataFrame, k: int) -> DataFrame:
    """id, word, coarse_id (first code + k times the second), codes of the whole vector."""
    cells = encode(vectors.select("id", "word", "vector", F.col("vector").alias("whole")), multi, ("id", "word", "whole"), "cell")
    cells = cells.select("id", "word", F.col("whole").alias("vector"), (F.col("cell")[0] + k * F.col("cell")[1]).cast("int").alias("coarse_id"))
    return encode(cells, codebook, ("id", "word", "coarse_id"))


def cell_counts(index: DataFrame, cells: int) -> DataFrame:
    """coarse_id, count of every cell, empty ones too."""
    every = index.sparkSession.range(cells).select(F.col("id").cast("int").alias("coarse_id"))
    return every.join(index.groupBy("coarse_id").count(), "coarse_id", "left").select("coarse_id", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def create_statistics(column: DataFrame, index: DataFrame, cells: int) -> DataFrame:
    """coarse_id, coarse_freq: the share of a text column's known rows (word) in each cell; and total, their number, in each row."""
    known = column.select("word").where("word is not null").join(index.select("word", "coarse_id"), "word")
    counts = cell_counts(known, cells)
    total = F.sum("count").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row a cell
    return counts.withColumn("total", total).select("coarse_id", F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(0.0).alias("coarse_freq"), "total")


def confidence(wanted: Column, targets: int, share: Column, total: int) -> Column:
    """The chance that cells with this share of all rows hold the wanted number of targets, by a normal distribution whose spread shrinks with the part of all rows that are targets."""
    n = float(targets)
    p = F.least(share, F.lit(1.0))
    spread = F.sqrt(n * p * (1 - p)) * ((total - n) / max(total - 1, 1))
    off = wanted - 0.5 - n * p
    z = F.when(spread > 0, off / (F.when(spread > 0, spread).otherwise(1.0) * math.sqrt(2)))
    by_spread = F.when(spread > 0, 1 - 0.5 * (1 + erf(z))).otherwise(F.when(off < 0, 1.0).otherwise(0.0))
    return F.when(wanted > n, 0.0).when(p <= _TINY, 0.0).when(p >= 1 - _TINY, F.when(off < 0, 1.0).otherwise(0.0)).otherwise(by_spread)


def cell_order(queries: DataFrame, multi: DataFrame, k: int, dims: int) -> DataFrame:
    """qid, coarse_id, rank from 1 and d: the cells of each query from near to far."""
    halves = slices(queries.select("qid", "vector"), 2, dims, ["qid"]).withColumnRenamed("vector", "part")
    near = halves.join(F.broadcast(multi.select("pos", "code", "vector")), "pos").select("qid", "pos", "code", squared_distance("part", "vector").alias("d"))
    x = near.where("pos = 0").select("qid", F.col("code").alias("c0"), F.col("d").alias("d0"))
    y = near.where("pos = 1").select("qid", F.col("code").alias("c1"), F.col("d").alias("d1"))
    cells = x.join(y, "qid").select("qid", (F.col("c0") + k * F.col("c1")).cast("int").alias("coarse_id"), F.round(F.col("d0") + F.col("d1"), FINE).alias("d"))
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "coarse_id")))


def flat_cell_order(queries: DataFrame, coarse: DataFrame) -> DataFrame:
    """cell_order for the cells of a coarse quantizer (coarse_id, vector)."""
    each = queries.select("qid", F.col("vector").alias("q")).crossJoin(F.broadcast(coarse.select("coarse_id", F.col("vector").alias("centre"))))
    cells = each.select("qid", "coarse_id", F.round(squared_distance("q", "centre"), FINE).alias("d"))
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "coarse_id")))


def chosen_cells(queries: DataFrame, multi: DataFrame, stats: DataFrame, targets: DataFrame, n: int, k: int, dims: int, alpha: int, wanted_confidence: float, use_targetlist: bool = True) -> DataFrame:
    """chosen of the multi-index's cells."""
    return chosen(cell_order(queries, multi, k, dims), stats, targets, n, alpha, wanted_confidence, use_targetlist)


def chosen(order: DataFrame, stats: DataFrame, targets: DataFrame, n: int, alpha: int, wanted_confidence: float, use_targetlist: bool = True) -> DataFrame:
    """qid, coarse_id: the cells (in order) that each query looks into, after all repetitions it needs.

    A query without a target list is repeated until its cells hold n targets, one with a list until they hold alpha * n
    of the round. targets is (id, coarse_id).
    """
    counts = targets.groupBy("coarse_id").count()
    size = counts.agg(F.sum("count")).first()[0] or 0
    total = (stats.select("total").first() or [0])[0] or 0
    rounds = max(0, math.ceil(math.log2(max(1, size) / max(1, n * alpha)))) + 1
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cells = order.join(F.broadcast(stats.select("coarse_id", "coarse_freq")), "coarse_id").join(F.broadcast(counts), "coarse_id", "left")
    cells = cells.withColumn("share", F.round(F.coalesce(F.sum("coarse_freq").over(before), F.lit(0.0)), FINE)).withColumn("held", F.sum(F.coalesce("count", F.lit(0))).over(upto))
    each = cells.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds)))).withColumn("wanted", F.lit(float(n * alpha)) * F.pow(F.lit(2.0), F.col("round")))
    each = each.where(F.round(confidence(F.col("wanted"), size, F.col("share"), total), FINE) < wanted_confidence)
    ends = each.groupBy("qid", "round").agg(F.max("rank").alias("last"), F.max("held").alias("held"), F.first("wanted").alias("wanted"))
    enough = F.col("held") >= (F.col("wanted") if use_targetlist else F.lit(n))
    first = ends.withColumn("enough", enough).groupBy("qid").agg(F.min_by("last", F.when(F.col("enough"), F.col("round"))).alias("last"))
    return cells.join(first, "qid").where(F.col("last").isNull() | (F.col("rank") <= F.col("last"))).select("qid", "coarse_id")


def ivpq_join(vectors: DataFrame, index: DataFrame, multi: DataFrame, codebook: DataFrame, stats: DataFrame, queries: DataFrame, targets: DataFrame, n: int, m: int, k: int, k_multi: int, dims: int, alpha: int = 3, pvf: int = 20, method: int = PQ, wanted_confidence: float = 0.8, use_targetlist: bool = True) -> DataFrame:
    """qid, id, word, similarity: the n nearest targets of each query (qid, vector), by codes, exactly, or by codes and then exactly."""
    among = within(index, targets)
    cells = chosen_cells(queries, multi, stats, among.select("id", "coarse_id"), n, k_multi, dims, alpha, wanted_confidence, use_targetlist)
    pairs = among.join(cells, "coarse_id")
    if method == EXACT:
        exact = pairs.select("qid", "id").join(vectors.select("id", "word", "vector"), "id").join(queries.select("qid", F.col("vector").alias("q")), "qid")
        exact = exact.select("qid", "id", "word", F.round(dot("q", "vector"), PLACES).alias("similarity"))
        return top(exact, ["qid"], [F.desc("similarity"), F.col("id")], n)
    luts = lookup_tables(queries, codebook, m, dims)
    near = pairs.join(luts, "qid").select("qid", "id", "word", distance("lut", "codes", k).alias("distance"))
    near = top(near, ["qid"], [F.col("distance"), F.col("id")], n * (max(1, pvf) if method == VERIFIED else 1))
    if method == VERIFIED:
        return verified(near, vectors, queries, n)
    return near.select("qid", "id", "word", (1 - F.col("distance") / 2).alias("similarity"))
