"""Groups and clusters of words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import FINE, grouped_centroid
from vectide.operators.knn import best_of, knn_pairs, matrix, within
from vectide.operators.pq import pq_nearest


def groups(vectors: DataFrame, tokens: DataFrame, names: DataFrame) -> DataFrame:
    """token, grouptoken: the nearest group word of each known token; ties go to the group of the smallest id."""
    known = within(vectors, tokens)
    near = knn_pairs(known.select(F.col("id").alias("qid"), "vector"), within(vectors, names), 1)
    return near.withColumnRenamed("word", "grouptoken").join(known.select(F.col("id").alias("qid"), F.col("word").alias("token")), "qid").select("token", "grouptoken")


def groups_pq(vectors: DataFrame, codes: DataFrame, codebook: DataFrame, tokens: DataFrame, names: DataFrame, m: int, k: int, dims: int) -> DataFrame:
    """token, grouptoken by the distance of tokens' codes to the group words' vectors. Group words are the few and serve as queries."""
    named = within(vectors, names).select(F.col("id").alias("qid"), F.col("word").alias("grouptoken"), "vector")
    own = within(codes, tokens)
    near = pq_nearest(own, codebook, named, m, k, dims).join(named.select("qid", "grouptoken"), "qid")
    return own.select("id", F.col("word").alias("token")).join(near, "id").select("token", "grouptoken")


def cluster(vectors: DataFrame, tokens: DataFrame, k: int, dims: int, seeds: list[int] | None = None, rounds: int = 10, nearest: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """word, cluster (from 1): rounds of assigning each token to the centroid of the largest product and of averaging.

    The first centroids are the tokens of the given ids, or the k first by a hash. Centroids are not normalised and an
    empty cluster keeps its own. Only k centroids leave the executors each round. nearest(tokens, centroids) gives
    rows (id, qid) and may use an index.
    """
    own = within(vectors, tokens).select("id", "word", "vector")
    if seeds is None:
        seeds = [r[0] for r in own.select("id").orderBy(F.xxhash64("id"), "id").limit(k).collect()]
    centre = {r[0]: r[1] for r in own.where(F.col("id").isin(seeds)).select("id", "vector").collect()}
    if missing := [i for i in seeds if i not in centre]:
        raise ValueError(f"no such tokens: {missing}")
    centroids = [[float(x) for x in centre[i]] for i in seeds]
    nearest = nearest or nearest_exact
    spark = vectors.sparkSession
    for turn in range(rounds):
        named = spark.createDataFrame([(j, c) for j, c in enumerate(centroids, 1)], "qid long, vector array<double>")
        found = nearest(own, named)
        if turn < rounds - 1:
            means = grouped_centroid(found.join(own, "id"), ["qid"], "vector", dims).collect()
            for qid, v in means:
                centroids[qid - 1] = [round(x, FINE) for x in v]
    return found.join(own.select("id", "word"), "id").select("word", F.col("qid").cast("int").alias("cluster"))


def nearest_exact(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, qid: the centroid of the largest product for each row, ties to the lowest number; the few centroids go to every task and nothing is shuffled."""
    got = centroids.orderBy("qid").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((got["qid"].to_numpy(), matrix(got["vector"].combine_chunks())))

    def work(batches):
        ids, c = shared.value
        for batch in batches:
            if batch.num_rows:
                sims = np.round(matrix(batch.column("vector")) @ c.T, FINE)
                r, at = best_of(sims, ids, 1, True)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(r)), pa.array(ids[at])], names=["id", "qid"])

    return rows.select("id", "vector").mapInArrow(work, "id long, qid long")
