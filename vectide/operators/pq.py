"""Search by product quantization: the distance of a vector's codes to a query is a sum of looked-up values.

Codes are rows (id, word, codes). A query's table holds its squared distance to every centroid, in order of position
and code; it is as large as the codebook's number of centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import PLACES, dot, squared_distance
from vectide.operators.codebooks import slices
from vectide.operators.knn import BROADCAST_ELEMENTS, PRODUCT, best_of, top, within

#: Elements of a block of tables, and rows of a block of codes, where the tables of all queries are too many to broadcast.
BLOCK_ELEMENTS, BLOCK_CODES = 1_000_000, 100_000


def lookup_tables(queries: DataFrame, codebook: DataFrame, m: int, dims: int, key: str = "qid") -> DataFrame:
    """key, lut: for each query (key, vector) the distances of its slices to all centroids."""
    parts = slices(queries.select(key, "vector"), m, dims, [key])
    each = parts.withColumnRenamed("vector", "part").join(F.broadcast(codebook.select("pos", "code", "vector")), "pos")
    each = each.select(key, "pos", "code", squared_distance("part", "vector").alias("d"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "code", "d"))).alias("rows")).select(key, F.transform("rows", lambda r: r["d"]).alias("lut"))  # as many as centroids


def distance(lut: str, codes: str, k: int) -> Column:
    """The sum over positions of a table's value for each code."""
    at = F.transform(codes, lambda c, i: F.element_at(F.col(lut), (i * k + c + 1).cast("int")))
    return F.round(F.aggregate(at, F.lit(0.0), lambda s, x: s + x), PLACES)


def as_similarity(d: str = "distance") -> Column:
    return (1 - F.col(d) / 2).alias("similarity")


def pq_search(codes: DataFrame, codebook: DataFrame, query: DataFrame, n: int, m: int, k: int, dims: int, targets: DataFrame | None = None) -> DataFrame:
    """id, word, distance of the n nearest of all codes, or of a set, to one query (qid, vector)."""
    codes = within(codes, targets) if targets is not None else codes
    lut = lookup_tables(query, codebook, m, dims)
    near = codes.crossJoin(F.broadcast(lut)).select("id", "word", distance("lut", "codes", k).alias("distance"))
    return near.orderBy("distance", "id").limit(n)


_FOUND = "qid long, id long, word string, distance double"


def _distances(codes: np.ndarray, luts: np.ndarray) -> np.ndarray:
    """Rounded distances by query and row."""
    d = np.zeros((len(luts), len(codes)))
    for p in range(codes.shape[1]):
        d += luts[:, p, codes[:, p]]
    return np.round(d, PLACES)


def _best_codes(rows: pa.RecordBatch, qids: np.ndarray, luts: np.ndarray, m: int, n: int) -> Iterator[pa.RecordBatch]:
    """The n nearest rows (id, word, codes) of each query."""
    rows = rows.take(pa.array(np.argsort(rows.column("id").to_numpy(), kind="stable")))
    c = rows.column("codes").flatten().to_numpy().astype(np.int64).reshape(rows.num_rows, m)
    step = max(1, PRODUCT // max(1, rows.num_rows))
    for a in range(0, len(qids), step):
        d = _distances(c, luts[a : a + step])
        r, at = best_of(d, rows.column("id").to_numpy(), n, False)
        at = pa.array(at)
        found = [pa.array(qids[a : a + step][r]), rows.column("id").take(at), rows.column("word").take(at), pa.array(d[r, at.to_numpy()])]
        yield pa.RecordBatch.from_arrays(found, names=["qid", "id", "word", "distance"])


def _tables(luts: DataFrame, m: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers and tables of all queries in order, or None if they are more than a broadcast may hold."""
    limit = BROADCAST_ELEMENTS // (m * k) + 1
    few = luts.limit(limit).toArrow().sort_by("qid")
    if few.num_rows == limit:
        return None
    return few["qid"].to_numpy(), few["lut"].combine_chunks().flatten().to_numpy().reshape(few.num_rows, m, k)


def pq_batch(codes: DataFrame, codebook: DataFrame, queries: DataFrame, n: int, m: int, k: int, dims: int, targets: DataFrame | None = None) -> DataFrame:
    """qid, id, word, distance of the n nearest to each query, in one pass over the codes.

    Tables of all queries are broadcast if they are few; else both sides are dealt into blocks by hash and each pair of
    blocks meets once.
    """
    codes = (within(codes, targets) if targets is not None else codes).select("id", "word", "codes")
    luts = lookup_tables(queries, codebook, m, dims)
    few = _tables(luts, m, k)
    if few is None:
        near = _blocked(codes, luts, m, k, n)
    else:
        shared = codes.sparkSession.sparkContext.broadcast(few)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(shared.value[0]):
                    yield from _best_codes(batch, *shared.value, m, n)

        near = codes.mapInArrow(work, _FOUND)
    return top(near, ["qid"], [F.col("distance"), F.col("id")], n)


def _blocked(codes: DataFrame, luts: DataFrame, m: int, k: int, n: int) -> DataFrame:
    """Every block of tables with every block of codes."""
    nq, nt = luts.count() * m * k // BLOCK_ELEMENTS + 1, codes.count() // BLOCK_CODES + 1
    left = luts.select("*", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("tb"))
    right = codes.select("*", F.pmod(F.xxhash64("id"), F.lit(nt)).cast("int").alias("tb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "word": pa.array([], pa.string()), "distance": pa.array([], pa.float64())})
        if not x.num_rows or not y.num_rows:
            return empty
        tables = x["lut"].combine_chunks().flatten().to_numpy().reshape(x.num_rows, m, k)
        return pa.Table.from_batches(list(_best_codes(y.combine_chunks().to_batches()[0], x["qid"].to_numpy(), tables, m, n)))

    return left.groupBy("qb", "tb").cogroup(right.groupBy("qb", "tb")).applyInArrow(work, _FOUND)


def pq_nearest(codes: DataFrame, codebook: DataFrame, queries: DataFrame, m: int, k: int, dims: int) -> DataFrame:
    """id, qid, distance: the nearest query of each row of codes, of equal ones the lowest; only one row a code leaves a task.

    The queries are groups or centroids and few; more than a broadcast holds are taken in parts of that size.
    """
    luts = lookup_tables(queries, codebook, m, dims)
    few = _tables(luts, m, k)
    if few is None:
        parts = luts.count() * m * k // BLOCK_ELEMENTS + 1
        some = [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == j) for j in range(parts)]
        found = [pq_nearest(codes, codebook, q, m, k, dims) for q in some]
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        best = F.min(F.struct("distance", "qid")).alias("b")
        return every.groupBy("id").agg(best).select("id", "b.qid", "b.distance")
    shared = codes.sparkSession.sparkContext.broadcast(few)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, tables = shared.value
        for batch in batches:
            if batch.num_rows and len(qids):
                c = batch.column("codes").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, m)
                d = _distances(c, tables)
                at = d.argmin(axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(qids[at]), pa.array(d[at, np.arange(len(c))])], names=["id", "qid", "distance"])

    return codes.select("id", "codes").mapInArrow(work, "id long, qid long, distance double")


def verified(found: DataFrame, vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """qid, id, word, similarity: the n best of found (qid, id) by exact similarity."""
    exact = found.select("qid", "id").join(vectors.select("id", "word", "vector"), "id").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    exact = exact.select("qid", "id", "word", F.round(dot("q", "vector"), PLACES).alias("similarity"))
    return top(exact, ["qid"], [F.desc("similarity"), F.col("id")], n)


def pq_search_verified(vectors: DataFrame, codes: DataFrame, codebook: DataFrame, query: DataFrame, n: int, m: int, k: int, dims: int, pvf: int) -> DataFrame:
    """The pvf * n nearest by codes, then the n best of them by exact similarity."""
    found = pq_search(codes, codebook, query, n * pvf, m, k, dims).crossJoin(F.broadcast(query.select("qid")))
    return verified(found, vectors, query, n)
