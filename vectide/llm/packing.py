"""Packing into optimal length buckets.

Sequences are documents, or their parts of max_len words. The histogram of their lengths, at most max_len rows, goes to
the driver, where dynamic programming picks the bucket lengths with the least padding. In a bucket of length b a batch
holds budget // b sequences. Sequences are numbered within a bucket by hash without one task seeing them all: each
(bucket, hash shard) is numbered on its own and starts after the counts of the shards before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import as_text, hash_bits, stored, table, word_count

MAX_LEN, BUCKETS, BUDGET = 8192, 16, 65536
#: Sequences that a numbering shard holds on average, and the most bits of its number.
PER_SHARD, MOST_SHARD_BITS, DIGITS = 50_000, 16, 13


def bucket_lengths(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The bucket lengths, at most so many, that minimise total padding; of equal choices the shorter buckets first.

    cost[k][j] is the least padded size of the j shortest lengths in k buckets. The best last cut moves right with j,
    so each k is solved by divide and conquer in m log m steps.
    """
    order = np.argsort(lengths)
    size = np.asarray(lengths, dtype=np.int64)[order]
    upto = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64)[order])])
    m = len(size)
    buckets = min(buckets, m)
    if not m:
        return []
    cost, cuts = np.concatenate([[0], size * upto[1:]]), []
    for k in range(2, buckets + 1):
        new, cut = cost.copy(), np.zeros(m + 1, dtype=np.int64)
        todo = [(k, m, k - 1, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(max(first, k - 1), min(last, j - 1) + 1)
            total = cost[i] + size[j - 1] * (upto[j] - upto[i])
            best = int(np.argmin(total))
            new[j], cut[j] = total[best], i[best]
            todo += [(lo, j - 1, first, int(i[best])), (j + 1, hi, int(i[best]), last)]
        cost = new
        cuts.append(cut)
    ends, j = [], m
    for cut in reversed(cuts):
        ends.append(int(size[j - 1]))
        j = int(cut[j])
    return sorted([*ends, int(size[j - 1])])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence: id, part, length, bucket_len, batch, slot.

    A document of n words has ceil(n / max_len) parts. One without words is a row with length and bucket_len 0 and no
    batch. A batch is identified by bucket_len and batch; all batches of a bucket but its last are full. Repeated rows
    are sequences of their own. An empty table gives no rows; other input columns may have any names.
    """
    rows = docs.select(F.col(id_col).alias("id"), word_count(as_text(text_col)).alias("words"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / max_len)).cast("long")))
    rows = rows.select("id", "words", parts.alias("part"))
    key = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("part").cast("string"))
    rows = rows.select("id", "part", F.least(F.lit(max_len), F.col("words") - F.col("part") * max_len).cast("long").alias("length"), hash_bits(key, DIGITS).alias("h"))
    rows = stored(rows, "pack-rows")

    histogram = rows.where("length > 0").groupBy("length").count().collect()
    bounds = bucket_lengths([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bits = min(MOST_SHARD_BITS, max(0, sum(r[1] for r in histogram) // PER_SHARD).bit_length())
    bucket = F.lit(0).cast("long")
    for b in reversed(bounds):
        bucket = F.when((F.col("length") > 0) & (F.col("length") <= b), F.lit(b).cast("long")).otherwise(bucket)
    rows = rows.withColumn("bucket_len", bucket).withColumn("shard", F.shiftright("h", 4 * DIGITS - bits))
    full = rows.where("bucket_len > 0")
    before = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = full.groupBy("bucket_len", "shard").count().select("bucket_len", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("h", "id", "part"))
    full = full.withColumn("own", own).join(starts, ["bucket_len", "shard"]).withColumn("at", F.col("start") + F.col("own") - 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    full = full.select("id", "part", "length", "bucket_len", F.floor(F.col("at") / room).cast("long").alias("batch"), (F.col("at") % room).alias("slot"))
    none = rows.where("bucket_len = 0").select("id", "part", "length", "bucket_len", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("slot"))
    return full.unionByName(none).withColumnRenamed("id", id_col)


def op7_pack_lengths(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def _dp_sql() -> str:
    """The dynamic programme unrolled, a step for each bucket; for small histograms only."""
    steps = ["c1 AS MATERIALIZED (SELECT j, len * upto AS cost, 0::BIGINT AS cut FROM l)"]
    for k in range(2, BUCKETS + 1):
        steps.append(f"c{k} AS MATERIALIZED (SELECT j, b.c AS cost, b.i AS cut FROM (SELECT l.j, min({{'c': p.cost + l.len * (l.upto - q.upto), 'i': p.j}}) AS b FROM c{k - 1} p JOIN l q ON q.j = p.j JOIN l ON l.j > p.j GROUP BY l.j))")
    back = [f"b{BUCKETS} AS (SELECT max(j) AS j FROM l)"]
    back += [f"b{k - 1} AS (SELECT cut AS j FROM c{k} JOIN b{k} USING (j))" for k in range(BUCKETS, 1, -1)]
    ends = " UNION ALL ".join(f"SELECT j FROM b{k}" for k in range(1, BUCKETS + 1))
    return ",\n".join([*steps, *back, f"ends AS (SELECT len AS bucket_len FROM l JOIN ({ends}) USING (j))"])


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM documents),
s AS (
  SELECT doc_id, part, least({MAX_LEN}, words - part * {MAX_LEN}) AS length,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || part), 1, {DIGITS}))::BIGINT AS h
  FROM (SELECT doc_id, words, unnest(range(greatest(1, (words + {MAX_LEN - 1}) // {MAX_LEN}))) AS part FROM d)),
g AS (SELECT length AS len, count(*) AS n FROM s WHERE length > 0 GROUP BY length),
l AS MATERIALIZED (SELECT len, row_number() OVER (ORDER BY len) AS j, sum(n) OVER (ORDER BY len)::BIGINT AS upto FROM g),
{_dp_sql()},
a AS (SELECT doc_id, part, length, h, (SELECT min(bucket_len) FROM ends WHERE bucket_len >= length) AS bucket_len FROM s WHERE length > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY h, doc_id, part) - 1 AS pos, greatest(1, {BUDGET} // bucket_len) AS room FROM a)
SELECT doc_id, part, length, bucket_len, pos // room AS batch, pos % room AS slot FROM n
UNION ALL SELECT doc_id, part, length, 0, NULL, NULL FROM s WHERE length = 0
"""
