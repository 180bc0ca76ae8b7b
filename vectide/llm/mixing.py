"""Mixing sources to target weights by hash-threshold histograms.

Each document has a size in words and a hash that is uniform in [0, 2**52). A source with target T and size S is taken
floor(T / S) times whole, and the documents whose hash lies below a threshold once more. The threshold is found
without sorting: sizes are summed by source and hash bucket, and only the bucket in which the sum passes the budget is
summed again by finer buckets, until a bucket is one hash value. Thresholds of a larger budget are never smaller, so
mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import as_text, discard, hash_bits, join_small, stored, table, word_count

DIGITS, BITS, STEP = 13, 52, 13
#: Weights by rank of the source, repeating; the budget as a share of all sizes; the most often a document may be taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """skey, source, source_size -> with target. One row a source is all that meets in one task here.

    Targets are weight shares of the budget, cut at most times the source's size; what is cut goes to the others by
    weight. Filled from the source that is cut first: a source is cut if the budget reaches its own cut level.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("level", F.col("cap") / F.col("w"))
    upto = Window.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("all_w"), F.sum("cap").over(upto).alias("cum_cap"), F.sum("w").over(upto).alias("cum_w"))
    s = s.withColumn("budget", F.lit(share) * F.col("total"))
    s = s.withColumn("cut", F.col("cum_cap") + F.col("level") * (F.col("all_w") - F.col("cum_w")) <= F.col("budget"))
    s = s.select("*", F.sum(F.when(F.col("cut"), F.col("cap")).otherwise(0.0)).over(every).alias("cut_cap"), F.sum(F.when(F.col("cut"), F.col("w")).otherwise(0.0)).over(every).alias("cut_w"))
    free = F.col("w") * ((F.col("budget") - F.col("cut_cap")) / (F.col("all_w") - F.col("cut_w")))
    return s.select("skey", "source_size", F.when(F.col("cut"), F.col("cap")).otherwise(free).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (skey, rest: words wanted by threshold) -> skey, below: documents with a smaller hash are taken once more.

    The document at which the sum passes rest is taken if that brings the sum nearer. Each round sums only rows of
    the one bucket of each source that holds the boundary.
    """
    at = plan.select("skey", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    settled = []
    for shift in range(BITS - STEP, -1, -STEP):
        inside = rows.withColumn("bucket", F.shiftright("h", shift + STEP)).join(at, ["skey", "bucket"])
        sums = inside.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("incl", F.col("before") + F.sum("words").over(upto)).withColumn("excl", F.col("incl") - F.col("words"))
        fits = F.col("incl") <= F.col("rest") if shift else F.col("excl") + F.col("incl") <= 2 * F.col("rest")
        level = stored(sums.select("skey", "rest", "bucket", "excl", "incl", fits.alias("fits")), f"mix-{shift}")
        settled.append(level.where("fits").groupBy("skey").agg(F.shiftleft(F.max("bucket") + 1, shift).alias("below")))
        if shift:
            at = level.where("excl < rest and incl > rest").select("skey", "rest", "bucket", F.col("excl").alias("before"))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.groupBy("skey").agg(F.max("below").alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, **rule) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words, repeats counted), times; with carry also row.

    A null text has size 0; null is a source of its own and the last. Rows with equal ids share their hash and so are
    taken together. A source without words has target 0, and its documents are taken 0 times. Empty tables give no
    rows. Other input columns may have any names.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"), F.col(source_col).alias("source"), word_count(as_text(text_col)).alias("size"), hash_bits(ident, DIGITS).alias("h"), *([F.struct("*").alias("row")] if carry else []))
    kept = stored(every.drop("row"), "mix-rows")
    rows = kept.select("skey", "h", "size")
    sizes = stored(kept.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    plan = source_targets(sizes, **rule)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", times.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan, "mix-plan")
    plan = stored(plan.join(thresholds(rows, plan), "skey", "left").select("skey", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")), "mix-thresholds")
    discard(sizes)
    out = join_small(every if carry else kept, plan, "skey", F.col("h"))
    out = out.withColumn("times", F.when(F.col("source_size") > 0, F.col("whole") + (F.col("h") < F.col("below")).cast("long")).otherwise(0))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", *(["row"] if carry else []))


def op3_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("times")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, list_value(3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         2.0::DOUBLE * source_size AS cap
  FROM s),
c AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w,
         sum(cap) OVER o AS cum_cap, sum(w) OVER o AS cum_w, cap / w AS level
  FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cum_cap + level * (all_w - cum_w) <= budget AS cut FROM c),
g AS (
  SELECT *, sum(CASE WHEN cut THEN cap ELSE 0 END) OVER () AS cut_cap, sum(CASE WHEN cut THEN w ELSE 0 END) OVER () AS cut_w FROM f),
t AS (
  SELECT source, source_size, CASE WHEN cut THEN cap ELSE w * ((budget - cut_cap) / (all_w - cut_w)) END AS target FROM g),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
h AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS incl FROM d GROUP BY source, h),
x AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, (2 * h.incl - h.words)::DOUBLE <= 2 * (p.target - p.whole * p.source_size) AND h.words > 0 AS more
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.h = h.h)
SELECT doc_id, size, source_size, target, (size * (CASE WHEN source_size > 0 THEN whole + more::INT ELSE 0 END))::BIGINT AS taken FROM x
"""
