"""Sharding by extendible hashing.

A row's hash is a string of 120 bits: 60 from its key, and 60 more from the key and the row's number, so that rows
which repeat a key can still be told apart. A shard is a bit prefix. The directory starts with one bucket and only
buckets over the byte limit split on further bits, until each fits or holds a single row.

Splitting works on sums: the rows of open buckets are counted by a prefix some bits longer, these cells are added up
for every shorter prefix, and each cell's shard is the shortest prefix that fits. Cells that are still too large stay
open for the next round, which reads their rows only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import as_text, discard, hash_bits, stored, table

HASH_BITS, DIGITS = 120, 15
#: The default limit of a shard in bytes of UTF-8 text.
LIMIT = 1 << 20
#: Bits that a round of cells goes beyond what even halving would need, and the bits of each later round.
SPARE, LATER = 3, 6


def directory(rows: DataFrame, limit: int = LIMIT) -> list[tuple[int, DataFrame]]:
    """rows (bits, bytes) -> for each round its depth and a stored table (cell, shard, shard_bytes, shard_docs); shard is null for cells still open."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, step, rounds, open_rows = 0, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE), [], rows
    while True:
        last, depth = depth, min(HASH_BITS, depth + step)
        cells = open_rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        cells = stored(cells, f"shard-cells-{depth}")
        nodes = cells.select("*", F.explode(F.sequence(F.lit(last), F.lit(depth))).alias("deep"))
        nodes = nodes.withColumn("node", F.expr("substring(cell, 1, deep)"))
        sums = nodes.groupBy("node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.length("node") == HASH_BITS))
        leaf = nodes.join(fits, "node").groupBy("cell").agg(F.min_by(F.struct("node", "shard_bytes", "shard_docs"), "deep").alias("leaf"))
        found = cells.select("cell").join(leaf, "cell", "left").select("cell", F.col("leaf.node").alias("shard"), F.col("leaf.shard_bytes"), F.col("leaf.shard_docs"))
        found = stored(found, f"shard-directory-{depth}")
        discard(cells)
        rounds.append((depth, found))
        still = found.where("shard is null").select("cell")
        if depth == HASH_BITS or still.isEmpty():
            return rounds
        open_rows = open_rows.withColumn("cell", F.substring("bits", 1, depth)).join(still, "cell").drop("cell")
        step = LATER


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, shard (its bit prefix), depth, shard_bytes, shard_docs; with carry also row.

    A null text has 0 bytes and a null id hashes as the empty text. A document larger than the limit gets a shard of
    its own, the only kind that exceeds it. Rows that repeat an id are spread by row number if their shard is too
    large, which holds as long as the input's files and their splits stay the same. An empty table gives no rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kept = docs.select(F.col(id_col).alias("id"), F.octet_length(as_text(text_col)).cast("long").alias("bytes"), key.alias("key"), F.monotonically_increasing_id().alias("uid"), *([F.struct("*").alias("row")] if carry else []))
    half = HASH_BITS // 2
    bits = F.concat(F.lpad(F.bin(hash_bits(F.col("key"), DIGITS)), half, "0"), F.lpad(F.bin(hash_bits(F.concat_ws("/", "key", F.col("uid").cast("string")), DIGITS)), half, "0"))
    kept = stored(kept, "shard-rows").withColumn("bits", bits)
    rounds = directory(kept.select("bits", "bytes"), limit)
    fields = ("shard", "shard_bytes", "shard_docs")
    out = kept
    for k, (depth, found) in enumerate(rounds):
        found = found.select(F.col("cell").alias(f"cell{k}"), *[F.col(f).alias(f"{f}{k}") for f in fields])
        out = out.withColumn(f"cell{k}", F.substring("bits", 1, depth)).join(found, f"cell{k}", "left")
    picked = {f: reduce(lambda a, b: F.coalesce(a, b), [F.col(f"{f}{k}") for k in range(len(rounds))]) for f in fields}
    return out.select(F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), picked["shard"].alias("shard"), F.length(picked["shard"]).alias("depth"), picked["shard_bytes"].alias("shard_bytes"), picked["shard_docs"].alias("shard_docs"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, **cols) -> None:
    """Write each shard's rows below path/shard=<bits>; a task writes whole shards, and a shard is as large as the limit."""
    rows = shard(docs, limit, carry=True, **cols)
    rows.select(F.concat(F.lit("b"), "shard").alias("shard"), "row.*").repartition("shard").write.partitionBy("shard").parquet(path)


def op1_extendible_shards(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


#: The SQL form adds up every prefix of up to 40 bits, which tells documents with different ids apart.
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         lpad(format('{{:b}}', ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
n AS (SELECT d.*, deep, substr(bits, 1, deep) AS node FROM d, range(0, 41) t(deep)),
s AS (SELECT node, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM n GROUP BY node),
f AS (SELECT * FROM s WHERE shard_bytes <= {LIMIT} OR shard_docs = 1)
SELECT doc_id, n_bytes, arg_min(f.node, deep) AS shard, min(deep)::INT AS depth,
       arg_min(shard_bytes, deep)::BIGINT AS shard_bytes, arg_min(shard_docs, deep)::BIGINT AS shard_docs
FROM n JOIN f ON n.node = f.node GROUP BY doc_id, n_bytes
"""
