"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are equal if their texts are identical without blanks and tab to carriage return. The byte length is the
first digit and then come successive bytes of the text in widening runs. In each round a group is split by its next
run; groups of one row and texts that have ended leave, and only the others are read on. Group numbers are handed out
by a stored table, so equality rests on the compared bytes alone and no digest is trusted.

Only per-group counts with map-side combining and equi-joins with a stored table are used. A group of copies with a
third of all rows is one counted row, which goes to the rows instead of gathering them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import as_text, bitmap, discard, in_bitmap, join_counted, stored, table, tidy

BLANKS = " \t\n\x0b\x0c\r"
#: Bytes compared in the first round and in the second; each later round takes WIDEN times as many as the one before.
FIRST, SECOND, WIDEN = 64, 4096, 16


def normalised(text: Column) -> Column:
    """The text without blanks, as UTF-8 bytes."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, text).cast("binary")


def _regroup(rows: DataFrame, groups: DataFrame, end: int, text: Column) -> DataFrame:
    """rows with their new group, null for a row that is alone, and their text if it goes on beyond end."""
    split = join_counted(rows, groups, ["grp", "n", "chunk"], "rows", "left")
    going = F.col("next").isNotNull() & (F.col("n") > end)
    kept = ("id", "points", "sha", "n", F.col("next").alias("grp"), going.alias("going"), "row")
    return split.select(*kept, F.when(going, text).alias("text"), F.monotonically_increasing_id().alias("uid"))


def _groups(rows: DataFrame, level: int) -> DataFrame:
    """The groups of more than one row, stored with a number each."""
    groups = rows.groupBy("grp", "n", "chunk").agg(F.count("*").alias("rows")).where("rows > 1")
    return stored(groups.select("grp", "n", "chunk", "rows", F.monotonically_increasing_id().alias("next")), f"radix-groups-{level}")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, first: int = FIRST, second: int = SECOND
) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256; with carry also row, a struct of all input columns.

    A null text is an empty one; all empty texts are equal. Of equal texts, the row with the most code points before
    normalisation stays, then the smallest id (null last), then any one of rows that repeat. Texts of any length are
    compared whole. An empty table gives no rows. Other input columns may have any names.

    Rows whose first digits are surely alone, by a bitmap of the groups' hashes, never move; those of very large groups
    stay where they are in every round, and the others move with what is left of their text to compare.
    """
    text, whole = as_text(text_col), F.struct("*")
    row = (whole if carry else F.lit(None).cast("int")).alias("row")
    base = docs.select(F.col(id_col).alias("id"), F.length(text).alias("points"), row, text.alias("text"), normalised(text).alias("norm"))
    base = base.withColumn("n", F.octet_length("norm").cast("long")).withColumn("grp", F.lit(0).cast("long"))
    base = base.withColumn("chunk", F.substring("norm", 1, first))
    # a text that travels in its row does not travel twice
    travelling = as_text(f"row.`{text_col}`") if carry else F.col("text")

    groups = _groups(base.select("grp", "n", "chunk"), 0)
    key = F.xxhash64("n", "chunk")
    bits, width_of = bitmap(groups.select(key.alias("h")))
    bits = stored(bits, "radix-bitmap")
    base = in_bitmap(base.withColumn("sha", F.sha2("norm", 256)), bits, width_of, key, "maybe")
    alone = base.where("not maybe").select("id", "sha", "row")
    rows = base.where("maybe").drop("norm", "maybe", *(["text"] if carry else []))

    done, spent, off, width, level = [], [], 0, first, 0
    while True:
        tidy(docs.sparkSession)
        split = stored(_regroup(rows, groups, off + width, travelling if level == 0 else F.col("text")), f"radix-rows-{level}")
        discard(groups)
        spent.append(split)
        alone = alone.unionByName(split.where("grp is null").select("id", "sha", "row"))
        done.append(split.where("not going and grp is not null").select("id", "points", "sha", "row", "uid", F.lit(level).alias("level"), "grp"))
        off, width, level = off + width, second if level == 0 else width * WIDEN, level + 1
        left = split.where("going")
        if left.isEmpty():
            break
        rows = left.select("id", "points", "text", "row", "n", "sha", "grp", F.substring(normalised(F.col("text")), off + 1, width).alias("chunk"))
        groups = _groups(rows, level)

    ended = reduce(DataFrame.unionByName, done)
    rank = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    best = stored(ended.groupBy("level", "grp").agg(F.min(rank).alias("best"), F.count("*").alias("rows")), "radix-best")
    copies = join_counted(ended, best, ["level", "grp"], "rows").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("rows").cast("long").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "row",
    )
    alone = alone.select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "row",
    )
    out = alone.unionByName(copies)
    return out if carry else out.drop("row")


def op8_radix_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
