"""What the corpus operators share: stored intermediate tables, keyed hashes and size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many narrow rows may be broadcast; its rows are counted first.
BROADCAST_ROWS = 20_000
#: A small table that may not be broadcast is joined to a skewed one in so many salted copies.
SALTS = 64
#: A key of at most so many rows is no burden to a task.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectide-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vectide-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vectide_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_vectide_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def tidy(spark: SparkSession) -> None:
    """Let go of what finished jobs left with the driver. Their broadcasts and shuffle files stay until both garbage
    collectors have seen that no plan refers to them, and the C library keeps what Python has freed."""
    gc.collect()
    spark._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def as_text(col: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def spare(name: str, taken) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """The number of words, runs of anything but blank and tab to carriage return."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def hash_bits(key: Column, digits: int) -> Column:
    """The first hex digits of the MD5 of a text as a long; at most 15, so that it is never negative."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def join_small(rows: DataFrame, small: DataFrame, key: str, salt: Column) -> DataFrame:
    """rows left-joined to a stored table of one row a key: broadcast if its counted rows allow, else salted for hot keys."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = small.withColumn("_salt", salts)
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"], "left").drop("_salt")


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to a stored table whose column `count` says how many rows a key may have at most.

    A key of more than HOT rows, and of more than a BROADCAST_ROWS-th of all counted ones, would fill a task; there are
    at most BROADCAST_ROWS such entries, so they are broadcast and their rows stay where they are. All others merge.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    bar = max(HOT, total // BROADCAST_ROWS)
    hot, cold = counted.where(F.col(count) > bar), counted.where(F.col(count) <= bar)
    names = [*rows.columns, *(c for c in counted.columns if c not in keys)]
    if total <= HOT or hot.isEmpty():
        return rows.join(cold.hint("merge"), keys, how).select(names)
    mark = spare("_hot", names)
    marks = F.broadcast(hot.select(*keys).distinct().withColumn(mark, F.lit(True)))
    left = rows.join(marks, keys, "left_anti").join(cold.hint("merge"), keys, how)
    return rows.join(F.broadcast(hot), keys).select(names).unionByName(left.select(names))


def bitmap(keys: DataFrame, most_bits: int = 27) -> tuple[DataFrame, int]:
    """(part, bits) of a set of hashes (h), to be broadcast, and the bits of a hash that it looks at: 16 times as many places as keys, 16 MB at most."""
    bits = min(most_bits, max(15, (16 * keys.count()).bit_length()))
    h = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    parts = keys.select(F.shiftright(h, 15).alias("part"), h.bitwiseAND(F.lit(32767)).alias("at"))
    return parts.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")), bits


def in_bitmap(rows: DataFrame, found: DataFrame, bits: int, h: Column, out: str) -> DataFrame:
    """rows with a boolean: False if the hash is surely not in the set."""
    part, seen = spare("_part", rows.columns), spare("_bits", rows.columns)
    low = h.bitwiseAND(F.lit((1 << bits) - 1))
    at = low.bitwiseAND(F.lit(32767)).cast("int")
    both = rows.withColumn(part, F.shiftright(low, 15)).join(F.broadcast(found.select(F.col("part").alias(part), F.col("bits").alias(seen))), part, "left")
    byte = F.conv(F.hex(F.substr(F.col(seen), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0
    return both.withColumn(out, F.coalesce(hit, F.lit(False))).drop(part, seen)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
