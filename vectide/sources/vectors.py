"""Vector files: text and binary word vectors in, tables out, and stored indexes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.vectors import vec_normalize

#: Words of this many characters and more are left out of text files.
LONGEST_WORD = 100


def read_text(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """id, word, vector of a text file with a header ``n d`` and lines ``word v1 ... vd``.

    Lines of another width and long words are skipped. Ids are numbers of lines that grow along the file but have gaps;
    number_rows makes them dense.
    """
    lines = spark.read.text(path)
    header = lines.where(r"value rlike '^[0-9]+ [0-9]+$'").first()
    if header is None:
        raise ValueError(f"{path} has no header")
    dims = int(header[0].split(" ")[1])
    parts = F.split(F.rtrim("value"), " ")
    rows = lines.select(F.monotonically_increasing_id().alias("id"), parts.alias("p")).where((F.size("p") == dims + 1) & (F.length(F.col("p")[0]) < LONGEST_WORD))
    vector = F.transform(F.slice("p", 2, dims), lambda x: x.try_cast("float"))
    rows = rows.select("id", F.col("p")[0].alias("word"), vector.alias("vector")).where(~F.exists("vector", lambda x: x.isNull()))
    return rows.withColumn("vector", vec_normalize("vector")) if normalize else rows


def number_rows(rows: DataFrame, order: str = "id") -> DataFrame:
    """rows with dense ids from 0 in their order, by counts of range partitions and no single task.

    The sorted rows are written to the shared folder first, so that counts and numbers are of the same rows even if a
    task is run again.
    """
    spark = rows.sparkSession
    spread = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    path = f"{shared_folder(spark)}/vectide-numbered-{uuid.uuid4().hex}"
    spread.withColumn("_part", F.shiftright("_at", 33)).write.parquet(path)
    spread = spark.read.parquet(path)
    counts = sorted(spread.groupBy("_part").count().collect())  # a row a partition
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    numbered = spread.join(F.broadcast(offsets), "_part").withColumn(order, F.col("_start") + F.col("_at") - F.shiftleft("_part", 33))
    return numbered.select(rows.columns)


def write_text(vectors: DataFrame, path: str) -> None:
    """The lines of vectors as text files, without a header; write_header adds a file with one."""
    values = F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")
    vectors.select(F.concat_ws(" ", "word", values).alias("value")).write.mode("overwrite").text(path)


def write_header(vectors: DataFrame, path: str, dims: int) -> None:
    """One more file beside those of write_text, with the number of vectors and their width."""
    vectors.agg(F.concat_ws(" ", F.count("*").cast("string"), F.lit(str(dims))).alias("value")).write.mode("append").text(path)


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """id, word, vector of a binary word2vec file: a header ``n d``, then words, a blank and d little-endian floats. One file is one task, as its records have no fixed length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                data = data.as_buffer().to_pybytes()
                at = data.index(b"\n") + 1
                n, d = map(int, data[:at].split())
                ids, words, values = [], [], []
                for k in range(n):
                    end = data.index(b" ", at)
                    words.append(data[at:end].lstrip(b"\n").decode("utf-8", "replace"))
                    ids.append(k)
                    values.append(np.frombuffer(data, "<f4", d, end + 1))
                    at = end + 1 + 4 * d
                    if len(ids) == 10_000 or k == n - 1:
                        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * d)
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)))], names=["id", "word", "vector"])
                        ids, words, values = [], [], []

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "id long, word string, vector array<float>")


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both read and write: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectide-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def save_index(index: DataFrame, path: str) -> None:
    """Inverted lists as Parquet in a folder for each cell, so that searches read their cells only; each cell is written by one task or few."""
    index.repartition("coarse_id").write.mode("overwrite").partitionBy("coarse_id").parquet(path)


def save_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table or an index that was saved."""
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
