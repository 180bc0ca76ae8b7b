"""Adding words to a vocabulary and its indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.operators import ivpq
from vectide.operators.codebooks import assign, encode, moved, slices
from vectide.operators.tokens import tokenize


@dataclass
class Indexes:
    """Tables of one vocabulary; codebooks keep running counts."""

    vectors: DataFrame
    codebook: DataFrame
    coarse: DataFrame
    residual_codebook: DataFrame
    multi: DataFrame
    m: int
    k_multi: int
    dims: int
    original: DataFrame | None = None


@dataclass
class Inserted:
    """Rows to append, and codebooks that replace the old ones. The multi-index shares the codebook of whole vectors, so its move is that one's; its coarse halves stay, as a cell's number must keep its meaning."""

    vectors: DataFrame
    original: DataFrame | None
    codes: DataFrame
    residual_codes: DataFrame
    multi_codes: DataFrame
    codebook: DataFrame
    residual_codebook: DataFrame


def new_words(vectors: DataFrame, terms: DataFrame, dims: int) -> DataFrame:
    """id, word, vector of terms (term) whose form with underscores is not a word yet and that have a known word.

    Ids go on from the largest in order of the word; a batch of terms is what one task numbers.
    """
    fresh = terms.select("term", F.replace("term", F.lit(" "), F.lit("_")).alias("word")).dropDuplicates(["word"]).join(vectors.select("word"), "word", "left_anti")
    found = tokenize(fresh.withColumnRenamed("word", "new"), vectors, dims, key="new", text="term").withColumnRenamed("new", "word")
    largest = vectors.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("largest"))
    number = F.row_number().over(Window.orderBy("word"))
    return found.withColumn("number", number).crossJoin(F.broadcast(largest)).select((F.col("largest") + F.col("number")).alias("id"), "word", "vector")


def insert_batch(base: Indexes, terms: DataFrame) -> Inserted:
    """The rows that a batch adds to the vectors and to each index, and the codebooks after it; append the rows and replace the codebooks."""
    added = new_words(base.vectors, terms, base.dims)
    codes = encode(added, base.codebook, ("id", "word"))
    rest = assign(added, base.coarse, ("id", "word"))
    residual = encode(rest, base.residual_codebook, ("id", "word", "coarse_id"))
    multi = ivpq.build(added, base.multi, base.codebook, base.k_multi)
    original = None
    if base.original is not None:
        form = F.replace("term", F.lit(" "), F.lit("_")).alias("new")
        raw = tokenize(terms.select("term", form).dropDuplicates(["new"]), base.original, base.dims, False, "new", "term")
        original = added.select("id", "word").join(raw.withColumnRenamed("new", "word"), "word").select("id", "word", "vector")
    return Inserted(added, original, codes, residual, multi, updated(base.codebook, added, codes, base), updated(base.residual_codebook, rest, residual, base))


def updated(codebook: DataFrame, vectors: DataFrame, codes: DataFrame, base: Indexes) -> DataFrame:
    """A codebook after these vectors have joined their codes."""
    own = codes.select("id", F.posexplode("codes").alias("pos", "code"))
    parts = slices(vectors, base.m, base.dims, ["id"]).join(own, ["id", "pos"]).select("pos", F.col("code").cast("int").alias("code"), "vector")
    return moved(codebook, parts, base.dims // base.m)
