"""Texts as vectors: the mean of the vectors of their distinct known words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import grouped_centroid, vec_normalize

#: A vocabulary of at most so many words is sent to every task.
BROADCAST_WORDS = 50_000


def tokenize(texts: DataFrame, vectors: DataFrame, dims: int, normalize: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, vector of each text that has a known word; words are split at single blanks and compared as they are, repeats count once."""
    words = texts.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("word"))
    known = vectors.select("word", "vector")
    few = known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    means = grouped_centroid(words.join(F.broadcast(known) if few else known, "word"), [key], "vector", dims)
    return means.select(key, (vec_normalize("vector") if normalize else F.col("vector")).alias("vector"))


def tokenize_all(texts: DataFrame, vectors: DataFrame, dims: int, normalize: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As tokenize, with an empty vector for texts without a known word."""
    found = tokenize(texts, vectors, dims, normalize, key, text)
    return texts.select(key).join(found, key, "left").select(key, F.coalesce("vector", F.array().cast("array<double>")).alias("vector"))


def lexicon(texts: DataFrame, size: int, text: str = "text") -> DataFrame:
    """id, word: the most frequent words, numbered from 0 by count and then by the word."""
    words = texts.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''").groupBy("word").count()
    first = words.orderBy(F.desc("count"), "word").limit(size)
    return first.select((F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1).cast("long").alias("id"), "word")
