"""Analogies: a is to b as c is to which word?

The three words are looked up in one row, which is joined to all candidates; an unknown word gives no rows. The input
words are no answers, and ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import PLACES, dot, vec_minus, vec_normalize, vec_plus
from vectide.operators.knn import within


def triple(vectors: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """One row (v1, v2, v3) of the words' vectors."""
    found = [vectors.where(F.col("word") == w).select(F.col("vector").alias(f"v{k}")).limit(1) for k, w in enumerate((a, b, c), 1)]
    return found[0].crossJoin(found[1]).crossJoin(found[2])


def offset(vectors: DataFrame, a: str, b: str, c: str, unit: bool = False) -> DataFrame:
    """One row (qid, vector): c - a + b."""
    v = vec_plus(vec_minus("v3", "v1"), F.col("v2"))
    return triple(vectors, a, b, c).select(F.lit(0).cast("long").alias("qid"), (vec_normalize(v) if unit else v).alias("vector"))


def _half(x, y):
    return (dot(x, y) + 1) / 2


SCORES = {
    "3cosadd": lambda: dot(vec_plus(vec_minus("v3", "v1"), F.col("v2")), "vector"),
    "3cosmul": lambda: _half("vector", "v3") * _half("vector", "v2") / (_half("vector", "v1") + 0.001),
    "pair_direction": lambda: dot(vec_normalize(vec_minus("v1", "v2")), vec_normalize(vec_minus("v3", "vector"))),
    "cosadd2": lambda: dot(vec_normalize(vec_plus(vec_minus("v1", "v2"), F.col("vector"))), vec_normalize("v3")),
}


def ranked(vectors: DataFrame, a: str, b: str, c: str, method: str = "3cosadd", candidates: DataFrame | None = None) -> DataFrame:
    """id, word, score of all candidates (vectors by default). pair_direction is meant for vectors of their original length."""
    rows = (vectors if candidates is None else candidates).where(~F.col("word").isin(a, b, c))
    rows = rows.crossJoin(F.broadcast(triple(vectors, a, b, c)))
    return rows.select("id", "word", F.round(SCORES[method](), PLACES).alias("score"))


def analogy(vectors: DataFrame, a: str, b: str, c: str, method: str = "3cosadd", targets: DataFrame | None = None) -> DataFrame:
    """The best word, among a set of words or ids if there is one."""
    among = within(vectors, targets) if targets is not None else None
    return ranked(vectors, a, b, c, method, among).orderBy(F.desc("score"), "id").limit(1).select("word")


def analogy_from(vectors: DataFrame, found: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """The best word by exact 3cosadd among found (id), the answer of an index to offset(): ask it for 3 more than wanted, as the inputs drop out."""
    return analogy(vectors, a, b, c, "3cosadd", found.select("id"))
