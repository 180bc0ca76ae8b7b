"""How good and how fast approximate search is."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_at_k(found: DataFrame, exact: DataFrame, k: int, key: str = "qid", item: str = "id") -> DataFrame:
    """key, precision: the share of the k exact neighbours that were found, for each query of exact."""
    hits = exact.select(key, item).join(found.select(key, item, F.lit(1).alias("hit")), [key, item], "left")
    return hits.groupBy(key).agg((F.count("hit") / F.lit(k)).alias("precision"))


def sample_words(vectors: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """So many different words, chosen by a seed."""
    return vectors.select("word").distinct().orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(n)


def timed(run: Callable[[], DataFrame], times: int = 3) -> tuple[float, float]:
    """Median and spread in seconds of writing a plan's rows nowhere."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    took.sort()
    return took[len(took) // 2], took[-1] - took[0]


def similarity_quantiles(pairs: DataFrame, shares: tuple[float, ...] = (0.2, 0.5, 0.8)) -> DataFrame:
    """Quantiles of the similarity of pairs."""
    return pairs.agg(*[F.percentile("similarity", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares])


def targets_seen(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """qid, seen: how many targets (id, coarse_id) lie in the cells (qid, coarse_id) of each query."""
    counts = targets.groupBy("coarse_id").count()
    return cells.join(counts, "coarse_id", "left").groupBy("qid").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("seen"))
