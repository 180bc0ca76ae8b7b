"""Session settings of the search operators, kept in the session's configuration under ``vectide.``."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The defaults of the search settings.
DEFAULTS = {
    "pvf": 20,
    "w": 3,
    "alpha": 3,
    "confidence": 0.8,
    "method": 0,
    "use_targetlist": True,
    "long_codes_threshold": 10_000_000,
    "knn": "exact",
    "knn_in": "exact",
    "knn_batch": "ivfadc",
    "knn_join": "exact",
    "analogy": "3cosadd",
    "analogy_in": "3cosadd",
    "groups": "exact",
    "cluster": "exact",
    "statistics_table": "stat_vectors_word",
}
TABLES = ("vectors", "vectors_original", "pq_codes", "pq_codebook", "coarse", "residual_codes", "residual_codebook", "multi_coarse", "multi_codes", "multi_codebook")


def get(spark: SparkSession, name: str):
    """A setting, with the type of its default."""
    default = DEFAULTS[name]
    value = spark.conf.get(f"vectide.{name}", None)
    if value is None:
        return default
    return value.lower() == "true" if isinstance(default, bool) else type(default)(value)


def put(spark: SparkSession, name: str, value) -> None:
    if name not in DEFAULTS:
        raise KeyError(f"no setting {name}")
    spark.conf.set(f"vectide.{name}", str(value).lower() if isinstance(value, bool) else str(value))


def name_tables(spark: SparkSession, **names: str) -> None:
    """Names of the tables and views that hold vectors and indexes."""
    for role, name in names.items():
        if role not in TABLES:
            raise KeyError(f"no table {role}")
        spark.conf.set(f"vectide.table.{role}", name)


def table_name(spark: SparkSession, role: str) -> str:
    return spark.conf.get(f"vectide.table.{role}", role)
