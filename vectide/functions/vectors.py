"""Vectors as array columns: similarity, arithmetic, centroids, and their SQL forms.

Arithmetic is in DOUBLE whatever the element type. Null in gives null out; vectors of different lengths are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decimals to which similarities and distances are rounded before they order anything, and to which distances are before an argmin.
PLACES, FINE = 6, 9


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _zipped(a: Column | str, b: Column | str, f) -> Column:
    a, b = _col(a), _col(b)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different lengths"))
    return F.when(a.isNull() | b.isNull() | same.isNull(), F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(_zipped(a, b, lambda x, y: x * y))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return _sum(_zipped(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 if either vector is 0."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).when(both.isNotNull(), F.lit(0.0))


def cosine_similarity_norm(a: Column | str, b: Column | str) -> Column:
    """The similarity of vectors that are normalised already."""
    return dot(a, b)


def vec_minus(a: Column | str, b: Column | str) -> Column:
    return _zipped(a, b, lambda x, y: x - y)


def vec_plus(a: Column | str, b: Column | str) -> Column:
    return _zipped(a, b, lambda x, y: x + y)


def vec_normalize(a: Column | str) -> Column:
    """The vector at length 1; one of length 0 stays as it is."""
    a = _col(a)
    # an array of the norm alone binds it, so that it isn't summed anew for each element
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return F.when(a.isNotNull(), scaled[0])


def centroid(vectors: Column | str) -> Column:
    """The mean of an array of vectors; an empty vector for none."""
    vs = _col(vectors)
    zero = F.transform(F.element_at(vs, 1), lambda x: F.lit(0.0))
    total = F.aggregate(vs, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(vs) > 0, F.transform(total, lambda x: x / F.size(vs))).when(vs.isNotNull(), F.array().cast("array<double>"))


def grouped_centroid(rows: DataFrame, keys: list[str], vector: str, dims: int, out: str = "vector") -> DataFrame:
    """The mean vector of each group, as one average for each dimension: combined before the shuffle, no vectors gathered."""
    sums = rows.where(F.col(vector).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(F.col(vector)[k].cast("double")).alias(f"_{k}") for k in range(dims)])
    return sums.select(*keys, F.array(*[F.col(f"_{k}") / F.col("_n") for k in range(dims)]).alias(out))


def dimensions(vectors: DataFrame, column: str = "vector") -> int:
    """The length of the first vector, 0 without one."""
    row = vectors.select(F.size(column)).where(F.col(column).isNotNull()).first()
    return row[0] if row else 0


def erf(x: Column) -> Column:
    """The error function by a rational approximation, good to 1.5e-7."""
    # Abramowitz and Stegun, formula 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    size = F.abs(x)
    t = 1.0 / (1.0 + F.lit(p) * size)
    poly = F.lit(a[4])
    for c in (a[3], a[2], a[1], a[0]):
        poly = poly * t + F.lit(c)
    return F.signum(x) * (1.0 - poly * t * F.exp(-size * size))


_D = "ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_SQUARES = "aggregate(transform({0}, x -> x * x), 0D, (s, x) -> s + x)"
SQL_FUNCTIONS = {
    "cosine_similarity": (f"a {_D}, b {_D}", "DOUBLE", f"CASE WHEN {_SQUARES.format('a')} > 0 AND {_SQUARES.format('b')} > 0 THEN {_DOT} / (sqrt({_SQUARES.format('a')}) * sqrt({_SQUARES.format('b')})) WHEN a IS NOT NULL AND b IS NOT NULL THEN 0D END"),
    "cosine_similarity_norm": (f"a {_D}, b {_D}", "DOUBLE", _DOT),
    "vec_minus": (f"a {_D}, b {_D}", _D, "zip_with(a, b, (x, y) -> x - y)"),
    "vec_plus": (f"a {_D}, b {_D}", _D, "zip_with(a, b, (x, y) -> x + y)"),
    "vec_normalize": (f"a {_D}", _D, f"transform(array({_SQUARES.format('a')}), n -> transform(a, x -> CASE WHEN n > 0 THEN x / sqrt(n) ELSE x END))[0]"),
    "centroid": (f"vs ARRAY<{_D}>", _D, "transform(aggregate(vs, transform(vs[0], x -> 0D), (s, v) -> zip_with(s, v, (x, y) -> x + y)), x -> x / size(vs))"),
}


def register(spark: SparkSession) -> None:
    """The functions above by name in SQL, for this session; Spark inlines them as expressions."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
