"""Exact search as SQL table functions of a session, for queries that are written in SQL.

Each keeps its k best by a row number and not by a limit, so that it may be called for every row of a table by LATERAL.
"""

from __future__ import annotations

from vectide.functions.vectors import PLACES, register as register_scalars
from vectide.plans.frontend import Model

_DOT = "round(aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x), %d)" % PLACES
_V = "vectide_sql_vectors"


def _best(part: str, select: str, source: str, k: str) -> str:
    return f"SELECT {select} FROM (SELECT *, row_number() OVER ({part} ORDER BY similarity DESC, id) AS r FROM ({source})) WHERE r <= {k}"


def _near(queries: str, targets: str) -> str:
    return f"SELECT q.word AS query, v.id, v.word, {_DOT.format('q.vector', 'v.vector')} AS similarity FROM {queries} q CROSS JOIN {targets} v"


def _in(words: str) -> str:
    return f"(SELECT * FROM {_V} WHERE array_contains({words}, word))"


_ONE = f"(SELECT * FROM {_V} WHERE word = p_query)"
_OFFSET = f"(SELECT zip_with(zip_with(z.vector, x.vector, (a, b) -> a - b), y.vector, (a, b) -> a + b) AS vector, 'query' AS word FROM {_V} x, {_V} y, {_V} z WHERE x.word = p_a AND y.word = p_b AND z.word = p_c)"
_SET = "ARRAY<STRING>"

FUNCTIONS = {
    "knn": ("p_query STRING, p_k INT", "word STRING, similarity DOUBLE", _best("", "word, similarity", _near(_ONE, _V), "p_k")),
    "knn_in": (f"p_query STRING, p_k INT, p_set {_SET}", "word STRING, similarity DOUBLE", _best("", "word, similarity", _near(_ONE, _in("p_set")), "p_k")),
    "knn_batch": (f"p_queries {_SET}, p_k INT", "query STRING, target STRING, similarity DOUBLE", _best("PARTITION BY query", "query, word AS target, similarity", _near(_in("p_queries"), _V), "p_k")),
    "knn_join": (f"p_queries {_SET}, p_k INT, p_targets {_SET}", "query STRING, target STRING, similarity DOUBLE", _best("PARTITION BY query", "query, word AS target, similarity", _near(_in("p_queries"), _in("p_targets")), "p_k")),
    "analogy": ("p_a STRING, p_b STRING, p_c STRING", "word STRING", _best("", "word", _near(_OFFSET, f"(SELECT * FROM {_V} WHERE word NOT IN (p_a, p_b, p_c))"), "1")),
    "analogy_in": (f"p_a STRING, p_b STRING, p_c STRING, p_set {_SET}", "word STRING", _best("", "word", _near(_OFFSET, f"(SELECT * FROM {_V} WHERE word NOT IN (p_a, p_b, p_c) AND array_contains(p_set, word))"), "1")),
    "groups": (f"p_tokens {_SET}, p_groups {_SET}", "token STRING, grouptoken STRING", _best("PARTITION BY query", "query AS token, word AS grouptoken", _near(_in("p_tokens"), _in("p_groups")), "1")),
}


def register(model: Model) -> None:
    """The scalar functions, and the table functions above over a model's vectors, by name in SQL for this session."""
    spark = model.spark
    register_scalars(spark)
    model.vectors.selectExpr("id", "word", "transform(vector, x -> double(x)) AS vector").createOrReplaceTempView(_V)
    for name, (args, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {body}")
