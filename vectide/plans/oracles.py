"""DuckDB SQL with the rows of the catalog's queries, by name."""

from __future__ import annotations

DIMS, M, K, KM = 64, 8, 16, 8
N, PVF, W, ALPHA, CONFIDENCE = 5, 4, 3, 3, 0.8
SUB, HALF = DIMS // M, DIMS // 2

#: Each relation with the names of those that it needs; ``with_`` puts together what a query uses.
PARTS = {
    "v": "SELECT vec_id AS id, 'w' || vec_id AS word, embedding::DOUBLE[] AS v, label FROM embeddings",
    "o": "SELECT id, word, list_transform(v, lambda x: x * (1 + id % 5)) AS v FROM v",
    "q": "SELECT id AS qid, word AS query, v AS qv FROM v WHERE id % 50 = 0",
    "t": "SELECT * FROM v WHERE label < 5",
    "q1": "SELECT id AS qid, word AS query, v AS qv FROM v WHERE word = 'w1'",
    "ab": "SELECT a.id, a.v AS a, b.v AS b FROM v a JOIN o b ON b.id = a.id + 1",
    "cb": f"SELECT p AS pos, id AS code, list_slice(v, p * {SUB} + 1, p * {SUB} + {SUB}) AS c FROM v, range({M}) r(p) WHERE id < {K}",
    "codes": f"SELECT id, word, label, pos, min({{'d': round(pow(list_distance(list_slice(v, pos * {SUB} + 1, pos * {SUB} + {SUB}), c), 2), 9), 'c': code}}).c AS code FROM v, cb GROUP BY id, word, label, pos",
    "coarse": "SELECT label AS coarse_id, list(x ORDER BY pos) AS c FROM (SELECT label, pos, round(avg(v[pos]), 9) AS x FROM v, range(1, 65) r(pos) GROUP BY label, pos) GROUP BY label",
    "cells": "SELECT id, word, v, min({'d': round(pow(list_distance(v, c), 2), 9), 'c': coarse_id}).c AS coarse_id FROM v, coarse GROUP BY id, word, v",
    "res": f"SELECT id, word, coarse_id, [v[i] - c[i] for i in range(1, {DIMS + 1})] AS v FROM cells JOIN coarse USING (coarse_id)",
    "rcb": f"SELECT p AS pos, id AS code, list_slice(v, p * {SUB} + 1, p * {SUB} + {SUB}) AS c FROM res, range({M}) r(p) WHERE id < {K}",
    "rcodes": f"SELECT id, word, coarse_id, pos, min({{'d': round(pow(list_distance(list_slice(v, pos * {SUB} + 1, pos * {SUB} + {SUB}), c), 2), 9), 'c': code}}).c AS code FROM res, rcb GROUP BY id, word, coarse_id, pos",
    "mcb": f"SELECT p AS pos, id AS code, list_slice(v, p * {HALF} + 1, p * {HALF} + {HALF}) AS c FROM v, range(2) r(p) WHERE id < {KM}",
    "mcodes": f"SELECT id, word, label, sum(code * CASE pos WHEN 0 THEN 1 ELSE {KM} END)::INT AS coarse_id FROM (SELECT id, word, label, pos, min({{'d': round(pow(list_distance(list_slice(v, pos * {HALF} + 1, pos * {HALF} + {HALF}), c), 2), 9), 'c': code}}).c AS code FROM v, mcb GROUP BY id, word, label, pos) GROUP BY id, word, label",
    "lex": "SELECT row_number() OVER (ORDER BY n DESC, word) - 1 AS id, word FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word) QUALIFY id < (SELECT count(*) FROM embeddings)",
}
NEEDS = {"o": "v", "q": "v", "t": "v", "q1": "v", "ab": "o", "cb": "v", "codes": "cb", "coarse": "v", "cells": "coarse", "res": "cells", "rcb": "res", "rcodes": "rcb", "mcb": "v", "mcodes": "mcb", "lex": ""}


def with_(uses: str, body: str, **more: str) -> str:
    """A query with the relations that it uses, and more of its own in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, "").split():
            add(x)
        if name not in order:
            order.append(name)

    for name in uses.split():
        add(name)
    ctes = [f"{n} AS MATERIALIZED ({PARTS[n]})" for n in order] + [f"{n} AS MATERIALIZED ({x})" for n, x in more.items()]
    return f"WITH {', '.join(ctes)} {body}"


def numbers(source: str, keys: str = "id", vector: str = "v") -> str:
    return f"SELECT {keys}, pos::INT - 1 AS pos, round({vector}[pos]::DOUBLE, 6) AS val FROM {source}, range(1, {DIMS + 1}) r(pos)"


def best(select: str, source: str, part: str, order: str, n: int = N) -> str:
    return f"SELECT {select} FROM (SELECT *, row_number() OVER ({f'PARTITION BY {part}' if part else ''} ORDER BY {order}) AS r FROM ({source})) WHERE r <= {n}"


def sims(queries: str, rows: str) -> str:
    return f"SELECT qid, query, id, word, round(list_inner_product(qv, v), 6) AS similarity FROM {queries}, {rows}"


def _lut(queries: str, book: str) -> str:
    return f"SELECT qid, pos, code, pow(list_distance(list_slice(qv, pos * {SUB} + 1, pos * {SUB} + {SUB}), c), 2) AS d FROM {queries}, {book}"


def pq_rows(queries: str, where: str = "") -> str:
    """qid, id, word, distance of all codes."""
    return f"SELECT qid, id, word, round(sum(d), 6) AS distance FROM codes JOIN ({_lut(queries, 'cb')}) USING (pos, code) {where} GROUP BY qid, id, word"


ALL = [1.0 if j % 2 else -1.0 for j in range(DIMS)]
FIXED = f"SELECT 0 AS qid, '' AS query, {ALL}::DOUBLE[] AS qv"
OFFSET = "SELECT 0::BIGINT AS qid, '' AS query, {} AS qv FROM (SELECT [z.v[i] - x.v[i] + y.v[i] for i in range(1, 65)] AS u FROM v x, v y, v z WHERE x.word = 'w1' AND y.word = 'w2' AND z.word = 'w3')"
RAW = OFFSET.format("u")
UNIT = OFFSET.format("list_transform(u, lambda e: e / sqrt(list_inner_product(u, u)))")


def _ivf(queries: str, n: int, w: int) -> dict[str, str]:
    """Relations of a search in inverted lists; the last is near: qid, id, word, distance."""
    return {
        "cc": "SELECT coarse_id, count(*) AS rows FROM cells GROUP BY coarse_id",
        "turns": f"SELECT *, floor((row_number() OVER (PARTITION BY qid ORDER BY d, coarse_id) - 1) / {w}) AS turn FROM (SELECT qid, coarse_id, qv, c, rows, round(pow(list_distance(qv, c), 2), 9) AS d FROM {queries}, coarse JOIN cc USING (coarse_id))",
        "befores": "SELECT *, coalesce(sum(rows) OVER (PARTITION BY qid ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turns",
        "looked": f"SELECT qid, coarse_id, [qv[i] - c[i] for i in range(1, {DIMS + 1})] AS qv FROM befores WHERE before < {n}",
        "luts": f"SELECT qid, coarse_id, pos, code, pow(list_distance(list_slice(qv, pos * {SUB} + 1, pos * {SUB} + {SUB}), c), 2) AS d FROM looked, rcb",
        "near": "SELECT qid, id, word, round(sum(d), 6) AS distance FROM rcodes JOIN luts USING (coarse_id, pos, code) GROUP BY qid, id, word",
    }


def _erf(x: str) -> str:
    # Abramowitz and Stegun, formula 7.1.26.
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592)"
    return f"(sign({x}) * (1.0 - {poly} * {t} * exp(-({x}) * ({x}))))"


def _ivpq(queries: str, lists: bool, where: str = "label < 5", n: int = N) -> dict[str, str]:
    """Relations of a join on the multi-index; the last is chosen: qid, coarse_id."""
    spread = "(sqrt(size * p * (1 - p)) * ((total - size) / greatest(total - 1, 1)))"
    off = "(wanted - 0.5 - size * p)"
    z = f"(CASE WHEN {spread} > 0 THEN {off} / (CASE WHEN {spread} > 0 THEN {spread} ELSE 1 END * sqrt(2::DOUBLE)) ELSE 0 END)"
    sure = f"CASE WHEN {off} < 0 THEN 1.0 ELSE 0.0 END"
    conf = f"CASE WHEN wanted > size THEN 0 WHEN p <= 1e-12 THEN 0 WHEN p >= 1 - 1e-12 THEN {sure} WHEN {spread} > 0 THEN 1 - 0.5 * (1 + {_erf(z)}) ELSE {sure} END"
    return {
        "tc": f"SELECT coarse_id, count(*) AS n FROM mcodes WHERE {where} GROUP BY coarse_id",
        "st": "SELECT coarse_id, count(*)::DOUBLE / (SELECT count(*) FROM mcodes) AS f FROM mcodes GROUP BY coarse_id",
        "k": f"SELECT (SELECT sum(n) FROM tc)::DOUBLE AS size, (SELECT count(*) FROM mcodes)::DOUBLE AS total, greatest(0, ceil(log2(greatest(1, (SELECT sum(n) FROM tc)) / {n * ALPHA}.0)))::BIGINT + 1 AS rounds",
        "halves": f"SELECT qid, pos, code, pow(list_distance(list_slice(qv, pos * {HALF} + 1, pos * {HALF} + {HALF}), c), 2) AS d FROM {queries}, mcb",
        "ranked": f"SELECT x.qid, (x.code + {KM} * y.code)::INT AS coarse_id, row_number() OVER (PARTITION BY x.qid ORDER BY round(x.d + y.d, 9), x.code + {KM} * y.code) AS rank FROM halves x JOIN halves y ON x.qid = y.qid AND x.pos = 0 AND y.pos = 1",
        "shares": "SELECT r.*, round(coalesce(sum(coalesce(f, 0)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS share, sum(coalesce(n, 0)) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS held FROM ranked r LEFT JOIN st USING (coarse_id) LEFT JOIN tc USING (coarse_id)",
        "tries": f"SELECT *, {n * ALPHA}.0 * pow(2, turn) AS wanted, least(share, 1.0) AS p FROM shares, k, range(0, 40) u(turn) WHERE turn <= rounds",
        "ends": f"SELECT qid, turn, max(rank) AS last, max(held) AS held, any_value(wanted) AS wanted FROM tries WHERE round({conf}, 9) < {CONFIDENCE} GROUP BY qid, turn",
        "firsts": f"SELECT qid, min({{'t': turn, 'l': last}}) FILTER (held >= {'wanted' if lists else n}) AS f FROM ends GROUP BY qid",
        "chosen": "SELECT s.qid, s.coarse_id FROM shares s JOIN firsts USING (qid) WHERE f IS NULL OR s.rank <= f.l",
    }


def _ivpq_pq(queries: str, where: str = "label < 5") -> str:
    return f"SELECT qid, id, c.word, round(sum(d), 6) AS distance FROM mcodes c JOIN chosen USING (coarse_id) JOIN codes x USING (id) JOIN ({_lut(queries, 'cb')}) USING (qid, pos, code) WHERE c.{where} GROUP BY qid, id, c.word"


NAMED = "JOIN (SELECT qid, query FROM q) USING (qid)"
NOT = "word NOT IN ('w1', 'w2', 'w3')"


def _top_of(found: str) -> str:
    """The best of found ids by exact 3cosadd."""
    return f"SELECT word FROM v, ({RAW}) WHERE {NOT} AND id IN (SELECT id FROM ({found})) ORDER BY round(list_inner_product(qv, v), 6) DESC, id LIMIT 1"


def _half(a: str, b: str) -> str:
    return f"(list_inner_product({a}, {b}) + 1) / 2"


def _unit(u: str) -> str:
    return f"list_transform({u}, lambda e: CASE WHEN list_inner_product({u}, {u}) > 0 THEN e / sqrt(list_inner_product({u}, {u})) ELSE e END)"


def _direction(a: str, b: str, c: str, x: str) -> str:
    left, right = f"[{a}[i] - {b}[i] for i in range(1, 65)]", f"[{c}[i] - {x}[i] for i in range(1, 65)]"
    return f"round(list_inner_product({left}, {right}) / (sqrt(list_inner_product({left}, {left})) * sqrt(list_inner_product({right}, {right}))), 6)"


TRIPLE = "SELECT x.v AS v1, y.v AS v2, z.v AS v3 FROM {0} x, {0} y, {0} z WHERE x.word = 'w1' AND y.word = 'w2' AND z.word = 'w3'"
COSADD = "round(list_inner_product([v3[i] - v1[i] + v2[i] for i in range(1, 65)], v), 6)"
COSMUL = f"round({_half('v', 'v3')} * ({_half('v', 'v2')}) / ({_half('v', 'v1')} + 0.001), 6)"
COSADD2 = f"round(list_inner_product({_unit('[v1[i] - v2[i] + v[i] for i in range(1, 65)]')}, {_unit('v3')}), 6)"


def _clusters(rounds: int, k: int, pq: bool) -> str:
    """Rounds of assignment, by product or by the distance of codes, and averaging, unrolled."""
    more = {"c0": f"SELECT id + 1 AS cluster, v AS c FROM v WHERE id < {k}"}
    for j in range(rounds):
        if pq:
            more[f"d{j}"] = f"SELECT id, word, cluster, round(sum(pow(list_distance(list_slice(x.c, pos * {SUB} + 1, pos * {SUB} + {SUB}), cb.c), 2)), 6) AS d FROM c{j} x, codes JOIN cb USING (pos, code) GROUP BY id, word, cluster"
            more[f"a{j}"] = f"SELECT id, word, min({{'d': d, 'c': cluster}}).c AS cluster FROM d{j} GROUP BY id, word"
        else:
            more[f"a{j}"] = f"SELECT id, word, min({{'s': -round(list_inner_product(v, c), 9), 'c': cluster}}).c AS cluster FROM v, c{j} GROUP BY id, word"
        if j < rounds - 1:
            more[f"m{j}"] = f"SELECT cluster, list(x ORDER BY pos) AS c FROM (SELECT cluster, pos, round(avg(v[pos]), 9) AS x FROM a{j} JOIN v USING (id, word), range(1, 65) r(pos) GROUP BY cluster, pos) GROUP BY cluster"
            more[f"c{j + 1}"] = f"SELECT cluster, coalesce(m.c, x.c) AS c FROM c{j} x LEFT JOIN m{j} m USING (cluster)"
    return with_("v codes" if pq else "v", f"SELECT word, cluster::INT AS cluster FROM a{rounds - 1}", **more)


def _texts(rows: str, unit: bool) -> str:
    words = "SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents"
    means = f"SELECT doc_id, list(x ORDER BY pos) AS u FROM (SELECT doc_id, pos, avg(v[pos]) AS x FROM ({words}) JOIN lex USING (word) JOIN {rows} e ON e.id = lex.id, range(1, 65) r(pos) GROUP BY doc_id, pos) GROUP BY doc_id"
    vector = _unit("u") if unit else "u"
    return with_(f"lex {rows}", f"SELECT doc_id, (pos - 1)::INT AS pos, round(v[pos], 6) AS val FROM (SELECT doc_id, {vector} AS v FROM means), range(1, 65) r(pos)", means=means)


#: New words: terms of two neighbours, their normalised mean and ids after the largest.
NEW = {
    "means": "SELECT a.word || '_w' || (a.id + 1) AS word, CASE WHEN b.id IS NULL THEN a.v ELSE [(a.v[i] + b.v[i]) / 2 for i in range(1, 65)] END AS u FROM v a LEFT JOIN v b ON b.id = a.id + 1",
    "new": f"SELECT (SELECT max(id) FROM v) + row_number() OVER (ORDER BY word) AS id, word, {_unit('u')} AS v FROM means",
    "ncodes": PARTS["codes"].replace("FROM v, cb", "FROM (SELECT *, 0 AS label FROM new), cb"),
}
NEW_CELLS = {
    "ncells": PARTS["cells"].replace("FROM v, coarse", "FROM new, coarse"),
    "nres": PARTS["res"].replace("FROM cells", "FROM ncells"),
    "nrcodes": PARTS["rcodes"].replace("FROM res, rcb", "FROM nres, rcb"),
    "nmcodes": PARTS["mcodes"].replace("FROM v, mcb", "FROM (SELECT *, 0 AS label FROM new), mcb"),
}

_GROUPS = "(SELECT id AS gid, word AS grouptoken, v AS gv FROM v WHERE id < 10)"
_PQ1 = best("word, 1 - distance / 2 AS similarity", pq_rows("q1"), "", "distance, id")
_IVF1 = with_("q1 rcodes", best("word, 1 - distance / 2 AS similarity", "SELECT * FROM near", "", "distance, id"), **_ivf("q1", N, W))

SQL = {
    "cosine_pairs": with_("ab", "SELECT id, round(list_cosine_similarity(a, b), 6) AS sim, round(list_inner_product(a, b), 6) AS dot, round(pow(list_distance(a, b), 2), 6) AS dist FROM ab"),
    "cosine_pairs_sql": with_("ab", "SELECT id, round(list_cosine_similarity(a, b), 6) AS sim, round(list_inner_product(a, b), 6) AS dot FROM ab"),
    "vec_minus": with_("ab", numbers("(SELECT id, [a[i] - b[i] for i in range(1, 65)] AS v FROM ab)")),
    "vec_plus": with_("ab", numbers("(SELECT id, [a[i] + b[i] for i in range(1, 65)] AS v FROM ab)")),
    "vec_normalize": with_("o", numbers(f"(SELECT id, {_unit('v')} AS v FROM o)")),
    "centroid_by_label": with_("v", "SELECT label, (pos - 1)::INT AS pos, round(avg(v[pos]), 6) AS val FROM v, range(1, 65) r(pos) GROUP BY label, pos"),
    "centroid_array": with_("ab", numbers("(SELECT id, [(a[i] + b[i]) / 2 for i in range(1, 65)] AS v FROM ab)")),
    "codec_roundtrip": with_("v", numbers("(SELECT id, 4 * len(v)::INT AS n_bytes, v FROM v)", "id, n_bytes")),
    "word_similarity": with_("v", "SELECT x.word AS a, 'w' || (x.id + 7) AS b, round(list_inner_product(x.v, y.v), 6) AS similarity FROM v x LEFT JOIN v y ON y.id = x.id + 7"),
    "vector_word_similarity": with_("v", "SELECT x.word, round(list_inner_product(x.v, y.v), 6) AS similarity FROM v x, v y WHERE y.word = 'w1'"),
    "knn_exact": with_("q1", best("word, similarity", sims("q1", "v"), "", "similarity DESC, id")),
    "knn_vector": with_("v", best("word, similarity", sims(f"({FIXED})", "v"), "", "similarity DESC, id")),
    "knn_in_words": with_("q1 t", best("word, similarity", sims("q1", "t"), "", "similarity DESC, id")),
    "knn_in_ids": with_("q1 t", best("word, similarity", sims("q1", "t"), "", "similarity DESC, id")),
    "knn_in_vectors": with_("v", best("id, similarity", f"SELECT row_number() OVER (ORDER BY id) AS id, round(list_inner_product(qv, v), 6) AS similarity FROM ({FIXED}), v WHERE label = 3", "", "similarity DESC, id")),
    "knn_join_exact": with_("q t", best("query, word AS target, similarity", sims("q", "t"), "qid", "similarity DESC, id")),
    "knn_join_all": with_("v", best("qid AS query, word AS target, similarity", sims("(SELECT id AS qid, '' AS query, v AS qv FROM v)", "v"), "qid", "similarity DESC, id")),
    "knn_lateral": with_("q", best("query, word AS target, similarity", sims("q", "v"), "qid", "similarity DESC, id")),
    "analogy_scores": with_("o", f"SELECT word, {COSADD} AS cosadd, {COSMUL} AS cosmul, {_direction('w1', 'w2', 'w3', 'ov')} AS direction, {COSADD2} AS cosadd2 FROM (SELECT v.word, v.v, o.v AS ov FROM v JOIN o USING (id)), ({TRIPLE.format('v')}), (SELECT v1 AS w1, v2 AS w2, v3 AS w3 FROM ({TRIPLE.format('o')})) WHERE {NOT}"),
    "analogy_3cosadd": with_("v", f"SELECT word FROM v, ({TRIPLE.format('v')}) WHERE {NOT} ORDER BY {COSADD} DESC, id LIMIT 1"),
    "analogy_3cosmul": with_("v", f"SELECT word FROM v, ({TRIPLE.format('v')}) WHERE {NOT} ORDER BY {COSMUL} DESC, id LIMIT 1"),
    "analogy_pair_direction": with_("o", f"SELECT word FROM o, ({TRIPLE.format('o')}) WHERE {NOT} ORDER BY {_direction('v1', 'v2', 'v3', 'v')} DESC, id LIMIT 1"),
    "analogy_3cosadd_in": with_("v t", f"SELECT word FROM t, ({TRIPLE.format('v')}) WHERE {NOT} ORDER BY {COSADD} DESC, id LIMIT 1"),
    "analogy_3cosadd_pq": with_("codes", _top_of(best("id", pq_rows(f"({UNIT})"), "", "distance, id", PVF + 3))),
    "analogy_3cosadd_in_pq": with_("codes", _top_of(best("id", pq_rows(f"({UNIT})", "WHERE label < 5"), "", "distance, id", PVF + 3))),
    "analogy_3cosadd_ivfadc": with_("rcodes", _top_of(best("id", "SELECT * FROM near", "", "distance, id", PVF + 3)), uq=UNIT, **_ivf("uq", PVF + 3, W)),
    "analogy_3cosadd_in_ivpq": with_("mcodes codes", _top_of(best("id", _ivpq_pq("uq"), "", "distance, id", 4)), uq=UNIT, **_ivpq("uq", True, n=4)),
    "groups_exact": with_("v", f"SELECT word AS token, min({{'s': -round(list_inner_product(v, gv), 6), 'g': gid, 'w': grouptoken}}).w AS grouptoken FROM v, {_GROUPS} GROUP BY word"),
    "groups_pq": with_("codes", "SELECT word AS token, min({'d': distance, 'g': qid, 'w': 'w' || qid}).w AS grouptoken FROM (" + pq_rows("(SELECT id AS qid, v AS qv FROM v WHERE id < 10)") + ") GROUP BY word"),
    "cluster_seeded": _clusters(10, 4, False),
    "cluster_pq": _clusters(2, 4, True),
    "cluster_ivpq": _clusters(2, 4, True),
    "lexicon": with_("lex", "SELECT id, word FROM lex"),
    "tokenize_docs": _texts("v", True),
    "tokenize_raw_docs": _texts("o", False),
    "pq_encode": with_("codes", "SELECT id, pos::INT AS pos, code::INT AS code FROM codes"),
    "pq_counts": with_("codes", "SELECT cb.pos::INT AS pos, cb.code::INT AS code, count(c.id) AS count FROM cb LEFT JOIN codes c ON c.pos = cb.pos AND c.code = cb.code GROUP BY cb.pos, cb.code"),
    "pq_search": with_("codes q1", best("id, word, distance", pq_rows("q1"), "", "distance, id")),
    "pq_search_in": with_("codes q1", best("id, word, distance", pq_rows("q1", "WHERE label < 5"), "", "distance, id")),
    "knn_pq": with_("codes q1", _PQ1),
    "knn_in_pq": with_("codes q1", best("word, 1 - distance / 2 AS similarity", pq_rows("q1", "WHERE label < 5"), "", "distance, id")),
    "pq_batch": with_("codes q", f"SELECT query, word AS target, 1 - distance / 2 AS similarity FROM ({best('*', pq_rows('q', 'WHERE label < 5'), 'qid', 'distance, id')}) {NAMED}"),
    "pq_verified": with_("codes q1", best("word, similarity", f"SELECT * FROM ({sims('q1', 'v')}) WHERE id IN ({best('id', pq_rows('q1'), '', 'distance, id', N * PVF)})", "", "similarity DESC, id")),
    "ivfadc_encode": with_("rcodes", "SELECT id, coarse_id, pos::INT AS pos, code::INT AS code FROM rcodes"),
    "ivfadc_search": _IVF1,
    "settings_front": _IVF1,
    "ivfadc_batch": with_("q rcodes", f"SELECT query, word AS target, 1 - distance / 2 AS similarity FROM ({best('*', 'SELECT * FROM near', 'qid', 'distance, id')}) {NAMED}", **_ivf("q", N, 1)),
    "ivfadc_verified": with_("q1 rcodes", best("word, similarity", f"SELECT * FROM ({sims('q1', 'v')}) WHERE id IN ({best('id', 'SELECT * FROM near', '', 'distance, id', N * PVF)})", "", "similarity DESC, id"), **_ivf("q1", N * PVF, W)),
    "ivpq_cells": with_("mcodes", f"SELECT c::INT AS coarse_id, count(id) AS count FROM range({KM * KM}) r(c) LEFT JOIN mcodes ON coarse_id = c GROUP BY c"),
    "create_statistics": with_("mcodes", f"SELECT c::INT AS coarse_id, count(id) / (SELECT count(*) FROM mcodes WHERE label < 5)::DOUBLE AS coarse_freq, (SELECT count(*) FROM mcodes WHERE label < 5) AS total FROM range({KM * KM}) r(c) LEFT JOIN (SELECT * FROM mcodes WHERE label < 5) ON coarse_id = c GROUP BY c"),
    "ivpq_chosen_cells": with_("mcodes q", "SELECT qid, coarse_id FROM chosen", **_ivpq("q", False)),
    "knn_in_ivpq": with_("mcodes codes q1", best("word, 1 - distance / 2 AS similarity", _ivpq_pq("q1"), "", "distance, id"), **_ivpq("q1", True)),
    "ivpq_join_pq": with_("mcodes codes q", f"SELECT query, word AS target, 1 - distance / 2 AS similarity FROM ({best('*', _ivpq_pq('q'), 'qid', 'distance, id')}) {NAMED}", **_ivpq("q", True)),
    "ivpq_join_exact": with_("mcodes q t", best("query, word AS target, similarity", f"SELECT s.* FROM ({sims('q', 't')}) s JOIN mcodes USING (id) JOIN chosen USING (qid, coarse_id)", "qid", "similarity DESC, id"), **_ivpq("q", True)),
    "ivpq_join_verified": with_("mcodes codes q t", best("query, word AS target, similarity", f"SELECT s.* FROM ({sims('q', 't')}) s JOIN ({best('qid, id', _ivpq_pq('q'), 'qid', 'distance, id', N * PVF)}) USING (qid, id)", "qid", "similarity DESC, id"), **_ivpq("q", True)),
    "insert_batch_words": with_("cb", numbers("new", "id, word"), **NEW),
    "insert_batch_codes": with_("rcodes mcb cb", "SELECT id, pos::INT AS pos, code::INT AS code, 'pq' AS kind FROM ncodes UNION ALL SELECT id, pos::INT, code::INT, 'residual' FROM nrcodes UNION ALL SELECT id, 0, coarse_id, 'cell' FROM nmcodes", **NEW, **NEW_CELLS),
    "insert_batch_codebook": with_("cb", f"SELECT cb.pos::INT AS pos, cb.code::INT AS code, count(n.id) AS count, dim::INT AS dim, round(CASE WHEN count(n.id) = 0 THEN any_value(c[dim + 1]) ELSE sum(n.v[cb.pos * {SUB} + dim + 1]) / count(n.id) END, 6) AS val FROM cb LEFT JOIN (SELECT ncodes.*, new.v FROM ncodes JOIN new USING (id)) n ON n.pos = cb.pos AND n.code = cb.code, range({SUB}) r(dim) GROUP BY cb.pos, cb.code, dim", **NEW),
    "precision_at_k": with_("codes q", f"SELECT e.qid, count(f.id) / {N}::DOUBLE AS precision FROM ({best('qid, id', sims('q', 'v'), 'qid', 'similarity DESC, id')}) e LEFT JOIN ({best('qid, id', pq_rows('q'), 'qid', 'distance, id')}) f ON f.qid = e.qid AND f.id = e.id GROUP BY e.qid"),
}

UNIT_FIXED = f"SELECT 0::BIGINT AS qid, '' AS query, {[x / 8 for x in ALL]}::DOUBLE[] AS qv"
_PQF = best("word, 1 - distance / 2 AS similarity", pq_rows(f"({UNIT_FIXED})"), "", "distance, id")
_PQF_IN = best("word, 1 - distance / 2 AS similarity", pq_rows(f"({UNIT_FIXED})", "WHERE label < 5"), "", "distance, id")
_NEAR = "SELECT * FROM near"


def _verified(queries: str, found: str) -> str:
    return best("word, similarity", f"SELECT * FROM ({sims(queries, 'v')}) WHERE id IN ({found})", "", "similarity DESC, id")


def _precision(found: str) -> str:
    exact = best("qid, id", sims("q", "v"), "qid", "similarity DESC, id")
    return f"SELECT e.qid, count(f.id) / {N}::DOUBLE AS precision FROM ({exact}) e LEFT JOIN ({found}) f ON f.qid = e.qid AND f.id = e.id GROUP BY e.qid"


def _flat() -> dict[str, str]:
    """_ivpq over the cells of the coarse quantizer."""
    more = _ivpq("q", True)
    more["mcodes"] = "SELECT c.id, c.coarse_id, v.label FROM cells c JOIN v USING (id)"
    more["ranked"] = "SELECT qid, coarse_id, row_number() OVER (PARTITION BY qid ORDER BY round(pow(list_distance(qv, c), 2), 9), coarse_id) AS rank FROM q, coarse"
    del more["halves"]
    return {"mcodes": more.pop("mcodes"), **more}


_WHOLE = "SELECT id, label, list_transform(v, lambda x: round(x * 1024)) AS v FROM v"
_PAIR = "SELECT x.id, x.v AS a, y.v AS b FROM whole x JOIN whole y ON y.id = x.id + 1"
_TWO = {"whole": _WHOLE, "pair": _PAIR}
_CELLS_AFTER = "SELECT id, coarse_id FROM {0} UNION ALL SELECT id, coarse_id FROM {1}"

SQL |= {
    "knn_in_vector_arrays": with_("v", best("part, id, similarity", f"SELECT id // 50 AS part, id % 50 + 1 AS id, round(list_inner_product(qv, v), 6) AS similarity FROM ({FIXED}), v", "part", "similarity DESC, id", 2)),
    "knn_in_vector_words": with_("t", best("word, similarity", sims(f"({FIXED})", "t"), "", "similarity DESC, id")),
    "knn_in_vector_ids": with_("t", best("word, similarity", sims(f"({FIXED})", "t"), "", "similarity DESC, id")),
    "knn_batch_vectors_in": with_("q t", best("qid AS query, word AS target, similarity", sims("q", "t"), "qid", "similarity DESC, id")),
    "knn_pq_vector": with_("codes", _PQF),
    "knn_in_pq_vector_words": with_("codes", _PQF_IN),
    "knn_in_pq_vector_ids": with_("codes", _PQF_IN),
    "pq_verified_vector": with_("codes", _verified(f"({UNIT_FIXED})", best("id", pq_rows(f"({UNIT_FIXED})"), "", "distance, id", N * PVF))),
    "ivfadc_vector": with_("rcodes", best("word, 1 - distance / 2 AS similarity", _NEAR, "", "distance, id"), fq=UNIT_FIXED, **_ivf("fq", N, W)),
    "ivfadc_verified_vector": with_("rcodes", _verified("fq", best("id", _NEAR, "", "distance, id", N * PVF)), fq=UNIT_FIXED, **_ivf("fq", N * PVF, W)),
    "flat_chosen_cells": with_("cells q", "SELECT qid, coarse_id FROM chosen", **_flat()),
    "ivpq_targets_seen": with_("mcodes q", "SELECT qid, coalesce(sum(n), 0)::BIGINT AS seen FROM chosen LEFT JOIN tc USING (coarse_id) GROUP BY qid", **_ivpq("q", False)),
    "precision_ivfadc": with_("q rcodes", _precision(best("qid, id", _NEAR, "qid", "distance, id")), **_ivf("q", N, W)),
    "precision_pq_verified": with_("q codes", _precision(best("qid, id", f"SELECT s.* FROM ({sims('q', 'v')}) s JOIN ({best('qid, id', pq_rows('q'), 'qid', 'distance, id', N * PVF)}) USING (qid, id)", "qid", "similarity DESC, id"))),
    "similarity_quantiles": with_("v", f"SELECT quantile_cont(similarity, 0.2) AS p20, quantile_cont(similarity, 0.5) AS p50, quantile_cont(similarity, 0.8) AS p80 FROM ({best('similarity', sims('(SELECT id AS qid, 0 AS query, v AS qv FROM v)', 'v'), 'qid', 'similarity DESC, id')})"),
    "insert_batch_original": with_("cb o", numbers("raw", "id, word"), **NEW, raw="SELECT n.id, n.word, CASE WHEN b.id IS NULL THEN a.v ELSE [(a.v[i] + b.v[i]) / 2 for i in range(1, 65)] END AS v FROM o a LEFT JOIN o b ON b.id = a.id + 1 JOIN new n ON n.word = a.word || '_w' || (a.id + 1)"),
    "insert_snapshot": with_("rcodes mcb cb mcodes", f"SELECT 'residual' AS index, coarse_id, count(*) AS count FROM ({_CELLS_AFTER.format('cells', 'ncells')}) GROUP BY coarse_id UNION ALL SELECT 'multi', coarse_id, count(*) FROM ({_CELLS_AFTER.format('mcodes', 'nmcodes')}) GROUP BY coarse_id", **NEW, **NEW_CELLS),
    "codec_integers": with_("v", f"SELECT id, 4 * {DIMS} AS n_int, 2 * {DIMS} AS n_short, pos::INT - 1 AS pos, 2 * v[pos] AS val FROM whole, range(1, {DIMS + 1}) r(pos)", whole=_WHOLE),
    "bytes_similarity": with_("v", "SELECT id, round(list_cosine_similarity(a, b), 6) AS sim FROM pair", **_TWO),
    "bytes_arithmetic": with_("v", f"SELECT id, pos::INT - 1 AS pos, a[pos] - b[pos] AS less, a[pos] + b[pos] AS more FROM pair, range(1, {DIMS + 1}) r(pos)", **_TWO),
    "bytes_normalize": with_("v", "SELECT id, 1.0::DOUBLE AS norm, round(a[1] / sqrt(list_inner_product(a, a)), 4) + 0.0::DOUBLE AS first FROM pair", **_TWO),
    "bytes_centroid": with_("v", "SELECT label, (pos - 1)::INT AS pos, round(avg(v[pos]), 2) AS val FROM whole, range(1, 65) r(pos) GROUP BY label, pos", whole=_WHOLE),
    "text_vectors": with_("v", numbers("v", "word")),
}
