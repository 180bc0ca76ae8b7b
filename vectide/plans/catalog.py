"""The queries of the embedding operators over the test tables; their SQL is in oracles.

Words are ``w<vec_id>``, vectors the table's embeddings, which have length 1. Queries are the words whose id is
divisible by 50, the target set those of label 0 to 4. Codebooks are seeded, so results are the same everywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import codecs, settings, vectors as vf
from vectide.operators import analogy, codebooks, evaluation, grouping, insertion, ivfadc, ivpq, knn, pq, tokens
from vectide.plans import oracles
from vectide.plans.frontend import Model
from vectide.sources import vectors as source

DIMS, M, K, K_MULTI = 64, 8, 16, 8
N, PVF, W, ALPHA, CONFIDENCE = 5, 4, 3, 3, 0.8
WORDS = ("w1", "w2", "w3")
SIZE = (M, K, DIMS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str) -> Model:
    rows = table(spark, sf_dir, "embeddings")
    base = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    original = base.withColumn("vector", F.transform("vector", lambda x: x.cast("double") * (1 + F.col("id") % 5)))
    coarse = vf.grouped_centroid(rows.select(F.col("label").alias("coarse_id"), F.col("embedding").alias("vector")), ["coarse_id"], "vector", DIMS)
    coarse = coarse.select("coarse_id", F.transform("vector", lambda x: F.round(x, vf.FINE)).alias("vector"))
    return Model(spark, base, original, coarse, DIMS, M, K, K_MULTI)


_saved: dict[tuple[str, str], str] = {}


def indexed(spark: SparkSession, sf_dir: str) -> Model:
    """The model with its indexes written once a session, as searches find them."""
    m, key = model(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _saved:
        path = f"{source.shared_folder(spark)}/vectide-index-{uuid.uuid4().hex}"
        m.save(path)
        _saved[key] = path
    return m.load(_saved[key])


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"), F.concat(F.lit("w"), "vec_id").alias("word"))


def query_words(m: Model) -> DataFrame:
    return m.vectors.where("id % 50 = 0").select("word")


def numbers(rows: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    """A row for each element of a vector, rounded."""
    return rows.select(*keys, F.posexplode(vector).alias("pos", "val")).select(*keys, "pos", F.round(F.col("val").cast("double"), vf.PLACES).alias("val"))


def _code_rows(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("codes").alias("pos", "code")).select(*keys, "pos", F.col("code").cast("int").alias("code"))


def _next(m: Model) -> DataFrame:
    """Each vector a and its successor b."""
    after = m.original.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b"))
    return m.vectors.select("id", F.col("vector").alias("a")).join(after, "id")


# scalars and aggregates


def cosine_pairs(spark, sf):
    return _next(model(spark, sf)).select("id", F.round(vf.cosine_similarity("a", "b"), 6).alias("sim"), F.round(vf.cosine_similarity_norm("a", "b"), 6).alias("dot"), F.round(vf.squared_distance("a", "b"), 6).alias("dist"))


def cosine_pairs_sql(spark, sf):
    vf.register(spark)
    return _next(model(spark, sf)).selectExpr("id", "round(cosine_similarity(a, b), 6) AS sim", "round(cosine_similarity_norm(a, b), 6) AS dot")


def vec_minus(spark, sf):
    return numbers(_next(model(spark, sf)).select("id", vf.vec_minus("a", "b").alias("vector")), "id")


def vec_plus(spark, sf):
    return numbers(_next(model(spark, sf)).select("id", vf.vec_plus("a", "b").alias("vector")), "id")


def vec_normalize(spark, sf):
    return numbers(model(spark, sf).original.select("id", vf.vec_normalize("vector").alias("vector")), "id")


def centroid_by_label(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    return numbers(vf.grouped_centroid(rows, ["label"], "vector", DIMS), "label")


def centroid_array(spark, sf):
    return numbers(_next(model(spark, sf)).select("id", vf.centroid(F.array(F.transform("a", lambda x: x.cast("double")), F.col("b"))).alias("vector")), "id")


def codec_roundtrip(spark, sf):
    packed = model(spark, sf).vectors.select("id", codecs.vec_to_bytes("vector").alias("bytes"))
    return numbers(packed.select("id", F.length("bytes").alias("n_bytes"), codecs.read_bytes("bytes").alias("vector")), "id", "n_bytes")


def word_similarity(spark, sf):
    m = model(spark, sf)
    pairs = m.vectors.select(F.col("word").alias("a"), F.concat(F.lit("w"), F.col("id") + 7).alias("b"))
    return knn.word_similarity(m.vectors, pairs)


def vector_word_similarity(spark, sf):
    m = model(spark, sf)
    return knn.similarity_to(m.vectors, m.vectors, "w1").select("word", "similarity")


# exact search


def knn_exact(spark, sf):
    return model(spark, sf).knn("w1", N)


def knn_vector(spark, sf):
    return model(spark, sf).knn([1.0 if j % 2 else -1.0 for j in range(DIMS)], N)


def knn_in_words(spark, sf):
    return model(spark, sf).knn_in("w1", N, targets(spark, sf).select("word"))


def knn_in_ids(spark, sf):
    return model(spark, sf).knn_in("w1", N, targets(spark, sf).select("id"))


FIXED = [1.0 if j % 2 else -1.0 for j in range(DIMS)]


def knn_in_vectors(spark, sf):
    """The vectors of label 3 are an array; its nearest to a fixed query by position."""
    rows = table(spark, sf, "embeddings").where("label = 3").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    return knn.knn_in_vectors(rows, [1.0 if j % 2 else -1.0 for j in range(DIMS)], N).select(F.col("id").cast("long").alias("id"), "similarity")


def knn_in_vector_arrays(spark, sf):
    """All vectors as arrays of at most 50; the nearest to a fixed query by position of each array."""
    rows = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("part"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    near = knn.knn_in_vector_rows(rows, FIXED, 2, ["part"])
    return near.select("part", F.col("id").cast("long").alias("id"), "similarity")


def knn_in_vector_words(spark, sf):
    return model(spark, sf).knn_in(FIXED, N, targets(spark, sf).select("word"))


def knn_in_vector_ids(spark, sf):
    return model(spark, sf).knn_in(FIXED, N, targets(spark, sf).select("id"))


def knn_batch_vectors_in(spark, sf):
    m = model(spark, sf)
    return knn.knn_join_vectors(m.vectors, m.vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), N, targets(spark, sf).select("id"))


def knn_join_exact(spark, sf):
    m = model(spark, sf)
    return m.knn_join(query_words(m), N, targets(spark, sf).select("word"))


def knn_join_all(spark, sf):
    """Every vector with its nearest among all."""
    m = model(spark, sf)
    return knn.knn_join_vectors(m.vectors, m.vectors.select(F.col("id").alias("qid"), "vector"), N)


def knn_lateral(spark, sf):
    """Neighbours of each row by LATERAL, from pairs that come as matrix products: k of each query and not all."""
    m = model(spark, sf)
    known = m.words(query_words(m))
    known.createOrReplaceTempView("vectide_queries")
    knn.knn_pairs(known, m.vectors, N).createOrReplaceTempView("vectide_near")
    return spark.sql(f"""
        SELECT q.query, n.word AS target, n.similarity
        FROM vectide_queries q,
        LATERAL (SELECT t.word, t.similarity, t.id FROM vectide_near t WHERE t.qid = q.qid ORDER BY t.similarity DESC, t.id LIMIT {N}) n""")


# analogies


def _analogy(how, among=False):
    def run(spark, sf):
        m = model(spark, sf)
        return m.analogy(*WORDS, how, targets(spark, sf).select("id") if among else None)

    return run


def analogy_scores(spark, sf):
    """All three scores of every candidate."""
    m = model(spark, sf)
    out = None
    for how in ("3cosadd", "3cosmul", "pair_direction", "cosadd2"):
        x = analogy.ranked(m.original if how == "pair_direction" else m.vectors, *WORDS, how).select("word", F.col("score").alias(how))
        out = x if out is None else out.join(x, "word")
    return out.select("word", F.col("3cosadd").alias("cosadd"), F.col("3cosmul").alias("cosmul"), F.col("pair_direction").alias("direction"), "cosadd2")


def analogy_3cosadd_pq(spark, sf):
    m = indexed(spark, sf)
    query = analogy.offset(m.vectors, *WORDS, unit=True)
    return analogy.analogy_from(m.vectors, m.pairs("pq", query, PVF + 3), *WORDS)


def analogy_3cosadd_in_pq(spark, sf):
    m = indexed(spark, sf)
    query = analogy.offset(m.vectors, *WORDS, unit=True)
    return analogy.analogy_from(m.vectors, m.pairs("pq", query, PVF + 3, targets(spark, sf).select("id")), *WORDS)


def analogy_3cosadd_ivfadc(spark, sf):
    m = indexed(spark, sf)
    query = analogy.offset(m.vectors, *WORDS, unit=True)
    return analogy.analogy_from(m.vectors, m.pairs("ivfadc", query, PVF + 3), *WORDS)


def analogy_3cosadd_in_ivpq(spark, sf):
    m = indexed(spark, sf)
    query = analogy.offset(m.vectors, *WORDS, unit=True)
    return analogy.analogy_from(m.vectors, m.pairs("ivpq", query, 4, targets(spark, sf).select("id")), *WORDS)


# groups, clusters, texts


def groups_exact(spark, sf):
    m = model(spark, sf)
    return m.groups(m.vectors.select("word"), spark.createDataFrame([(f"w{k}",) for k in range(10)], "word string"), "exact")


def groups_pq(spark, sf):
    m = indexed(spark, sf)
    return m.groups(m.vectors.select("word"), spark.createDataFrame([(f"w{k}",) for k in range(10)], "word string"), "pq")


def cluster_seeded(spark, sf):
    m = model(spark, sf)
    return m.cluster(m.vectors.select("id"), 4, "exact", [0, 1, 2, 3])


def cluster_pq(spark, sf):
    m = indexed(spark, sf)
    return m.cluster(m.vectors.select("id"), 4, "pq", [0, 1, 2, 3], rounds=2)


def cluster_ivpq(spark, sf):
    """With every cell visited, so that all tokens are assigned."""
    m = indexed(spark, sf)
    return m.cluster(m.vectors.select("id"), 4, "ivpq", [0, 1, 2, 3], rounds=2)


def _lexicon(spark, sf):
    m = model(spark, sf)
    words = tokens.lexicon(table(spark, sf, "documents"), m.vectors.count())
    return words, m


def lexicon(spark, sf):
    return _lexicon(spark, sf)[0]


def tokenize_docs(spark, sf):
    words, m = _lexicon(spark, sf)
    return numbers(tokens.tokenize(table(spark, sf, "documents"), words.join(m.vectors.select("id", "vector"), "id"), DIMS), "doc_id")


def tokenize_raw_docs(spark, sf):
    words, m = _lexicon(spark, sf)
    return numbers(tokens.tokenize(table(spark, sf, "documents"), words.join(m.original.select("id", "vector"), "id"), DIMS, normalize=False), "doc_id")


# product quantization


def pq_encode(spark, sf):
    return _code_rows(model(spark, sf).codes, "id")


def pq_counts(spark, sf):
    return codebooks.code_counts(model(spark, sf).codes, M, K)


def pq_search(spark, sf):
    m = indexed(spark, sf)
    return pq.pq_search(m.codes, m.codebook, m.one("w1"), N, *SIZE)


def pq_search_in(spark, sf):
    m = indexed(spark, sf)
    return pq.pq_search(m.codes, m.codebook, m.one("w1"), N, *SIZE, targets(spark, sf).select("id"))


def knn_pq(spark, sf):
    return indexed(spark, sf).knn("w1", N, "pq")


def knn_in_pq(spark, sf):
    return indexed(spark, sf).knn_in("w1", N, targets(spark, sf).select("word"), "pq")


def pq_batch(spark, sf):
    m = indexed(spark, sf)
    return m.knn_join(query_words(m), N, targets(spark, sf).select("word"), "pq")


def pq_verified(spark, sf):
    return indexed(spark, sf).knn("w1", N, "pq_verified", PVF)


def _unit(spark, sf):
    """A query vector of length 1 that is no word's."""
    return [x / DIMS**0.5 for x in FIXED]


def knn_pq_vector(spark, sf):
    return indexed(spark, sf).knn(_unit(spark, sf), N, "pq")


def knn_in_pq_vector_words(spark, sf):
    return indexed(spark, sf).knn_in(_unit(spark, sf), N, targets(spark, sf).select("word"), "pq")


def knn_in_pq_vector_ids(spark, sf):
    return indexed(spark, sf).knn_in(_unit(spark, sf), N, targets(spark, sf).select("id"), "pq")


def pq_verified_vector(spark, sf):
    return indexed(spark, sf).knn(_unit(spark, sf), N, "pq_verified", PVF)


def ivfadc_vector(spark, sf):
    return indexed(spark, sf).knn(_unit(spark, sf), N, "ivfadc")


def ivfadc_verified_vector(spark, sf):
    return indexed(spark, sf).knn(_unit(spark, sf), N, "ivfadc_verified", PVF)


# inverted lists


def ivfadc_encode(spark, sf):
    return _code_rows(model(spark, sf).residual_codes, "id", "coarse_id")


def ivfadc_search(spark, sf):
    return indexed(spark, sf).knn("w1", N, "ivfadc")


def ivfadc_batch(spark, sf):
    m = indexed(spark, sf)
    return m.knn_batch(query_words(m), N, "ivfadc")


def ivfadc_verified(spark, sf):
    return indexed(spark, sf).knn("w1", N, "ivfadc_verified", PVF)


# the multi-index


def ivpq_cells(spark, sf):
    return ivpq.cell_counts(indexed(spark, sf).multi_codes, K_MULTI**2)


def create_statistics(spark, sf):
    return ivpq.create_statistics(targets(spark, sf).select("word"), indexed(spark, sf).multi_codes, K_MULTI**2)


def _ivpq(method):
    def run(spark, sf):
        m = indexed(spark, sf)
        known = m.words(query_words(m))
        near = ivpq.ivpq_join(m.vectors, m.multi_codes, m.multi, m.codebook, m.statistics(), known, targets(spark, sf).select("id"), N, M, K, K_MULTI, DIMS, ALPHA, PVF, method, CONFIDENCE)
        return near.join(known.select("qid", "query"), "qid").select("query", F.col("word").alias("target"), "similarity")

    return run


def ivpq_chosen_cells(spark, sf):
    """The cells of each query without a target list."""
    m = indexed(spark, sf)
    among = knn.within(m.multi_codes, targets(spark, sf).select("id"))
    return ivpq.chosen_cells(m.words(query_words(m)), m.multi, m.statistics(), among.select("id", "coarse_id"), N, K_MULTI, DIMS, ALPHA, CONFIDENCE, False)


def flat_chosen_cells(spark, sf):
    """The cells of the coarse quantizer that each query looks into by confidence, with target lists."""
    m = indexed(spark, sf)
    every = ivpq.cell_counts(m.residual_codes, 10)
    total = F.lit(m.vectors.count())
    stats = every.select("coarse_id", (F.col("count") / total).alias("coarse_freq"), total.alias("total"))
    among = knn.within(m.residual_codes, targets(spark, sf).select("id")).select("id", "coarse_id")
    return ivpq.chosen(ivpq.flat_cell_order(m.words(query_words(m)), m.coarse), stats, among, N, ALPHA, CONFIDENCE)


def ivpq_targets_seen(spark, sf):
    m = indexed(spark, sf)
    among = knn.within(m.multi_codes, targets(spark, sf).select("id")).select("id", "coarse_id")
    return evaluation.targets_seen(ivpq_chosen_cells(spark, sf), among)


def knn_in_ivpq(spark, sf):
    return indexed(spark, sf).knn_in("w1", N, targets(spark, sf).select("word"), "ivpq")


# insertion, evaluation, training, settings


def _inserted(spark, sf):
    m = model(spark, sf)
    terms = m.vectors.select(F.concat(F.lit("w"), "id", F.lit(" w"), F.col("id") + 1).alias("term"))
    return insertion.insert_batch(m.indexes, terms)


def insert_batch_words(spark, sf):
    return numbers(_inserted(spark, sf).vectors, "id", "word")


def insert_batch_codes(spark, sf):
    got = _inserted(spark, sf)
    rows = _code_rows(got.codes, "id").withColumn("kind", F.lit("pq"))
    rows = rows.unionByName(_code_rows(got.residual_codes, "id").withColumn("kind", F.lit("residual")))
    return rows.unionByName(got.multi_codes.select("id", F.lit(0).alias("pos"), F.col("coarse_id").alias("code"), F.lit("cell").alias("kind")))


def insert_batch_codebook(spark, sf):
    return _inserted(spark, sf).codebook.select("pos", "code", "count", F.posexplode("vector").alias("dim", "val")).withColumn("val", F.round("val", vf.PLACES))


def precision_at_k(spark, sf):
    m = indexed(spark, sf)
    known = m.words(query_words(m))
    return evaluation.precision_at_k(m.pairs("pq", known, N), m.pairs("exact", known, N), N)


def _precision(how, n=N):
    def run(spark, sf):
        m = indexed(spark, sf)
        known = m.words(query_words(m))
        return evaluation.precision_at_k(m.pairs(how, known, N, None, PVF), m.pairs("exact", known, N), N)

    return run


def similarity_quantiles(spark, sf):
    return evaluation.similarity_quantiles(knn_join_all(spark, sf))


def insert_batch_original(spark, sf):
    return numbers(_inserted(spark, sf).original, "id", "word")


def insert_snapshot(spark, sf):
    """How many rows each cell of a new snapshot holds, by index."""
    m = indexed(spark, sf)
    terms = m.vectors.select(F.concat(F.lit("w"), "id", F.lit(" w"), F.col("id") + 1).alias("term"))
    new = m.insert(terms, f"{source.shared_folder(spark)}/vectide-snapshot-{uuid.uuid4().hex}")
    rows = new.residual_counts.select(F.lit("residual").alias("index"), "coarse_id", "count")
    multi = ivpq.cell_counts(new.multi_codes, K_MULTI**2).where("count > 0")
    return rows.unionByName(multi.select(F.lit("multi").alias("index"), "coarse_id", "count"))


def codec_integers(spark, sf):
    """Elements as integers, packed by 4 and by 2 bytes and read back."""
    whole = model(spark, sf).vectors.select("id", F.transform("vector", lambda x: F.round(x.cast("double") * 1024)).alias("v"))
    rows = whole.select("id", F.col("v").cast("array<int>").alias("int"), F.col("v").cast("array<smallint>").alias("short"))
    packed = rows.select("id", *[codecs.vec_to_bytes(k, k).alias(k) for k in ("int", "short")])
    back = packed.select("id", F.length("int").alias("n_int"), F.length("short").alias("n_short"), codecs.read_bytes("int", "int").alias("i"), codecs.read_bytes("short", "short").alias("s"))
    return back.select("id", "n_int", "n_short", F.posexplode(F.zip_with("i", "s", lambda a, b: a.cast("double") + b.cast("double"))).alias("pos", "val"))


def _packed_pairs(spark, sf):
    """Each vector and its successor as whole numbers, packed."""
    v = model(spark, sf).vectors.select("id", F.transform("vector", lambda x: F.round(x.cast("double") * 1024).cast("float")).alias("v"))
    after = v.select((F.col("id") - 1).alias("id"), codecs.vec_to_bytes("v").alias("b"))
    return v.select("id", codecs.vec_to_bytes("v").alias("a")).join(after, "id")


def bytes_similarity(spark, sf):
    return _packed_pairs(spark, sf).select("id", F.round(codecs.cosine_similarity_bytes("a", "b"), 6).alias("sim"))


def bytes_arithmetic(spark, sf):
    rows = _packed_pairs(spark, sf).select("id", codecs.vec_minus_bytes("a", "b").alias("less"), codecs.vec_plus_bytes("a", "b").alias("more"))
    both = F.arrays_zip(codecs.read_bytes("less").alias("less"), codecs.read_bytes("more").alias("more"))
    rows = rows.select("id", F.posexplode(both).alias("pos", "x"))
    return rows.select("id", "pos", F.col("x.less").cast("double").alias("less"), F.col("x.more").cast("double").alias("more"))


def bytes_normalize(spark, sf):
    rows = _packed_pairs(spark, sf).select("id", codecs.read_bytes(codecs.vec_normalize_bytes("a")).alias("v"))
    return rows.select("id", F.round(vf.norm("v"), 5).alias("norm"), (F.round(F.col("v")[0].cast("double"), 4) + F.lit(0.0)).alias("first"))


def bytes_centroid(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", codecs.vec_to_bytes(F.transform("embedding", lambda x: F.round(x.cast("double") * 1024).cast("float"))).alias("b"))
    got = codecs.grouped_centroid_bytes(rows, ["label"], "b", DIMS)
    return got.select("label", F.posexplode(codecs.read_bytes("vector")).alias("pos", "val")).select("label", "pos", F.round(F.col("val").cast("double"), 2).alias("val"))


def text_vectors(spark, sf):
    """Vectors written as a text file with a header and read back."""
    m, path = model(spark, sf), f"{source.shared_folder(spark)}/vectide-text-{uuid.uuid4().hex}"
    source.write_text(m.vectors, path)
    source.write_header(m.vectors, path, DIMS)
    return numbers(source.read_text(spark, path, normalize=False), "word")


def kmeans_trained(spark, sf):
    """Codes by trained codebooks; no SQL form."""
    m = model(spark, sf)
    book = codebooks.trained_codebook(m.vectors, M, K, DIMS)
    return _code_rows(codebooks.encode(m.vectors, book, ("id",)), "id")


def settings_front(spark, sf):
    """The front end with another implementation by setting."""
    before = settings.get(spark, "knn")
    settings.put(spark, "knn", "ivfadc")
    try:
        return indexed(spark, sf).knn("w1", N)
    finally:
        settings.put(spark, "knn", before)


QUERIES = {f.__name__: f for f in (
    cosine_pairs, cosine_pairs_sql, vec_minus, vec_plus, vec_normalize, centroid_by_label, centroid_array, codec_roundtrip, word_similarity, vector_word_similarity,
    knn_exact, knn_vector, knn_in_words, knn_in_ids, knn_in_vectors, knn_join_exact, knn_join_all, knn_lateral,
    analogy_scores, analogy_3cosadd_pq, analogy_3cosadd_in_pq, analogy_3cosadd_ivfadc, analogy_3cosadd_in_ivpq,
    groups_exact, groups_pq, cluster_seeded, cluster_pq, cluster_ivpq, lexicon, tokenize_docs, tokenize_raw_docs,
    pq_encode, pq_counts, pq_search, pq_search_in, knn_pq, knn_in_pq, pq_batch, pq_verified,
    ivfadc_encode, ivfadc_search, ivfadc_batch, ivfadc_verified,
    ivpq_cells, create_statistics, ivpq_chosen_cells, knn_in_ivpq,
    insert_batch_words, insert_batch_codes, insert_batch_codebook, precision_at_k, kmeans_trained, settings_front,
    knn_in_vector_arrays, knn_in_vector_words, knn_in_vector_ids, knn_batch_vectors_in,
    knn_pq_vector, knn_in_pq_vector_words, knn_in_pq_vector_ids, pq_verified_vector, ivfadc_vector, ivfadc_verified_vector,
    flat_chosen_cells, ivpq_targets_seen, similarity_quantiles, insert_batch_original, insert_snapshot,
    codec_integers, bytes_similarity, bytes_arithmetic, bytes_normalize, bytes_centroid, text_vectors,
)} | {
    "precision_ivfadc": _precision("ivfadc"), "precision_pq_verified": _precision("pq_verified"),
    "analogy_3cosadd": _analogy("3cosadd"), "analogy_3cosmul": _analogy("3cosmul"), "analogy_pair_direction": _analogy("pair_direction"), "analogy_3cosadd_in": _analogy("3cosadd", True),
    "ivpq_join_pq": _ivpq(ivpq.PQ), "ivpq_join_exact": _ivpq(ivpq.EXACT), "ivpq_join_verified": _ivpq(ivpq.VERIFIED),
}

SQL = oracles.SQL
