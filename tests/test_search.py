import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import settings
from vectide.operators import codebooks, evaluation, insertion, ivfadc, ivpq, knn, pq, tokens
from vectide.plans import catalog
from vectide.sources import vectors as source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return catalog.model(spark, SF)


def test_unknown_words(spark, model):
    assert model.knn("nobody", 3).count() == 0
    assert model.knn("nobody", 3, "pq").count() == 0
    assert model.analogy("w1", "nobody", "w2").count() == 0
    targets = spark.createDataFrame([("w1",), ("w1",), ("nobody",)], "word string")
    assert [r[0] for r in model.knn_in("w2", 5, targets).collect()] == ["w1"]
    assert model.knn_in("nobody", 5, targets, "ivpq").count() == 0


def test_repeated_queries_repeat(spark, model):
    queries = spark.createDataFrame([("w1",), ("w1",), ("nobody",)], "word string")
    assert model.knn_join(queries, 2, None).count() == 4


def test_blocks_of_both_sides(spark, model, monkeypatch):
    queries = model.vectors.select(F.col("id").alias("qid"), "vector")
    want = sorted(map(tuple, knn.knn_pairs(queries, model.vectors, 3).collect()))
    monkeypatch.setattr(knn, "BROADCAST_ELEMENTS", 0)
    monkeypatch.setattr(knn, "BLOCK", 100)
    assert sorted(map(tuple, knn.knn_pairs(queries, model.vectors, 3).collect())) == want


def test_groups_of_many_tokens(spark, model, monkeypatch):
    """More tokens than are broadcast, and few group words."""
    names = spark.createDataFrame([(f"w{k}",) for k in range(10)], "word string")
    want = sorted(map(tuple, model.groups(model.vectors.select("word"), names).collect()))
    monkeypatch.setattr(knn, "BROADCAST_ELEMENTS", 64 * 100)
    assert sorted(map(tuple, model.groups(model.vectors.select("word"), names).collect())) == want
    assert len(want) == 500


def test_nearest_against_loops():
    """Equal vectors, ties, few targets, other scales, targets in any order and in parts."""
    rng = np.random.default_rng(1)
    for n, width, k, scale in ((7, 3, 5, 1.0), (50, 8, 3, 1000.0), (400, 64, 5, 0.001), (3000, 4, 6, 1.0), (1, 2, 1, 1.0)):
        x, ids = np.round(rng.normal(size=(n, width)), 1) * scale, rng.permutation(n)
        best = knn.Nearest(x, k)
        for a in range(0, n, 333):
            best.add(knn.Block(ids[a : a + 333], np.array([f"w{i}" for i in ids[a : a + 333]], dtype=object), x[a : a + 333], k))
        sims = np.round(np.einsum("ij,kj->ik", x, x), knn.PLACES)
        got = best.rows(np.arange(n)).to_pydict()
        order = [np.lexsort((ids, -s))[:k] for s in sims]
        assert got["id"] == [i for o in order for i in ids[o]]
        assert got["word"] == [f"w{i}" for i in got["id"]]
        assert got["similarity"] == [x for s, o in zip(sims, order, strict=True) for x in s[o]]


def test_lateral_pairs_not_all(spark):
    """The LATERAL query meets k pairs of each query, not every query with every vector."""
    plan = catalog.knn_lateral(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quantiles_of_both_sides_large(spark, monkeypatch):
    """Neither side is broadcast whole; a known subset is the query side, which once made a column ambiguous."""
    m = catalog.model(spark, SF)
    every = m.vectors.select(F.col("word"))
    want = sorted(map(tuple, knn.knn_join(m.vectors, every, 3, every).collect()))
    quantiles = catalog.similarity_quantiles(spark, SF).collect()
    monkeypatch.setattr(knn, "BROADCAST_ELEMENTS", 64 * 150)
    assert sorted(map(tuple, knn.knn_join(m.vectors, every, 3, every).collect())) == want
    assert catalog.similarity_quantiles(spark, SF).collect() == quantiles


def test_rounds_keep_queries_with_few_targets(spark, monkeypatch):
    """More neighbours wanted than there are targets, and a vector without a length; NaN comes first, as in SQL."""
    rows = [(i, f"w{i}", [float(i % 3), 1.0 if i != 4 else float("nan")]) for i in range(7)]
    vectors = spark.createDataFrame(rows, "id long, word string, vector array<double>")
    queries = vectors.select(F.col("id").alias("qid"), "vector")
    want = sorted(map(tuple, knn.knn_pairs(queries, vectors.where("id < 4"), 9).collect()))
    first = knn.knn_pairs(queries.where("qid < 4"), vectors, 1).collect()
    assert len(want) == 7 * 4 and {r["id"] for r in first} == {4}
    monkeypatch.setattr(knn, "BROADCAST_ELEMENTS", 2)
    monkeypatch.setattr(knn, "BLOCK", 2)
    assert str(sorted(map(tuple, knn.knn_pairs(queries, vectors.where("id < 4"), 9).collect()))) == str(want)


def test_batch_beyond_broadcast(model, monkeypatch):
    known = model.words(catalog.query_words(model))
    want = sorted(map(tuple, pq.pq_batch(model.codes, model.codebook, known, 3, 8, 16, 64).collect()))
    monkeypatch.setattr(pq, "BROADCAST_ELEMENTS", 0)
    assert sorted(map(tuple, pq.pq_batch(model.codes, model.codebook, known, 3, 8, 16, 64).collect())) == want


def test_verification_of_everything_is_exact(model):
    n = model.vectors.count()
    assert model.knn("w1", 5, "pq_verified", n).collect() == model.knn("w1", 5, "exact").collect()
    assert model.knn("w1", 5, "ivfadc_verified", n).collect() == model.knn("w1", 5, "exact").collect()


def test_all_cells_hold_all(model):
    one = model.one("w1")
    got = ivfadc.ivfadc_search(model.residual_codes, model.coarse, model.residual_codebook, one, 10_000, 8, 16, 64, 3)
    assert got.count() == model.vectors.count()


def test_confidence_is_a_share_and_grows(spark):
    rows = spark.range(0, 11).select((F.col("id") / 10).alias("p"))
    got = [r[0] for r in rows.select(ivpq.confidence(F.lit(15.0), 250, F.col("p"), 500)).collect()]
    assert got[0] == 0 and got[-1] == 1 and got == sorted(got)
    assert rows.select(ivpq.confidence(F.lit(300.0), 250, F.col("p"), 500)).distinct().collect() == [(0.0,)]


def test_join_on_multi_index_is_complete_in_the_end(spark, model):
    """With more neighbours wanted than the first cells hold, repetition reaches them all."""
    few = spark.createDataFrame([(k,) for k in range(0, 40)], "id long")
    near = model.pairs("ivpq", model.one("w1"), 40, few)
    assert near.count() == 40


def test_training(model):
    book = codebooks.trained_codebook(model.vectors, 8, 16, 64, seed=3)
    assert book.count() == 128
    codes = codebooks.encode(model.vectors, book, ("id", "word"))
    exact = model.pairs("exact", model.words(catalog.query_words(model)), 5)
    found = pq.verified(pq.pq_batch(codes, book, model.words(catalog.query_words(model)), 100, 8, 16, 64), model.vectors, model.words(catalog.query_words(model)), 5)
    assert evaluation.precision_at_k(found, exact, 5).agg(F.avg("precision")).first()[0] >= 0.8
    with pytest.raises(ValueError):
        codebooks.slices(model.vectors, 7, 64, [])


def test_nearest_codes_by_hand():
    rng = np.random.default_rng(1)
    x, book = rng.normal(size=(50, 8)), rng.normal(size=(2, 5, 4))
    want = [[int(np.argmin(((v[4 * p : 4 * p + 4] - book[p]) ** 2).sum(axis=1))) for p in range(2)] for v in x]
    assert codebooks.nearest_codes(x, book).tolist() == want


def test_tokenize_empty(spark, model):
    texts = spark.createDataFrame([(1, "w1 w1  w2"), (2, "nothing known"), (3, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in tokens.tokenize_all(texts, model.vectors, 64).collect()}
    assert len(got[1]) == 64 and got[2] == [] and got[3] == []
    assert np.linalg.norm(got[1]) == pytest.approx(1)


def test_insertion_keeps_known_words(spark, model):
    terms = spark.createDataFrame([("w1",), ("w2 w3",), ("w2 w3",), ("none of these",)], "term string")
    got = insertion.insert_batch(model.indexes, terms)
    assert [tuple(r) for r in got.vectors.select("id", "word").collect()] == [(model.vectors.count(), "w2_w3")]
    assert got.codebook.agg(F.sum("count")).first()[0] == 8


def test_index_files_are_pruned(spark, model, tmp_path):
    source.save_index(model.residual_codes, str(tmp_path / "index"))
    index = source.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, index.select("id", "coarse_id").collect())) == sorted(map(tuple, model.residual_codes.select("id", "coarse_id").collect()))
    plan = index.where("coarse_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(coarse_id" in plan


def test_text_vectors(spark, model, tmp_path):
    lines = ["3 2", "a 3 4", "b 1 0", f"{'x' * 100} 1 1", "wide 1 2 3", "bad 1 y"]
    (tmp_path / "v.txt").write_text("\n".join(lines) + "\n")
    got = {r["word"]: r["vector"] for r in source.read_text(spark, str(tmp_path / "v.txt")).collect()}
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx([0.6, 0.8])
    raw = source.number_rows(source.read_text(spark, str(tmp_path / "v.txt"), normalize=False))
    assert sorted((r["id"], r["word"], r["vector"]) for r in raw.collect()) == [(0, "a", [3.0, 4.0]), (1, "b", [1.0, 0.0])]
    source.write_text(raw, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a 3.0 4.0", "b 1.0 0.0"]


def test_binary_vectors(spark, tmp_path):
    data = b"2 3\n" + b"one " + np.asarray([1, 2, 3], "<f4").tobytes() + b"\n" + "zwölf ".encode() + np.asarray([4, 5, 6], "<f4").tobytes() + b"\n"
    (tmp_path / "v.bin").write_bytes(data)
    got = [tuple(r) for r in source.read_word2vec(spark, str(tmp_path / "v.bin")).collect()]
    assert got == [(0, "one", [1.0, 2.0, 3.0]), (1, "zwölf", [4.0, 5.0, 6.0])]


def test_front_end_follows_settings(spark, model):
    for name in ("pq", "ivfadc", "ivpq"):
        settings.put(spark, "knn", name)
        assert model.knn("w1", 3).collect() == model.knn("w1", 3, name).collect()
    settings.put(spark, "knn", "exact")
    with pytest.raises(ValueError):
        model.knn("w1", 3, "nothing")


def test_sampling_and_timing(model):
    words = evaluation.sample_words(model.vectors, 10)
    assert words.count() == 10 and words.collect() == evaluation.sample_words(model.vectors, 10).collect()
    middle, spread = evaluation.timed(lambda: words, 2)
    assert middle > 0 and spread >= 0


def test_insert_stream(spark, model, tmp_path):
    from vectide.streaming.insertion import insert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"term": "w1 w2"}\n{"term": "w3 w4"}\n')
    got = {}
    terms = spark.readStream.schema("term string").json(str(tmp_path / "in"))
    query = insert_stream(terms, lambda: model.indexes, lambda rows, n: got.update({n: [r[0] for r in rows.vectors.select("word").collect()]}), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert got == {0: ["w1_w2", "w3_w4"]}
