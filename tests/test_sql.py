"""Search as SQL table functions gives what the front end gives."""

import pytest

from vectide.plans import catalog, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    m = catalog.model(spark, SF)
    sql.register(m)
    return m


def words(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "word string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_search(spark, model):
    assert rows(spark.sql("SELECT * FROM knn('w1', 5)")) == rows(model.knn("w1", 5))
    assert rows(spark.sql("SELECT * FROM knn('nobody', 5)")) == []
    assert rows(spark.sql("SELECT * FROM knn_in('w1', 2, array('w2', 'w3', 'w4', 'w4'))")) == rows(model.knn_in("w1", 2, words(spark, "w2", "w3", "w4")))
    assert rows(spark.sql("SELECT * FROM knn_batch(array('w1', 'w2'), 3)")) == rows(model.knn_batch(words(spark, "w1", "w2"), 3, "exact"))
    assert rows(spark.sql("SELECT * FROM knn_join(array('w1', 'w2'), 2, array('w3', 'w4', 'w5'))")) == rows(model.knn_join(words(spark, "w1", "w2"), 2, words(spark, "w3", "w4", "w5")))


def test_analogies_and_groups(spark, model):
    assert rows(spark.sql("SELECT * FROM analogy('w1', 'w2', 'w3')")) == rows(model.analogy("w1", "w2", "w3"))
    assert rows(spark.sql("SELECT * FROM analogy_in('w1', 'w2', 'w3', array('w7', 'w8', 'w3'))")) == rows(model.analogy("w1", "w2", "w3", "3cosadd", words(spark, "w7", "w8", "w3")))
    assert rows(spark.sql("SELECT * FROM groups(array('w10', 'w11', 'w12'), array('w1', 'w2'))")) == rows(model.groups(words(spark, "w10", "w11", "w12"), words(spark, "w1", "w2")))


def test_lateral(spark, model):
    words(spark, "w1", "w2", "w3").createOrReplaceTempView("movies")
    got = rows(spark.sql("SELECT m.word, t.word, t.similarity FROM movies m, LATERAL knn(m.word, 2) t"))
    assert got == rows(model.knn_join(words(spark, "w1", "w2", "w3"), 2, None))
