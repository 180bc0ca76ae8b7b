import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import codecs, settings, vectors as vf


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


def test_similarity(spark):
    assert one(spark, vf.cosine_similarity("a", "b"), a=[1, 0], b=[1, 1]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vf.cosine_similarity("a", "b"), a=[0, 0], b=[1, 1]) == 0
    assert one(spark, vf.squared_distance("a", "b"), a=[1, 2], b=[3, 5]) == 13
    assert one(spark, vf.dot("a", "b"), a=[1, 2], b=[3, 5]) == 13


def test_null_and_length(spark):
    row = spark.sql("SELECT array(1D) AS a, CAST(NULL AS ARRAY<DOUBLE>) AS b, array(1D, 2D) AS c")
    assert row.select(vf.dot("a", "b")).first()[0] is None
    assert row.select(vf.vec_normalize("b")).first()[0] is None
    with pytest.raises(Exception, match="different lengths"):
        row.select(vf.dot("a", "c")).collect()


def test_arithmetic(spark):
    assert one(spark, vf.vec_minus("a", "b"), a=[1, 2], b=[3, 5]) == [-2, -3]
    assert one(spark, vf.vec_plus("a", "b"), a=[1, 2], b=[3, 5]) == [4, 7]
    assert one(spark, vf.vec_normalize("a"), a=[3, 4]) == pytest.approx([0.6, 0.8])
    assert one(spark, vf.vec_normalize("a"), a=[0, 0]) == [0, 0]


def test_centroids(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "g int, v array<double>")
    got = {r[0]: r[1] for r in vf.grouped_centroid(rows, ["g"], "v", 2).collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0, 6.0]}
    assert rows.agg(F.collect_list("v").alias("vs")).select(vf.centroid("vs")).first()[0] == pytest.approx([3.0, 4.0])
    assert spark.sql("SELECT CAST(array() AS ARRAY<ARRAY<DOUBLE>>) AS vs").select(vf.centroid("vs")).first()[0] == []


def test_erf(spark):
    xs = [-3.0, -1.0, -0.1, 0.0, 0.1, 1.0, 3.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(vf.erf(F.col("x"))).collect()
    assert [g[0] for g in got] == pytest.approx([math.erf(x) for x in xs], abs=2e-7)


@pytest.mark.parametrize("kind, values", [("float", [1.5, -2.25]), ("int", [1, -70000]), ("short", [3, -4])])
def test_codecs(spark, kind, values):
    rows = spark.createDataFrame([(values,), ([],), (None,)], f"v array<{'smallint' if kind == 'short' else kind}>")
    packed = rows.select("v", codecs.vec_to_bytes("v", kind).alias("b"))
    got = packed.select("v", "b", codecs.read_bytes("b", kind).alias("back")).collect()
    assert [r["v"] for r in got] == [r["back"] for r in got]
    assert bytes(got[0]["b"]) == np.asarray(values, {"float": "<f4", "int": "<i4", "short": "<i2"}[kind]).tobytes()
    with pytest.raises(ValueError):
        codecs.read_bytes("b", "double")


def test_settings(spark):
    assert settings.get(spark, "pvf") == 20
    settings.put(spark, "pvf", 7)
    settings.put(spark, "use_targetlist", False)
    assert settings.get(spark, "pvf") == 7 and settings.get(spark, "use_targetlist") is False
    settings.put(spark, "pvf", 20)
    settings.put(spark, "use_targetlist", True)
    with pytest.raises(KeyError):
        settings.put(spark, "nothing", 1)
    settings.name_tables(spark, vectors="words")
    assert settings.table_name(spark, "vectors") == "words" and settings.table_name(spark, "coarse") == "coarse"


def test_sql_functions(spark):
    vf.register(spark)
    assert spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D))").first()[0] == pytest.approx(math.sqrt(0.5))
    assert spark.sql("SELECT vec_plus(array(1D), array(2D)), vec_minus(array(1D), array(2D)), vec_normalize(array(3D, 4D)), centroid(array(array(1D), array(3D)))").first()[:] == ([3.0], [-1.0], [0.6, 0.8], [2.0])


@given(st.lists(st.floats(-1e3, 1e3).filter(lambda x: x == 0 or abs(x) > 1e-3), min_size=1, max_size=8))
def test_distance_of_unit_vectors(v):
    """The identity that approximate search rests on: 1 - d / 2 is the similarity of unit vectors."""
    a = np.asarray(v)
    if np.linalg.norm(a) > 0:
        a = a / np.linalg.norm(a)
        b = np.roll(a, 1)
        assert 1 - ((a - b) ** 2).sum() / 2 == pytest.approx(a @ b, abs=1e-9)
