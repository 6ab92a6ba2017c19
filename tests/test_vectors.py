"""Functions on points, boxes and names, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from orthoscan.functions import names as N
from orthoscan.functions import vectors as V


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()[0]


def P(*xs):
    return V.literal_point(xs)


def test_boxes(one):
    assert value(one, V.volume(P(0, 0), P(6, 8))) == 48
    assert value(one, V.volume(P(1, 0), P(0, 8))) == 0
    assert value(one, V.min_squared_distance(P(0, 0), P(6, 8), P(7, 9))) == 2
    assert value(one, V.min_squared_distance(P(0, 0), P(6, 8), P(3, 3))) == 0
    assert value(one, V.enlargement(P(0, 0), P(1, 1), P(2, 3), P(2, 3))) == 5
    assert value(one, V.dead_space(P(0, 0), P(1, 1), P(2, 2), P(3, 3))) == 7
    assert value(one, V.overlaps(P(0, 0), P(1, 1), P(1, 1), P(2, 2)))
    assert not value(one, V.overlaps(P(0, 0), P(1, 1), P(1.1, 1), P(2, 2)))
    assert value(one, V.contains(P(0, 0), P(3, 5), P(3, 5)))
    assert not value(one, V.contains(P(3, 5), P(0, 0), P(1, 1)))


def test_distance_literal_column_and_long_agree(one):
    a, b = [float(i) for i in range(100)], [float(i * i % 7) for i in range(100)]
    want = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assert value(one, V.squared_distance(P(*a), b)) == want == value(one, V.squared_distance(P(*a), P(*b)))
    assert value(one, V.squared_distance(P(*a[:5]), b[:5])) == sum((x - y) ** 2 for x, y in zip(a[:5], b[:5], strict=True))
    assert value(one, V.norm(P(3, 4))) == 5


@pytest.mark.parametrize("bad", ["array(1f, null)", "array(1f, float('nan'))", "array(1f, float('inf'))", "array(1f)", "cast(null as array<float>)"])
def test_invalid_points(one, bad):
    assert not value(one, F.coalesce(V.is_valid(F.expr(bad), 2), F.lit(False)))
    assert value(one, V.is_valid(P(1, 2), 2))


@pytest.mark.parametrize(("dims", "records", "most", "least"), [(2, 511, 204, 81), (5, 204, 92, 36), (10, 102, 48, 19), (20, 51, 24, 9), (30, 34, 16, 6)])
def test_capacities(one, dims, records, most, least):
    d = F.lit(dims)
    assert (value(one, N.records_per_page(d)), value(one, N.node_capacity(d)), value(one, N.node_minimum(d))) == (records, most, least)


def test_names(one):
    assert value(one, N.audio_url(F.lit("jazz.00004.7.wav"))) == "/audio/jazz/jazz.00004.wav#t=21,24"
    assert value(one, N.audio_url(F.lit("jazz.00004.wav"))) == "/audio/jazz/jazz.00004.wav"
    assert value(one, N.audio_url(F.lit("jazz.00004.x.wav"))) == "/audio/jazz/jazz.00004.wav"
    assert value(one, N.genre(F.lit(""))) == "unknown"
    assert value(one, N.clean_label(F.lit("n02085620-Shih_Tzu"))) == "Shih Tzu"
    assert value(one, N.image_url(F.lit("a\\b\\c.jpg"), "a")) == "/images/b/c.jpg"
    assert value(one, N.image_url(F.lit("x/c.jpg"), "a")) is None
    assert value(one, N.speedup(F.lit(1000), F.lit(0))) == 0
    assert value(one, N.winner(F.lit(5), F.lit(5), F.lit(9))) == "KD-tree"
    assert value(one, N.winner(F.lit(None).cast("int"), F.lit(0), F.lit(9))) == "linear"
