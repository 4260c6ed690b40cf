"""Literal inputs with the values that the definitions give."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import sequences as S
from eventloom.operators import similarity as M

SCHEMA = "id string, ts double, embedding array<double>, modality string, tie long"
EIGHT = [[(3 * k + j * j) % 4 / 2 for j in range(3)] for k in range(8)]


def seq(spark, times, vectors, name="a"):
    return spark.createDataFrame([(name, float(t), [float(x) for x in v], "text", i) for i, (t, v) in enumerate(zip(times, vectors))], SCHEMA)


@pytest.fixture(scope="module")
def three(spark):
    return seq(spark, [1, 2, 3], [[1, 0, 0], [0, 1, 0], [0, 0, 1]])


def test_representation(three):
    got = S.representation(three, 3, S.Config(levels=1)).first().embedding
    assert got == pytest.approx([0.090031, 0.244728, 0.665241], abs=1e-6)


def test_trend_and_prediction(three):
    got = {r.step: r.prediction for r in S.predict_next(three, 3, 2).collect()}
    assert got[1] == pytest.approx([-0.268941, -0.462117, 1.731059], abs=1e-6)
    assert got[2] == pytest.approx([-0.537883, -0.924234, 2.462117], abs=1e-6)


def test_one_event_is_repeated(spark):
    got = S.predict_next(seq(spark, [5], [[1, 2, 3]]), 3, 2).collect()
    assert [r.prediction for r in got] == [[1, 2, 3], [1, 2, 3]]


def test_windows(spark):
    s = seq(spark, [0, 0.1, 0.2, 5, 5.1, 9, 9.1, 10], EIGHT)
    adaptive = [r.window for r in S.adaptive_windows(s).orderBy("ts").collect()]
    assert adaptive == [0, 0, 0, 1, 1, 2, 2, 3]
    fixed = [r.window for r in S.fixed_windows(s).orderBy("ts").collect()]
    assert [fixed[:3], fixed[3:5], fixed[5:]] == [[fixed[0]] * 3, [fixed[3]] * 2, [fixed[5]] * 3] and len(set(fixed)) == 3


def test_equal_gaps_are_one_window(three):
    assert {r.window for r in S.adaptive_windows(three).collect()} == {0}


def test_ema(spark):
    s = seq(spark, [1, 2, 3], [[1, 0], [0.5, 0.5], [0, 1]])
    assert S.ema(s, 2, 0.5).first().embedding == pytest.approx([0.487205, 0.512795], abs=1e-6)


def test_relationships(spark):
    rows = [("e1", "text", [0.8, 0.2], "x"), ("e1", "image", [1.0, 0.0], "x"), ("e2", "text", [0.6, 0.4], "x"), ("e3", "text", [-0.2, 0.8], "y"), ("e4", "audio", [1.0, 1.0], None)]
    e = spark.createDataFrame(rows, "entity_id string, modality string, embedding array<double>, category string")
    got = {(r.entity_id, r.related_entity_id): r.similarity for r in M.relationships(e, 0.5).collect()}
    assert set(got) == {("e1", "e2"), ("e2", "e1")} and got["e1", "e2"] == pytest.approx(min(1.0, 0.56 / (0.68**0.5 * 0.52**0.5) + 0.1))


def test_order_of_rows_and_partitions_plays_no_part(spark):
    s = seq(spark, [0, 0.1, 0.2, 5, 5.1, 9, 9.1, 10], EIGHT)
    a = S.representation(s, 3).first().embedding
    assert S.representation(s.orderBy(F.rand(3)).repartition(5), 3).first().embedding == pytest.approx(a)


def test_required_columns():
    with pytest.raises(ValueError):
        S.from_table(type("D", (), {"columns": ["x"], "dtypes": [("x", "int")]})(), {"id": "i", "ts": "t", "embedding": "e"})


def test_vector_search_errors(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a")], "id long, embedding array<double>, kind string")
    with pytest.raises(ValueError):
        M.by_vector(c, [1.0], 3)
    with pytest.raises(KeyError):
        M.by_id(c, 9, 3)
    assert [r.id for r in M.by_id(c, 1, 5).collect()] == [2]
