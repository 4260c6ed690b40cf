"""Probes on vectors that many rows share: fits of grouped rows, medians and ranks without one task that holds all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import probes as P


def grouped_and_single(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30, 3)) * [1, 5, 0.2]
    rows = [(int(k), [float(v) for v in x[k]], float(x[k] @ [1, -0.3, 2] + rng.normal()), float(x[k, 0] + rng.normal() > 0.4)) for k in rng.integers(0, 30, 500)]
    return spark.createDataFrame(rows, "k long, embedding array<double>, y double, c double").repartition(4)


def test_ridge_of_means_is_that_of_rows(spark):
    df = grouped_and_single(spark)
    one = P.ridge(P.features(df), "y", 3.0)
    few = df.groupBy("k").agg(F.first("embedding").alias("embedding"), F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    two = P.ridge(P.features(few), "y", 3.0, weight="w")
    assert list(two.coefficients) == pytest.approx(list(one.coefficients), rel=1e-8) and two.intercept == pytest.approx(one.intercept, rel=1e-8)


def test_logistic_of_counts_is_that_of_rows(spark):
    df = grouped_and_single(spark)
    one = P.logistic(P.features(df), "c", 0.05)
    few = df.groupBy("k", "c").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).cast("double").alias("n"))
    two = P.logistic(P.features(few), "c", 0.05, "n")
    assert list(two.coefficients) == pytest.approx(list(one.coefficients), rel=1e-4) and two.intercept == pytest.approx(one.intercept, rel=1e-3, abs=1e-4)
    held, counts = P.positive(one.transform(P.features(df))), P.positive(one.transform(P.features(few)))
    assert P.roc_auc(counts, "c", count="n").first().auc == pytest.approx(P.roc_auc(held, "c").first().auc)
    assert P.average_precision(counts, "c", count="n").first()[0] == pytest.approx(P.average_precision(held, "c").first()[0])


def test_medians_by_counting(spark, monkeypatch):
    monkeypatch.setattr(P, "PICKED", 5)
    monkeypatch.setattr(P, "BINS", 8)
    rng = np.random.default_rng(12)
    for values in (rng.lognormal(0, 4, 501), rng.integers(0, 4, 300) * 1.0, np.array([7.0] * 50), np.array([1.0, 2.0]), np.array([0.0, 5e-324] * 20), rng.normal(size=1000)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        assert P.median(df, "x") == np.median(values)
    assert P.median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_running_sums_have_no_task_with_all_rows(spark, monkeypatch):
    held, real = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: held.append(real(df, name)) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(2000).select((F.col("id") * 0.5).alias("s"), F.col("id").cast("double").alias("q"))
    got = P.running(df, "s", "q")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held[0].groupBy("_part").count().agg(F.max("count")).first()[0] < 1500
    assert all(r._before_q == (2 * r.s) * (2 * r.s - 1) / 2 for r in got.collect())
    assert P.running(df, "s", "q", descending=True).where("s = 999.5").first()._before_q == 0
