"""Supervised probes on vectors: ridge and logistic regression, random forests, and their metrics. The solvers are Spark ML's, over all rows."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import stored

LOG = logging.getLogger(__name__)


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``held``: whether a row's hash of key and seed falls into the test share. The same rows whatever the partitions."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn("held", u < test)


def labelled(vectors: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Vectors with their labels, rows without either dropped; none at all raises ``ValueError``."""
    out = vectors.join(labels.dropna(), key)
    if out.isEmpty():
        raise ValueError("no label has a vector")
    return out


def features(df: DataFrame, vector: str = "embedding", codes: list[str] | None = None, numbers: list[str] | None = None) -> DataFrame:
    """``df`` with ``features``: the vector, the index of each code among its sorted values, and the numbers."""
    out = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    parts = ["_v"]
    for c in codes or []:
        out = StringIndexer(inputCol=c, outputCol=f"_{c}", stringOrderType="alphabetAsc", handleInvalid="keep").fit(out).transform(out)
        parts.append(f"_{c}")
    assembler = VectorAssembler(inputCols=[*parts, *(numbers or [])], outputCol="features", handleInvalid="skip")
    return assembler.transform(out).drop(*parts)


def ridge(df: DataFrame, label: str, alpha: float = 1.0, weight: str | None = None):
    """Ridge regression minimising sum of squares + alpha |w|^2 (the intercept is free).

    Rows of equal features may be given as one, with their mean label and their number as ``weight``: the fit is the same.
    """
    if weight is None:
        n, spread = df.agg(F.count(label), F.stddev_pop(label)).first()
    else:
        n, mean = df.agg(F.sum(weight), F.sum(F.col(weight) * F.col(label)) / F.sum(weight)).first()
        spread = df.agg(F.sqrt(F.sum(F.col(weight) * F.pow(F.col(label) - F.lit(mean), 2.0)) / F.sum(weight))).first()[0]
    # Spark's solver works on the label divided by its deviation
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=alpha / max(n or 0, 1) * (spread or 0.0), elasticNetParam=0.0, standardization=False, solver="normal")
    return (model if weight is None else model.setWeightCol(weight)).fit(df)


#: Values among which a median is picked at once, at most, and bins that others are counted in.
PICKED, BINS = 100_000, 4096


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of a column of numbers: values are counted in ever narrower bins until few are left, so none has to hold them all."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull())
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None

    def at(place: int, low: float, high: float) -> float:
        inside, count = rows, n
        while count > PICKED and low < high:
            width = (high - low) / BINS
            if not 0 < width < float("inf") or low + width == low or high - width == high:
                break
            bins = inside.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("bin").collect()
            for b in bins:
                if place < b["n"]:
                    low, high, count = b["low"], b["high"], b["n"]
                    break
                place -= b["n"]
            inside = rows.where(F.col("x").between(low, high))
        if low == high:
            return low
        if count <= PICKED:
            return [r.x for r in inside.orderBy("x").collect()][place]
        for r in inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").toLocalIterator():  # neighbouring numbers
            if place < r["n"]:
                return r.x
            place -= r["n"]

    return (at((n - 1) // 2, low, high) + at(n // 2, low, high)) / 2


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: n, r2, mae, mape, median absolute error."""
    rows = stored(df.select(F.col(label).alias("y"), F.abs(F.col(label) - F.col(prediction)).alias("e")), "errors")
    e = F.col("e")
    return rows.agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"), F.avg(e).alias("mae"), F.avg(e / F.nullif(F.abs("y"), F.lit(0))).alias("mape"), F.lit(median(rows, "e")).cast("double").alias("median_error"))


def balanced(df: DataFrame, label: str, count: str | None = None) -> DataFrame:
    """``df`` with ``weight`` n / (classes * n of the class); a row stands for ``count`` rows."""
    one = F.lit(1) if count is None else F.col(count)
    counts = df.groupBy(label).agg(F.sum(one).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    return df.join(counts, label).crossJoin(F.broadcast(whole)).withColumn("weight", one * F.col("_all") / (F.col("_classes") * F.col("_n"))).drop("_n", "_all", "_classes")


def logistic(df: DataFrame, label: str, regularisation: float = 0.0, count: str | None = None):
    """Logistic regression with balanced classes. Rows of equal features and label may be given as one with their ``count``: the fit is the same."""
    rows = balanced(df, label, count)
    if count is not None:  # the penalty is on features over their deviations, which Spark divides by the weights' sum less their squares over it
        w = F.col("weight")
        total, grouped, single = rows.agg(F.sum(w), F.sum(w * w), F.sum(w * w / F.col(count))).first()
        if total and total > single / total:
            regularisation *= max(0.0, total - grouped / total) / (total - single / total)
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=regularisation, maxIter=100).fit(rows)


def positive(df: DataFrame) -> DataFrame:
    """Predictions with ``score``, the probability of class 1."""
    return df.withColumn("score", vector_to_array("probability")[1])


def running(df: DataFrame, order: str, *columns: str, descending: bool = False) -> DataFrame:
    """``df``, of one row a value of ``order``, with the sums of ``columns`` over the rows before (``_before_...``).

    Range partitions are stored and summed each for itself; their totals, one row each, give what to add. So no task has all rows.
    """
    by = F.desc(order) if descending else F.asc(order)
    ranged = stored(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranged")
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(past), F.lit(0)).alias(f"_s_{c}") for c in columns])
    inside = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in columns]).join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *[(F.col(f"_i_{c}") + F.col(f"_s_{c}")).alias(f"_before_{c}") for c in columns])


def by_score(df: DataFrame, label: str, score: str, count: str | None) -> DataFrame:
    """(score, p, q): how many rows of class 1 and of others have each score; a row stands for ``count`` rows."""
    one, hit = F.lit(1) if count is None else F.col(count), F.col(label) == 1
    part = lambda c: F.coalesce(F.sum(F.when(c, one)), F.lit(0)).cast("double")
    return df.groupBy(score).agg(part(hit).alias("p"), part(~F.coalesce(hit, F.lit(False)) & F.col(label).isNotNull()).alias("q"), F.sum(one).alias("n"))


def roc_auc(df: DataFrame, label: str, score: str = "score", count: str | None = None) -> DataFrame:
    """One row: auc, exactly, ties counted half; 0.5 with one class only. Ranks come from counts by score and running sums of range partitions."""
    ranked = running(by_score(df, label, score, count), score, "q")
    pairs = F.sum("p") * F.sum("q")
    return ranked.agg(F.when(pairs > 0, F.sum(F.col("p") * (F.col("_before_q") + F.col("q") / 2)) / pairs).otherwise(0.5).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str = "score", count: str | None = None) -> DataFrame:
    per = running(by_score(df, label, score, count), score, "p", "n", descending=True)
    at = (F.col("_before_p") + F.col("p")) / (F.col("_before_n") + F.col("n"))
    return per.agg((F.sum(F.col("p") * at) / F.sum("p")).alias("average_precision"))


def top_weights(coefficients, n: int = 10) -> list[tuple[int, float]]:
    """The dimensions of the largest weights by magnitude."""
    values = list(coefficients)
    return [(i, values[i]) for i in sorted(range(len(values)), key=lambda i: (-abs(values[i]), i))[:n]]


def forest(df: DataFrame, label: str, trees: int = 40, depth: int = 8, seed: int = 42):
    """Multiclass random forest (Spark has no multiclass boosting)."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(df)


def class_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(class, support, precision, recall)."""
    pairs = df.groupBy(F.col(label).cast("double").alias("a"), F.col(prediction).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    real = pairs.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    said = pairs.groupBy(F.col("b").alias("class")).agg(F.sum("n").alias("said"))
    return real.join(said, "class", "left").select("class", "support", (F.col("hits") / F.col("said")).alias("precision"), (F.col("hits") / F.col("support")).alias("recall"))


def sweep(checkpoints: dict[str, DataFrame], probes: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(checkpoint, probe, ...): the metrics of every probe on the vectors of every checkpoint, columns by name; a probe that has no data is left out."""
    parts = []
    for name, vectors in checkpoints.items():
        for kind, probe in probes.items():
            try:
                parts.append(probe(vectors).select(F.lit(name).alias("checkpoint"), F.lit(kind).alias("probe"), "*"))
            except ValueError as e:  # as ``labelled`` raises without labels
                LOG.warning("%s of %s: %s", kind, name, e)
    if not parts:
        raise ValueError("no probe has data")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
