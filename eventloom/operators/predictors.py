"""Trained predictors of the next events of a sequence, fitted over all windows in one pass.

A window of ``context`` vectors predicts the ``steps`` vectors that follow. The fit is ridge regression on the window's values, or on ``hidden`` fixed
random features of them (one hidden layer whose weights are drawn, not trained), so that it is exact from sums: partitions send products of
features, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import sequences as S
from eventloom.session import reach


@dataclass
class Predictor:
    d: int
    context: int
    steps: int
    weights: np.ndarray  # (1 + features, steps * d), the intercept first
    layer: tuple[np.ndarray, np.ndarray] | None
    rows: int

    def features(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.layer)

    def next(self, vectors: list[list[float]], steps: int | None = None) -> list[list[float]]:
        """The vectors after a sequence: shorter ones are padded with zeros in front, more steps than fitted go on from the predictions."""
        held, out = [np.zeros(self.d)] * max(0, self.context - len(vectors)) + [np.asarray(v, float) for v in vectors], []
        while len(out) < (steps or self.steps):
            got = (self.features(np.concatenate(held[-self.context :])[None]) @ self.weights).reshape(self.steps, self.d)
            out += list(got)
            held += list(got)
        return [v.tolist() for v in out[: steps or self.steps]]

    def predict(self, sequences: DataFrame, steps: int | None = None) -> DataFrame:
        """(id, step, prediction) after the newest events of each sequence."""
        reach(sequences.sparkSession)
        last = sequences.withColumn("_p", F.row_number().over(S.Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("tie")))).where(F.col("_p") <= self.context)
        kept = last.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_p")).alias("p"), F.col("embedding").cast("array<double>").alias("v")))), lambda x: x["v"]).alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [self.next(v, steps) for v in batch.column(1).to_pylist()]
                n = steps or self.steps
                yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n))), pa.array(np.tile(np.arange(1, n + 1), batch.num_rows), pa.int32()), pa.array([v for one in found for v in one], pa.list_(pa.float64()))], names=["id", "step", "prediction"])

        return kept.mapInArrow(run, "id string, step int, prediction array<double>")


def features(x: np.ndarray, layer: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x if layer is None else np.maximum(x @ layer[0] + layer[1], 0)], axis=1)


def fit(sequences: DataFrame, d: int, context: int = 5, steps: int = 1, hidden: int = 0, l2: float = 1e-6, seed: int = 42) -> Predictor:
    """Fit to all complete windows of (id, ts, embedding, tie); without any all predictions are zero."""
    reach(sequences.sparkSession)
    layer = None
    if hidden:
        rng = np.random.default_rng(seed)
        layer = rng.normal(size=(context * d, hidden)) / np.sqrt(context * d), rng.normal(size=hidden)
    size, out = 1 + (hidden or context * d), steps * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size * (size + out)), 0
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (0, 1))
                f = features(x, layer)
                total += np.concatenate([f.T @ f, f.T @ y], axis=1).ravel()
                n += batch.num_rows
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([total.tolist()])], names=["n", "part"])

    windows = S.sliding(sequences.withColumn("embedding", F.col("embedding").cast("array<double>")), context, steps)
    flat = windows.select(F.flatten("context").alias("x"), F.flatten("target").alias("y")).where((F.size("x") == context * d) & (F.size("y") == out))
    parts = flat.mapInArrow(run, "n long, part array<double>").select("n", F.posexplode("part").alias("at", "x"))
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("at").collect()  # size * (size + out) numbers, however many windows
    if not rows:
        return Predictor(d, context, steps, np.zeros((size, out)), layer, 0)
    sums = np.array([r.x for r in rows]).reshape(size, size + out)
    penalty = np.full(size, l2 * rows[0].n)
    penalty[0] = 0.0
    weights = np.linalg.lstsq(sums[:, :size] + np.diag(penalty), sums[:, size:], rcond=None)[0]
    return Predictor(d, context, steps, weights, layer, rows[0].n)
