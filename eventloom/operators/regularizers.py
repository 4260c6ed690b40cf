"""How far a population of embeddings is from a target distribution. Each is a few sums over the rows: partitions send sums, never rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import reach


def directions(d: int, n: int, seed: int) -> np.ndarray:
    """(d, n): random columns of length 1."""
    x = np.random.default_rng(seed).normal(size=(d, n))
    return x / np.linalg.norm(x, axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _summed(df: DataFrame, vector: str, sums) -> tuple[int, np.ndarray]:
    """(rows, sum of ``sums(matrix)`` over all batches); its flat array is added up by place in Spark."""
    reach(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch.column(0))).ravel()
                total, n = part if total is None else total + part, n + batch.num_rows
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([total.tolist()])], names=["n", "part"])

    parts = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "n long, part array<double>")
    rows = parts.select("n", F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("at").collect()
    return (rows[0].n, np.array([r.x for r in rows])) if rows else (0, np.zeros(0))


def sigreg(df: DataFrame, d: int, vector: str = "embedding", count: int = 64, seed: int = 42, sigma: float = 1.0, points: int = 17, reach_to: float = 5.0) -> float:
    """Mean over random directions of n times the weighted squared distance of the empirical characteristic function of the standardised data from the Gaussian's."""
    n, moments = _summed(df, vector, lambda x: np.concatenate([x.sum(0), (x * x).sum(0)]))
    if n < 2:
        return 0.0
    mean = moments[:d] / n
    std = np.maximum(np.sqrt(np.maximum(moments[d:] - n * mean**2, 0) / (n - 1)), 1e-8)
    u, t = directions(d, count, seed), np.linspace(-reach_to, reach_to, points)

    def waves(x: np.ndarray) -> np.ndarray:
        phase = (((x - mean) / std) @ u)[:, :, None] * t
        return np.stack([np.cos(phase).sum(0), np.sin(phase).sum(0)])

    _, sums = _summed(df, vector, waves)
    real, imaginary = sums.reshape(2, count, points) / n
    off = ((real - np.exp(-0.5 * t**2)) ** 2 + imaginary**2) * np.exp(-((t / sigma) ** 2))
    return float(n * np.trapezoid(off, t, axis=1).mean())


def weak_sigreg(df: DataFrame, d: int, vector: str = "embedding", sketch: int = 32, seed: int = 42) -> float:
    """Squared distance of the sketched covariance (divided by n) from the sketched identity."""
    n, sums = _summed(df, vector, lambda x: np.concatenate([x.sum(0), (x.T @ x).ravel()]))
    if not n:
        return 0.0
    mean = sums[:d] / n
    cov = sums[d:].reshape(d, d) / n - np.outer(mean, mean)
    s = np.random.default_rng(seed).normal(size=(sketch, d)) / np.sqrt(d)
    return float((((s @ cov @ s.T) - s @ s.T) ** 2).sum())


def rdmreg(df: DataFrame, d: int, vector: str = "embedding", key: str = "id", count: int = 16, seed: int = 42, p: float = 2.0, sparsity: float = 0.0) -> float:
    """Sliced squared Wasserstein distance of the rectified data from a rectified generalised Gaussian sample of the same size.

    Each row draws its sample from its key. Ranks are windows by direction, so there are as many sorted partitions as directions.
    """
    from statistics import NormalDist

    u, mu = directions(d, count, seed), -NormalDist().inv_cdf(1 - sparsity) if sparsity else 0.0
    reach(df.sparkSession)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.maximum(_matrix(batch.column(1)), 0) @ u
            y = np.stack([np.random.default_rng([seed, k & 0xFFFFFFFF]).normal(size=d) for k in batch.column(0).to_pylist()])
            y = np.maximum(np.sign(y) * np.abs(y) ** (2.0 / p) + mu, 0) @ u
            yield pa.record_batch([pa.array(np.tile(np.arange(count), len(x))), pa.array(x.ravel()), pa.array(y.ravel())], names=["direction", "x", "y"])

    rows = df.select(F.xxhash64(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(project, "direction long, x double, y double")
    place = lambda c: rows.select("direction", c, F.row_number().over(Window.partitionBy("direction").orderBy(c)).alias("place"))
    both = place("x").join(place("y"), ["direction", "place"])
    return both.agg(F.avg(F.pow(F.col("x") - F.col("y"), 2.0))).first()[0] or 0.0


def vicreg(online: DataFrame, target: DataFrame, d: int, key: str = "id", vector: str = "embedding", weights: tuple[float, float, float] = (25.0, 25.0, 1.0)) -> dict[str, float]:
    """Invariance (mean squared difference of rows of one key), variance (hinge of 1 on the deviation of each dimension, n - 1, of both sides) and
    covariance (squared off-diagonal covariances over d, of both sides), and their weighted ``loss``. Each is a few sums; 0 without common keys."""
    both = online.select(key, F.col(vector).cast("array<double>").alias("a")).join(target.select(key, F.col(vector).cast("array<double>").alias("b")), key)
    held = both.select(F.concat("a", "b").alias("ab"))
    size = 2 * d
    n, sums = _summed(held, "ab", lambda x: np.concatenate([x.sum(0), (x.T @ x).ravel(), [((x[:, :d] - x[:, d:]) ** 2).sum()]]))
    if n < 2:
        return {"invariance": 0.0, "variance": 0.0, "covariance": 0.0, "loss": 0.0}
    mean, products = sums[:size] / n, sums[size:-1].reshape(size, size)
    cov = (products - n * np.outer(mean, mean)) / (n - 1)
    out = {"invariance": float(sums[-1] / (n * d)), "variance": 0.0, "covariance": 0.0}
    for part in (cov[:d, :d], cov[d:, d:]):
        out["variance"] += float(np.maximum(0, 1 - np.sqrt(np.diag(part) + 1e-4)).mean())
        out["covariance"] += float(((part - np.diag(np.diag(part))) ** 2).sum() / d)
    return out | {"loss": weights[0] * out["invariance"] + weights[1] * out["variance"] + weights[2] * out["covariance"]}


def combined_loss(prediction: float, levels: list[float], weight: float = 0.1, weights: list[float] | None = None) -> float:
    """prediction + weight * the weighted sum of the levels' penalties; uniform weights unless given."""
    weights = weights or [1.0 / len(levels)] * len(levels) if levels else []
    return prediction + weight * reduce(lambda a, b: a + b, (w * x for w, x in zip(weights, levels)), 0.0)
