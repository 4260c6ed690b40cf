"""Vector algebra as columns. With a known dimension the sums are unrolled, so they stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many dimensions expressions are unrolled; longer vectors use higher-order functions.
UNROLL = 256


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dims(df: DataFrame, vector: str) -> int:
    """The length of the vectors of ``df`` (0 without any)."""
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return row[0] if row else 0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside lambdas Catalyst would repeat the expression for every element."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column | str, b: Column | str, d: int | None = None) -> Column:
    a, b = _c(a), _c(b)
    if d is not None and 0 < d <= UNROLL:
        return reduce(lambda x, y: x + y, (a[i].cast("double") * b[i].cast("double") for i in range(d)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str, d: int | None = None) -> Column:
    return F.sqrt(dot(a, a, d))


def cosine(a: Column | str, b: Column | str, d: int | None = None) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    scale = norm(a, d) * norm(b, d)
    return F.when(scale > 0, dot(a, b, d) / scale).otherwise(0.0)


def euclidean(a: Column | str, b: Column | str, d: int | None = None) -> Column:
    return norm(sub(a, b), None) if d is None or d > UNROLL else F.sqrt(reduce(lambda x, y: x + y, (F.pow(_c(a)[i].cast("double") - _c(b)[i], 2.0) for i in range(d))))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y)


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y)


def scale(a: Column | str, by: Column | float) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double") * by)


def unit(a: Column | str, floor: float = 0.0, d: int | None = None) -> Column:
    """``a`` at length 1; a vector without length (or shorter than ``floor``) is divided by ``floor``, or stays."""
    n = norm(a, d)
    n = F.greatest(n, F.lit(floor)) if floor else F.when(n > 0, n).otherwise(1.0)
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def mean(a: Column | str, d: int) -> Column:
    """Aggregate: the mean vector."""
    return F.array(*[F.avg(_c(a)[i].cast("double")) for i in range(d)])


def weighted_mean(a: Column | str, w: Column | str, d: int) -> Column:
    """Aggregate: sum(w * v) / sum(w) by dimension; a zero total divides by 1."""
    w = _c(w)
    total = F.when(F.sum(w) == 0, F.lit(1.0)).otherwise(F.sum(w))
    return F.array(*[F.sum(w * _c(a)[i].cast("double")) / total for i in range(d)])


def long_form(df: DataFrame, vector: str, *keep: str, places: int | None = 6) -> DataFrame:
    """(keep..., dim, val): a row for each dimension, rounded to ``places``."""
    out = df.select(*keep, F.posexplode(vector).alias("dim", "val"))
    return out.withColumn("val", F.round(F.col("val").cast("double"), places)) if places is not None else out


def seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp, with microseconds; the session's time zone should be UTC."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)
