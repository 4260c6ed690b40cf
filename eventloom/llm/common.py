"""What the operators of this subpackage share."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import BROADCAST_ROWS, columns_of, drop, named, reach, small_enough, stored

#: Rows and bytes of an Arrow batch: texts can be long, so batches hold fewer than by Spark's default. A longer text comes alone.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def arrow_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes of an Arrow batch to ``ARROW_ROWS`` and ``ARROW_BYTES`` if the session has more, and let the workers find this package."""
    reach(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= ARROW_BYTES:
        spark.conf.set(size, str(ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_type(docs: DataFrame, key: str = "doc_id") -> str:
    """The type that an operator gives ids in: long for whole numbers, else string."""
    return "long" if dict(docs.dtypes)[key] in INTEGRAL else "string"


def narrow(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under names of its own: further columns can't clash."""
    return docs.select(named(key).cast(id_type(docs, key)).alias("_k"), named(text).cast("string").alias("_t"))


def without(docs: DataFrame, drop: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in column ``name`` of the stored table ``drop``.

    ``drop`` is broadcast up to ``BROADCAST_ROWS`` rows; a larger one is joined by shuffling both sides.
    """
    small = small_enough(drop)
    kept = docs.join(F.broadcast(drop) if small else drop, key == drop[name], "left_anti")
    return kept


def apart(found: list[tuple]) -> list[tuple]:
    """Of tuples with begin and end at 1 and 2, best first, those that overlap no better one; in order of begin."""
    kept: list[tuple] = []
    begins: list[int] = []
    for f in found:
        at = bisect.bisect_left(begins, f[2])
        if not at or kept[at - 1][2] <= f[1]:
            kept.insert(at, f)
            begins.insert(at, f[1])
    return kept


__all__ = ["ARROW_ROWS", "BROADCAST_ROWS", "apart", "arrow_batches", "columns_of", "documents", "drop", "id_type", "named", "narrow", "small_enough", "stored", "without"]
