"""File sinks: Parquet artefacts that are made once, and Arrow IPC files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from eventloom.session import remove


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def materialize(df: DataFrame, path: str, again: bool = False, partition_by: list[str] | None = None, rows_per_file: int = 0) -> DataFrame:
    """``df`` as ZSTD Parquet at ``path``, read back. What is complete there already (its success marker says so) stays, unless ``again``."""
    spark = df.sparkSession
    if again or not exists(spark, f"{path}/_SUCCESS"):
        if exists(spark, path):
            remove(spark, path)
        writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def to_ipc(df: DataFrame, path: str, limit: int = 10_000_000) -> int:
    """Write the rows to one Arrow IPC file for other programs; more than ``limit`` rows raise (they belong in Parquet). Returns the rows."""
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise ValueError(f"more than {limit} rows: write Parquet instead")
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    return table.num_rows


def from_ipc(spark: SparkSession, path: str) -> DataFrame:
    with pa.memory_map(path) as source:
        return spark.createDataFrame(pa.ipc.open_file(source).read_all())
