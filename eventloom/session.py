"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows that a join side may have and still be broadcast.
BROADCAST_ROWS = 200_000


def local_session(app: str = "eventloom", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from outside."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, whatever folder they are started in."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *have])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none (tests, local runs) gets a temporary one; on a cluster that is an error, as executors don't share
    the driver's disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="eventloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that ``path`` is on, and the path as its own."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it is on."""
    files, target = file_system(spark, path)
    files.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it, so that a reader never sees half of it; an existing one stays as it is."""
    files, target = file_system(spark, path)
    _, made = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(made, target):
        files.delete(made, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    files, target = file_system(spark, path)
    source = files.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    files, target = file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def at_end(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted when the driver ends."""
    files, target = file_system(spark, path)
    files.deleteOnExit(target)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends, and columns stay prunable.

    The folder goes when the driver ends, or before with ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_end(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing lazy reads any more."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def named(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever they are called."""
    return [named(c) for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with as many underscores after it as no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows. ``df`` should be a stored table: its rows are counted."""
    return df.limit(limit + 1).count() <= limit
