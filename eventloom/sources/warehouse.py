"""Named sources, the warehouse view over them, loading of sequences and entities, and writers of results.

A source is a folder of tables, a database reached over JDBC, or a dictionary of DataFrames. Nothing is read until a table is asked for. The
warehouse is a union by name over the sources that have a table, with the source's name in ``sourcedb``; it is one plan, so filters on
``sourcedb`` and on columns reach the scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import BROADCAST_ROWS

from eventloom.operators.sequences import from_table

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
FORMATS = ("parquet", "orc", "csv", "json", "avro")


def checked(name: str) -> str:
    """``name`` if it can stand in SQL as it is."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


class Source:
    """A place tables come from: ``tables`` lists them, ``table`` reads one."""

    def __init__(self, tables: Callable[[], list[str]], table: Callable[[str], DataFrame]):
        self.tables, self.table = tables, table

    @staticmethod
    def folder(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> Source:
        """``path``/<table>.<kind>, files or folders, on any file system that Spark reaches."""
        if kind not in FORMATS:
            raise ValueError(f"unknown format: {kind}")

        def listed() -> list[str]:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
            return sorted(n.removesuffix(f".{kind}") for n in names if n.endswith(f".{kind}"))

        return Source(listed, lambda t: spark.read.format(kind).options(**options).load(f"{path}/{t}.{kind}"))

    @staticmethod
    def jdbc(spark: SparkSession, url: str, listing: str, **options: str) -> Source:
        """A database; ``listing`` is the query of its table names. ``partitionColumn`` and its companions split a table's read."""
        read = lambda **more: spark.read.format("jdbc").options(url=url, **(options | more)).load()
        plain = {k: v for k, v in options.items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
        return Source(lambda: sorted(r[0] for r in spark.read.format("jdbc").options(url=url, query=listing, **plain).load().collect()), lambda t: read(dbtable=checked(t)))

    @staticmethod
    def memory(tables: dict[str, DataFrame]) -> Source:
        return Source(lambda: sorted(tables), tables.__getitem__)

    @staticmethod
    def schema(spark: SparkSession, database: str) -> Source:
        """A database of the session's catalog."""
        return Source(lambda: sorted(t.name for t in spark.catalog.listTables(database)), lambda t: spark.table(f"{checked(database)}.{checked(t)}"))


class Warehouse:
    """Attached sources and what is built from them. Also a context manager; a closed one raises RuntimeError."""

    def __init__(self, spark: SparkSession):
        self._spark, self._sources, self._views = spark, {}, []

    def __enter__(self) -> Warehouse:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            raise RuntimeError("the warehouse is closed")
        return self._spark

    def close(self) -> None:
        if self._spark is not None:
            for view in self._views:
                self._spark.catalog.dropTempView(view)
        self._spark, self._sources = None, {}

    def attach(self, name: str, source: Source | str, kind: str = "parquet", **options: str) -> None:
        """Attach a source, or the folder it is in. Sources are only read."""
        checked(name)
        if name in self._sources:
            raise ValueError(f"already attached: {name}")
        self._sources[name] = Source.folder(self.spark, source, kind, **options) if isinstance(source, str) else source

    def detach(self, name: str) -> None:
        if self._sources.pop(name, None) is None:
            raise KeyError(name)

    @property
    def attached(self) -> list[str]:
        return list(self._sources)

    def tables(self, name: str) -> list[str]:
        return self._sources[name].tables()

    def union(self, table: str, only: list[str] | None = None) -> DataFrame | None:
        """The rows of ``table`` in all sources that have it (of ``only``), columns by name, missing ones null."""
        self.spark  # noqa: B018
        unknown = set(only or []) - set(self._sources)
        if unknown:
            raise KeyError(f"not attached: {sorted(unknown)}")
        parts = [s.table(table).withColumn("sourcedb", F.lit(n)) for n, s in self._sources.items() if (only is None or n in only) and table in s.tables()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def build(self, tables: list[str], only: list[str] | None = None, save: bool = False) -> dict[str, int]:
        """Make each table's union a view (or a saved table) of that name; returns the rows of each, 0 for one that no source has."""
        counts = {}
        for t in tables:
            whole = self.union(checked(t), only)
            if whole is None:
                counts[t] = 0
                continue
            if save:
                whole.write.mode("overwrite").saveAsTable(t)
            else:
                whole.createOrReplaceTempView(t)
                self._views.append(t)
            counts[t] = self.spark.table(t).count()
        return counts

    def query(self, text: str, limit: int | None = None) -> DataFrame:
        """A SELECT over the views; anything that writes is refused."""
        if not re.match(r"\s*(select|with|values|table|from|show|describe)\b", text, re.I):
            raise ValueError("only reading queries are allowed")
        out = self.spark.sql(text)
        return out if limit is None else out.limit(limit)

    def sample(self, table: str, n: int = 10) -> DataFrame:
        return self.spark.table(table).limit(n)

    def _named(self, table: str | None, query: str | None) -> DataFrame:
        if (table is None) == (query is None):
            raise ValueError("give a table or a query")
        return self.spark.table(table) if table else self.query(query)

    def load_sequences(self, table: str | None = "event_sequences", query: str | None = None, columns: dict[str, str] | None = None, tie: str | None = None) -> DataFrame:
        """(id, ts, embedding, modality, tie) from a table or a query; ``columns`` maps our names to its."""
        names = {"id": "sequence_id", "ts": "timestamp", "embedding": "embedding", "modality": "modality"} | (columns or {})
        df = self._named(None if query else table, query)
        missing = [c for k, c in names.items() if c not in df.columns and k != "modality"]
        if missing:
            raise ValueError(f"required columns not found: {missing}")
        return from_table(df, {k: c for k, c in names.items() if c in df.columns}, tie)

    def load_entities(self, table: str | None = "entities", query: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
        """(id, category, embeddings by modality): one row an entity."""
        names = {"id": "entity_id", "modality": "modality", "embedding": "embedding", "category": "category"} | (columns or {})
        df = self._named(None if query else table, query)
        missing = [c for k, c in names.items() if c not in df.columns and k != "category"]
        if missing:
            raise ValueError(f"required columns not found: {missing}")
        category = F.max(names["category"]) if names["category"] in df.columns else F.lit(None).cast("string")
        rows = df.groupBy(F.col(names["id"]).cast("string").alias("id"), F.col(names["modality"]).alias("modality")).agg(F.max_by(F.col(names["embedding"]), F.col(names["embedding"]).cast("string")).alias("embedding"), category.alias("category"))
        return rows.groupBy("id").agg(F.max("category").alias("category"), F.map_from_entries(F.collect_list(F.struct("modality", "embedding"))).alias("embeddings"))


def steps(df: DataFrame, key: str = "id", predictions: str = "predictions") -> DataFrame:
    """(key, step, prediction): predictions one a row, steps from 1."""
    return df.select(key, F.posexplode(predictions).alias("step", "prediction")).withColumn("step", F.col("step") + 1)


def step_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, vector): predictions under ids of their own, <id>_step_<n>."""
    return steps(df, key).select(F.concat_ws("_step_", key, F.col("step").cast("string")).alias("id"), F.col("prediction").alias("vector"))


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append to a table of files, which is made if it isn't there."""
    df.write.mode("append").format(kind).save(path)


def write_results(results: DataFrame, root: str) -> None:
    """Append the representations, patterns and predictions of processed sequences under ``root``."""
    append(results.select(F.col("id").alias("sequence_id"), F.col("representation").cast("array<float>")), f"{root}/representations.parquet")
    append(results.select(F.col("id").alias("sequence_id"), F.col("patterns").cast("array<int>").alias("salient_dimensions")), f"{root}/patterns.parquet")
    append(steps(results).select(F.col("id").alias("sequence_id"), "step", F.col("prediction").cast("array<float>")), f"{root}/predictions.parquet")


def upsert(spark: SparkSession, old: DataFrame | None, new: DataFrame, key: str, path: str) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and ``new``; written to ``path``, another one than ``old`` is read from."""
    whole = new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
    whole.write.mode("overwrite").parquet(path)
    return spark.read.schema(whole.schema).parquet(path)


def touching(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which one of the columns contains ``text``."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).contains(text) for c in columns]))


def with_ids(df: DataFrame, ids: list, key: str | Column) -> DataFrame:
    """Rows with one of the listed ids: a short list is pushed down to the scan, a longer one is a semi-join, broadcast up to ``BROADCAST_ROWS`` ids."""
    column = F.col(key) if isinstance(key, str) else key
    if len(ids) <= 500:
        return df.where(column.isin(ids))
    held = df.sparkSession.createDataFrame([(i,) for i in ids], ["_wanted"])
    return df.join(F.broadcast(held) if len(ids) <= BROADCAST_ROWS else held, column == F.col("_wanted"), "left_semi")
