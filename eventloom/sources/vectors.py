"""A store of vector collections as tables of files: create, insert or replace, get, delete, search, copy with a filter, and use as a table.

A collection is <root>/<name>: numbered versions of Parquet files bucketed by id, and state files that say which version of each bucket counts. A change
rewrites the buckets that it touches and then writes the next state file, so readers see all of it or nothing, and a writer that fails changes nothing.
One writer a collection at a time: of two the second one's state file exists already, and it raises ``FileExistsError``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import similarity as M
from eventloom.session import listed, read_text, remove, shared_folder, write_text
from eventloom.sources.warehouse import checked, step_ids

ROWS = "id string, embedding array<float>, tag string"


class VectorStore:
    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root or f"{shared_folder(spark)}/vectors", buckets

    def _state(self, name: str) -> dict:
        numbers = [int(x[:-5]) for x in listed(self.spark, f"{self.root}/{checked(name)}/state") if re.fullmatch(r"\d+\.json", x)]
        if not numbers:
            raise KeyError(name)
        return json.loads(read_text(self.spark, f"{self.root}/{name}/state/{max(numbers)}.json")) | {"number": max(numbers)}

    def _next(self, name: str, state: dict, where: dict[str, int]) -> None:
        number = state["number"] + 1
        write_text(self.spark, f"{self.root}/{name}/state/{number}.json", json.dumps({"width": state["width"], "buckets": state["buckets"], "where": where}))
        used = {*where.values(), *state["where"].values()}  # a reader may still have the state before
        for version in listed(self.spark, f"{self.root}/{name}/data"):
            if int(version) not in used:
                remove(self.spark, f"{self.root}/{name}/data/{version}")

    def create(self, name: str, width: int) -> bool:
        """Make a collection of vectors of ``width``; whether it was missing. One of another width raises ``ValueError``."""
        if self.exists(name):
            if self._state(name)["width"] != width:
                raise ValueError(f"{name} has vectors of another width")
            return False
        write_text(self.spark, f"{self.root}/{name}/state/1.json", json.dumps({"width": width, "buckets": self.buckets, "where": {}}))
        return True

    def exists(self, name: str) -> bool:
        return bool(listed(self.spark, f"{self.root}/{checked(name)}/state"))

    def collections(self) -> list[str]:
        return [x for x in listed(self.spark, self.root) if self.exists(x)]

    def drop(self, name: str) -> None:
        self._state(name)
        remove(self.spark, f"{self.root}/{name}")

    def describe(self, name: str) -> dict:
        return {"name": name, "width": self._state(name)["width"], "count": self.table(name).count()}

    def table(self, name: str) -> DataFrame:
        """(id, embedding, tag) of all vectors."""
        state = self._state(name)
        return self._read(name, state, sorted(state["where"]))

    def _read(self, name: str, state: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.root}/{name}/data/{state['where'][k]}/bucket={k}" for k in buckets]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(state["buckets"])).cast("int")

    def put(self, name: str, rows: DataFrame) -> int:
        """Insert (id, embedding[, tag]), in place of vectors of the same ids; returns how many ids. Of rows that repeat an id one counts (the largest).

        A null id, a null vector or one of another width raises ``ValueError``, and nothing is changed.
        """
        state = self._state(name)
        tag = F.col("tag").cast("string") if "tag" in rows.columns else F.lit(None).cast("string")
        new = rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), tag.alias("tag"))
        bad = new.where(F.col("id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != state["width"])).limit(1).count()
        if bad:
            raise ValueError(f"ids and vectors of width {state['width']} are needed")
        one = new.groupBy("id").agg(F.max(F.struct("embedding", "tag")).alias("v")).select("id", "v.*")
        return self._change(name, state, one)

    def delete(self, name: str, ids: DataFrame) -> int:
        """Remove the ids of a one-column table; returns how many were asked for."""
        return self._change(name, self._state(name), ids.toDF("id").select(F.col("id").cast("string")).where("id is not null").distinct().withColumns({"embedding": F.lit(None).cast("array<float>"), "tag": F.lit(None).cast("string")}))

    def _change(self, name: str, state: dict, new: DataFrame) -> int:
        number, path = state["number"] + 1, f"{self.root}/{name}/data"
        new.withColumn("bucket", self._bucket(state)).write.mode("overwrite").parquet(f"{path}/0")  # what is new, held as a table while it is counted and joined
        new = self.spark.read.parquet(f"{path}/0")
        touched = {r["bucket"]: r["n"] for r in new.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        kept = self._read(name, state, [str(k) for k in touched if str(k) in state["where"]]).join(new.select("id"), "id", "left_anti")
        whole = kept.withColumn("bucket", self._bucket(state)).unionByName(new.where("embedding is not null"))
        whole.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/{number}")
        left = {x.removeprefix("bucket=") for x in listed(self.spark, f"{path}/{number}") if x.startswith("bucket=")}
        where = {k: v for k, v in state["where"].items() if int(k) not in touched} | {k: number for k in left}
        self._next(name, state, where)
        return sum(touched.values())

    def get(self, name: str, ids: DataFrame) -> DataFrame:
        return self.table(name).join(ids.toDF("id").select(F.col("id").cast("string")), "id", "left_semi")

    def search(self, name: str, vector: list[float], k: int = 10, tag: str | None = None) -> DataFrame:
        """(id, similarity) of the nearest, of those with a tag if given; a vector of another width raises ``ValueError``."""
        rows = self.table(name)
        rows = rows if tag is None else rows.where(F.col("tag") == tag)
        if len(vector) != self._state(name)["width"]:
            raise ValueError("vector of another width")
        return M.by_vector(rows, vector, k)

    def copy(self, source: str, target: str, tag: str | None = None) -> int:
        """Put the vectors of one collection (those with ``tag``, if given) into another, which is made if missing."""
        self.create(target, self._state(source)["width"])
        rows = self.table(source)
        return self.put(target, rows if tag is None else rows.where(F.col("tag") == tag))

    def register(self, name: str, table: str | None = None) -> str:
        """A saved table of the collection, made again if there is one; returns its name."""
        table = checked(table or name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.table(name).write.mode("overwrite").saveAsTable(table)
        return table

    def sync(self, results: DataFrame, prefix: str = "sequences") -> dict[str, int]:
        """Put the representations and predictions of processed sequences into <prefix>_representations and <prefix>_predictions; the numbers of ids."""
        out = {}
        for kind, rows in (("representations", results.select("id", F.col("representation").alias("embedding"))), ("predictions", step_ids(results).toDF("id", "embedding"))):
            first = rows.where("embedding is not null").select(F.size("embedding")).first()
            if first is None:
                out[kind] = 0
                continue
            self.create(f"{prefix}_{kind}", first[0])
            out[kind] = self.put(f"{prefix}_{kind}", rows.withColumn("tag", F.lit(kind)))
        return out
