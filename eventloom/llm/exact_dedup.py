"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests bucketed and sorted by digest. A batch of new data is reduced to its distinct digests, anti-joined
with the index by sort-merge (the index side needs no shuffle, and no sort while a bucket is one file), and the new digests are appended. After
``compact_after`` appends the index is rewritten to one sorted file a bucket.

A batch's digests are appended by ``Batch.commit``, after the rows that stay have been written: a job that fails before has changed nothing and
is run again. A commit that is repeated adds digests twice, which changes no result and goes with the next rewriting.

Defined cases: of several rows with equal text the one with the smallest id stays (a null id is larger than any; of repeated rows with the
same id one stays, the first by its JSON form); a null text has no content to compare and always stays; empty texts are equal to each other; an
empty batch adds nothing; ids may be of any type with an order. Further columns pass through whatever their names and types.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import BROADCAST_ROWS, INTEGRAL, columns_of, drop, named, small_enough, stored
from eventloom.session import file_system, remove, shared_folder, unused


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside know that a bucket of one file is sorted."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class DigestIndex:
    """Digests seen so far, under ``path``: generations g<n>_b<buckets>, of which the newest complete one counts.

    The path outlives the session: opening it again registers the same files, with the buckets that they have. ``buckets`` should not be fewer than
    the shuffle's partitions, or Spark may shuffle the index too.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64, compact_after: int = 16):
        self.spark, self.path, self.name, self.compact_after = spark, path, name, compact_after
        self.generation, self.buckets = 0, buckets
        files, root = file_system(spark, path)
        made = [re.fullmatch(r"g(\d+)_b(\d+)", s.getPath().getName()) for s in files.listStatus(root)] if files.exists(root) else []
        done = sorted((int(m[1]), int(m[2])) for m in made if m and files.exists(file_system(spark, f"{path}/{m[0]}/_SUCCESS")[1]))
        if done:
            self.generation, self.buckets = done[-1]
            self._register()
        for m in made:
            if m and m[0] != self._folder():
                remove(spark, f"{path}/{m[0]}")

    def _folder(self) -> str:
        return f"g{self.generation}_b{self.buckets}"

    def _table(self) -> str:
        return f"{self.name}_{self._folder()}"

    def _register(self) -> None:
        if not self.spark.catalog.tableExists(self._table()):
            self.spark.sql(f"CREATE TABLE {self._table()} (digest BINARY) USING parquet OPTIONS (path '{self.path}/{self._folder()}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def table(self) -> DataFrame | None:
        return self.spark.table(self._table()) if self.spark.catalog.tableExists(self._table()) else None

    def unseen(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` whose column ``digest`` is not in the index."""
        known = self.table()
        return digests if known is None else digests.hint("merge").join(known.hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame) -> None:
        """Add distinct digests that are not in the index yet."""
        if self.table() is not None and self.files_a_bucket() >= self.compact_after:
            self.compact()
        self._write(digests)

    def _write(self, digests: DataFrame) -> None:
        writer = digests.select("digest").repartition(self.buckets, "digest").write.format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", f"{self.path}/{self._folder()}").saveAsTable(self._table())

    def files_a_bucket(self) -> int:
        files, root = file_system(self.spark, f"{self.path}/{self._folder()}")
        buckets = [re.search(r"_(\d{5})(?:\.|$)", s.getPath().getName()) for s in files.listStatus(root)]
        return max(Counter(m[1] for m in buckets if m).values(), default=0)

    def compact(self) -> None:
        """Rewrite the index to one sorted file a bucket. Until that is complete the old generation counts."""
        every, old, table = self.table().distinct(), self._folder(), self._table()
        self.generation += 1
        self._write(every)
        self.spark.sql(f"DROP TABLE {table}")
        remove(self.spark, f"{self.path}/{old}")

    def delete(self) -> None:
        """Drop the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table()}")
        remove(self.spark, self.path)


@dataclass
class Batch:
    """``rows`` stay; write them, then ``commit`` their digests."""

    rows: DataFrame
    digests: DataFrame
    index: DigestIndex

    def commit(self) -> None:
        self.index.append(self.digests)


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(named(text).cast("string"), 256))


def dedup(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, beside what ``index`` holds; the index is not changed."""
    return _kept(docs, index, key, text)[0]


def batch(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> Batch:
    """The rows of ``docs`` that stay and the digests that ``index`` is to get."""
    return Batch(*_kept(docs, index, key, text), index)


def ingest(docs: DataFrame, index: DigestIndex, write: Callable[[DataFrame], None], key: str = "doc_id", text: str = "text") -> None:
    """Write the rows of ``docs`` that stay, and commit their digests if that did not fail."""
    new = batch(docs, index, key, text)
    write(new.rows)
    new.commit()


def _kept(docs: DataFrame, index: DigestIndex | None, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the digests that are new.

    Only (digest, id) is shuffled to find the copies, after (digest, id) has been counted in each partition. The digests that occur more than once,
    with the id that stays, are then joined to the documents: broadcast up to ``BROADCAST_ROWS`` of them, else by a shuffle.
    """
    d, i = unused(docs, "_digest"), unused(docs, "_id")
    by_id = docs.where(named(text).isNotNull()).select(digest_of(text).alias("digest"), named(key).alias("id")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by(F.struct("id", "n"), F.struct(F.col("id").isNull(), F.col("id")))
    groups = by_id.groupBy("digest").agg(F.sum("n").alias("n"), first.alias("first"))
    groups = stored(groups.select("digest", "n", F.col("first.id").alias("id"), F.col("first.n").alias("same")), "digests")
    fresh, copied = groups, lambda t, known: t.select("digest", "id", "same", F.lit(known).alias("known"))
    dropped = copied(groups.where("n > 1"), False)
    if index and index.table() is not None:
        with sorted_buckets(docs.sparkSession):
            fresh = stored(index.unseen(groups), "fresh")
        dropped = copied(fresh.where("n > 1"), False).unionByName(copied(groups.join(fresh.select("digest"), "digest", "left_anti"), True))
    dropped = stored(dropped, "copies")
    copies = dropped.select(F.col("digest").alias(d), F.col("id").alias(i), F.col("same").alias(unused(docs, "_same")), F.col("known").alias(unused(docs, "_known")))
    same, known = copies.columns[2:]
    joined = docs.withColumn(d, digest_of(text)).join(F.broadcast(copies) if small_enough(dropped) else copies, d, "left")
    stays = joined.where(F.col(same).isNull() | (~F.col(known) & named(key).eqNullSafe(F.col(i))))
    if dropped.where("not known and same > 1").limit(1).count():
        place = unused(docs, "_place")
        ordered = Window.partitionBy(d).orderBy(F.to_json(F.struct(*columns_of(docs))))
        again = stays.where(F.col(same) > 1).withColumn(place, F.row_number().over(ordered)).where(F.col(place) == 1)
        stays = stays.where(F.coalesce(F.col(same), F.lit(1)) == 1).select(*columns_of(docs)).unionByName(again.select(*columns_of(docs)))
    if fresh is not groups:
        drop(groups)
    return stays.select(*columns_of(docs)), fresh


def dedup_batches(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in two batches: the smaller half of the ids first, then the others and null ids (text ids in one batch).

    The index is this call's own unless given. Its digests are committed before the rows are written, as the rows are this call's result: if they
    are not written, the whole call is made again with another index.
    """
    own = index or new_index(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    half = docs.agg(F.percentile_approx(named(key), 0.5)).first()[0] if kind in INTEGRAL else None
    low = F.coalesce(named(key) <= F.lit(half), F.lit(False)) if half is not None else F.lit(True)
    out = None
    for part in (docs.where(low), docs.where(~low)) if half is not None else (docs,):
        one = batch(part, own, key, text)
        one.commit()
        out = one.rows if out is None else out.union(one.rows)
    if index is None:
        own.delete()
    return out


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, f"{shared_folder(spark)}/{name}", name, buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))


__all__ = ["BROADCAST_ROWS", "Batch", "DigestIndex", "batch", "dedup", "dedup_batches", "digest_of", "ingest", "new_index"]
