"""An index of vectors by cells around means, with exact nearest-neighbour search.

Means are fitted on a bounded sample; every vector is put into the cell of its nearest mean. A search looks into the nearest cells that hold enough
vectors, and then into every other cell that may hold a nearer one: by the triangle inequality of angles none in a cell can be nearer to a query
than its angle to the mean less the cell's widest angle. So the result is that of comparing all, whatever the data; how many cells are passed over
depends on how clustered they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.similarity import largest, packed, paired, unit_matrix
from eventloom.session import reach, stored

#: Vectors that means are fitted on, cells, and vectors of a cell that one task packs, at most.
SAMPLE, CELLS, PACKED_ROWS = 20_000, 1024, 200_000


@dataclass
class CellIndex:
    """``blocks``: packed vectors with their cell as kind. ``means`` (cells, d) of length 1; ``widest`` angle and ``size`` of each cell."""

    blocks: DataFrame
    means: np.ndarray
    widest: np.ndarray
    size: np.ndarray

    @property
    def d(self) -> int:
        return self.means.shape[1]


def means_of(x: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell keeps its mean."""
    means = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        cell = np.argmax(x @ means.T, axis=1)
        total = np.zeros_like(means)
        np.add.at(total, cell, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        means = np.where(length > 1e-12, total / np.maximum(length, 1e-12), means)
    return means


def angles(s: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(s, -1.0, 1.0))


def build(df: DataFrame, d: int, key: str = "id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """Index all vectors of length ``d`` that have a direction; others, and null ids, are left out. ``cells`` is the root of their number by default."""
    reach(df.sparkSession)
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == d) & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: F.isnan(x) | x.isNull()))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()["v"].combine_chunks()
    if not len(some):
        return CellIndex(packed(rows.withColumn("cell", F.lit(0)), "id", "v", "cell"), np.zeros((0, d)), np.zeros(0), np.zeros(0, np.int64))
    x = unit_matrix(some if isinstance(some, pa.Array) else pa.concat_arrays(some.chunks))
    means = means_of(x, cells or min(CELLS, max(1, int(np.sqrt(rows.count())))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = unit_matrix(batch.column(1)) @ means.T if batch.num_rows else np.zeros((0, len(means)))
            cell = np.argmax(s, axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(angles(s[np.arange(len(cell)), cell]))], names=["id", "v", "cell", "angle"])

    placed = stored(rows.mapInArrow(assign, "id long, v array<double>, cell int, angle double"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest")).toPandas()  # a row a cell
    widest, size = np.full(len(means), -np.inf), np.zeros(len(means), np.int64)
    widest[sizes.cell], size[sizes.cell] = sizes.widest + 1e-7, sizes.n
    parts = F.element_at(F.array(*[F.lit(int(max(1, -(-n // PACKED_ROWS)))) for n in size]), F.col("cell") + 1)
    spread = placed.withColumn("_salt", F.pmod(F.xxhash64("id"), parts)).repartition("cell", "_salt").sortWithinPartitions("cell")
    return CellIndex(stored(packed(spread, "id", "v", "cell"), "blocks"), means, widest, size)


def search(index: CellIndex, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query, neighbour, similarity, place): the ``k`` nearest of all indexed vectors by cosine, the query's own id left out, ties by id.

    Queries without a direction, or of another length, have no neighbours.
    """
    reach(queries.sparkSession)
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == index.d) & F.exists("v", lambda x: x != 0))
    means, widest, size = index.means, index.widest, index.size

    def cells_of(choose: Callable[[np.ndarray, list], np.ndarray], rows: DataFrame) -> DataFrame:
        """(id, v, cell) of the cells that ``choose(angles to means, further columns)`` says."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(means):
                    i, cell = np.nonzero(choose(angles(unit_matrix(batch.column(1)) @ means.T), [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]))
                    take = pa.array(i)
                    yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell, pa.int32())], names=["id", "v", "cell"])

        return rows.mapInArrow(run, "id long, v array<double>, cell int").repartition("cell").sortWithinPartitions("cell")

    def nearest_cells(a: np.ndarray, _: list | None = None) -> np.ndarray:
        """The nearest cells, as many as hold ``k`` vectors beside the query."""
        order = np.argsort(a, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        take = np.zeros(a.shape, bool)
        np.put_along_axis(take, order, before < k + 1, axis=1)
        return take & (size > 0)

    def others(a: np.ndarray, more: list) -> np.ndarray:
        return ~nearest_cells(a) & (a - widest <= more[0][:, None] + 1e-9) & (size > 0)

    def pick(s, ids, ids2):
        s = np.where(ids[:, None] == ids2[None, :], -np.inf, s)
        i, j = largest(s, ids2, k)
        return pa.record_batch([pa.array(ids[i]), pa.array(ids2[j]), pa.array(s[i, j])], names=["query", "neighbour", "similarity"])

    def found(rows: DataFrame) -> DataFrame:
        return paired(packed(rows, "id", "v", "cell"), index.blocks, pick, "query long, neighbour long, similarity double", F.col("kind") == F.col("kind2"))

    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 10)), "neighbour")
    best = lambda rows: rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    first = stored(best(found(cells_of(nearest_cells, asked))), "nearest")
    bound = first.where(F.col("place") == k).select(F.col("query").alias("id"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "similarity"))).alias("bound"))
    rest = found(cells_of(others, asked.join(bound, "id", "left").select("id", "v", F.coalesce("bound", F.lit(4.0)).alias("bound"))))
    return best(first.drop("place").unionByName(rest).distinct())
