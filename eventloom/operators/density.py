"""Density clustering: DBSCAN over vectors from a grid of products and connected components.

No pair of near vectors leaves its task: the grid is passed over for the number of each vector's neighbours, then for edges that join the core vectors
of a cell (a forest, at most an edge a vector) and the smallest core neighbour of the others. What is shuffled is in proportion to the vectors of the
cells, however many are near each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import grid
from eventloom.operators.components import components
from eventloom.session import drop, stored


def near_pairs(df: DataFrame, eps: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(a, b) in both orders: pairs of different ids whose cosine distance is at most ``eps``."""
    known = df.where(F.col(key).isNotNull())
    got = grid.meet(known, None, key, vector, grid.pairs_above(1 - eps, strict=False), "a long, b long, similarity double").select("a", "b")
    return got.union(got.select("b", "a"))


def counted(least: float) -> Callable:
    """Work of a cell: (id, n) of how many of the other side are near."""

    def work(held: dict, stream: Iterator[grid.Part], diagonal: bool) -> Iterator[pa.RecordBatch]:
        counts = {key: np.zeros(len(p.ids), np.int64) for key, p in held.items()}
        out = lambda ids, n: pa.record_batch([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["id", "n"])
        for q in stream:
            if q.key not in held:
                continue
            p, other = held[q.key], np.zeros(len(q.ids), np.int64)
            for i, j, _ in grid.hits(p, q, least):
                keep = p.ids[i] != q.ids[j]
                counts[q.key] += np.bincount(i[keep], minlength=len(p.ids))
                if not diagonal:
                    other += np.bincount(j[keep], minlength=len(q.ids))
            if not diagonal:
                yield out(q.ids, other)
        for key, p in held.items():
            yield out(p.ids, counts[key])

    return work


class Forest:
    """Sets of numbered nodes; each is named by its smallest node."""

    def __init__(self):
        self.root = np.zeros(0, np.int64)

    def grow(self, n: int) -> int:
        at = len(self.root)
        self.root = np.concatenate([self.root, np.arange(at, at + n)])
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while len(r):
            up = self.root[r]
            if (up == r).all():
                break
            r = up
        self.root[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.of(a), self.of(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def linked(least: float) -> Callable:
    """Work of a cell: edges (a, b, true) that connect its core vectors as all their near pairs do, and (a, b, false): a vector that is not core and
    its smallest core neighbour. A vector is core if its tag is 1."""

    def work(held: dict, stream: Iterator[grid.Part], diagonal: bool) -> Iterator[pa.RecordBatch]:
        forest, names = Forest(), []
        none = np.iinfo(np.int64).max
        at, cores, best = {}, {key: p.tags == "1" for key, p in held.items()}, {key: np.full(len(p.ids), none) for key, p in held.items()}
        for key, p in held.items():
            at[key] = forest.grow(len(p.ids))
            names.append(p.ids)
        row = lambda a, b, core: pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), core))], names=["a", "b", "core"])
        border = lambda p, to: row(p.ids[to < none], to[to < none], False)
        for q in stream:
            if q.key not in held:
                continue
            p, cp, cq = held[q.key], cores[q.key], q.tags == "1"
            if diagonal:  # the right side is the left one: its nodes are those of the same ids
                order = np.argsort(p.ids)
                nodes = at[q.key] + order[np.searchsorted(p.ids[order], q.ids)]
            else:
                nodes = forest.grow(len(q.ids)) + np.arange(len(q.ids))
                names.append(q.ids)
            other = np.full(len(q.ids), none)
            for i, j, _ in grid.hits(p, q, least):
                keep = p.ids[i] != q.ids[j]
                i, j = i[keep], j[keep]
                both = cp[i] & cq[j]
                forest.join(at[q.key] + i[both], nodes[j[both]])
                one = ~cp[i] & cq[j]
                np.minimum.at(best[q.key], i[one], q.ids[j[one]])
                if not diagonal:
                    two = cp[i] & ~cq[j]
                    np.minimum.at(other, j[two], p.ids[i[two]])
            if not diagonal:
                yield border(q, other)
        for key, p in held.items():
            yield border(p, best[key])
        ids = np.concatenate(names)
        root = forest.of(np.arange(len(ids)))
        far = root != np.arange(len(ids))
        yield row(ids[far], ids[root[far]], True)

    return work


def dbscan(df: DataFrame, eps: float, least: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, core): vectors with ``least`` neighbours (themselves counted) within ``eps`` are core; clusters are the components of near core
    vectors, named by the smallest core id; another vector near a core one is in that of its smallest core neighbour, else its cluster is -1.

    A null vector is noise. Rows that repeat an id are one; a table that has such is worked on by its pairs, which are stored.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null")
    every = df.select(F.col(key).cast("long").alias("id")).distinct()
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        counts = grid.meet(rows, None, "id", "v", counted(1 - eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        core = stored(counts.where(F.col("n") + 1 >= least).select("id"), "core")
        tagged = rows.join(core.withColumn("tag", F.lit("1")), "id", "left").withColumn("tag", F.coalesce("tag", F.lit("0")))
        edges = stored(grid.meet(tagged, None, "id", "v", linked(1 - eps), "a long, b long, core boolean", "tag"), "near")
        pairs, near = edges.where("core").select("a", "b"), edges.where("not core").select("a", "b")
    else:
        near = stored(near_pairs(df, eps, key, vector).distinct(), "near")
        core = stored(near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= least).select(F.col("a").alias("id")), "core")
        ends = core.withColumnRenamed("id", "core")
        pairs = near.join(ends, F.col("a") == F.col("core"), "left_semi").join(ends, F.col("b") == F.col("core"), "left_semi").select("a", "b")
    found = components(pairs).select(F.col("node").alias("id"), "root")
    clusters = stored(core.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("cluster")), "clusters")
    drop(core)
    border = near.join(clusters.select(F.col("id").alias("b"), "cluster"), "b").groupBy("a").agg(F.min_by("cluster", "b").alias("border"))
    got = every.join(clusters, "id", "left").join(border.withColumnRenamed("a", "id"), "id", "left")
    return got.select("id", F.coalesce("cluster", "border", F.lit(-1)).cast("long").alias("cluster"), F.col("cluster").isNotNull().alias("core"))
