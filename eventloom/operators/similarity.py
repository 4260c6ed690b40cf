"""Entity similarity and vector search: relationship discovery, nearest neighbours, similarity joins, evolutionary search.

All-pairs work is a grid of tasks (``grid``). Searches of an index pack their vectors into blocks of one cell and width, which are joined on both
(``paired``): each pair of blocks is one matrix product. No side is broadcast whole.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import vectors as V
from eventloom.operators import grid
from eventloom.session import reach, stored

#: Vectors and bytes of a block at most.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
PACKED = "ids array<long>, kind string, width int, data binary"


def unit_matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length at length 1; zero vectors stay zero."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def packed(df: DataFrame, key: str, vector: str, kind: str | None = None) -> DataFrame:
    """Blocks of unit vectors of one partition that have the same length and kind; zero vectors stay zero, null and empty ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            tags = batch.column(1).dictionary_encode()
            codes = tags.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for width, code in sorted(set(zip(lengths.tolist(), codes.tolist()))):
                rows = np.flatnonzero((lengths == width) & (codes == code))
                step = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(width, 1))))
                for at in range(0, len(rows) if width else 0, step):
                    part = pa.array(rows[at : at + step])
                    x = unit_matrix(batch.column(2).take(part))
                    tag = None if code < 0 else tags.dictionary[code].as_py()
                    yield pa.record_batch([pa.array([batch.column(0).take(part).to_pylist()], pa.list_(pa.int64())), pa.array([tag], pa.string()), pa.array([width], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["ids", "kind", "width", "data"])

    reach(df.sparkSession)
    tag = F.col(kind).cast("string") if kind else F.lit("")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), tag.alias("t"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, PACKED)


def paired(left: DataFrame, right: DataFrame, pick: Callable, schema: str, on: Column | None = None) -> DataFrame:
    """The pairs of blocks of one width (and for which ``on`` holds of kind and kind2), reduced by ``pick(similarities, ids, ids2)`` to record batches.

    A pair of blocks is one row of at most twice ``BLOCK_BYTES``; Arrow batches are bounded by bytes too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, width, data, ids2, data2 = (c[i].as_py() for c in batch.columns)
                a, b = (np.frombuffer(x).reshape(-1, width) for x in (data, data2))
                yield pick(a @ b.T, np.array(ids), np.array(ids2))

    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", 4 * BLOCK_BYTES
    if not 0 < left.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= size:
        left.sparkSession.conf.set(key, str(size))
    other = right.toDF("ids2", "kind2", "width2", "data2")
    met = left.join(other, F.col("width") == F.col("width2") if on is None else (F.col("width") == F.col("width2")) & on)
    return met.select("ids", "width", "data", "ids2", "data2").mapInArrow(run, schema)


def largest(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row and what is within 2e-10 of the last; of many ties those of the smallest ids."""
    if s.shape[1] <= k:
        return np.nonzero(np.isfinite(s))
    keep = (s >= np.partition(s, -k, axis=1)[:, -k][:, None] - 2e-10) & np.isfinite(s)
    for i in np.flatnonzero(keep.sum(1) > 4 * k):
        first = np.lexsort((ids, -np.round(s[i], 10)))[:k]
        keep[i] = False
        keep[i, first] = np.isfinite(s[i, first])
    return np.nonzero(keep)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, key: str = "id", vector: str = "embedding", kind: str | None = None, same_kind: bool = False, target: str | None = None) -> DataFrame:
    """(query, neighbour, similarity, place): the ``k`` nearest by cosine, the query's own id left out, ties by id.

    ``same_kind`` compares within a kind only; ``target`` takes neighbours of that kind only. Each cell of the grid keeps its ``k`` best a query, so
    what is shuffled after it is queries times ``k`` times the few cells that a query is in. Rows without an id are left out.
    """
    if target is not None:
        corpus = corpus.where(F.col(kind).cast("string") == target)
    known = F.col(key).isNotNull()
    got = grid.meet(queries.where(known), corpus.where(known), key, vector, grid.nearest_of(k), "query long, neighbour long, similarity double", kind, same_kind)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 10)), "neighbour")
    return got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def all_pairs(left: DataFrame, right: DataFrame, key: str = "id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """(a, b, similarity) of every pair of vectors of one length, rounded to ``places`` if given; zero vectors have similarity 0."""
    return grid.meet(left, right, key, vector, grid.every_pair(places), "a long, b long, similarity double")


def kind_pairs(df: DataFrame, key: str = "id", vector: str = "embedding", kind: str = "kind", places: int | None = None) -> DataFrame:
    """(a, b, similarity) of the pairs a < b of one kind and length; null vectors have null similarities."""
    got = grid.meet(df, None, key, vector, grid.every_pair(places, True), "a long, b long, similarity double", kind, True)
    rows = df.select(F.col(key).alias("_a"), F.col(kind).alias("_k"), F.col(vector).isNull().alias("_n"))
    one, two = rows.where("_n"), rows.toDF("_b", "_k2", "_n2")
    gone = one.join(two, (F.col("_k") == F.col("_k2")) & (F.col("_a") != F.col("_b")) & (~F.col("_n2") | (F.col("_a") < F.col("_b"))))
    return got.union(gone.select(F.least("_a", "_b"), F.greatest("_a", "_b"), F.lit(None).cast("double")))


def threshold_join(df: DataFrame, least: float, key: str = "id", vector: str = "embedding", kind: str = "kind") -> DataFrame:
    """(a, b, similarity) of the pairs a < b of different kinds with a cosine above ``least``; rows without an id or kind have none."""
    known = df.where(F.col(key).isNotNull() & F.col(kind).isNotNull())
    return grid.meet(known, None, key, vector, grid.pairs_above(least, different=True), "a long, b long, similarity double", kind)


def entity_blocks(entities: DataFrame) -> DataFrame:
    """Blocks of entities: ids, categories, and for each modality and width who has it and the unit vectors in a matrix (zeros for the others)."""
    kind = dict(entities.dtypes)["entity_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            while n < batch.num_rows:
                part = batch.slice(n, 512)
                n += part.num_rows
                lists = part.column(2)
                flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                vectors, tags = flat.field("embedding"), flat.field("modality").dictionary_encode()
                codes, widths = tags.indices.fill_null(-1).to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
                names, sizes, masks, data = [], [], [], []
                for code, width in sorted(set(zip(codes.tolist(), widths.tolist()))):
                    rows = np.flatnonzero((codes == code) & (widths == width))
                    v, own = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width), owner[rows]
                    order = np.lexsort((*v.T[::-1], own)) if len(np.unique(own)) < len(own) else np.argsort(own)  # of repeated ones the smallest
                    own, first = np.unique(own[order], return_index=True)
                    x, mask = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
                    x[own], mask[own] = v[order[first]], True
                    names.append(None if code < 0 else tags.dictionary[code].as_py())
                    sizes.append(width)
                    masks.append(mask.tobytes())
                    data.append((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).tobytes())
                one = lambda c: pa.array([c.to_pylist()], pa.list_(c.type))
                yield pa.record_batch(
                    [one(part.column(0)), one(part.column(1)), pa.array([names], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32())), pa.array([masks], pa.list_(pa.binary())), pa.array([data], pa.list_(pa.binary()))],
                    names=["ids", "categories", "modalities", "widths", "masks", "data"],
                )

    vectors = F.collect_list(F.when(F.col("embedding").isNotNull(), F.struct(F.col("modality").cast("string").alias("modality"), F.col("embedding").cast("array<double>").alias("embedding"))))
    grouped = entities.groupBy("entity_id").agg(F.max("category").cast("string").alias("category"), vectors.alias("vectors"))
    return grouped.mapInArrow(run, f"ids array<{kind}>, categories array<string>, modalities array<string>, widths array<int>, masks array<binary>, data array<binary>")


def relationships(entities: DataFrame, least: float = 0.5, ids: DataFrame | None = None, bonus: float = 0.1) -> DataFrame:
    """(entity_id, related_entity_id, similarity) over (entity_id, modality, embedding, category).

    The mean cosine over shared modalities, plus ``bonus`` (to 1 at most) for equal known categories; entities that share none are skipped.
    ``ids`` (one column) restricts the left side. Entities are grouped once; each pair of blocks is a matrix product a modality, added up in place, and
    only pairs of at least ``least`` leave it.
    """
    reach(entities.sparkSession)
    kind = dict(entities.dtypes)["entity_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, b), sides = (batch.column(k)[i].values for k in (0, 6)), []
                for k in (0, 6):
                    names, widths, masks, data = (batch.column(k + c)[i].as_py() for c in (2, 3, 4, 5))
                    sides.append({(m, w): (np.frombuffer(y, bool).astype(float), np.frombuffer(x).reshape(-1, w)) for m, w, y, x in zip(names, widths, masks, data)})
                total, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
                for key in sides[0].keys() & sides[1].keys():
                    (ma, xa), (mb, xb) = sides[0][key], sides[1][key]
                    total += xa @ xb.T
                    shared += ma[:, None] * mb[None, :]
                codes = pa.chunked_array([batch.column(1)[i].values, batch.column(7)[i].values]).dictionary_encode().combine_chunks()
                codes = np.concatenate([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (codes.chunks if isinstance(codes, pa.ChunkedArray) else [codes])])
                ca, cb = codes[: len(a)], codes[len(a) :]
                s = np.divide(total, shared, out=np.full(total.shape, -np.inf), where=shared > 0)
                s = np.where((ca[:, None] == cb[None, :]) & (ca >= 0)[:, None], np.minimum(1.0, s + bonus), s)
                x, y = np.nonzero(s >= least)
                left, right = a.take(pa.array(x)), b.take(pa.array(y))
                other = pc.not_equal(left, right)
                yield pa.record_batch([left.filter(other), right.filter(other), pa.array(s[x, y]).filter(other)], names=["entity_id", "related_entity_id", "similarity"])

    right = stored(entity_blocks(entities), "entities")
    left = right if ids is None else stored(entity_blocks(entities.join(ids.toDF("entity_id"), "entity_id", "left_semi")), "entities")
    met = left.crossJoin(right.toDF(*[f"{c}2" for c in right.columns]))
    return met.mapInArrow(run, f"entity_id {kind}, related_entity_id {kind}, similarity double")


def by_vector(corpus: DataFrame, vector: list[float], k: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to a given vector; a wrong length raises ``ValueError``."""
    d = V.dims(corpus, column)
    if len(vector) != d:
        raise ValueError(f"vector has {len(vector)} dimensions, the corpus {d}")
    q = F.array(*[F.lit(float(x)) for x in vector])
    return corpus.select(key, V.cosine(column, q, d).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def by_id(corpus: DataFrame, value, k: int, key: str = "id", column: str = "embedding", kind: str | None = None) -> DataFrame:
    """The ``k`` rows nearest to the row of id ``value``, of its own kind if ``kind`` names a column; an unknown id raises ``KeyError``."""
    row = corpus.where(F.col(key) == value).select(column, *([kind] if kind else [])).first()
    if row is None:
        raise KeyError(value)
    rest = corpus.where(F.col(key) != value)
    return by_vector(rest.where(F.col(kind) == row[1]) if kind else rest, list(row[0]), k, key, column)


@dataclass
class SearchResult:
    hits: DataFrame
    best: float
    trajectory: list[float] = field(default_factory=list)


def best_cosines(corpus: DataFrame, queries: np.ndarray, column: str = "embedding") -> list[float]:
    """The best cosine in the corpus of each query: a matrix product a batch, and one row a query from each partition."""
    reach(corpus.sparkSession)
    q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full(len(q), -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                top = np.maximum(top, (x @ q.T).max(0))
        yield pa.record_batch([pa.array(np.arange(len(q))), pa.array(top)], names=["i", "s"])

    rows = corpus.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "i long, s double")
    return [r.s if np.isfinite(r.s) else 0.0 for r in rows.groupBy("i").agg(F.max("s").alias("s")).orderBy("i").collect()]


def evolve_search(corpus: DataFrame, seed_vector: list[float], k: int = 10, iterations: int = 5, population: int = 10, mutation: float = 0.1, diversity: float = 0.3, seed: int = 42, key: str = "id", column: str = "embedding") -> SearchResult:
    """Evolutionary search: mutated query vectors are scored by their best match and by how far they are from the others.

    Each iteration is one scan that computes the best cosine of all queries of the population at once; only that many numbers come back.
    """
    rng, d = random.Random(seed), len(seed_vector)

    def mutated(v: list[float]) -> list[float]:
        return [x + rng.gauss(0, mutation) for x in v]

    def literal(v: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in v])

    pool, path = [list(seed_vector)] + [mutated(seed_vector) for _ in range(population - 1)], []
    for _ in range(iterations):
        x = np.array(pool)
        best = best_cosines(corpus, x, column)
        away = np.linalg.norm(x[:, None] - x[None], axis=2).sum(1) / max(len(pool) - 1, 1)
        away = away / away.max() if away.max() > 0 else away
        fitness = [(1 - diversity) * (s or 0.0) + diversity * float(a) for s, a in zip(best, away)]
        order = sorted(range(len(pool)), key=lambda i: (-fitness[i], i))
        path.append(fitness[order[0]])
        kept = [pool[i] for i in order[: max(1, population // 2)]]
        pool = kept + [mutated(kept[i % len(kept)]) for i in range(population - len(kept))]
    q = literal(pool[0])
    hits = corpus.select(key, V.cosine(column, q, d).alias("similarity"), V.euclidean(column, q, d).alias("distance")).orderBy(F.desc("similarity"), key).limit(k)
    return SearchResult(hits, path[-1] if path else 0.0, path)


def evolve_query(seed_vector: list[float], feedback: DataFrame, score: str = "score", column: str = "embedding", blend: float = 0.5) -> list[float]:
    """The seed blended with the score-weighted centroid of the feedback's unit vectors, at length 1."""
    d = len(seed_vector)
    got = feedback.agg(F.count(F.lit(1)), V.weighted_mean(V.unit(column, d=d), score, d)).first()
    if not got[0]:
        raise ValueError("no feedback")
    seed, centre = np.array(seed_vector, float), np.array(got[1])
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    return unit((1 - blend) * unit(seed) + blend * unit(centre)).tolist()


class Registry:
    """Named functions from column to column: models and embedding types that a user plugs in."""

    def __init__(self):
        self.models: dict[str, Callable[[Column], Column]] = {}

    def register(self, name: str, model: Callable[[Column], Column]) -> None:
        if not callable(model):
            raise TypeError(f"{name} is not callable")
        self.models[name] = model

    def apply(self, name: str, column: Column | str) -> Column:
        if name not in self.models:
            raise KeyError(name)
        return self.models[name](F.col(column) if isinstance(column, str) else column)
