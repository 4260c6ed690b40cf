"""Near duplicates among embeddings by cross-polytope hashing after fast Hadamard rotations.

A hash turns the unit vector by three rounds of random signs and a Hadamard transform and takes the largest coordinate and its sign: one of
2d values. A table joins as many hashes to a bucket as make the buckets outnumber the vectors, so that buckets stay small at every size; the
number of tables follows from the chance that a pair of cosine ``least`` meets in one, so that the recall stays. Each vector is put into its
bucket and looks into this and ``probes`` further ones of each table: those reached by taking the next largest coordinate of one of the
hashes, the least loss first. Candidate pairs whose sign sketches are too far apart go; the others are verified by their cosine.

Groups are the connected components of the verified pairs. Each bucket is first verified as a star around its smallest id; then every candidate
pair whose ends are still in different components. So no bucket is expanded to all of its pairs unless they belong to different groups.

A vector's links are those of its group with a cosine of at least ``least``. With the angles a and b of two vectors to the group's root, a + b
bounds their own angle: where this is enough for a vector and the group's widest one, all of the group are links, uncounted. The other vectors
are counted exactly by products of blocks of at most about ``BLOCK`` vectors.

Defined cases: null, empty, zero and non-finite vectors have no cosine, no links and are a group each; only vectors of equal length are compared;
null ids are left out; of rows that repeat an id the smallest vector counts; an empty table gives no rows. Ids may be whole numbers or texts.
Equal vectors are links of each other. Further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import kernels as K
from eventloom.llm.common import arrow_batches, drop, id_type, named, stored
from eventloom.operators.components import components


def hadamard(x: np.ndarray) -> np.ndarray:
    """The (unnormalised) Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def rotate(x: np.ndarray, table: int, function: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, table, function])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1])) / math.sqrt(x.shape[1])
    return x


def buckets(vectors: np.ndarray, tables: int, functions: int, probes: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each table, (n, 1 + probes) bucket hashes of unit vectors: the own one first."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = vectors
    deep = min(size, probes + 1)
    for table in range(tables):
        values, losses = [], []
        for function in range(functions):
            y = rotate(x, table, function, seed)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :deep]
            height = np.take_along_axis(y, top, 1)
            values.append(2 * top + (height < 0))
            losses.append(np.abs(height[:, :1]) - np.abs(height))
        own = np.stack([v[:, 0] for v in values], axis=1)
        options = np.concatenate([loss[:, 1:] for loss in losses], axis=1)
        best = np.argsort(options, axis=1, kind="stable")[:, :probes]
        out = np.empty((n, 1 + best.shape[1]), np.uint64)
        for p in range(1 + best.shape[1]):
            key = own.copy()
            if p:
                which, rank = np.divmod(best[:, p - 1], deep - 1)
                for function in range(functions):
                    here = which == function
                    key[here, function] = values[function][here, rank[here] + 1]
            h = np.full(n, np.uint64(d * 1_000_003 + table))
            with np.errstate(over="ignore"):
                for function in range(functions):
                    h = K.mix(h * np.uint64(0xD6E8FEB86659FD93) + key[:, function].astype(np.uint64))
            out[:, p] = h
        yield table, out


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of the vectors that have a direction, those of one length at a time."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)
        good = np.isfinite(flat).all(axis=1)
        scale = np.abs(np.where(good[:, None], flat, 0)).max(axis=1)
        good &= scale > 0
        unit = flat[good] / scale[good, None]
        yield rows[good], unit / np.linalg.norm(unit, axis=1, keepdims=True)


def plan(count: int, width: int, least: float, miss: float = 0.002) -> tuple[int, int]:
    """(functions, tables) for ``count`` vectors: at most ``miss`` of the pairs of cosine ``least`` should meet in no table.

    One hash agrees with a chance of about d ** -(t / (4 - t)) (t the squared distance) times 0.69; four probes double a table's chance (both as
    measured).
    """
    functions = max(1, math.ceil(math.log(max(count, 2)) / math.log(2 * max(2, width))))
    t = 2 - 2 * least
    meet = min(0.9, 2.05 * (0.69 * max(2, width) ** -(t / (4 - t))) ** functions)
    return functions, math.ceil(math.log(miss) / math.log(1 - meet))


#: Bits of the sign sketch, and the fewest coordinates that it is used for.
SIGNS, LEAST_WIDTH = 64, 32
BLOCK = 512


def signs(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Signs of ``SIGNS`` coordinates of rotated vectors as int64; 0 for short vectors."""
    n, d = vectors.shape
    if d < LEAST_WIDTH:
        return np.zeros(n, np.int64)
    size = 1 << (d - 1).bit_length()
    x = np.zeros((n, size))
    x[:, :d] = vectors
    turned = np.concatenate([rotate(x, -1 & 0xFFFF, k, seed) for k in range(-(-SIGNS // size))], axis=1)[:, :SIGNS]
    return np.packbits(turned > 0, axis=1).view(">i8").ravel().astype(np.int64)


def most_flips(least: float) -> int:
    """Bits in which the sign sketches of a pair of cosine ``least`` differ, plus six standard deviations."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(SIGNS * p + 6 * math.sqrt(SIGNS * p * (1 - p)))


def cosines(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Of each pair of vectors; -2 where there is none."""
    out = np.full(len(left), -2.0)
    lengths = left.value_lengths().to_numpy(zero_copy_only=False)
    same = lengths == right.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[same]):
        rows = np.flatnonzero(same & (lengths == d))
        x, y = (v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d) for v in (left, right))
        with np.errstate(all="ignore"):
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
            got = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        out[rows] = np.where(np.isfinite(got), got, -2.0)
    return out


def cosine(left: str, right: str) -> Column:
    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(cosines(x, y))

    return of(left, right)


def groups(table: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", probes: int = 4, seed: int = 11) -> DataFrame:
    """(vec_id, group_id, links) of every vector: the smallest id of its group, and the number of its links."""
    arrow_batches(table.sparkSession)
    kind = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    rows = table.select(named(key).cast(id_type(table, key)).alias("id"), named(vector).cast(kind).alias("v")).where("id is not null")
    source = stored(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    edges = near(source, least, probes, seed)
    found = stored(components(edges).select(F.col("node").alias("id"), "root"), "groups")
    drop(edges)
    got = links(source, found, least)
    return source.select("id").join(got, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("root", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near(source: DataFrame, least: float, probes: int, seed: int) -> DataFrame:
    """(a, b): verified pairs of which the components are those of all candidate pairs."""
    id_kind = dict(source.dtypes)["id"]
    count, width = source.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    functions, tables = plan(count, width or 2, least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in by_length(batch.column(1)):
                code = signs(unit, seed)
                for _, keys in buckets(unit, tables, functions, probes, seed):
                    n, p = keys.shape
                    ids = batch.column(0).take(pa.array(np.repeat(rows, p)))
                    yield pa.record_batch([ids, pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(p) == 0, n)), pa.array(np.repeat(code, p))], names=["id", "bucket", "own", "code"])

    entries = stored(source.where("v is not null").mapInArrow(hashed, f"id {id_kind}, bucket long, own boolean, code long"), "entries")
    hubs = entries.where("own").groupBy("bucket").agg(F.min(F.struct("id", "code")).alias("hub"), F.count(F.lit(1)).alias("n"))
    alike = F.bit_count(F.col("code").bitwiseXOR(F.col("hub.code"))) <= most_flips(least)
    met = entries.join(hubs, "bucket").where("id <> hub.id or n > 1").select("bucket", "id", "own", "code", "n", "hub.id", (F.col("id") != F.col("hub.id")) & alike)
    met = stored(met.toDF("bucket", "id", "own", "code", "n", "hub", "alike"), "met")
    star = stored(met.where("alike").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "star")
    edges = stored(verified(star, source, least), "edges")
    root = components(edges).withColumnRenamed("node", "id")
    # buckets of one owner are stars: only others can have a pair that was not compared
    placed = stored(met.where("n > 1").join(root, "id", "left").select("bucket", "id", "own", "code", F.coalesce("root", "id").alias("c")), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    mixed = placed.join(stored(open_, "open"), "bucket", "left_semi")
    left, right = mixed.where("own").toDF("bucket", "x", "_", "code_x", "cx"), mixed.toDF("bucket", "y", "_", "code_y", "cy")
    alike = F.bit_count(F.col("code_x").bitwiseXOR(F.col("code_y"))) <= most_flips(least)
    rest = left.join(right, "bucket").where("cx <> cy").where(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    every = stored(edges.union(verified(rest.join(star, ["a", "b"], "left_anti"), source, least)), "edges")
    drop(entries, met, star, placed, edges)
    return every


def verified(pairs: DataFrame, source: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose vectors have a cosine of at least ``least``."""
    one, two = source.toDF("a", "_a"), source.toDF("b", "_b")
    return pairs.join(one, "a").join(two, "b").select("a", "b", cosine("_a", "_b").alias("cosine")).where(F.col("cosine") >= least).select("a", "b")


def links(source: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(id, root, links) of the vectors in the groups ``found`` (id, root)."""
    id_kind, kind = dict(source.dtypes)["id"], dict(source.dtypes)["v"]
    limit = math.acos(max(-1.0, min(1.0, least)))
    member = found.join(source, "id")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine("v", "_r"))))
    placed = stored(member.join(source.toDF("root", "_r"), "root").select("id", "root", "v", angle.alias("angle")), "placed")
    widest = placed.groupBy("root").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("size"))
    sized = placed.join(widest, "root").withColumn("all", F.col("angle") + F.col("widest") <= limit - 1e-7)
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))
    wide = stored(sized.where(F.col("angle") + F.col("widest") > limit - 1e-7).select("root").distinct(), "wide")
    blocks = sized.join(wide, "root", "left_semi").groupBy("root", block.alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"), F.collect_list("all").alias("all"))
    blocks = stored(blocks, "blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, asked = batch.column(0)[k].values, ~np.array(batch.column(2)[k].as_py(), bool)
                x, y = (unit_rows(batch.column(c)[k].values) for c in (1, 3))
                same = batch.column(4)[k].as_py()
                yield pa.record_batch([ids.filter(pa.array(asked)), pa.array((x[asked] @ y.T >= least).sum(axis=1) - same)], names=["id", "n"])

    left, right = blocks.toDF("root", "bx", "ids", "x", "all"), blocks.select("root", F.col("block").alias("by"), F.col("vs").alias("y"))
    asked = left.where(F.exists("all", lambda a: ~a)).join(right, "root").select("ids", "x", "all", "y", (F.col("bx") == F.col("by")).cast("int").alias("same"))
    counted = asked.mapInArrow(count, f"id {id_kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return sized.join(counted, "id", "left").select("id", "root", F.when(F.col("all"), F.col("size") - 1).otherwise(F.col("n")).alias("links"))


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Unit vectors of a list array of vectors of one length."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
