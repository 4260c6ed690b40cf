"""Near-duplicate groups by ProbMinHash over weighted shingles, banding and exact verification.

Each text becomes its word pairs weighted by how often they occur. Every shingle starts a Poisson process of rate = its weight whose
arrivals are hashed from the shingle alone; an arrival picks one of ``SIZE`` registers, and each register keeps the shingle that arrived
first. A shingle is left as soon as its next arrival is later than every register's. Two texts agree in a register with the probability
Jaccard similarity J_P = sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i). Registers are grouped into bands; texts that share a band
are candidates; candidates are verified with J_P itself, computed from the texts.

Groups are the connected components of the verified pairs. Texts with equal shingle weights are one node from the start. Each bucket is
first verified as a star around its smallest id. Then the candidate pairs whose ends are still in different components are compared by their
signatures (one byte a register), in blocks of about ``BLOCK`` members of a bucket, a matrix a pair of blocks; those that the signatures put within
``SIGMAS`` standard errors of the threshold are verified. So the groups are those of all verified candidate pairs, no bucket is held by one task, and
neither the pairs inside a group nor those of texts that merely share a bucket are emitted.

Defined cases: rows with a null id or a text without words (null, empty, only punctuation) are in no group and stay; a text of one word has
that word as its shingle; rows that repeat an id count as that one document; the smallest id of a group stands for it; ties can't arise
since ids decide; an empty table gives no group; ids may be whole numbers or texts. Texts are taken whole. Further columns pass through
``keep_one`` whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import kernels as K
from eventloom.llm.common import arrow_batches, columns_of, drop, id_type, named, narrow, small_enough, stored, without
from eventloom.operators.components import components
from eventloom.session import unused

#: Bands of 4 registers: a pair at the threshold of 0.5 shares one of 64 with chance 0.984.
SIZE, BANDS, SHINGLE = 256, 64, 2
#: Members of a bucket that are compared at once; standard errors by which an estimate may miss the threshold.
BLOCK, SIGMAS = 256, 5.0
GOLD = 0x9E3779B97F4A7C15


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted; shingles are 48-bit hashes of ``width`` consecutive words (all words of a shorter text).

    At most 65,535 texts at once.
    """
    n = len(offsets) - 1
    assert n < 1 << 16
    _, _, hashes, text = K.words(data, offsets, K.PUNCT, K.LOWER)
    have = np.bincount(text, minlength=n) if len(text) else np.zeros(n, np.int64)
    rolled = K.rolling(hashes, width)
    inside = text[: len(rolled)] == text[width - 1 :] if len(rolled) else np.zeros(0, bool)
    keys = [(text[: len(rolled)][inside].astype(np.uint64) << np.uint64(48)) | (rolled[inside] >> np.uint64(16))]
    short = np.flatnonzero((have > 0) & (have < width))
    if len(short):
        begins = np.concatenate([[0], np.cumsum(have)])[short]
        with np.errstate(over="ignore"):
            total = np.array([K.mix(np.array([hashes[b : b + have[d]].sum(dtype=np.uint64) + np.uint64(have[d])]))[0] for d, b in zip(short, begins)], np.uint64)
        keys.append((short.astype(np.uint64) << np.uint64(48)) | (total >> np.uint64(16)))
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[new] >> np.uint64(48)).astype(np.int64), key[new] & np.uint64((1 << 48) - 1), np.diff(np.append(new, len(key)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """(n, size) registers of ProbMinHash; texts without shingles keep zeros. ``size`` is a power of two."""
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, np.uint64)
    latest = np.full(n, np.inf)
    active = np.arange(len(text))
    arrival = np.zeros(len(text))
    at, low = 0, np.uint64(size - 1)
    while len(active):
        block = 1 if len(active) > 20_000 else 32  # arrivals drawn at once: the later ones are wasted if a shingle is done early
        with np.errstate(over="ignore"):
            steps = (np.arange(at + 1, at + block + 1, dtype=np.uint64) * np.uint64(GOLD))[None, :]
            h = K.mix(shingle[active][:, None] + steps)
        gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active][:, None]
        gaps[:, 0] += arrival[active]
        times = np.cumsum(gaps, axis=1)
        cell = (text[active][:, None] * size + (h & low).astype(np.int64)).ravel()
        flat, who = times.ravel(), np.repeat(shingle[active], block)
        early = flat < first[cell]
        cell, flat, who = cell[early], flat[early], who[early]
        np.minimum.at(first, cell, flat)
        won = first[cell] == flat
        winner[cell[won]] = who[won]
        latest = first.reshape(n, size).max(axis=1)
        arrival[active] = times[:, -1]
        active = active[times[:, -1] < latest[text[active]]]
        at += block
    return winner.reshape(n, size)


def bands(signature: np.ndarray, number: int = BANDS) -> np.ndarray:
    """(n, number) band hashes as int64."""
    n, size = signature.shape
    parts = signature.reshape(n, number, size // number)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, number + 1, dtype=np.uint64) * np.uint64(GOLD), (n, number))
        for k in range(parts.shape[2]):
            h = K.mix(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return h.view(np.int64)


def sketch(docs: DataFrame, size: int = SIZE, number: int = BANDS, width: int = SHINGLE) -> DataFrame:
    """(id, d1, d2, bands, sig) of each text with words: d1 and d2 are a 128-bit digest of its weighted shingles, sig a byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "_t"):
            data, offsets = K.text_parts(batch.column(1))
            n = len(offsets) - 1
            text, shingle, count = shingles(data, offsets, width)
            has = np.bincount(text, minlength=n) > 0
            d = []
            with np.errstate(over="ignore"):
                for salt in (1, 2):
                    each = K.mix(shingle * np.uint64(2 * salt + 1) + K.mix(count.astype(np.uint64) + np.uint64(salt * GOLD & K.MASK)))
                    total = np.concatenate([[np.uint64(0)], np.cumsum(each)])
                    ends = np.searchsorted(text, np.arange(n + 1))
                    d.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64)[has])
            registers = signatures(text, shingle, count.astype(np.float64), n, size)[has]
            found = bands(registers, number)
            of = pa.array(np.arange(len(found) + 1) * number, pa.int32())
            sig = pa.array([row.tobytes() for row in K.mix(registers).astype(np.uint8)], pa.binary())
            yield pa.record_batch([batch.column(0).filter(pa.array(has)), pa.array(d[0]), pa.array(d[1]), pa.ListArray.from_arrays(of, pa.array(found.ravel())), sig], names=["id", "d1", "d2", "bands", "sig"])

    return narrow(docs).where("_k is not null and _t is not null").mapInArrow(run, f"id {id_type(docs)}, d1 long, d2 long, bands array<long>, sig binary")


def similarity(left: pa.Array, right: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """J_P of each pair of texts."""
    out = np.zeros(len(left))
    a, b = (shingles(*K.text_parts(x), width) for x in (left, right))
    keys = [(t.astype(np.uint64) << np.uint64(48)) | s for t, s, _ in (a, b)]
    every = np.union1d(*keys)
    weights = np.zeros((2, len(every)))
    for row, (key, part) in enumerate(zip(keys, (a, b))):
        weights[row, np.searchsorted(every, key)] = part[2]
    pair = (every >> np.uint64(48)).astype(np.int64)
    x, y = weights
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.lexsort((ratio, pair))
    pair, x, y, ratio = pair[order], x[order], y[order], ratio[order]
    begin = np.searchsorted(pair, np.arange(len(left) + 1))
    sum_x, sum_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    shared = np.flatnonzero((x > 0) & (y > 0))
    p = pair[shared]
    above = sum_x[begin[p + 1]] - sum_x[shared]
    below = sum_y[shared] - sum_y[begin[p]]
    np.add.at(out, p, 1 / (above / x[shared] + below / y[shared]))
    return out


def verified(pairs: DataFrame, texts: DataFrame, least: float, width: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of ids whose texts have at least ``least``; ``texts`` has (id, text), one row an id."""

    @F.arrow_udf("double")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        done, step = [], 256
        for at in range(0, len(left), step):
            done.append(similarity(left.slice(at, step), right.slice(at, step), width))
        return pa.array(np.concatenate(done) if done else np.zeros(0))

    one, two = texts.toDF("a", "_left"), texts.toDF("b", "_right")
    return pairs.join(one, "a").join(two, "b").select("a", "b", compare("_left", "_right").alias("similarity")).where(F.col("similarity") >= least)


def near_by_signature(mixed: DataFrame, least: float, size: int) -> DataFrame:
    """(a, b): pairs of one bucket and different components of ``mixed`` (bucket, id, c, sig, n) whose signatures let their similarity be ``least``."""
    kind = dict(mixed.dtypes)["id"]
    floor = least - SIGMAS * np.sqrt(least * (1 - least) / size)
    enough = (floor * (1 - 1 / 256) + 1 / 256) * size

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (ids, comp, x), (others, comps, y) = (((row := batch.column(c)[k].values).field("id"), row.field("c").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(row.field("sig").to_pylist()), np.uint8).reshape(len(row), size)) for c in (0, 1))
                left, right = [], []
                for i in range(len(ids)):
                    near = np.flatnonzero(((x[i] == y).sum(axis=1) >= enough) & (comps != comp[i]))
                    left.append(np.full(len(near), i))
                    right.append(near)
                yield pa.record_batch([ids.take(pa.array(np.concatenate(left))), others.take(pa.array(np.concatenate(right)))], names=["a", "b"])

    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    blocks = stored(mixed.groupBy("bucket", block.alias("block")).agg(F.collect_list(F.struct("id", "c", "sig")).alias("rows")), "blocks")
    left, right = blocks.toDF("bucket", "bx", "x"), blocks.toDF("bucket", "by", "y")
    found = left.join(right, "bucket").where("bx <= by").select("x", "y").mapInArrow(compare, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, least: float = 0.5, size: int = SIZE, number: int = BANDS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, group_id) of the documents that have near duplicates; group_id is the smallest id of the group."""
    arrow_batches(docs.sparkSession)
    sketched = stored(sketch(docs, size, number, width), "sketch")
    least_of = sketched.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = stored(sketched.select("id", "d1", "d2").join(least_of, ["d1", "d2"]).where("id <> rep").distinct(), "equal")
    nodes = sketched.join(F.broadcast(equal) if small_enough(equal) else equal, ["id", "d1", "d2"], "left_anti")
    entries = nodes.select("id", F.explode("bands").alias("bucket")).distinct()
    hubs = entries.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(entries.join(stored(hubs, "hubs"), "bucket").select("bucket", "id", "hub", "n"), "buckets")
    star = stored(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "star")
    wanted = stored(shared.select(F.col("id").alias("_w")).distinct(), "wanted")
    texts = narrow(docs).where("_t is not null").join(F.broadcast(wanted) if small_enough(wanted) else wanted, F.col("_k") == F.col("_w"), "left_semi")
    texts = stored(texts.groupBy("_k").agg(F.min("_t").alias("_t")).toDF("id", "text"), "texts")
    edges = stored(verified(star, texts, least, width).select("a", "b"), "edges")
    found = components(edges)
    placed = stored(shared.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("c")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    mixed = placed.join(stored(mixed, "mixed"), "bucket", "left_semi").join(sketched.join(wanted, F.col("id") == F.col("_w"), "left_semi").select("id", "sig").distinct(), "id")
    rest = near_by_signature(mixed, least, size).join(star, ["a", "b"], "left_anti")
    more = stored(verified(rest, texts, least, width).select("a", "b"), "more")
    drop(shared, star, wanted, texts, placed)
    found = components(edges.union(more).union(equal.select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    drop(sketched, equal, edges, more)
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def keep_one(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents without those that another one of their group stands for."""
    found = groups(docs, least)
    gone = stored(found.where("doc_id <> group_id").select(F.col("doc_id").alias(unused(docs, "_dropped"))), "near")
    return without(docs, gone, named("doc_id").cast(id_type(docs)), unused(docs, "_dropped")).select(*columns_of(docs))
