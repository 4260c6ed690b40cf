"""Substring dedup: passages of at least ``WINDOW`` words that occur in two or more documents.

Windows are taken in runs: each window is represented by the smallest hash of the ``GRAM``-word grams inside it, which it shares with every
equal window, and a run is a stretch of windows of one text with the same representative.

First pass, the prefilter: each partition counts the representatives of its runs in a count-min sketch of ``ROWS`` rows, cut into blocks of
cells; a representative's cells of all rows lie in one block. The partitions' sketches are merged block by block. A cell never counts less
than the occurrences of a window, so what it estimates as repeated includes all that is repeated. A cell also knows whether all runs counted
in it had the same words. The merged sketch stays spread over the cluster, whatever its size: the runs' cells are shuffled to the blocks, and
the numbers of the runs estimated repeated in every row return to the documents by a join. Blocks that many runs ask for are asked in salted
parts; the driver and the workers hold only the asked counts of at most 2**``BLOCKS`` blocks.

Second pass: only windows estimated repeated are grouped, exactly, by two independent 64-bit hashes of their words. A run whose cell has seen
no other words is one unit, as its windows repeat all or none; else each window is a unit. Units in two or more documents are merged to spans.

The sketch's width follows the amount of text; ``most_cells`` bounds it. A narrower sketch lets more through to the exact grouping, and still
loses none.

Defined cases: words are what white space (ASCII) separates, compared exactly; a text of fewer than ``WINDOW`` words, a null or an empty one
has no window; a null id is left out; rows that repeat an id are one document, so they don't repeat each other; a passage repeated only inside
one document is not reported; texts are taken whole; an empty table gives no spans; ids may be whole numbers or texts; further columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm import kernels as K
from eventloom.llm.common import arrow_batches, drop, narrow, stored

WINDOW, GRAM, ROWS = 50, 25, 2
#: log2 of the fewest cells of a block, and of the most blocks.
CELLS, BLOCKS = 16, 20
#: Runs that a partition packs at once, and that one task may ask a block for.
PACK, ASKED = 4_000_000, 1_000_000
SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def windows(column: pa.Array, width: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its text, its first word, its representative and two hashes; windows are in order."""
    data, offsets = K.text_parts(column)
    _, _, hashes, text = K.words(data, offsets)
    n = len(hashes) - width + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none.view(np.int64), none.view(np.int64), none, none, none
    grams = K.rolling(hashes, gram)
    least, span, want = grams, 1, width - gram + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: n], least[want - span : want - span + n])
    inside = text[:n] == text[width - 1 :]
    begins = np.searchsorted(text, text[:n][inside])
    one, two = K.rolling(hashes, width, 0xC2B2AE3D27D4EB4F), K.rolling(hashes, width, 0x9FB21C651E98DF25)
    return text[:n][inside], np.flatnonzero(inside) - begins, least[:n][inside], one[inside], two[inside]


def runs(text: np.ndarray, representative: np.ndarray) -> np.ndarray:
    """Where a run of windows of one text with the same representative begins."""
    if not len(text):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (representative[1:] != representative[:-1])]))


def sketch_bits(docs: DataFrame, most_cells: int) -> tuple[int, int]:
    """log2 of the blocks and of the cells of a block in a row: about a cell for 16 bytes of text in all."""
    total = docs.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    bits = int(min(max(total // 16, 1 << CELLS), most_cells)).bit_length()
    blocks = min(max(0, bits - CELLS), BLOCKS)
    return blocks, bits - blocks


def places(representative: np.ndarray, blocks: int, cells: int) -> np.ndarray:
    """(n, 1 + ROWS): block and cells of each representative."""
    out = np.empty((len(representative), 1 + ROWS), np.uint32)
    with np.errstate(over="ignore"):
        for k, bits in enumerate((blocks, *[cells] * ROWS)):
            out[:, k] = (K.mix(representative * SALTS[k]) >> np.uint64(63 - bits)) >> np.uint64(1)
    return out


def run_hashes(begin: np.ndarray, *hashes: np.ndarray) -> list[np.ndarray]:
    """Of each run, a hash of its windows' hashes in order, for each of ``hashes``."""
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in hashes]
    n = np.diff(np.append(begin, len(hashes[0])))
    place = (np.arange(len(hashes[0])) - np.repeat(begin, n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return [K.mix(np.add.reduceat(K.mix(h + place * np.uint64(K.GOLD)), begin) + n.astype(np.uint64)) for h in hashes]


def packed(block: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Blocks, where each begins (and the end), and the columns in order of the blocks."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    return block[begin], np.append(begin, len(block)), [c[order] for c in columns]


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The rows of ``values`` between each two of ``ends`` as one binary."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


ENTRY = np.dtype([("cells", np.uint32, ROWS), ("n", np.uint32), ("one", np.uint64)])


def merged(docs: DataFrame, blocks: int, cells: int, width: int, gram: int) -> DataFrame:
    """(block, asked, twice, mixed): how many runs are in a block; for each row, packed bits of whether a cell's merged count is two or more, and
    whether it has seen different words."""

    def flush(seen: list[tuple]) -> Iterator[pa.RecordBatch]:
        representative, one = (np.concatenate(x) for x in zip(*seen))
        order = np.lexsort((one, representative))
        representative, one = representative[order], one[order]
        # a partition's count of a representative: its first and its last run tell two and more, and different words
        first = np.flatnonzero(np.concatenate([[True], representative[1:] != representative[:-1]])) if len(one) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(one)))
        last = (first + n - 1)[n > 1]
        entry = np.zeros(len(first) + len(last), ENTRY)
        at = places(np.concatenate([representative[first], representative[last]]), blocks, cells)
        entry["cells"], entry["one"], entry["n"] = at[:, 1:], np.concatenate([one[first], one[last]]), np.concatenate([n - (n > 1), np.ones(len(last), np.int64)])
        block, ends, (entry,) = packed(at[:, 0], entry)
        yield pa.record_batch([pa.array(block.astype(np.int32)), binaries(entry, ends)], names=["block", "entries"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = [], 0
        for batch in K.slices(batches, "_t"):
            text, _, representative, one, _ = windows(batch.column(1), width, gram)
            begin = runs(text, representative)
            seen.append((representative[begin], run_hashes(begin, one)[0]))
            n += len(begin)
            if n > PACK:
                yield from flush(seen)
                seen, n = [], 0
        if n:
            yield from flush(seen)

    def merge(table: pa.Table) -> pa.Table:
        entry = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table["entries"]])
        twice, mixed = np.zeros((ROWS, 1 << cells), bool), np.zeros((ROWS, 1 << cells), bool)
        for row in range(ROWS):
            order = np.lexsort((entry["one"], entry["cells"][:, row]))
            cell, one = entry["cells"][order, row], entry["one"][order]
            same = cell[1:] == cell[:-1]
            twice[row, cell[1:][same]] = True
            mixed[row, cell[1:][same & (one[1:] != one[:-1])]] = True
        bits = [pa.array([np.packbits(x).tobytes()], pa.binary()) for x in (twice, mixed)]
        return pa.table([table["block"][:1], pa.array([int(entry["n"].sum())], pa.int64()), *bits], names=["block", "asked", "twice", "mixed"])

    sketched = docs.select("_k", "_t").mapInArrow(count, "block int, entries binary")
    return sketched.groupBy("block").applyInArrow(merge, "block int, asked long, twice binary, mixed binary")


def repeated_runs(docs: DataFrame, sketch: DataFrame, blocks: int, cells: int, width: int, gram: int) -> DataFrame:
    """(_k, _h, run, mixed): the numbers of the runs of each text that every row of the sketch estimates repeated."""
    asked = sketch.select("block", "asked").where(F.col("asked") > ASKED).toArrow()
    parts = np.ones(1 << blocks, np.int32)
    parts[asked["block"].to_numpy()] = -(-asked["asked"].to_numpy() // ASKED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, turn = [], 0, 0
        for batch in K.slices(batches, "_t"):
            text, _, representative, _, _ = windows(batch.column(1), width, gram)
            begin = runs(text, representative)
            of = text[begin]
            rows = pa.array(of)
            held.append((places(representative[begin], blocks, cells), (np.arange(len(begin)) - np.searchsorted(of, of)).astype(np.int32), batch.column(0).take(rows), batch.column(2).take(rows)))
            n += len(begin)
            if n > PACK:
                yield flush(held, turn)
                held, n, turn = [], 0, turn + 1
        if n:
            yield flush(held, turn)

    def flush(held: list[tuple], turn: int) -> pa.RecordBatch:
        at, run = (np.concatenate(x) for x in list(zip(*held))[:2])
        ids, texts = (pa.concat_arrays(x) for x in list(zip(*held))[2:])
        salt = (np.arange(len(run)) + turn) % parts[at[:, 0]]  # one passage can be what most of a block's runs hold
        whole = at[:, 0].astype(np.int64) << 31 | salt
        key, ends, (pair, run, order) = packed(whole, at[:, 1:], run, np.arange(len(run)))
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x.take(pa.array(order))) for x in (ids, texts)]
        return pa.record_batch([pa.array((key >> 31).astype(np.int32)), pa.array((key & ((1 << 31) - 1)).astype(np.int32)), binaries(pair, ends), binaries(run, ends), *lists], names=["block", "salt", "cells", "runs", "ids", "texts"])

    def answer(questions: pa.Table, sketch: pa.Table) -> pa.Table:
        names = ["_k", "_h", "run", "mixed"]
        types = [questions.schema.field(n).type.value_type for n in ("ids", "texts")]
        if not len(questions) or not len(sketch):
            return pa.table([pa.array([], t) for t in (*types, pa.int32(), pa.bool_())], names=names)
        pair = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in questions["cells"]]).reshape(-1, ROWS).astype(np.int64)
        run = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in questions["runs"]])
        often, mixed = np.ones(len(run), bool), np.ones(len(run), bool)
        for name, total in (("twice", often), ("mixed", mixed)):
            bits = np.frombuffer(sketch[name][0].as_buffer(), np.uint8).reshape(ROWS, -1)
            for row in range(ROWS):
                cell = pair[:, row]
                total &= (bits[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        take = pa.array(np.flatnonzero(often))
        ids, texts = (pa.concat_arrays([x.flatten() for x in questions[n].chunks]).take(take) for n in ("ids", "texts"))
        return pa.table([ids, texts, pa.array(run[often]), pa.array(mixed[often])], names=names)

    kind = dict(docs.dtypes)["_k"]
    questions = docs.mapInArrow(ask, f"block int, salt int, cells binary, runs binary, ids array<{kind}>, texts array<long>")
    salted = F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("asked") / F.lit(float(ASKED)), F.lit(1.0))).cast("int") - 1))
    spread = sketch.select("block", salted.alias("salt"), "twice", "mixed")
    return questions.groupBy("block", "salt").cogroup(spread.groupBy("block", "salt")).applyInArrow(answer, f"_k {kind}, _h long, run int, mixed boolean")


def units(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most_cells: int = 1 << 40) -> DataFrame:
    """(h1, h2, doc_id, word, n): what is estimated repeated: ``n`` windows from ``word`` on, known by the hashes."""
    blocks, cells = sketch_bits(docs, most_cells)
    sketch = stored(merged(docs, blocks, cells, width, gram), "sketch")
    found = repeated_runs(docs, sketch, blocks, cells, width, gram)
    # the low bit of a number says that the run's windows go one by one
    by_text = found.groupBy("_k", "_h").agg(F.collect_set(F.col("run").cast("long") * 2 + F.col("mixed").cast("long")).alias("_runs"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "_t"):
            text, word, representative, one, two = windows(batch.column(1), width, gram)
            begin = runs(text, representative)
            of, listed = text[begin], batch.column(2)
            number = np.arange(len(begin)) - np.searchsorted(of, of)
            asked = np.sort((np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy()) << 33) | listed.flatten().to_numpy())
            key = (of << 33) | (number << 1)
            left = np.searchsorted(asked, key)
            lengths = np.diff(np.append(begin, len(text)))
            got = asked[np.minimum(left, len(asked) - 1)] if len(asked) else np.full(len(key), -1)
            whole, single = got == key, np.repeat(got == key | 1, lengths)
            h1, h2 = run_hashes(begin, one, two)
            first = np.concatenate([begin[whole], np.flatnonzero(single)])
            yield pa.record_batch(
                [pa.array(np.concatenate([a[whole], b[single]]).view(np.int64)) for a, b in ((h1, one), (h2, two))]
                + [batch.column(0).take(pa.array(text[first])), pa.array(word[first].astype(np.int32)), pa.array(np.concatenate([lengths[whole], np.ones(single.sum(), np.int64)]).astype(np.int32))],
                names=["h1", "h2", "doc_id", "word", "n"],
            )

    kind = dict(docs.dtypes)["_k"]
    wanted = docs.join(by_text, ["_k", "_h"]).select("_k", "_t", "_runs")
    out = stored(wanted.mapInArrow(emit, f"h1 long, h2 long, doc_id {kind}, word int, n int"), "units")
    drop(sketch)
    return out


def repeated_units(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most_cells: int = 1 << 40) -> DataFrame:
    """(doc_id, word, n): ``n`` windows, from the one that begins at ``word``, that occur in two or more documents."""
    arrow_batches(docs.sparkSession)
    docs = narrow(docs).where("_k is not null and _t is not null").withColumn("_h", F.xxhash64("_t"))
    found = units(docs, width, gram, most_cells)
    ends = found.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    repeated = stored(ends.where("lo < hi").select("h1", "h2", "n"), "repeated")
    return found.join(repeated, ["h1", "h2", "n"], "left_semi").select("doc_id", "word", "n").distinct()


def spans(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most_cells: int = 1 << 40) -> DataFrame:
    """(doc_id, begin_word, end_word): the words, end excluded, of each longest stretch that repeated windows cover without a gap."""
    one = repeated_units(docs, width, gram, most_cells)
    order = Window.partitionBy("doc_id").orderBy("word", "n")
    last = F.max(F.col("word") + F.col("n") - 1)
    fresh = one.withColumn("fresh", F.when(F.col("word") <= last.over(order.rowsBetween(Window.unboundedPreceding, -1)) + width, 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(order))
    return island.groupBy("doc_id", "island").agg(F.min("word").alias("begin_word"), (last + width).alias("end_word")).drop("island")
