"""Byte-level BPE encoding and decoding as a tree reduction over a monoid of encoded spans.

A text is halved recursively down to leaves, which are encoded on their own. Two neighbours are joined by encoding a window around their
border again. The window ends where the pre-tokenizer provably starts a new piece whatever came before: between a character that is no white
space and a white space (in the pattern white space only ever begins a piece or is followed by more of itself). From there on the scan of
the halves and of the whole text are in the same state, so the tokens outside the window are those of the whole text. A window without such
a place is doubled until it has one or reaches the end of the span. Decoding concatenates the bytes of the tokens up the same tree.

Defined cases: a null text gives null tokens; an empty one an empty list; special-token strings are ordinary text; equal texts give equal
tokens; texts are encoded whole whatever their length. Ids, ties and repeated rows play no part: each row is encoded by itself. Further columns
pass through whatever their names and types.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_batches, named
from eventloom.session import unused

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, WINDOW = 2048, 64
#: A white space after something else: every scan has a border before it.
SAFE = re.compile(r"(?<=\S)(?=\s)")


class Codec:
    """A vocabulary file of byte ranks, with what is derived from it."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.table = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def leaf(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text).astype(np.int32) if text else np.zeros(0, np.int32)

    def encode(self, text: str, leaf: int = LEAF, window: int = WINDOW) -> np.ndarray:
        return self._encode(text, 0, len(text), leaf, window)

    def _encode(self, text: str, low: int, high: int, leaf: int, window: int) -> np.ndarray:
        if high - low <= max(leaf, 1):
            return self.leaf(text[low:high])
        middle = (low + high) // 2
        left, right = self._encode(text, low, middle, leaf, window), self._encode(text, middle, high, leaf, window)
        return self.join(text, low, middle, high, left, right, window)

    def join(self, text: str, low: int, middle: int, high: int, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Tokens of text[low:high] from those of text[low:middle] and text[middle:high]."""
        start, size = low, window
        while middle - size > low:
            found = [m.start() for m in SAFE.finditer(text, middle - size, middle - 1) if m.start() > middle - size]
            if found:
                start = found[-1]
                break
            size *= 2
        end, size = high, window
        while middle + size < high:
            found = next((m.start() for m in SAFE.finditer(text, middle + 1, middle + size) if m.start() > middle + 1), None)
            if found is not None:
                end = found
                break
            size *= 2
        keep = self._before(left, len(text[start:middle].encode())) if start > low else 0
        skip = self._after(right, len(text[middle:end].encode())) if end < high else len(right)
        return np.concatenate([left[:keep], self.leaf(text[start:end]), right[skip:]])

    def _before(self, tokens: np.ndarray, tail: int) -> int:
        """How many tokens come before the last ``tail`` bytes."""
        have, at = 0, len(tokens)
        while have < tail:
            at -= 1
            have += self.lengths[tokens[at]]
        assert have == tail, "a token crosses a border of the pre-tokenizer"
        return at

    def _after(self, tokens: np.ndarray, head: int) -> int:
        have = at = 0
        while have < head:
            have += self.lengths[tokens[at]]
            at += 1
        assert have == head, "a token crosses a border of the pre-tokenizer"
        return at

    def decode_bytes(self, tokens: np.ndarray, leaf: int = LEAF) -> bytes:
        """Bytes of the tokens: leaves are looked up at once, and concatenated up the tree."""
        if len(tokens) > leaf:
            half = len(tokens) // 2
            return self.decode_bytes(tokens[:half], leaf) + self.decode_bytes(tokens[half:], leaf)
        lengths = self.lengths[tokens]
        total = int(lengths.sum())
        if not total:
            return b""
        shift = self.starts[tokens] - np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return self.table[np.arange(total) + np.repeat(shift, lengths)].tobytes()

    def decode(self, tokens: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(tokens, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str = VOCABULARY) -> Codec:
    """One codec a worker process."""
    return Codec(path)


def encode_udf(path: str = VOCABULARY):
    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        c, parts, ends = codec(path), [], [0]
        nulls = []
        for text in column:
            value = text.as_py()
            nulls.append(value is None)
            tokens = c.encode(value) if value else np.zeros(0, np.int32)
            parts.append(tokens)
            ends.append(ends[-1] + len(tokens))
        values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(nulls, pa.bool_()))

    return encode


def decode_udf(path: str = VOCABULARY):
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if tokens is None else c.decode(tokens) for tokens in _lists(column)], pa.string())

    return decode


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    values, offsets, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]] if valid[i] else None


def encode(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``tokens`` instead of ``text``, and their number in ``n_tokens`` (null for a null text)."""
    arrow_batches(docs.sparkSession)
    tokens, n = unused(docs, "tokens"), unused(docs, "n_tokens")
    coded = docs.withColumn(tokens, encode_udf(path)(named(text).cast("string")))
    return coded.select(*[named(c) for c in docs.columns if c != text], tokens, F.when(F.col(tokens).isNotNull(), F.size(tokens)).alias(n))


def decode(coded: DataFrame, tokens: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``coded`` with ``text`` instead of ``tokens``."""
    arrow_batches(coded.sparkSession)
    return coded.select(*[named(c) for c in coded.columns if c != tokens], decode_udf(path)(named(tokens)).alias(unused(coded, "text")))


def encode_checked(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``encode`` with ``exact``: whether decoding the tokens gives the text back, in one pass."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("struct<tokens:array<int>,exact:boolean>")
    def both(column: pa.Array) -> pa.Array:
        c, parts, ends, nulls, exact = codec(path), [], [0], [], []
        for item in column:
            value = item.as_py()
            nulls.append(value is None)
            tokens = c.encode(value) if value else np.zeros(0, np.int32)
            parts.append(tokens)
            ends.append(ends[-1] + len(tokens))
            exact.append(None if value is None else c.decode_bytes(tokens) == value.encode())
        values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(nulls, pa.bool_()))
        return pa.StructArray.from_arrays([lists, pa.array(exact, pa.bool_())], names=["tokens", "exact"])

    held = unused(docs, "_coded")
    names = [unused(docs, n) for n in ("tokens", "n_tokens", "exact")]
    got = docs.withColumn(held, both(named(text).cast("string")))
    return got.select(
        *[named(c) for c in docs.columns if c != text], F.col(f"{held}.tokens").alias(names[0]),
        F.when(F.col(f"{held}.tokens").isNotNull(), F.size(f"{held}.tokens")).alias(names[1]), F.col(f"{held}.exact").alias(names[2]),
    )
