import random

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe as B

SCHEMA = "doc_id long, text string, tokens int, _coded string"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' \t\n  é界🙂9.,-<|>")), max_size=300), st.integers(1, 40), st.integers(1, 16))
def test_tree_gives_the_same_tokens(text, leaf, window):
    c = B.codec()
    want = c.encoding.encode_ordinary(text)
    assert c.encode(text, leaf, window).tolist() == want
    assert c.decode_bytes(np.array(want, np.int64), leaf) == text.encode()


def test_long_texts_without_and_with_spaces():
    c, rng = B.codec(), random.Random(6)
    for text in ("a" * 50000, " " * 50000, "ab" * 20000 + "  " * 9000, "\n \t" * 20000, "".join(rng.choice("abc éß 9\n") for _ in range(100000))):
        assert c.encode(text).tolist() == c.encoding.encode_ordinary(text)


def test_awkward_rows(spark):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (3, ""), (None, "<|endoftext|>"), (4, "word " * 60000), (5, "\u0000﻿ é")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = B.encode_checked(docs)
    assert got.columns == ["doc_id", "tokens", "_coded", "tokens_", "n_tokens", "exact"]
    for r in got.collect():
        if r.tokens_ is None:
            assert r.doc_id == 2 and r.n_tokens is None and r.exact is None
        else:
            assert r.exact and r.n_tokens == len(r.tokens_)
    coded = B.encode(docs)
    back = B.decode(coded.drop("tokens"), "tokens_")
    assert sorted((r.text is None, r.text or "") for r in back.collect()) == sorted((t is None, t or "") for _, t in rows)


def test_empty(spark):
    assert B.encode_checked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf):
    from eventloom.llm.registry import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    encoding: tiktoken.Encoding = B.codec().encoding
    got = queries()["op9_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.exact and r.tokens == encoding.encode_ordinary(texts[r.doc_id])
