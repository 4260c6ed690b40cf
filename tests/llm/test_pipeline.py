import math
import re
from collections import Counter

import pytest
from test_minhash import exact, shingles
from test_mixing import brute as mixed
from test_toxicity import hash_of

import corpus_pipeline as C
from eventloom.llm import bpe, toxicity
from eventloom.llm.registry import MIX_WEIGHTS, queries


def by_hand(spark, sf):
    """Rows (doc_id, source, tokens) with their number, from plain Python over the whole table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))

    def severity(text):
        counts = Counter(h for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().lower()) for h in hash_of(w) if h in weight)
        x = sum(math.log1p(c) * weight[h] for h, c in counts.items())
        return sum(1 / (1 + math.exp(-max(-50, min(50, x - t)))) for t in model.thresholds)

    rows = [r for r in docs.orderBy("doc_id").collect() if severity(r.text) < 0.5]
    seen, kept = set(), []
    for r in rows:
        if r.text not in seen:
            kept.append(r)
        seen.add(r.text)
    grams = [shingles(r.text) for r in kept]
    size = [sum(g.values()) for g in grams]
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if sum((grams[i] & grams[j]).values()) >= 0.33 * max(size[i], size[j], 1) and exact(kept[i].text, kept[j].text) >= 0.5:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    alone = [r for i, r in enumerate(kept) if root[i] == i]
    times = mixed([(r.doc_id, r.text, r.source) for r in alone], MIX_WEIGHTS)
    encoding = bpe.codec().encoding
    return {(r.doc_id, r.source, tuple(encoding.encode_ordinary(r.text))): n for r, n in zip(alone, times) if n}


def test_each_stage_does_something(spark):
    """At the scale where the toxicity stage has features: it rejects most labelled toxic rows, and every stage drops some."""
    sf = "/root/testdata/sf0.01"
    docs, toxic = spark.read.parquet(f"{sf}/documents.parquet"), {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    n, out = docs.count(), docs
    for name, stage in C.STAGES[:3]:
        out = stage(spark, out, sf).persist()
        assert out.count() < n, name
        n = out.count()
        if name == "toxicity":
            assert len(toxic & {r.doc_id for r in out.select("doc_id").collect()}) <= len(toxic) / 2


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_against_brute_force(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    got = Counter((r.doc_id, r.source, tuple(r.tokens)) for r in C.run(spark, sf).collect() if r.exact)
    want = Counter(by_hand(spark, sf))
    assert got == want
    assert queries()["pipeline"] is C.run


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mix_sources", "bpe"]
    out = docs.limit(40)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns


def test_awkward_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (None, "", None, "src0", 0, 1), (2, "one two three", "en", "src0", 1, 1), (2, "one two three", "en", "src0", 1, 1)], "doc_id long, text string, lang string, source string, n_chars long, tokens int")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in C.STAGES:
            out = stage(spark, out, sf)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in out.collect()) == ([(False, 2, 3)] * out.where("doc_id = 2").count() + [(True, 0, 0)] * out.where("doc_id is null").count() if rows is docs else [])
