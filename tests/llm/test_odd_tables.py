"""Every operator and stage over one table with text ids, nulls, repeated rows, a dotted name, a map and names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from eventloom.llm import bpe, exact_dedup, licenses, minhash, mixing, pii, secrets, substring, toxicity

PASSAGE = " ".join(f"word{k}" for k in range(70))
TEXTS = [
    ("d1", PASSAGE), ("d2", PASSAGE), ("d3", PASSAGE + " and one more"), ("d4", "write to jo@mail.example.org now"), ("d5", "Licensed under the Apache License, Version 2.0"),
    ("d6", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), ("d7", None), ("d8", ""), (None, "no id here"), ("d9", "twice"), ("d9", "twice"), ("d10", "long " * 100000),
]
EXTRA = ["a.b", "m`p", "_k", "_t", "tokens", "severity", "kind", "bucket", "id", "text_", "copy"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id string, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") != "d4", "s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.create_map(F.lit("k"), F.lit(1)) if c == "m`p" else F.lit(c) for c in EXTRA}).repartition(3)


def same_columns(out, docs):
    return out.columns[: len(docs.columns)] == docs.columns and all(r["a.b"] == "a.b" and r["m`p"] == {"k": 1} and r["_k"] == "_k" for r in out.collect())


def ids(df, name="doc_id"):
    return sorted(r[name] or "" for r in df.collect())


def test_mix(docs):
    out = mixing.mix(docs, {"s": 1.0}, copies="copy")
    assert same_columns(out, docs) and out.columns[-1] == "copy_"
    every = mixing.mix(docs, {}, budget=40.0)
    assert every.columns == docs.columns and {i for i in ids(every)} == {i or "" for i, _ in TEXTS}


def test_exact(docs):
    out = exact_dedup.dedup_batches(docs)
    assert same_columns(out, docs) and ids(out) == sorted(["", "d1", "d10", "d3", "d4", "d5", "d6", "d7", "d8", "d9"])


def test_near(docs):
    assert {(r.doc_id, r.group_id) for r in minhash.groups(docs).collect()} == {("d1", "d1"), ("d2", "d1"), ("d3", "d1")}
    out = minhash.keep_one(docs)
    assert same_columns(out, docs) and ids(out) == sorted(["", "d1", "d10", "d4", "d5", "d6", "d7", "d8", "d9", "d9"])


def test_substrings(docs):
    assert sorted((r.doc_id, r.begin_word, r.end_word) for r in substring.spans(docs).collect()) == [("d1", 0, 70), ("d2", 0, 70), ("d3", 0, 70)]


def test_scans(docs):
    assert [(r.doc_id, r.kind) for r in pii.find(docs).collect()] == [("d4", "email")]
    assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [("d5", "Apache-2.0")]
    assert [(r.doc_id, r.kind, r.confirmed) for r in secrets.scan(docs).collect()] == [("d6", "assigned_hex", False)]
    assert secrets.scan(docs, unconfirmed=False).count() == 0
    clean = pii.redact(docs)
    assert same_columns(clean, docs) and clean.where("doc_id = 'd4'").first().text == "write to <email> now"


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(1, 10)], "doc_id string, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert same_columns(scored, docs) and scored.columns[-3:] == ["severity_", "grade", "rejected"] and scored.count() == len(TEXTS)
    assert ids(toxicity.keep_clean(docs, labels)) == sorted(i or "" for i, _ in TEXTS)


def test_tokens(docs):
    coded = bpe.encode_checked(docs)
    assert coded.columns[-3:] == ["tokens_", "n_tokens", "exact"] and all(r.exact or r.doc_id == "d7" for r in coded.collect())
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text", "`a.b`")))
    assert {(r.doc_id, r.text) for r in back.collect()} == set(TEXTS)


def test_stages(docs, spark, tmp_path):
    spark.createDataFrame([("d1", 0), ("d2", 1), (None, 1), ("d9", None)], "doc_id string, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {
        "toxicity": sorted(i or "" for i, _ in TEXTS), "exact_dedup": sorted(["", "d1", "d10", "d3", "d4", "d5", "d6", "d7", "d8", "d9"]), "minhash_near_dedup": sorted(["", "d1", "d10", "d4", "d5", "d6", "d7", "d8", "d9"]),
    }
    out = docs
    for name, stage in C.STAGES:
        out = stage(spark, out, str(tmp_path))
        if name in want:
            assert out.columns == docs.columns and ids(out) == want[name], name
        if name == "mix_sources":
            assert out.columns == docs.columns
    assert all(r.exact or r.text is None for r in out.withColumn("text", F.col("exact")).collect())
