"""The queries of this subpackage, one for each operator and the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe, embedding_dedup, exact_dedup, licenses, minhash, mixing, pii, secrets, substring, toxicity
from eventloom.llm.common import documents

#: Relative weights of the named sources; the others have 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), MIX_WEIGHTS, copies="copy")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_batches(documents(spark, sf_dir))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select("doc_id", "text"), model).drop("text")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_checked(documents(spark, sf_dir).select("doc_id", "text"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_substring": op5_substring,
    "op6_minhash": op6_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
}

SQL: dict[str, str] = {
    "op1_mix": """
WITH counted AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n FROM documents),
per AS (SELECT source, sum(n)::DOUBLE AS tokens, CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 2.0::DOUBLE WHEN 'src3' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM counted GROUP BY source HAVING sum(n) > 0),
rates AS (SELECT source, weight * sum(tokens) OVER () / (sum(weight) OVER () * tokens) AS rate FROM per),
drawn AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, rate,
                 ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, md5(d.text), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
          FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT + 1))::INTEGER AS copy
FROM drawn""",
    "op3_exact_dedup": """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place FROM documents)
WHERE text IS NULL OR place = 1""",
    "op4_embedding_dedup": """
WITH RECURSIVE near AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.id),
least AS (SELECT id, min(root) AS group_id FROM reach GROUP BY id),
linked AS (SELECT a, count(*) AS links FROM near GROUP BY a)
SELECT l.id AS vec_id, l.group_id, coalesce(links, 0)::BIGINT AS links FROM least l LEFT JOIN linked ON l.id = linked.a""",
    "op5_substring": """
WITH words AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r\x1c-\x1f]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS word FROM words WHERE len(w) >= 50),
wins AS (SELECT doc_id, word, md5(array_to_string(w[word + 1 : word + 50], ' ')) AS h FROM places),
twice AS (SELECT h FROM wins GROUP BY h HAVING min(doc_id) < max(doc_id)),
found AS (SELECT DISTINCT doc_id, word FROM wins WHERE h IN (SELECT h FROM twice)),
starts AS (SELECT *, CASE WHEN word <= lag(word) OVER (PARTITION BY doc_id ORDER BY word) + 50 THEN 0 ELSE 1 END AS fresh FROM found),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY word) AS island FROM starts)
SELECT doc_id, min(word)::INTEGER AS begin_word, (max(word) + 50)::INTEGER AS end_word FROM islands GROUP BY doc_id, island""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
