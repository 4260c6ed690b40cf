"""Queries of node memories, density clusters, trained predictors, regularising losses and the vector store, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.extensions import Extensions
from eventloom.operators import density, index, memory, predictors, probes
from eventloom.operators import regularizers as G
from eventloom.plans import q_schema
from eventloom.plans import q_sequences as QS
from eventloom.plans.q_population import D, emb, ids, knn_out, knn_sql, r, read
from eventloom.session import shared_folder
from eventloom.sources.vectors import VectorStore

MONTH = 30 * 86400.0


def edges(s: SparkSession, d: str) -> DataFrame:
    """Triples with whole numbers as values: their sums don't depend on the order."""
    return q_schema.triples(s, d).withColumn("numeric_value", F.floor("numeric_value").cast("double"))


def c13(s, d):
    return memory.messages(edges(s, d), MONTH).select("node", "batch", "n", r("message", 4).alias("message"), r("last", 3).alias("last"))


def c13_memory(s, d):
    return memory.memories(edges(s, d), MONTH).select("node", "batches", r("memory", 3).alias("memory"), r("last", 3).alias("last"))


def e20(s, d):
    return density.dbscan(emb(s, d), 0.65, 4, "vec_id").select(F.col("id").alias("vec_id"), "cluster", "core")


def d16(s, d):
    """The nearest of all vectors for every fiftieth one, by the index."""
    e = ids(s, d)
    return knn_out(index.search(index.build(e, D), e.where("id % 50 = 0"), 10))


def m04(s, d):
    """The next value of each sequence by a regression on the last one, fitted to all pairs of neighbours."""
    seq = QS.sequences(s, d).withColumn("embedding", F.slice("embedding", 1, 1))
    return predictors.fit(seq, 1, context=1, steps=1, l2=0.0).predict(seq).select("id", "step", r(F.col("prediction")[0], 5).alias("value"))


def m14(s, d):
    e = emb(s, d)
    got = G.vicreg(e, e.withColumn("embedding", F.transform("embedding", lambda x, i: x * (1 + i % 3))), D, "vec_id")
    return s.createDataFrame([(k, round(v, 5)) for k, v in got.items()], "part string, value double")


def store(s: SparkSession, d: str) -> VectorStore:
    """The embeddings by label, every fifth doubled by a second insert, every seventh deleted."""
    v = VectorStore(s, f"{shared_folder(s)}/vectors-{uuid.uuid4().hex}", 4)
    rows = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("tag"))
    v.create("all_vectors", D)
    v.put("all_vectors", rows)
    v.put("all_vectors", rows.where("id % 5 = 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float"))))
    v.delete("all_vectors", rows.where("id % 7 = 0").select("id"))
    return v


def a15(s, d):
    v = store(s, d)
    n = v.copy("all_vectors", "threes", "3")
    return v.table("threes").select("id", "tag", F.lit(n).cast("long").alias("copied"))


def a16(s, d):
    return store(s, d).table("all_vectors").select("id", "tag", r(F.col("embedding")[0].cast("double"), 5).alias("x"))


def a17(s, d):
    v = store(s, d)
    table = v.register("all_vectors", f"vectors_{uuid.uuid4().hex}")
    got = s.table(table).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a tag, so that the table can go
    s.sql(f"DROP TABLE {table}")
    return s.createDataFrame(got, "tag string, n long")


def a19(s, d):
    from eventloom.operators import sequences as S

    v = VectorStore(s, f"{shared_folder(s)}/vectors-{uuid.uuid4().hex}", 4)
    counts = v.sync(S.process(QS.sequences(s, d), 2, S.Config(1), 2), "users")
    return s.createDataFrame([(k, n, v.table(f"users_{k}").count()) for k, n in counts.items()], "kind string, synced long, held long")


def l01(s, d):
    """A column, an aggregate and a table function of the user's own, in one SQL query."""
    import pyarrow.compute as pc

    class Letters:
        def eval(self, text: str, n: int):
            for k in range(0, len(text or ""), n):
                yield (text[k : k + n],)

    more = Extensions(s)
    more.column("my_double", "double", lambda x: pc.multiply(x, 2.0))
    more.aggregate("my_span", "double", lambda x: float(x.max() - x.min()))
    more.table("my_letters", "part string", Letters)
    # the table function sees each distinct text once
    return s.sql(
        "SELECT part, round(my_span(x), 4) AS span FROM (SELECT c_mktsegment AS m, my_double(c_acctbal) AS x FROM {c}) t "
        "JOIN (SELECT d.m AS k, part FROM (SELECT DISTINCT c_mktsegment AS m FROM {c}) d, LATERAL my_letters(d.m, 4)) l ON t.m <=> l.k GROUP BY part",
        c=read(s, d, "customer"),
    )


def h06(s, d):
    """Probes over checkpoints: which vectors tell the halves of the ids apart, and how large the first coordinate is."""
    e = emb(s, d).select("vec_id", "embedding", "label")
    versions = {"first": e, "scaled": e.withColumn("embedding", F.transform("embedding", lambda x: x * 2))}
    found = {"rows": lambda v: v.agg(F.count(F.lit(1)).cast("double").alias("value")), "largest": lambda v: v.agg(r(F.max(F.col("embedding")[0]), 5).alias("value"))}
    return probes.sweep(versions, found)


QUERIES = {
    "h06_sweep": h06, "l01_extensions": l01,
    "a15_copy_filtered": a15, "a16_vector_store": a16, "a17_register": a17, "a19_sync": a19,
    "c13_node_messages": c13, "c13_node_memory": c13_memory, "d16_index_search": d16, "e20_density_clusters": e20, "m04_predictor": m04, "m14_vicreg": m14,
}

MESSAGES = f"""{q_schema.TRIPLE_SQL}, ends AS (SELECT unnest(list_distinct([subject_id, object_id])) AS node, floor(t_epoch / {MONTH}::DOUBLE)::BIGINT AS batch, t_epoch, floor(numeric_value) AS v FROM tri),
msg AS (SELECT node, batch, count(*) AS n, avg(v) AS message, max(t_epoch) AS last FROM ends GROUP BY 1, 2)"""
COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
HELD = "held AS (SELECT vec_id::VARCHAR AS id, label::VARCHAR AS tag, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END * embedding[1] AS x FROM embeddings WHERE vec_id % 7 <> 0)"

SQL = {
    "h06_sweep": "SELECT v AS checkpoint, p AS probe, CASE WHEN p = 'rows' THEN n ELSE round(m * CASE WHEN v = 'scaled' THEN 2 ELSE 1 END, 5) END AS value FROM (SELECT count(*)::DOUBLE AS n, max(embedding[1])::DOUBLE AS m FROM embeddings), (VALUES ('first'), ('scaled')) a(v), (VALUES ('rows'), ('largest')) b(p)",
    "l01_extensions": "SELECT part, round(max(x) - min(x), 4) AS span FROM (SELECT substr(c_mktsegment, k::INTEGER, 4) AS part, 2 * c_acctbal AS x FROM customer, range(1, 100, 4) r(k) WHERE k <= length(c_mktsegment)) GROUP BY 1",
    "a15_copy_filtered": f"WITH {HELD} SELECT id, tag, count(*) OVER () AS copied FROM held WHERE tag = '3'",
    "a16_vector_store": f"WITH {HELD} SELECT id, tag, round(x::DOUBLE, 5) AS x FROM held",
    "a17_register": f"WITH {HELD} SELECT tag, count(*) AS n FROM held GROUP BY 1",
    "a19_sync": "SELECT 'representations' AS kind, count(DISTINCT user_id) AS synced, count(DISTINCT user_id) AS held FROM events UNION ALL SELECT 'predictions', 2 * count(DISTINCT user_id), 2 * count(DISTINCT user_id) FROM events",
    "c13_node_messages": f"WITH {MESSAGES} SELECT node, batch, n, round(message, 4) AS message, round(last, 3) AS last FROM msg",
    "c13_node_memory": f"WITH {MESSAGES}, w AS (SELECT *, 0.5::DOUBLE * pow(0.5::DOUBLE, row_number() OVER (PARTITION BY node ORDER BY batch DESC) - 1) AS w FROM msg) SELECT node, count(*) AS batches, round(sum(w * message), 3) AS memory, round(max(last), 3) AS last FROM w GROUP BY 1",
    "d16_index_search": knn_sql(10, "a.vec_id % 50 = 0"),
    "e20_density_clusters": f"""
WITH RECURSIVE near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COSINE} >= 0.35),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= 4),
linked AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.id),
own AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
border AS (SELECT a AS id, arg_min(cluster, b) AS cluster FROM near JOIN own ON own.id = b GROUP BY a)
SELECT vec_id, coalesce(own.cluster, border.cluster, -1)::BIGINT AS cluster, own.cluster IS NOT NULL AS core FROM embeddings LEFT JOIN own ON own.id = vec_id LEFT JOIN border ON border.id = vec_id""",
    "m04_predictor": f"WITH {QS.SEQ}, p AS (SELECT d0 AS y, lag(d0) OVER (PARTITION BY id ORDER BY ts, tie) AS x FROM seq), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE x IS NOT NULL), l AS (SELECT id, arg_max(d0, (ts, tie)) AS x FROM seq GROUP BY id) SELECT id, 1::INTEGER AS step, round(a + b * x, 5) AS value FROM l, f",
    "m14_vicreg": """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
y AS (SELECT vec_id, i, v, v * (1 + i % 3) AS w FROM x),
inv AS (SELECT avg((v - w) * (v - w)) AS q FROM y),
var AS (SELECT avg(greatest(0, 1 - sqrt(sv + 1e-4))) + avg(greatest(0, 1 - sqrt(sw + 1e-4))) AS q FROM (SELECT i, var_samp(v) AS sv, var_samp(w) AS sw FROM y GROUP BY i)),
cov AS (SELECT sum(cv * cv) / 64 + sum(cw * cw) / 64 AS q FROM (SELECT a.i, b.i, covar_samp(a.v, b.v) AS cv, covar_samp(a.w, b.w) AS cw FROM y a JOIN y b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY a.i, b.i))
SELECT part, round(value, 5) AS value FROM (SELECT 'invariance' AS part, q AS value FROM inv UNION ALL SELECT 'variance', q FROM var UNION ALL SELECT 'covariance', q FROM cov UNION ALL SELECT 'loss', 25 * inv.q + 25 * var.q + cov.q FROM inv, var, cov)""",
}
