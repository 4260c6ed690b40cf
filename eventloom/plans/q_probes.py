"""Queries of the supervised probes and regularisers. Fits are iterative, so only alignment, splits and metrics have SQL; tests hold the fits against numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import probes as P
from eventloom.operators import regularizers as G
from eventloom.plans import q_kpi
from eventloom.plans.q_population import D, emb, r, read
from eventloom.session import stored

SPLIT = "(('0x' || substr(md5('42:' || {k}), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2)"


def cases(s: SparkSession, d: str) -> DataFrame:
    """The rows of ``case_rows`` with their vectors."""
    return case_rows(s, d).join(emb(s, d).drop("label"), "vec_id")


def case_rows(s: SparkSession, d: str) -> DataFrame:
    """Closed visits that have a vector: an order has the embedding of its key modulo their number. Stored without the vectors, as these repeat."""
    e = emb(s, d)
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    v = q_kpi.visits(s, d).where("end_on is not null").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("visit") % F.col("_n")).drop("_n").dropna()
    rows = stored(v.select("visit", "vec_id", "site", "los", "bill", "denied"), "cases")
    return P.split(P.labelled(e.select("vec_id").distinct(), rows, "vec_id"), "visit")


def h00(s, d):
    e = emb(s, d).select("vec_id")
    return P.labelled(e, read(s, d, "orders").select((F.col("o_orderkey") * 2).alias("vec_id"), "o_orderstatus"), "vec_id").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def h01(s, d):
    return P.split(read(s, d, "orders").select("o_orderkey"), "o_orderkey")


def probe(s, d, value, rows: DataFrame | None = None) -> DataFrame:
    """The fit sees each vector once, with the mean and number of its visits' values; a vector's prediction is joined to its held visits."""
    c = (case_rows(s, d) if rows is None else rows).withColumn("y", value).where("y is not null").select("vec_id", "y", "held")
    e = emb(s, d).select("vec_id", "embedding")
    per = c.where("not held").groupBy("vec_id").agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg("y").alias("y"))
    model = P.ridge(P.features(e.join(stored(per, "means"), "vec_id")), "y", weight="w")
    said = model.transform(P.features(e)).select("vec_id", "prediction")
    return P.regression_metrics(c.where("held").join(said, "vec_id"), "y").select("n", r("r2", 3).alias("r2"), r("mae", 3).alias("mae"), r("median_error", 3).alias("median_error"))


def h02(s, d, rows=None):
    return probe(s, d, F.log1p(F.col("los").cast("double")), rows)


def h03(s, d, rows=None):
    return probe(s, d, F.log1p("bill"), rows)


def h04(s, d):
    c = case_rows(s, d).groupBy("vec_id", "held", (F.col("denied") > 0).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = stored(c, "counts")
    e = emb(s, d).select("vec_id", "embedding")
    model = P.logistic(P.features(e.join(c.where("not held"), "vec_id")), "y", 0.01, "n")
    said = P.positive(model.transform(P.features(e))).select("vec_id", "score")
    held = stored(c.where("held").join(said, "vec_id"), "held")
    return P.roc_auc(held, "y", count="n").crossJoin(P.average_precision(held, "y", count="n")).select(r("auc", 3).alias("auc"), r("average_precision", 3).alias("average_precision"))


def h05(s, d):
    e = emb(s, d).withColumn("y", F.col("label").cast("double"))
    c = P.split(P.features(e), "vec_id")
    return P.class_metrics(P.forest(c.where("not held"), "y").transform(c.where("held")), "y").select("class", "support", r("precision", 3).alias("precision"), r("recall", 3).alias("recall"))


def h06(s, d):
    """All probes as one table."""
    c = case_rows(s, d)
    parts = [(name, f(s, d, c)) for name, f in (("stay", h02), ("bill", h03))]
    return parts[0][1].withColumn("probe", F.lit(parts[0][0])).unionByName(parts[1][1].withColumn("probe", F.lit(parts[1][0])))


def h07(s, d):
    """The probe of one site's visits."""
    return probe(s, d, F.log1p("bill"), case_rows(s, d).where("site < 5")).select("n", "mae")


def h08(s, d):
    """Feature rows: codes become indexes of their sorted values."""
    v = q_kpi.visits(s, d).where("code is not null").withColumn("embedding", F.array(F.col("items").cast("double")))
    from pyspark.ml.functions import vector_to_array

    got = P.features(v, codes=["code", "payer"], numbers=["los"]).select("visit", vector_to_array("features").alias("x"))
    return got.select("visit", F.posexplode("x").alias("dim", "val"))


def m01(s, d):
    e = emb(s, d)
    return s.createDataFrame([("sigreg", round(G.sigreg(e, D), 4)), ("weak_sigreg", round(G.weak_sigreg(e, D), 4)), ("rdmreg", round(G.rdmreg(e, D, key="vec_id"), 4))], "name string, loss double")


QUERIES = {"h00_labels": h00, "h01_split": h01, "h02_stay_probe": h02, "h03_cost_probe": h03, "h04_risk_probe": h04, "h05_forest": h05, "h06_all_probes": h06, "h07_site_probe": h07, "h08_feature_rows": h08, "m01_regularizers": m01}

SQL = {
    "h00_labels": "SELECT o_orderstatus, count(*) AS n FROM orders JOIN embeddings ON vec_id = o_orderkey * 2 GROUP BY 1",
    "h01_split": f"SELECT o_orderkey, {SPLIT.format(k='o_orderkey')} AS held FROM orders",
    "h08_feature_rows": f"WITH {q_kpi.V}, w AS (SELECT visit, items, los, dense_rank() OVER (ORDER BY code) - 1 AS c, dense_rank() OVER (ORDER BY payer) - 1 AS p FROM v WHERE code IS NOT NULL) SELECT visit, 0 AS dim, items::DOUBLE AS val FROM w UNION ALL SELECT visit, 1, c FROM w UNION ALL SELECT visit, 2, p FROM w UNION ALL SELECT visit, 3, los FROM w",
}
