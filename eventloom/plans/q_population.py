"""Queries of the similarity and population operators over embeddings and orders, with their SQL.

An order's vector is the embedding of id o_orderkey modulo the number of embeddings. Status F is the adverse outcome, O the favourable one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import vectors as V
from eventloom.operators import population as P
from eventloom.operators import similarity as M
from eventloom.session import stored

D = 64


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def emb(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


def ids(s: SparkSession, d: str) -> DataFrame:
    return emb(s, d).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("kind"), "embedding")


def vis(s: SparkSession, d: str) -> DataFrame:
    """Orders with vectors. The count is a scalar aggregate that Spark joins as one row."""
    e = emb(s, d)
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    o = read(s, d, "orders").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("o_orderkey") % F.col("_n")).drop("_n")
    return o.join(e, "vec_id")


def tra(s: SparkSession, d: str) -> DataFrame:
    return P.with_deltas(moves(s, d), read(s, d, "embeddings"), "vec_id")


def moves(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    o = read(s, d, "orders").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("o_orderkey") % F.col("_n")).drop("_n")
    return P.moves(o, e, "vec_id", "o_custkey", ["o_orderdate", "o_orderkey"])


def r(c, places: int = 6):
    return F.round(c, places)


def half_up(c, places: int):
    """Rounded by the binary value (times a power of ten, then half away from zero); Spark's own round goes by the decimal text of the number."""
    by = 10.0**places
    return F.signum(c) * F.floor(F.abs(c * by) + 0.5) / by + 0.0


N = "(SELECT count(*) FROM embeddings)"
EMB = "emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
VIS = f"vis AS (SELECT o.*, e.vec_id, e.label, e.embedding::DOUBLE[] AS v FROM orders o JOIN embeddings e ON e.vec_id = o.o_orderkey % {N})"
MINUS = "list_transform(range(1, 65), lambda i: {a}[i] - {b}[i])"
TRA = f"{VIS}, tr0 AS (SELECT *, row_number() OVER w AS visit, lag(v) OVER w AS before FROM vis WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), tra AS (SELECT *, {MINUS.format(a='v', b='before')} AS delta FROM tr0 WHERE before IS NOT NULL)"


def cent(to: str, source: str, by: str = "", vec: str = "v", where: str = "") -> str:
    """CTE with the mean vector c (and n) of each group."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    inner = f"SELECT {keys}unnest({vec}) AS x, generate_subscripts({vec}, 1) AS dim FROM {source} {('WHERE ' + where) if where else ''}"
    return f"{to} AS (SELECT {keys}list(m ORDER BY dim) AS c, max(k) AS n FROM (SELECT {keys}dim, avg(x) AS m, count(*) AS k FROM ({inner}) GROUP BY {keys}dim) {group})"


def entities(s: SparkSession, d: str) -> DataFrame:
    e = emb(s, d)
    return e.select(F.floor(F.col("vec_id") / 2).alias("entity_id"), F.when(F.col("vec_id") % 2 == 0, "text").otherwise("image").alias("modality"), "embedding", F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("category"))


def with_axis(s: SparkSession, d: str, source: DataFrame, flag: str = "label") -> DataFrame:
    """Rows with the centroids of class 0 (adverse) and 1 (favourable) and the axis between them."""
    two = P.centroids(emb(s, d).where("label in (0, 1)"), D, "label")
    of = lambda k: F.max(F.when(F.col("label") == k, F.col("centroid")))
    return source.crossJoin(F.broadcast(two.agg(of(0).alias("bad"), of(1).alias("good")))).withColumn("axis", V.sub("bad", "good"))


AXIS = f"{EMB}, {cent('bad', 'emb', where='label = 0')}, {cent('good', 'emb', where='label = 1')}, ax AS (SELECT bad.c AS bad, good.c AS good, {MINUS.format(a='bad.c', b='good.c')} AS axis FROM bad, good)"


def d12(s, d):
    return M.threshold_join(ids(s, d), 0.4).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), r("similarity", 4).alias("similarity"))


def d13(s, d):
    seed = list(emb(s, d).where("vec_id = 0").first()["embedding"])
    return M.evolve_search(ids(s, d), seed).hits


def d14(s, d):
    e = emb(s, d)
    seed = list(e.where("vec_id = 0").first()["embedding"])
    got = M.evolve_query(seed, e.where("label = 0").withColumn("score", F.lit(1.0) + F.col("vec_id") % 3))
    return s.createDataFrame([(i, round(x, 6)) for i, x in enumerate(got)], "dim int, val double")


def e05(s, d):
    cents = stored(P.centroids(emb(s, d), D, "label"), "centroids")
    between = P.centroid_pairs(cents, D, "label").agg(F.avg("distance").alias("between"))
    return P.coherence(emb(s, d), D, "label", cents=cents).crossJoin(F.broadcast(between)).select("label", "n", r("intra").alias("intra"), r("between").alias("between"))


def e07(s, d):
    new = ids(s, d).withColumn("embedding", F.when(F.col("kind") < "5", V.scale("embedding", 1.01)).otherwise(F.col("embedding")))
    return P.drift(ids(s, d), new, D).select(r("most").alias("most"), r("mean").alias("mean"), r("median").alias("median"), "moved")


def e10(s, d):
    t = tra(s, d)
    adverse = P.mean_of(t, D, F.col("o_orderstatus") == "F", "delta", "adverse")
    got = t.crossJoin(F.broadcast(adverse)).select("o_orderkey", r(V.cosine("delta", "adverse", D)).alias("cosine")).where("cosine > 0")
    return P.top(got, 20, "cosine", "o_orderkey")


def e12(s, d):
    """Customers' visits are counted before the vectors are joined; the means of few priorities are broadcast."""
    m = moves(s, d).withColumn("visits", F.max("visit").over(Window.partitionBy("o_custkey")))
    t = P.with_deltas(m.where("visits >= 3"), read(s, d, "embeddings"), "vec_id").select("o_orderkey", "o_orderpriority", "delta")
    mean = P.few(P.centroids(tra(s, d), D, "o_orderpriority", vector="delta", least=5).select("o_orderpriority", "centroid"))
    got = t.join(mean, "o_orderpriority").select("o_orderkey", r(V.cosine("delta", "centroid", D)).alias("cosine"))
    return P.top(got, 20, "cosine", "o_orderkey", descending=False)


def e13(s, d):
    g = P.gravity(vis(s, d), D, "o_orderpriority")
    return with_axis(s, d, g).select("o_orderpriority", "n", r("length").alias("length"), r(V.cosine("pull", "axis", D)).alias("risk"))


def returns(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = vis(s, d).withColumn("_next", F.lead("o_orderdate").over(w))
    return v.withColumn("returns", F.coalesce(F.date_diff(F.to_date("_next"), F.to_date("o_orderdate")).between(1, 30), F.lit(False)).cast("int"))


RET = f"{VIS}, ret AS (SELECT *, coalesce(date_diff('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) BETWEEN 1 AND 30, false)::INTEGER AS returns FROM vis)"


def e14(s, d):
    g = P.mean_of(vis(s, d), D, name="g")
    return returns(s, d).crossJoin(F.broadcast(g)).groupBy("returns").agg(F.count(F.lit(1)).alias("n"), r(F.avg(V.euclidean("embedding", "g", D))).alias("distance"))


def e15(s, d):
    e = emb(s, d)
    c = P.mean_of(e, D, F.col("label") == 0, name="o").crossJoin(P.mean_of(e, D, F.col("label") == 1, name="t"))
    moved = e.where("label = 0").crossJoin(F.broadcast(c)).select(F.col("vec_id").alias("id"), P.counterfactual("embedding", "o", "t").alias("embedding"))
    got = M.nearest(moved, ids(s, d).select("id", "embedding"), 1)
    return got.select(F.col("query").alias("vec_id"), "neighbour", r("similarity", 5).alias("similarity"))


def e16(s, d):
    near = M.nearest(ids(s, d), ids(s, d), 5)
    labels = emb(s, d).select(F.col("vec_id").alias("neighbour"), "label")
    return near.join(labels, "neighbour").groupBy(F.col("query").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), r(F.avg((F.col("label") == 0).cast("double"))).alias("adverse"))


def kmeans(df: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_f", array_to_vector(F.col(vector)))
    return KMeans(k=k, seed=42, featuresCol="_f", predictionCol="cluster").fit(x).transform(x).drop("_f")


def e17(s, d):
    m = stored(moves(s, d).select("vec_id", "before_id", "o_orderstatus"), "moves")
    t = P.with_deltas(m, read(s, d, "embeddings"), "vec_id").select("o_orderstatus", "delta")
    k = max(2, min(10, m.count() // 10))
    c = kmeans(t, k, "delta").withColumn("speed", V.norm("delta", D))
    share = F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.mode("o_orderstatus").alias("dominant"), F.avg("speed").alias("speed"), F.stddev_pop("speed").alias("spread"), share.alias("has_adverse"))


def e18(s, d):
    e = emb(s, d)
    n = e.count()
    return kmeans(e, 10 if n >= 5000 else max(2, min(10, n // 5))).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.mode("label").alias("label"))


def e19(s, d):
    g = vis(s, d).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.avg("o_totalprice").alias("cost"))
    name = F.concat(F.when(F.col("cost") > 250000, "costly").otherwise("ordinary"), F.lit(" / "), F.when(F.col("rate") > 0.33, "adverse").otherwise("calm"))
    light = F.when(F.col("rate") > 0.34, "red").when(F.col("rate") > 0.32, "yellow").otherwise("green")
    return g.select("o_orderpriority", "n", name.alias("name"), light.alias("light"))


def prox(s, d):
    """Embeddings with cosine to the adverse centroid and the projection on the axis."""
    return with_axis(s, d, emb(s, d)).select("vec_id", "label", "embedding", V.cosine("embedding", "bad", D).alias("proximity"), V.dot("embedding", "axis", D).alias("projection"))


PROX = f"{AXIS}, prox AS (SELECT vec_id, label, v, list_cosine_similarity(v, bad) AS proximity, list_inner_product(v, axis) AS projection FROM emb, ax)"


def vprox(s, d):
    return vis(s, d).drop("embedding", "label").join(prox(s, d).select("vec_id", "proximity"), "vec_id")


VPROX = f"{PROX}, {VIS}, vp AS (SELECT vis.*, prox.proximity FROM vis JOIN prox ON vis.vec_id = prox.vec_id)"


def e22(s, d):
    t = with_axis(s, d, tra(s, d)).select("o_custkey", "o_orderkey", V.norm("delta", D).alias("speed"), V.cosine("delta", "axis", D).alias("direction"))
    risk = t.withColumn("risk", r(F.col("speed") * F.greatest(F.col("direction"), F.lit(0.0))))
    one = risk.withColumn("_p", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("risk"), "o_orderkey"))).where("_p = 1")
    return P.top(one.select("o_custkey", "o_orderkey", "risk"), 50, "risk", "o_custkey")


def e23(s, d):
    v = vis(s, d)
    period = lambda a, b: (F.col("o_orderdate") < F.lit(b).cast("timestamp_ntz")) & (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS") >= F.lit(a).cast("timestamp_ntz"))
    a, b = P.centroids(v.where(period("1997-01-01", "1997-02-01")), D, "o_orderpriority", least=5), P.centroids(v.where(period("1998-01-01", "1998-02-01")), D, "o_orderpriority", least=5)
    return a.select("o_orderpriority", F.col("centroid").alias("ca")).join(b.select("o_orderpriority", F.col("centroid").alias("cb")), "o_orderpriority").select("o_orderpriority", r(V.euclidean("ca", "cb", D)).alias("drift"))


def e24(s, d):
    v = vprox(s, d).join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    whole = v.agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.avg("proximity").alias("mean"))
    g = v.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("observed"), F.avg("proximity").alias("risk")).where("n >= 5")
    return g.crossJoin(F.broadcast(whole)).select("c_nationkey", "n", r(F.col("observed"), 5).alias("observed"), r(F.col("observed") / (F.col("rate") * (1 + F.col("risk") - F.col("mean"))), 5).alias("ratio"))


def e26(s, d, two: bool = False):
    v = vprox(s, d).groupBy("o_custkey").agg(F.avg("proximity").alias("p"), F.count(F.lit(1)).alias("n"), (F.date_diff(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate"))) / F.lit(30.0)).alias("los"), (F.max("proximity") / 10).alias("risk"))
    if two:
        return v.select("o_custkey", r(0.5 * F.least(F.col("p") / 0.5, F.lit(1.0)) + 0.5 * F.least(F.col("los") / 60, F.lit(1.0)), 5).alias("score"))
    why = P.reasons((F.col("p") > 0.1, "close to adverse outcomes"), (F.col("los") > 40, "long"), (F.col("n") >= 10, "frequent"))
    return v.select("o_custkey", r(P.priority(F.col("p"), F.col("los"), F.col("risk"), F.col("n")), 5).alias("score"), why.alias("why"))


def e28(s, d):
    g = P.centroids(vis(s, d), D, "o_orderpriority")
    return with_axis(s, d, g).select("o_orderpriority", r(V.cosine("centroid", "bad", D), 5).alias("to_bad"), r(V.cosine("centroid", "good", D), 5).alias("to_good"), r(V.dot("centroid", "axis", D)).alias("projection"))


def e29(s, d):
    w = Window.partitionBy("o_custkey")
    v = vprox(s, d).withColumn("visit", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")))
    cut = prox(s, d).agg(F.percentile("proximity", F.lit(0.75)).alias("p75"))
    g = v.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("proximity", "visit").alias("slope"), F.max_by("proximity", "visit").alias("last")).where("n BETWEEN 5 AND 30")
    got = g.crossJoin(F.broadcast(cut)).where("slope > 0 AND last > p75").select("o_custkey", "n", r("slope").alias("slope"))
    return P.top(got, 30, "slope", "o_custkey")


def e30(s, d):
    lines = read(s, d, "lineitem").join(read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.col("l_orderkey").alias("o_orderkey")).distinct()
    v = lines.join(vis(s, d).select("o_orderkey", "embedding"), "o_orderkey")
    g = P.centroids(v, D, "p_brand", least=10)
    return with_axis(s, d, g).select("p_brand", "n", r(V.cosine("centroid", "axis", D), 4).alias("risk"))


def e31(s, d):
    node = F.concat(F.lit("src"), F.col("label") % 3, F.lit("/ID_CD_VECTOR_"), F.col("vec_id"))
    nodes = emb(s, d).select(node.alias("node")).union(read(s, d, "orders").select(F.concat(F.lit("shop/ID_CD_ORDER_"), F.col("o_orderkey"))))
    return nodes.groupBy(F.regexp_extract("node", r"/(ID_CD_\w+?)_\d+", 1).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def e33(s, d):
    e = emb(s, d)
    two = P.mean_of(e, D, F.col("label") == 2, name="x").crossJoin(P.mean_of(e, D, F.col("label") == 3, name="y"))
    return with_axis(s, d, two).select(r(V.dot(V.sub("x", "y"), "axis") / V.norm("axis")).alias("projection"))


def e36(s, d):
    e = emb(s, d)
    pair = P.centroid_pairs(P.centroids(e, D, "label"), D, "label")
    intra = P.coherence(e, D, "label", 1).select("label", "intra")
    got = pair.join(intra.toDF("a", "ia"), "a").join(intra.toDF("b", "ib"), "b")
    return got.select("a", "b", r(F.col("distance") / ((F.col("ia") + F.col("ib")) / 2)).alias("separation"), r(1 - F.col("cosine"), 5).alias("cosine_distance"))


def effects(s, d):
    v = vis(s, d).join(read(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pair = P.centroids(v, D, "c_nationkey", "o_orderpriority", least=10).withColumnRenamed("centroid", "pc")
    cluster = P.centroids(v, D, "o_orderpriority").select("o_orderpriority", F.col("centroid").alias("cc"))
    return pair.join(cluster, "o_orderpriority").withColumn("effect", V.sub("pc", "cc"))


def e37(s, d):
    return with_axis(s, d, effects(s, d)).select("c_nationkey", "o_orderpriority", "n", r(V.norm("effect", D)).alias("length"), r(V.cosine("effect", "axis", D), 5).alias("risk"))


def ship(s, d):
    return read(s, d, "orders").join(read(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))


def e39(s, d):
    a = ship(s, d).groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    w = Window.partitionBy("c_mktsegment")
    got = a.withColumn("mean", F.sum(F.col("m") * F.col("n")).over(w) / F.sum("n").over(w)).withColumn("actors", F.count(F.lit(1)).over(w)).where("actors >= 3")
    up, down = w.orderBy(F.desc("m"), "c_nationkey"), w.orderBy("m", "c_nationkey")
    got = got.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).where("up <= 3 or down <= 3")
    return got.select("c_mktsegment", "c_nationkey", r("m", 2).alias("m"), r("mean", 2).alias("mean"), F.col("up").cast("int").alias("up"), F.col("down").cast("int").alias("down"))


def e40(s, d):
    m = effects(s, d).withColumn("length", V.norm("effect", D)).groupBy("o_orderpriority").agg(F.avg("length").alias("length"))
    span = read(s, d, "orders").groupBy("o_orderpriority").agg((F.max("o_totalprice") - F.min("o_totalprice")).alias("span"))
    return P.top(m.join(span, "o_orderpriority").select("o_orderpriority", r(F.col("length") * F.col("span"), 3).alias("score")), 10, "score", "o_orderpriority")


def e41(s, d):
    e = emb(s, d)
    two = P.mean_of(e, D, F.col("label") == 1, name="x").crossJoin(P.mean_of(e, D, F.col("label") == 0, name="y"))
    return P.top(V.long_form(two.select(F.transform(V.sub("x", "y"), lambda v: F.abs(v)).alias("g")), "g"), 10, "val", "dim")


def e43(s, d):
    e = read(s, d, "events").withColumn("t", V.seconds("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    week = 7 * 86400.0
    parts = [F.when(F.lead("t", k).over(w).isNotNull(), F.exp(-F.log(F.lit(2.0)) * (F.lead("t", k).over(w) - F.col("t")) / week)) for k in range(1, 6)]
    got = e.select("event_id", F.array_compact(F.array(*parts)).alias("x"))
    return got.select("event_id", r(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("weight"))


def e46(s, d):
    e = emb(s, d)
    c = P.centroids(e, D, "label").select("label", F.col("centroid").alias("own"))
    target = P.mean_of(e, D, F.col("label") == 1, name="t").select("t")
    worst = P.top(P.distances(e, D, "label"), 1, "distance", "vec_id", "label").where("label <> 1")
    moved = worst.join(c, "label").crossJoin(F.broadcast(target)).select(F.col("vec_id").alias("id"), P.counterfactual("embedding", "own", "t").alias("embedding"))
    near = M.nearest(moved, ids(s, d).select("id", "embedding"), 20).join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    return near.groupBy(F.col("query").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), r(F.avg((F.col("label") == 1).cast("double"))).alias("favourable"), F.median("label").alias("median_label"))


def e47(s, d):
    means = ship(s, d).groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    med = means.groupBy("c_mktsegment").agg(F.median("m").alias("med"), F.count(F.lit(1)).alias("actors")).where("actors >= 3")
    over = means.join(med, "c_mktsegment").where("m > med").groupBy("c_mktsegment").agg(r(F.sum((F.col("m") - F.col("med")) * F.col("n")), 2).alias("excess"))
    return P.top(over, 10, "excess", "c_mktsegment")


def e48(s, d):
    n = emb(s, d).count()
    return kmeans(emb(s, d), min(8, n)).select("vec_id", "cluster")


def case_frame(s, d):
    a = P.anomalies(emb(s, d), D, "label").select("vec_id", "z")
    v = read(s, d, "orders").crossJoin(F.broadcast(emb(s, d).agg(F.count(F.lit(1)).alias("_n")))).withColumn("vec_id", F.col("o_orderkey") % F.col("_n"))
    base = read(s, d, "orders").agg(F.avg("o_totalprice").alias("base"))
    return v.join(a, "vec_id").crossJoin(F.broadcast(base))


CASES = f"""{EMB}, {cent('cl', 'emb', 'label')}, di AS (SELECT vec_id, e.label, list_distance(v, c) AS dist FROM emb e JOIN cl ON e.label = cl.label),
zz AS (SELECT vec_id, label, dist, (dist - avg(dist) OVER p) / greatest(stddev_pop(dist) OVER p, 1e-8) AS z FROM di WINDOW p AS (PARTITION BY label)),
cases AS (SELECT o.*, z, (SELECT avg(o_totalprice) FROM orders) AS base FROM orders o JOIN zz ON zz.vec_id = o.o_orderkey % {N})"""


def e50(s, d):
    c = case_frame(s, d)
    level = F.when((F.col("z") >= 2.5) | (F.col("o_totalprice") >= 480000) | (F.col("o_orderstatus") == "F") & (F.col("z") >= 2), "critical").when(F.col("z") >= 1.5, "high").otherwise("moderate")
    return c.select("o_orderkey", level.alias("severity"), F.when(F.col("base") == 0, "N/A").otherwise(F.concat(F.floor(100 * (F.col("o_totalprice") / F.col("base") - 1)).cast("string"), F.lit("%"))).alias("relative"))


def e51(s, d):
    c = case_frame(s, d)
    first = F.when(F.col("o_totalprice") > 1.8 * F.col("base"), "bill far above the mean").when(F.col("o_totalprice") > 1.5 * F.col("base"), "bill above the mean").when(F.col("z") > 2, "unlike its group").otherwise("no single reason")
    return c.select("o_orderkey", F.concat_ws("; ", first, F.when(F.col("o_orderstatus") == "P", "open"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")).alias("why"))


def e52(s, d):
    c = case_frame(s, d)
    advice = P.reasons((F.col("o_totalprice") > 1.8 * F.col("base"), "audit the bill"), (F.col("z") > 2, "review the case"), ((F.col("o_orderstatus") == "P") & (F.col("z") > 1), "follow up"))
    return c.select("o_orderkey", F.when(advice == "", "no action").otherwise(advice).alias("advice"))


def e53(s, d):
    near = M.nearest(ids(s, d), ids(s, d), 3).select("query", "neighbour", "place")
    bill = vis(s, d).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("o_totalprice"), 2).alias("bill"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("open"))
    return near.join(bill, F.col("neighbour") == F.col("vec_id"), "left").select("query", "neighbour", F.col("place").cast("int").alias("place"), "n", "bill", "open")


def knn_out(df, *more):
    return df.select(F.col("query").alias("vec_id"), "neighbour", r("similarity", 5).alias("similarity"), F.col("place").cast("int").alias("place"), *more)


def knn_sql(k: int, cond: str = "true") -> str:
    return f"""WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {cond}),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 10) DESC, neighbour)::INTEGER AS place FROM s) SELECT vec_id, neighbour, round(sim, 5) AS similarity, place FROM k WHERE place <= {k}"""


QUERIES = {
    "d01_cosine": lambda s, d: M.kind_pairs(ids(s, d), places=5).toDF("id_a", "id_b", "cosine"),
    "d02_all_pairs": lambda s, d: M.all_pairs(ids(s, d), ids(s, d), places=5).toDF("id_a", "id_b", "similarity"),
    "d03_relationships": lambda s, d: M.relationships(entities(s, d), 0.25).select("entity_id", "related_entity_id", r("similarity", 5).alias("similarity")),
    "d07_nearest_same_type": lambda s, d: knn_out(M.nearest(ids(s, d), ids(s, d), 10, kind="kind", same_kind=True)),
    "d08_nearest_cross_type": lambda s, d: knn_out(M.nearest(ids(s, d), ids(s, d), 3, kind="kind", target="7")),
    "d09_nearest_by_id": lambda s, d: M.by_id(ids(s, d), 3, 10, kind="kind").select("id", r("similarity", 4).alias("similarity")),
    "d10_nearest_by_vector": lambda s, d: M.by_vector(ids(s, d), [1.0] + [0.0] * 63, 10).select("id", r("similarity", 4).alias("similarity")),
    "d11_batch_nearest": lambda s, d: knn_out(M.nearest(ids(s, d), ids(s, d), 5)),
    "d12_threshold_join": d12,
    "d13_evolutionary_search": d13,
    "d14_query_evolution": d14,
    "d15_vector_helpers": lambda s, d: emb(s, d).select("vec_id", r(V.norm("embedding", D)).alias("length"), r(V.dot("embedding", V.unit("embedding", d=D), D)).alias("own"), r(V.euclidean("embedding", V.scale("embedding", 2.0), D)).alias("away")),
    "e01_centroid_distance": lambda s, d: P.top(P.distances(emb(s, d), D, "label").select("label", "vec_id", r("distance").alias("distance")), 20, "distance", "vec_id", "label").withColumn("place", F.col("place").cast("int")),
    "e02_zscore": lambda s, d: P.anomalies(emb(s, d), D, "label").select("vec_id", r("z", 5).alias("z")),
    "e03_anomalies_of_type": lambda s, d: P.top(P.anomalies(emb(s, d).where("label = 3"), D, "label").select("vec_id", r("z", 2).alias("z"), r("distance", 4).alias("distance"), r(F.avg("distance").over(Window.partitionBy("label")), 4).alias("mean"), r(F.stddev_pop("distance").over(Window.partitionBy("label")), 4).alias("std")), 10, "distance", "vec_id"),
    "e04_anomalies_over_threshold": lambda s, d: P.distances(emb(s, d).withColumn("all", F.lit(1)), D, "all").crossJoin(F.broadcast(P.distances(emb(s, d).withColumn("all", F.lit(1)), D, "all").agg(F.avg("distance").alias("mu"), F.stddev_pop("distance").alias("sd")))).select("vec_id", r((F.col("distance") - F.col("mu")) / (F.col("sd") + 1e-9), 4).alias("z")).where("z > 2"),
    "e05_coherence": e05,
    "e06_isotropy": lambda s, d: P.isotropy(emb(s, d), D).select(r("ratio").alias("ratio"), "effective"),
    "e07_drift": e07,
    "e08_group_dna": lambda s, d: P.dna(emb(s, d), D, "label").select("label", "n", r("similarity", 5).alias("similarity"), (F.col("similarity") == F.min("similarity").over(Window.partitionBy())).alias("most_unique")),
    "e09_trajectory_delta": lambda s, d: V.long_form(P.centroids(tra(s, d), D, "o_orderstatus", vector="delta"), "centroid", "o_orderstatus"),
    "e10_adverse_trajectories": e10,
    "e11_speed": lambda s, d: tra(s, d).withColumn("speed", V.norm("delta", D)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r(F.avg("speed")).alias("mean"), r(F.stddev_pop("speed")).alias("std")),
    "e11_fastest": lambda s, d: P.top(tra(s, d).select("o_orderkey", r(V.norm("delta", D)).alias("speed")), 20, "speed", "o_orderkey"),
    "e11_slowest": lambda s, d: P.top(tra(s, d).select("o_orderkey", r(V.norm("delta", D)).alias("speed")).where("speed > 1e-6"), 20, "speed", "o_orderkey", descending=False),
    "e12_anomalous_trajectories": e12,
    "e13_gravity": e13,
    "e14_return_displacement": e14,
    "e15_counterfactual": e15,
    "e16_knn_prognosis": e16,
    "e17_cluster_deltas": e17,
    "e18_cluster_entities": e18,
    "e19_cluster_names": e19,
    "e20_cluster_fallback": lambda s, d: kmeans(emb(s, d), min(12, emb(s, d).count())).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
    "e21_outcome_proximity": lambda s, d: prox(s, d).select("vec_id", r("proximity").alias("proximity"), r("projection").alias("projection")),
    "e22_trajectory_risk": e22,
    "e23_period_drift": e23,
    "e24_observed_expected": e24,
    "e25_percentiles": lambda s, d: prox(s, d).agg(F.percentile("proximity", F.array(*[F.lit(x) for x in (0.75, 0.9, 0.95, 0.99)])).alias("p")).select(*[r(F.col("p")[i]).alias(n) for i, n in enumerate(("p75", "p90", "p95", "p99"))]),
    "e26_priority": e26,
    "e27_priority_of_two": lambda s, d: e26(s, d, True),
    "e28_landscape": e28,
    "e29_chronic_slope": e29,
    "e30_product_landscape": e30,
    "e31_type_census": e31,
    "e32_type_stats": lambda s, d: prox(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[r(f("proximity")).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))]).where("n >= 3"),
    "e33_group_difference": e33,
    "e34_member_to_parent": lambda s, d: emb(s, d).join(P.centroids(emb(s, d), D, "label"), "label").select("vec_id", r(V.cosine("embedding", "centroid", D)).alias("cosine")),
    "e35_percentile_rank": lambda s, d: prox(s, d).agg(r(F.avg((F.col("proximity") < 0.1).cast("double"))).alias("below")),
    "e36_separability": e36,
    "e37_actor_effects": e37,
    "e38_variance_explained": lambda s, d: P.variance_explained(ship(s, d), "o_totalprice", "c_nationkey", "o_orderpriority").select("o_orderpriority", "actors", r("explained").alias("explained")),
    "e39_weighted_rollup": e39,
    "e40_top_clusters": e40,
    "e41_mean_gap": e41,
    "e43_lookahead": e43,
    "e44_covariance_penalty": lambda s, d: P.covariance_penalty(emb(s, d), D).select(r("penalty").alias("penalty")),
    "e45_signed_log": lambda s, d: read(s, d, "customer").select("c_custkey", r(P.signed_log(F.col("c_acctbal"))).alias("val"), r(P.signed_log(F.col("c_acctbal")) / 20).alias("scaled")),
    "e46_actor_counterfactual": e46,
    "e47_excess_over_median": e47,
    "e48_cluster_codes": e48,
    "e49_named_centroid": lambda s, d: V.long_form(P.centroids(emb(s, d).where("vec_id < 100").withColumn("all", F.lit(1)), D, "all", least=5).select(V.unit("centroid", 1e-9, D).alias("c")), "c"),
    "e50_severity": e50,
    "e51_explanation": e51,
    "e52_recommendation": e52,
    "e53_similar_details": e53,
    "e54_embedding_table": lambda s, d: emb(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"), F.min(F.size("embedding")).cast("int").alias("width")),
    "e55_single_scope_anomalies": lambda s, d: P.top(P.anomalies(emb(s, d).withColumn("scope", F.lit(1)), D, "scope").select("vec_id", r("z", 4).alias("z")), 20, "z", "vec_id"),
}

CL = f"{EMB}, {cent('cl', 'emb', 'label')}"
DI = f"{CL}, di AS (SELECT vec_id, e.label, list_distance(v, c) AS dist FROM emb e JOIN cl ON e.label = cl.label)"
ONE = f"{EMB}, {cent('c0', 'emb')}, di AS (SELECT vec_id, list_distance(v, c) AS dist FROM emb, c0)"
PAIR = "pr AS (SELECT a.label AS a, b.label AS b, list_cosine_similarity(a.c, b.c) AS cosine, list_distance(a.c, b.c) AS distance FROM cl a JOIN cl b ON a.label < b.label)"
SPEED = f"WITH {TRA}, sp AS (SELECT o_orderkey, o_orderstatus, list_distance(v, before) AS speed FROM tra)"
CUST = "JOIN customer ON o_custkey = c_custkey"
EFF = f"{VIS}, vc AS (SELECT * FROM vis {CUST}), {cent('pc', 'vc', 'c_nationkey, o_orderpriority')}, {cent('cc', 'vc', 'o_orderpriority')}, eff AS (SELECT pc.c_nationkey, pc.o_orderpriority, pc.n, {MINUS.format(a='pc.c', b='cc.c')} AS e FROM pc JOIN cc ON pc.o_orderpriority = cc.o_orderpriority WHERE pc.n >= 10)"
ZERO = "list_transform(range(64), lambda i: 0.0::DOUBLE)"
PRI = f"{VPROX}, g AS (SELECT o_custkey, avg(proximity) AS p, count(*) AS n, date_diff('day', min(o_orderdate), max(o_orderdate)) / 30.0::DOUBLE AS los, max(proximity) / 10 AS risk FROM vp GROUP BY 1)"

SQL = {
    "d01_cosine": "SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id",
    "d02_all_pairs": "SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a, embeddings b",
    "d03_relationships": """WITH e AS (SELECT vec_id // 2 AS entity_id, vec_id % 2 AS m, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 2 = 0 THEN label END AS cat FROM embeddings),
s AS (SELECT a.entity_id, b.entity_id AS related_entity_id, avg(list_cosine_similarity(a.v, b.v)) AS s, max(a.cat) AS ca, max(b.cat) AS cb FROM e a JOIN e b ON a.m = b.m AND a.entity_id <> b.entity_id GROUP BY 1, 2),
t AS (SELECT entity_id, related_entity_id, CASE WHEN ca = cb THEN least(1.0, s + 0.1) ELSE s END AS s FROM s) SELECT entity_id, related_entity_id, round(s, 5) AS similarity FROM t WHERE s >= 0.25""",
    "d07_nearest_same_type": knn_sql(10, "a.label = b.label"),
    "d08_nearest_cross_type": knn_sql(3, "b.label = 7"),
    "d09_nearest_by_id": "SELECT b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id = 3 AND b.vec_id <> 3 AND a.label = b.label ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 10",
    "d10_nearest_by_vector": "SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS similarity FROM embeddings ORDER BY embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) DESC, vec_id LIMIT 10",
    "d11_batch_nearest": knn_sql(5),
    "d12_threshold_join": "SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4",
    "d14_query_evolution": f"""WITH {EMB}, seed AS (SELECT list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS s FROM emb WHERE vec_id = 0),
f AS (SELECT 1.0 + vec_id % 3 AS w, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM emb WHERE label = 0),
l AS (SELECT dim, sum(w * x) / sum(w) AS x FROM (SELECT w::DOUBLE AS w, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM f) GROUP BY dim),
b AS (SELECT dim, 0.5::DOUBLE * s[dim] + 0.5::DOUBLE * x / (SELECT sqrt(sum(x * x)) FROM l) AS y FROM l, seed) SELECT (dim - 1)::INTEGER AS dim, round(y / (SELECT sqrt(sum(y * y)) FROM b), 6) AS val FROM b""",
    "d15_vector_helpers": f"WITH {EMB}, n AS (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM emb) SELECT vec_id, round(l, 6) AS length, round(l, 6) AS own, round(l, 6) AS away FROM n",
    "e01_centroid_distance": f"WITH {DI}, k AS (SELECT label, vec_id, round(dist, 6) AS distance, row_number() OVER (PARTITION BY label ORDER BY round(dist, 6) DESC, vec_id)::INTEGER AS place FROM di) SELECT * FROM k WHERE place <= 20",
    "e02_zscore": f"WITH {CASES} SELECT vec_id, round(z, 5) AS z FROM zz",
    "e03_anomalies_of_type": f"WITH {DI} SELECT vec_id, round((dist - avg(dist) OVER ()) / greatest(stddev_pop(dist) OVER (), 1e-8), 2) AS z, round(dist, 4) AS distance, round(avg(dist) OVER (), 4) AS mean, round(stddev_pop(dist) OVER (), 4) AS std FROM di WHERE label = 3 ORDER BY round(dist, 4) DESC, vec_id LIMIT 10",
    "e04_anomalies_over_threshold": f"WITH {ONE}, z AS (SELECT vec_id, round((dist - avg(dist) OVER ()) / (stddev_pop(dist) OVER () + 1e-9), 4) AS z FROM di) SELECT * FROM z WHERE z > 2",
    "e05_coherence": f"WITH {DI}, {PAIR} SELECT label, count(*) AS n, round(avg(dist), 6) AS intra, (SELECT round(avg(distance), 6) FROM pr) AS between FROM di GROUP BY label HAVING count(*) >= 10",
    "e06_isotropy": f"WITH {EMB}, l AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM emb), w AS (SELECT var_pop(x) AS w FROM l GROUP BY dim) SELECT round(min(w) / max(w), 6) AS ratio, (count(*) FILTER (w > 0.01 * (SELECT max(w) FROM w)))::INTEGER AS effective FROM w",
    "e07_drift": f"WITH {EMB}, l AS (SELECT vec_id, abs(x * CASE WHEN label < 5 THEN 1.01 ELSE 1.0 END - x) AS c FROM (SELECT vec_id, label, unnest(v) AS x FROM emb)) SELECT round(max(c), 6) AS most, round(avg(c), 6) AS mean, round(median(c), 6) AS median, (SELECT count(*) FROM (SELECT vec_id FROM l GROUP BY 1 HAVING max(c) > 1e-6)) AS moved FROM l",
    "e08_group_dna": f"WITH {CL}, s AS (SELECT a.label, max(a.n) AS n, avg(list_cosine_similarity(a.c, b.c)) AS s FROM cl a JOIN cl b ON a.label <> b.label GROUP BY 1) SELECT label, n, round(s, 5) AS similarity, s = min(s) OVER () AS most_unique FROM s",
    "e09_trajectory_delta": f"WITH {TRA}, {cent('m', 'tra', 'o_orderstatus', 'delta')} SELECT o_orderstatus, (generate_subscripts(c, 1) - 1)::INTEGER AS dim, round(unnest(c), 6) AS val FROM m",
    "e10_adverse_trajectories": f"""WITH {TRA}, {cent('m', 'tra', '', 'delta', "o_orderstatus = 'F'")}, k AS (SELECT o_orderkey, round(CASE WHEN list_distance(delta, {ZERO}) > 0 THEN list_cosine_similarity(delta, c) ELSE 0 END, 6) AS cosine FROM tra, m) SELECT * FROM k WHERE cosine > 0 ORDER BY cosine DESC, o_orderkey LIMIT 20""",
    "e11_speed": f"{SPEED} SELECT o_orderstatus, count(*) AS n, round(avg(speed), 6) AS mean, round(stddev_pop(speed), 6) AS std FROM sp GROUP BY 1",
    "e11_fastest": f"{SPEED} SELECT o_orderkey, round(speed, 6) AS speed FROM sp ORDER BY 2 DESC, 1 LIMIT 20",
    "e11_slowest": f"{SPEED} SELECT o_orderkey, round(speed, 6) AS speed FROM sp WHERE round(speed, 6) > 1e-6 ORDER BY 2, 1 LIMIT 20",
    "e12_anomalous_trajectories": f"WITH {TRA}, {cent('m', 'tra', 'o_orderpriority', 'delta')}, t AS (SELECT *, max(visit) OVER (PARTITION BY o_custkey) AS visits FROM tra), k AS (SELECT o_orderkey, round(CASE WHEN list_distance(delta, {ZERO}) > 0 THEN list_cosine_similarity(delta, c) ELSE 0 END, 6) AS cosine FROM t JOIN m ON t.o_orderpriority = m.o_orderpriority WHERE visits >= 3 AND m.n >= 5) SELECT * FROM k ORDER BY cosine, o_orderkey LIMIT 20",
    "e13_gravity": f"WITH {AXIS}, {VIS}, {cent('m', 'vis', 'o_orderpriority')}, {cent('g', 'vis')}, q AS (SELECT o_orderpriority, m.n, {MINUS.format(a='m.c', b='g.c')} AS q FROM m, g) SELECT o_orderpriority, n, round(list_distance(q, {ZERO}), 6) AS length, round(list_cosine_similarity(q, axis), 6) AS risk FROM q, ax",
    "e14_return_displacement": f"WITH {RET}, {cent('g', 'vis')} SELECT returns, count(*) AS n, round(avg(list_distance(v, c)), 6) AS distance FROM ret, g GROUP BY 1",
    "e15_counterfactual": f"WITH {CL}, m AS (SELECT vec_id, list_transform(range(1, 65), lambda i: v[i] - o.c[i] + t.c[i]) AS q FROM emb, (SELECT c FROM cl WHERE label = 0) o, (SELECT c FROM cl WHERE label = 1) t WHERE label = 0), s AS (SELECT m.vec_id, e.vec_id AS neighbour, list_cosine_similarity(q, v) AS sim FROM m JOIN emb e ON m.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 10) DESC, neighbour) AS p FROM s) SELECT vec_id, neighbour, round(sim, 5) AS similarity FROM k WHERE p = 1",
    "e16_knn_prognosis": f"WITH k AS ({knn_sql(5)}) SELECT k.vec_id, count(*) AS n, round(avg(CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS adverse FROM k JOIN embeddings e ON k.neighbour = e.vec_id GROUP BY 1",
    "e19_cluster_names": "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) AS rate, avg(o_totalprice) AS cost FROM orders GROUP BY 1) SELECT o_orderpriority, n, CASE WHEN cost > 250000 THEN 'costly' ELSE 'ordinary' END || ' / ' || CASE WHEN rate > 0.33 THEN 'adverse' ELSE 'calm' END AS name, CASE WHEN rate > 0.34 THEN 'red' WHEN rate > 0.32 THEN 'yellow' ELSE 'green' END AS light FROM g",
    "e21_outcome_proximity": f"WITH {PROX} SELECT vec_id, round(proximity, 6) AS proximity, round(projection, 6) AS projection FROM prox",
    "e22_trajectory_risk": f"WITH {AXIS}, {TRA}, k AS (SELECT o_custkey, o_orderkey, round(list_distance(v, before) * greatest(CASE WHEN list_distance(v, before) > 0 THEN list_cosine_similarity(delta, axis) ELSE 0 END, 0.0), 6) AS risk FROM tra, ax), o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY risk DESC, o_orderkey) AS p FROM k) SELECT o_custkey, o_orderkey, risk FROM o WHERE p = 1 ORDER BY risk DESC, o_custkey LIMIT 50",
    "e23_period_drift": f"""WITH {VIS}, {cent('a', 'vis', 'o_orderpriority', where="o_orderdate < TIMESTAMP '1997-02-01' AND o_orderdate + INTERVAL 10 DAYS >= TIMESTAMP '1997-01-01'")}, {cent('b', 'vis', 'o_orderpriority', where="o_orderdate < TIMESTAMP '1998-02-01' AND o_orderdate + INTERVAL 10 DAYS >= TIMESTAMP '1998-01-01'")} SELECT a.o_orderpriority, round(list_distance(a.c, b.c), 6) AS drift FROM a JOIN b ON a.o_orderpriority = b.o_orderpriority WHERE a.n >= 5 AND b.n >= 5""",
    "e24_observed_expected": f"WITH {VPROX}, v AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS f FROM vp {CUST}), w AS (SELECT avg(f) AS rate, avg(proximity) AS mean FROM v), g AS (SELECT c_nationkey, count(*) AS n, avg(f) AS observed, avg(proximity) AS risk FROM v GROUP BY 1 HAVING count(*) >= 5) SELECT c_nationkey, n, round(observed, 5) AS observed, round(observed / (rate * (1 + risk - mean)), 5) AS ratio FROM g, w",
    "e25_percentiles": f"WITH {PROX} SELECT " + ", ".join(f"round(quantile_cont(proximity, {q}), 6) AS p{int(q * 100)}" for q in (0.75, 0.9, 0.95, 0.99)) + " FROM prox",
    "e26_priority": f"WITH {PRI} SELECT o_custkey, round(0.35 * least(p / 0.5, 1.0) + 0.30 * least(los / 60, 1.0) + 0.20 * least(risk / 0.05, 1.0) + 0.15 * least(n / 3, 1.0), 5) AS score, concat_ws('; ', CASE WHEN p > 0.1 THEN 'close to adverse outcomes' END, CASE WHEN los > 40 THEN 'long' END, CASE WHEN n >= 10 THEN 'frequent' END) AS why FROM g",
    "e27_priority_of_two": f"WITH {PRI} SELECT o_custkey, round(0.5::DOUBLE * least(p / 0.5, 1.0) + 0.5::DOUBLE * least(los / 60, 1.0), 5) AS score FROM g",
    "e28_landscape": f"WITH {AXIS}, {VIS}, {cent('m', 'vis', 'o_orderpriority')} SELECT o_orderpriority, round(list_cosine_similarity(c, bad), 5) AS to_bad, round(list_cosine_similarity(c, good), 5) AS to_good, round(list_inner_product(c, axis), 6) AS projection FROM m, ax",
    "e29_chronic_slope": f"WITH {VPROX}, w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit FROM vp), g AS (SELECT o_custkey, count(*) AS n, regr_slope(proximity, visit) AS slope, max_by(proximity, visit) AS last FROM w GROUP BY 1 HAVING count(*) BETWEEN 5 AND 30) SELECT o_custkey, n, round(slope, 6) AS slope FROM g WHERE slope > 0 AND last > (SELECT quantile_cont(proximity, 0.75) FROM prox) ORDER BY 3 DESC, 1 LIMIT 30",
    "e30_product_landscape": f"WITH {AXIS}, {VIS}, li AS (SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey), lv AS (SELECT p_brand, v FROM li JOIN vis ON l_orderkey = o_orderkey), {cent('m', 'lv', 'p_brand')} SELECT p_brand, n, round(list_cosine_similarity(c, axis), 4) AS risk FROM m, ax WHERE n >= 10",
    "e31_type_census": "WITH n AS (SELECT 'src' || (label % 3) || '/ID_CD_VECTOR_' || vec_id AS node FROM embeddings UNION ALL SELECT 'shop/ID_CD_ORDER_' || o_orderkey FROM orders) SELECT regexp_extract(node, '/(ID_CD_\\w+?)_\\d+', 1) AS type, count(*) AS n FROM n GROUP BY 1",
    "e32_type_stats": f"WITH {PROX} SELECT label, count(*) AS n, round(avg(proximity), 6) AS mean, round(stddev_pop(proximity), 6) AS std, round(min(proximity), 6) AS low, round(max(proximity), 6) AS high FROM prox GROUP BY 1 HAVING count(*) >= 3",
    "e33_group_difference": f"WITH {AXIS}, {cent('x', 'emb', where='label = 2')}, {cent('y', 'emb', where='label = 3')} SELECT round((list_inner_product(x.c, axis) - list_inner_product(y.c, axis)) / sqrt(list_inner_product(axis, axis)), 6) AS projection FROM x, y, ax",
    "e34_member_to_parent": f"WITH {CL} SELECT vec_id, round(list_cosine_similarity(v, c), 6) AS cosine FROM emb e JOIN cl ON e.label = cl.label",
    "e35_percentile_rank": f"WITH {PROX} SELECT round(avg(CASE WHEN proximity < 0.1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS below FROM prox",
    "e36_separability": f"WITH {DI}, {PAIR}, i AS (SELECT label, avg(dist) AS intra FROM di GROUP BY 1) SELECT a, b, round(distance / ((x.intra + y.intra) / 2), 6) AS separation, round(1 - cosine, 5) AS cosine_distance FROM pr JOIN i x ON a = x.label JOIN i y ON b = y.label",
    "e37_actor_effects": f"WITH {AXIS}, {EFF} SELECT c_nationkey, o_orderpriority, n, round(list_distance(e, {ZERO}), 6) AS length, round(list_cosine_similarity(e, axis), 5) AS risk FROM eff, ax",
    "e38_variance_explained": f"WITH m AS (SELECT o_orderpriority, c_nationkey, count(*) AS n, avg(o_totalprice) AS m FROM orders {CUST} GROUP BY 1, 2), c AS (SELECT *, sum(n * m) OVER p / sum(n) OVER p AS c, (SELECT avg(o_totalprice) FROM orders {CUST}) AS g FROM m WINDOW p AS (PARTITION BY o_orderpriority)) SELECT o_orderpriority, count(*) AS actors, round(100 * sum(n * pow(m - c, 2)) / sum(n * pow(m - g, 2)), 6) AS explained FROM c GROUP BY 1 HAVING count(*) >= 2",
    "e39_weighted_rollup": f"WITH a AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(o_totalprice) AS m FROM orders {CUST} GROUP BY 1, 2), b AS (SELECT *, sum(m * n) OVER w / sum(n) OVER w AS mean, count(*) OVER w AS actors, row_number() OVER (PARTITION BY c_mktsegment ORDER BY m DESC, c_nationkey)::INTEGER AS up, row_number() OVER (PARTITION BY c_mktsegment ORDER BY m, c_nationkey)::INTEGER AS down FROM a WINDOW w AS (PARTITION BY c_mktsegment)) SELECT c_mktsegment, c_nationkey, round(m, 2) AS m, round(mean, 2) AS mean, up, down FROM b WHERE actors >= 3 AND (up <= 3 OR down <= 3)",
    "e40_top_clusters": f"WITH {EFF}, m AS (SELECT o_orderpriority, avg(list_distance(e, {ZERO})) AS l FROM eff GROUP BY 1), s AS (SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS s FROM orders GROUP BY 1) SELECT m.o_orderpriority, round(l * s, 3) AS score FROM m JOIN s ON m.o_orderpriority = s.o_orderpriority ORDER BY 2 DESC, 1 LIMIT 10",
    "e41_mean_gap": f"WITH {AXIS} SELECT (i - 1)::INTEGER AS dim, round(abs(axis[i]), 6) AS val FROM ax, range(1, 65) r(i) ORDER BY 2 DESC, 1 LIMIT 10",
    "e43_lookahead": "WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events) SELECT event_id, round(" + " + ".join(f"coalesce(exp(-ln(2.0::DOUBLE) * (lead(t, {k}) OVER w - t) / 604800), 0)" for k in range(1, 6)) + ", 6) AS weight FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "e44_covariance_penalty": f"WITH {EMB}, l AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb), c AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY 1, 2) SELECT round(sum(c * c) / 64, 6) AS penalty FROM c",
    "e45_signed_log": "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS val, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)) / 20, 6) AS scaled FROM customer",
    "e46_actor_counterfactual": f"WITH {DI}, w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist DESC, vec_id) AS p FROM di WHERE label <> 1), m AS (SELECT w.vec_id, list_transform(range(1, 65), lambda i: e.v[i] - o.c[i] + t.c[i]) AS q FROM w JOIN emb e ON w.vec_id = e.vec_id JOIN cl o ON o.label = w.label, (SELECT c FROM cl WHERE label = 1) t WHERE p = 1), s AS (SELECT m.vec_id, e.vec_id AS nb, e.label, list_cosine_similarity(q, v) AS sim FROM m JOIN emb e ON m.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 10) DESC, nb) AS p FROM s) SELECT vec_id, count(*) AS n, round(avg(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS favourable, median(label) AS median_label FROM k WHERE p <= 20 GROUP BY 1",
    "e47_excess_over_median": f"WITH m AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(o_totalprice) AS m FROM orders {CUST} GROUP BY 1, 2), d AS (SELECT c_mktsegment, median(m) AS med FROM m GROUP BY 1 HAVING count(*) >= 3) SELECT m.c_mktsegment, round(sum((m - med) * n), 2) AS excess FROM m JOIN d ON m.c_mktsegment = d.c_mktsegment WHERE m > med GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "e49_named_centroid": f"WITH {EMB}, {cent('m', 'emb', where='vec_id < 100')} SELECT (i - 1)::INTEGER AS dim, round(c[i] / greatest(sqrt(list_inner_product(c, c)), 1e-9), 6) AS val FROM m, range(1, 65) r(i)",
    "e50_severity": f"WITH {CASES} SELECT o_orderkey, CASE WHEN z >= 2.5 OR o_totalprice >= 480000 OR (o_orderstatus = 'F' AND z >= 2) THEN 'critical' WHEN z >= 1.5 THEN 'high' ELSE 'moderate' END AS severity, floor(100 * (o_totalprice / base - 1))::BIGINT || '%' AS relative FROM cases",
    "e51_explanation": f"WITH {CASES} SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice > 1.8::DOUBLE * base THEN 'bill far above the mean' WHEN o_totalprice > 1.5::DOUBLE * base THEN 'bill above the mean' WHEN z > 2 THEN 'unlike its group' ELSE 'no single reason' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS why FROM cases",
    "e52_recommendation": f"WITH {CASES}, a AS (SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice > 1.8::DOUBLE * base THEN 'audit the bill' END, CASE WHEN z > 2 THEN 'review the case' END, CASE WHEN o_orderstatus = 'P' AND z > 1 THEN 'follow up' END) AS a FROM cases) SELECT o_orderkey, CASE WHEN a = '' THEN 'no action' ELSE a END AS advice FROM a",
    "e53_similar_details": f"WITH {VIS}, k AS ({knn_sql(3)}), b AS (SELECT vec_id, count(*) AS n, round(avg(o_totalprice), 2) AS bill, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS open FROM vis GROUP BY 1) SELECT k.vec_id AS query, neighbour, place, n, bill, open FROM k LEFT JOIN b ON neighbour = b.vec_id",
    "e54_embedding_table": "SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids, min(len(embedding))::INTEGER AS width FROM embeddings GROUP BY 1",
    "e55_single_scope_anomalies": f"WITH {ONE} SELECT vec_id, round((dist - avg(dist) OVER ()) / greatest(stddev_pop(dist) OVER (), 1e-8), 4) AS z FROM di ORDER BY 2 DESC, 1 LIMIT 20",
}
