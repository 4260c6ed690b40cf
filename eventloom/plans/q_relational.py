"""Queries of sources, joins, aggregates, windows, set operations and scalar functions, and of the stateful operators in batch form, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import vectors as V
from eventloom.plans import q_sequences as QS
from eventloom.plans.q_population import ids, r, read
from eventloom.session import reach, shared_folder
from eventloom.sources import files, warehouse
from eventloom.streaming import buffer
from eventloom.streaming.triggers import Cascade, Level, Rule, TriggerEngine


def two_sources(s: SparkSession, d: str) -> warehouse.Warehouse:
    """Customers and orders split into an eastern and a western source of different columns."""
    c, o = read(s, d, "customer"), read(s, d, "orders")
    w = warehouse.Warehouse(s)
    w.attach("east", warehouse.Source.memory({"customer": c.where("c_nationkey < 10").drop("c_acctbal"), "orders": o.where("o_custkey % 2 = 0")}))
    w.attach("west", warehouse.Source.memory({"customer": c.where("c_nationkey >= 10")}))
    return w


def a05(s, d):
    w = two_sources(s, d)
    return s.createDataFrame([(n, t) for n in w.attached for t in w.tables(n)], "source string, name string")


def a06(s, d):
    return two_sources(s, d).union("customer").groupBy("sourcedb").agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("balances"), r(F.sum("c_acctbal"), 2).alias("total"))


def a07(s, d):
    """Sequences of a table with renamed columns."""
    e = read(s, d, "events").select(F.col("user_id").alias("sid"), "ts", F.array(F.col("value")).alias("emb"), F.col("event_type").alias("mod"), "event_id")
    w = warehouse.Warehouse(s)
    w.attach("log", warehouse.Source.memory({"loaded_events": e}))
    w.build(["loaded_events"])
    return w.load_sequences("loaded_events", columns={"id": "sid", "ts": "ts", "embedding": "emb", "modality": "mod"}, tie="event_id").groupBy("id").agg(F.count(F.lit(1)).alias("n"), r(F.min("ts"), 3).alias("first"), r(F.sum(F.col("embedding")[0]), 3).alias("total"), F.max("modality").alias("modality"))


def a08(s, d):
    """Entities with their modalities in a map."""
    e = read(s, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("string").alias("entity_id"), F.when(F.col("vec_id") % 2 == 0, "text").otherwise("image").alias("modality"), "embedding", F.col("label").cast("string").alias("category"))
    w = warehouse.Warehouse(s)
    w.attach("vectors", warehouse.Source.memory({"loaded_entities": e}))
    w.build(["loaded_entities"])
    got = w.load_entities("loaded_entities")
    return got.select("id", "category", F.size("embeddings").alias("modalities"), r(F.col("embeddings")["text"][0].cast("double"), 5).alias("x"))


def a09(s, d):
    """Predictions one a row, and under ids of their own."""
    e = read(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2)).alias("predictions"))
    a, b = warehouse.steps(e), warehouse.step_ids(e)
    joined = a.withColumn("key", F.concat_ws("_step_", "id", F.col("step").cast("string"))).join(b.withColumnRenamed("id", "key"), "key")
    return joined.select("key", "step", r(F.col("vector")[0].cast("double"), 5).alias("x"))


def a10(s, d):
    """Live predictions replaced by id, the rest kept."""
    o = read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    new = o.where("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"))
    got = warehouse.upsert(s, o, new, "o_custkey", f"{shared_folder(s)}/upsert-{uuid.uuid4().hex}")
    return got.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


def a11(s, d):
    """A pruned read of an artefact that is written once."""
    path = f"{shared_folder(s)}/artefact-{uuid.uuid4().hex}"
    for _ in range(2):
        got = files.materialize(read(s, d, "orders"), path)
    return got.select("o_custkey", "o_orderstatus").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n"))


def a13(s, d):
    return warehouse.touching(read(s, d, "part"), "ring", "p_name", "p_type").select("p_partkey", "p_name")


def a20(s, d):
    return warehouse.with_ids(read(s, d, "orders"), list(range(0, 3000, 3)), "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def a21(s, d):
    """A read-only query and a sample of a view."""
    w = two_sources(s, d)
    w.build(["customer", "orders", "absent"])
    return w.query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE sourcedb = 'west' GROUP BY c_mktsegment")


def i01(s, d):
    li, o = read(s, d, "lineitem"), read(s, d, "orders")
    keyed = li.select("l_orderkey", (F.col("l_suppkey") % 5).alias("k"), "l_quantity").join(o.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("k")), ["l_orderkey", "k"])
    return keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


def i02(s, d):
    per = read(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
    return read(s, d, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), r(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"), F.col("n").isNotNull().alias("has"))


def i04(s, d):
    big = read(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return read(s, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


def i05(s, d):
    done = read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(s, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


def i06(s, d):
    """Residual condition after an equi-join: orders over twice their customer's median."""
    o = read(s, d, "orders")
    med = o.groupBy("o_custkey").agg(F.median("o_totalprice").alias("med"))
    return o.join(med, "o_custkey").where("o_totalprice > 2 * med").select("o_orderkey", r("med", 3).alias("med"))


def overlaps(e: DataFrame) -> DataFrame:
    """(a, b): events of a user whose intervals overlap, bucketed by week, so that the join is on equal users and weeks rather than on all pairs."""
    e = e.select("event_id", "user_id", "ts", (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("till"))
    weeks = e.withColumn("week", F.explode(F.sequence(F.floor(V.seconds("ts") / 604800), F.floor(V.seconds("till") / 604800))))
    a, b = (weeks.select("week", "user_id", F.col("event_id").alias(x), F.col("ts").alias(f"t{x}"), F.col("till").alias(f"e{x}")) for x in "ab")
    first = F.col("week") == F.floor(V.seconds(F.greatest("ta", "tb")) / 604800)
    return a.join(b, ["week", "user_id"]).where((F.col("a") < F.col("b")) & (F.col("ta") < F.col("eb")) & (F.col("tb") < F.col("ea")) & first).select("a", "b")


def i07(s, d):
    """Overlaps of every user's events."""
    return overlaps(read(s, d, "events"))


def j01(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("actors"), F.sum("l_quantity").alias("q"), r(F.avg("l_extendedprice"), 3).alias("mean"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
        F.median("l_quantity").alias("med"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"), r(F.stddev_pop("l_extendedprice"), 3).alias("sd"), r(F.percentile("l_extendedprice", 0.9), 3).alias("p90"),
        F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("states"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("dearest"), r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
    )


def j02(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(s, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"), r(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(w).cast("long").alias("quarter"), r(F.percent_rank().over(w), 6).alias("share"))


def j03(s, d):
    o = read(s, d, "orders")
    f, p = (o.where(F.col("o_orderstatus") == x).select("o_custkey") for x in ("F", "P"))
    tag = lambda df, name: df.withColumn("kind", F.lit(name))
    return tag(f.intersect(p), "both").union(tag(f.distinct().subtract(p), "only")).union(tag(f.union(p).distinct(), "either"))


def j04(s, d):
    return read(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def j05(s, d):
    return read(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


def j06(s, d):
    """A correlated scalar: each customer's dearest order against the average of the nation."""
    c, o = read(s, d, "customer"), read(s, d, "orders")
    c.createOrReplaceTempView("j06_customer")
    o.createOrReplaceTempView("j06_orders")
    return s.sql("WITH spent AS (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS x FROM j06_customer JOIN j06_orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_custkey, round(x, 2) AS x FROM spent a WHERE x > (SELECT 1.5D * avg(b.x) FROM spent b WHERE b.c_nationkey = a.c_nationkey)")


def j07(s, d):
    """Two aggregates: in one, a sketch would be kept for each distinct value."""
    li = read(s, d, "lineitem").select("l_partkey")
    exact, near = li.distinct().agg(F.count("l_partkey").alias("n")), li.agg(F.approx_count_distinct("l_partkey", 0.01).alias("about"))
    return exact.crossJoin(F.broadcast(near)).select("n", (F.abs(F.col("about") / F.col("n") - 1) < 0.05).alias("close"))


def k01(s, d):
    c = F.col("p_name")
    return read(s, d, "part").select("p_partkey", F.upper(c).alias("up"), F.length(c).alias("n"), c.like("%ring%").alias("a"), c.ilike("RED%").alias("b"), F.trim(F.concat(F.lit("  "), c)).alias("t"), c.rlike("^[a-m]").alias("re"), F.split(c, " ")[1].alias("second"), F.regexp_replace(c, "[aeiou]", "_").alias("veiled"))


def k02(s, d):
    o = F.col("o_orderdate")
    return read(s, d, "orders").select("o_orderkey", F.date_diff(F.lit("2002-01-01").cast("date"), F.to_date(o)).cast("long").alias("days"), F.trunc(o, "month").alias("month"), F.year(o).cast("long").alias("y"), (F.dayofweek(o) - 1).cast("long").alias("dow"), F.date_add(F.to_date(o), 30).alias("later"), V.seconds("o_orderdate").cast("long").alias("epoch"), F.date_format(o, "yyyy/MM").alias("shown"))


def k03(s, d):
    return read(s, d, "events").select("event_id", F.expr("try_cast(event_type AS INT)").alias("none"), F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.floor("value").alias("whole"))


def k04(s, d):
    return read(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal").between(0, 1000), "low").otherwise("high").alias("band"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("n"), F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("-")).alias("m"), F.col("c_nationkey").isin(1, 2, 3).alias("some"))


def k05(s, d):
    x = F.col("value")
    return read(s, d, "events").select("event_id", r(F.exp(-x / 10), 6).alias("e"), r(F.log1p(x), 6).alias("l"), r(F.expm1(x / 100), 6).alias("m"), r(F.sqrt(x), 6).alias("s"), r(F.sin(x), 6).alias("i"), r(F.cos(x), 6).alias("c"), r(F.pow(x, 1.5), 4).alias("p"), F.signum(x - 5).alias("g"), r(F.greatest(F.lit(1.0), F.least(x, F.lit(9.0))), 4).alias("clip"))


def k06(s, d):
    v = F.col("embedding")
    top = F.array_sort(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))[0]["i"]
    return ids(s, d).select("id", r(V.norm("embedding", 64), 5).alias("norm"), top.cast("long").alias("top"), r(F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda a, x: a + x), 5).alias("head"), r(V.dot("embedding", F.reverse(v), 64), 5).alias("mirror"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"))


def k07(s, d):
    k = F.col("c_custkey").cast("string")
    return read(s, d, "customer").select("c_custkey", F.md5(k).alias("m"), F.sha2(k, 256).alias("s"), ((F.col("c_custkey") + 1) * 2654435761).bitwiseAND(4294967295).alias("knuth"))


def k08(s, d):
    e = read(s, d, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), "event_type"))).alias("m"))
    return e.select("user_id", F.size("m").cast("long").alias("n"), F.size(F.array_distinct(F.map_values("m"))).cast("long").alias("kinds"), F.size(F.array_intersect(F.map_keys("m"), F.array(*[F.lit(str(i)) for i in range(100)]))).cast("long").alias("early"))


def k09(s, d):
    return read(s, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("json"))


def c02(s, d):
    """Batch updates: the same state from one pass over each sequence in Python, one row an id."""
    import pandas as pd

    from eventloom.streaming.incremental import Incremental

    reach(s)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = Incremental.of(rows.embedding.tolist(), rows.ts.tolist())
        return pd.DataFrame({"id": [rows.id.iloc[0]], "n": [held.n], "d0": [held.rep[0]], "d1": [held.rep[1]]})

    got = QS.sequences(s, d).select("id", "ts", "embedding").groupBy("id").applyInPandas(run, "id string, n long, d0 double, d1 double")
    return got.select("id", "n", r("d0").alias("d0"), r("d1").alias("d1"))


def c06(s, d):
    return buffer.batches(QS.sequences(s, d), 10).groupBy("id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("tie").alias("first"))


def newest_day(s, d):
    """The history before and after the last two days arrive."""
    h = QS.sequences(s, d)
    cut = h.agg(F.max("ts")).first()[0] - 2
    return h, h.where(F.col("ts") <= cut)


def c07(s, d):
    h, old = newest_day(s, d)
    now = [old]
    engine = TriggerEngine(s, lambda: now[0], 2, rules=[Rule("many", "size(patterns) >= 1")], clock=lambda: 1000.0)
    engine.poll()
    now[0] = h
    engine.poll()
    live = engine.live()
    return live.select(F.col("sequence_id").alias("id"), "step", r(F.col("prediction")[0], 5).alias("d0"), r(F.col("prediction")[1], 5).alias("d1"), "updated_at")


def c09(s, d):
    h, old = newest_day(s, d)
    now = [old]
    engine = TriggerEngine(s, lambda: now[0], 2, rules=[Rule("rising", "predictions[0][0] > 0", "warning", "{sequence_id}: {num_predictions} steps")], clock=lambda: 1000.0)
    engine.poll()
    now[0] = h
    engine.poll()
    return engine.alerts().select("sequence_id", "rule_name", "severity", "message", "fired_at")


def c11(s, d):
    """Two levels: the second needs one more poll than the first."""
    h, old = newest_day(s, d)
    cut = h.agg(F.max("ts")).first()[0] - 1
    now, at = [old], [0.0]
    cascade = Cascade(s, lambda: now[0], [Level("near", 2), Level("far", 2, num_steps=2)], clock=lambda: at[0])
    for k, rows in enumerate((old, h.where(F.col("ts") <= cut), h)):
        now[0], at[0] = rows, 100.0 + k
        cascade.poll()
    return cascade.predictions("far").select("sequence_id", "step", "updated_at")


QUERIES = {
    "a05_source_tables": a05, "a06_warehouse": a06, "a07_load_sequences": a07, "a08_load_entities": a08, "a09_prediction_rows": a09, "a10_upsert": a10, "a11_artefact": a11, "a13_touching": a13, "a20_id_list": a20, "a21_query": a21,
    "c02_batch_updates": c02, "c06_buffer": c06, "c07_trigger_poll": c07, "c09_alerts": c09, "c11_cascade": c11,
    "i01_composite_key": i01, "i02_left": i02, "i04_semi": i04, "i05_anti": i05, "i06_residual": i06, "i07_overlap": i07,
    "j01_aggregates": j01, "j02_windows": j02, "j03_set_operations": j03, "j04_cube": j04, "j05_pivot": j05, "j06_correlated": j06, "j07_approximate": j07,
    "k01_strings": k01, "k02_dates": k02, "k03_conversion": k03, "k04_conditional": k04, "k05_math": k05, "k06_arrays": k06, "k07_hashes": k07, "k08_maps": k08, "k09_json": k09,
}

#: The ids with events after the history that the last poll but one saw.
NEWS = f"{QS.SEQ}, mark AS (SELECT max(ts) AS m FROM seq WHERE ts <= (SELECT max(ts) FROM seq) - 2), changed AS (SELECT DISTINCT id FROM seq, mark WHERE ts > m)"

SQL = {
    "a05_source_tables": "SELECT * FROM (VALUES ('east', 'customer'), ('east', 'orders'), ('west', 'customer')) t(source, name)",
    "a06_warehouse": "SELECT CASE WHEN c_nationkey < 10 THEN 'east' ELSE 'west' END AS sourcedb, count(*) AS n, count(c_acctbal) FILTER (c_nationkey >= 10) AS balances, round(sum(c_acctbal) FILTER (c_nationkey >= 10), 2) AS total FROM customer GROUP BY 1",
    "a07_load_sequences": "SELECT user_id::VARCHAR AS id, count(*) AS n, round(min(epoch_us(ts) / 1e6), 3) AS first, round(sum(value), 3) AS total, arg_min(event_type, (ts, event_id)) AS modality FROM events GROUP BY 1",
    "a08_load_entities": "SELECT (vec_id // 2)::VARCHAR AS id, max(label)::VARCHAR AS category, count(*)::INTEGER AS modalities, round(max(embedding[1]::DOUBLE) FILTER (vec_id % 2 = 0), 5) AS x FROM embeddings GROUP BY 1",
    "a09_prediction_rows": "SELECT vec_id || '_step_' || k AS key, k::INTEGER AS step, round(embedding[2 * k - 1]::DOUBLE, 5) AS x FROM embeddings, range(1, 3) t(k)",
    "a10_upsert": "SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY 1",
    "a11_artefact": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1",
    "a13_touching": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_type, 'ring')",
    "a20_id_list": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 AND o_custkey < 3000 GROUP BY 1",
    "a21_query": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey >= 10 GROUP BY 1",
    "c02_batch_updates": f"WITH {QS.SEQ}, l AS (SELECT *, lag(ts) OVER (PARTITION BY id ORDER BY ts, tie) AS t0, max(ts) OVER (PARTITION BY id) AS t FROM seq), w AS (SELECT *, exp(-(t - ts)) - coalesce(exp(-(t - t0)), 0) AS w FROM l) SELECT id, count(*) AS n, round(sum(w * d0), 6) AS d0, round(sum(w * d1), 6) AS d1 FROM w GROUP BY id",
    "c07_trigger_poll": f"WITH {NEWS}, {QS.TREND} SELECT id, step::INTEGER AS step, round(l0 + t0 * step, 5) AS d0, round(l1 + t1 * step, 5) AS d1, 1000.0::DOUBLE AS updated_at FROM trend, range(1, 4) r(step) WHERE id IN (SELECT id FROM changed)",
    "c09_alerts": f"WITH {NEWS}, {QS.TREND} SELECT id AS sequence_id, 'rising' AS rule_name, 'warning' AS severity, id || ': 3 steps' AS message, 1000.0::DOUBLE AS fired_at FROM trend WHERE l0 + t0 > 0 AND id IN (SELECT id FROM changed)",
    "c11_cascade": f"WITH {NEWS.replace('- 2', '- 1')} SELECT id AS sequence_id, step::INTEGER AS step, 102.0::DOUBLE AS updated_at FROM changed, range(1, 3) r(step)",
    "c06_buffer": "WITH x AS (SELECT user_id::VARCHAR AS id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events) SELECT id, batch, count(*) AS n, min(event_id) AS first FROM x GROUP BY 1, 2",
    "i01_composite_key": "SELECT l_suppkey % 5 AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 5 = l_suppkey % 5 GROUP BY 1",
    "i02_left": "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent, count(o_orderkey) > 0 AS has FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "i04_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "i05_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "i06_residual": "WITH m AS (SELECT o_custkey, median(o_totalprice) AS med FROM orders GROUP BY 1) SELECT o_orderkey, round(med, 3) AS med FROM orders JOIN m USING (o_custkey) WHERE o_totalprice > 2 * med",
    "i07_overlap": "WITH e AS (SELECT * FROM events) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.ts < b.ts + INTERVAL 3 HOUR AND b.ts < a.ts + INTERVAL 3 HOUR",
    "j01_aggregates": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS actors, sum(l_quantity) AS q, round(avg(l_extendedprice), 3) AS mean, min(l_shipdate) AS first, max(l_shipdate) AS last, median(l_quantity) AS med, count(*) FILTER (l_discount > 0.05) AS cheap, round(stddev_pop(l_extendedprice), 3) AS sd, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS states, max({a: l_extendedprice, b: l_orderkey}).b AS dearest, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1",
    "j02_windows": "SELECT o_orderkey, row_number() OVER w AS place, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, count(*) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS share FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "j03_set_operations": "WITH f AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT *, 'both' AS kind FROM (SELECT * FROM f INTERSECT SELECT * FROM p) UNION ALL SELECT *, 'only' FROM (SELECT * FROM f EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'either' FROM (SELECT * FROM f UNION SELECT * FROM p)",
    "j04_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "j05_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "j06_correlated": "WITH spent AS (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS x FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_custkey, round(x, 2) AS x FROM spent a WHERE x > (SELECT 1.5::DOUBLE * avg(b.x) FROM spent b WHERE b.c_nationkey = a.c_nationkey)",
    "j07_approximate": "SELECT count(DISTINCT l_partkey) AS n, true AS close FROM lineitem",
    "k01_strings": "SELECT p_partkey, upper(p_name) AS up, length(p_name)::INTEGER AS n, p_name LIKE '%ring%' AS a, p_name ILIKE 'RED%' AS b, trim('  ' || p_name) AS t, regexp_matches(p_name, '^[a-m]') AS re, split_part(p_name, ' ', 2) AS second, regexp_replace(p_name, '[aeiou]', '_', 'g') AS veiled FROM part",
    "k02_dates": "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS days, date_trunc('month', o_orderdate)::DATE AS month, year(o_orderdate) AS y, dayofweek(o_orderdate) AS dow, (o_orderdate::DATE + 30)::DATE AS later, epoch(o_orderdate)::BIGINT AS epoch, strftime(o_orderdate, '%Y/%m') AS shown FROM orders",
    "k03_conversion": "SELECT event_id, try_cast(event_type AS INTEGER) AS \"none\", try_cast(props->>'$.k' AS DOUBLE) AS k, floor(value)::BIGINT AS whole FROM events",
    "k04_conditional": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' ELSE 'high' END AS band, nullif(c_nationkey, 3) AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS m, c_nationkey IN (1, 2, 3) AS some FROM customer",
    "k05_math": "SELECT event_id, round(exp(-value / 10), 6) AS e, round(ln(1 + value), 6) AS l, round(exp(value / 100) - 1, 6) AS m, round(sqrt(value), 6) AS s, round(sin(value), 6) AS i, round(cos(value), 6) AS c, round(pow(value, 1.5), 4) AS p, sign(value - 5)::DOUBLE AS g, round(greatest(1.0, least(value, 9.0)), 4) AS clip FROM events",
    "k06_arrays": "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, round(sqrt(list_dot_product(v, v)), 5) AS norm, list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x)))) - 1 AS top, round(list_sum(v[1:8]), 5) AS head, round(list_dot_product(v, list_reverse(v)), 5) AS mirror, len(list_filter(v, lambda x: x > 0)) AS positive FROM e",
    "k07_hashes": "SELECT c_custkey, md5(c_custkey::VARCHAR) AS m, sha256(c_custkey::VARCHAR) AS s, ((c_custkey + 1) * 2654435761::BIGINT) & 4294967295 AS knuth FROM customer",
    "k08_maps": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_id < 100) AS early FROM events GROUP BY 1",
    "k09_json": "SELECT '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json FROM nation",
}
