"""Queries of schema profiling, key discovery, encoders, materialised timelines and triples, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import vectors as V
from eventloom.operators import schema as S
from eventloom.operators import sequences as Q
from eventloom.plans.q_population import r, read
from eventloom.plans.q_sequences import adaptive

TABLES = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
PROFILED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}
NUMBERS = {"c_custkey", "c_nationkey", "c_acctbal", "o_orderkey", "o_custkey", "o_totalprice", "n_nationkey", "n_regionkey"}
KIND = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "n_nationkey": "int", "n_regionkey": "int"}
KEYS = {"customer": ["c_custkey", "c_nationkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "nation": ["n_nationkey", "n_regionkey"], "orders": ["o_orderkey", "o_custkey"], "part": ["p_partkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey", "s_nationkey"]}
TRIPLE_SQL = """tri AS (
SELECT 'ORDER_' || o_orderkey AS subject_id, 'HAS_CUST_VIA_orders' AS predicate, 'CUST_' || o_custkey AS object_id, epoch_us(o_orderdate) / 1e6 AS t_epoch, coalesce(o_totalprice, 0)::DOUBLE AS numeric_value FROM orders
UNION ALL SELECT 'ORDER_' || l_orderkey, 'HAS_PART_VIA_lineitem', 'PART_' || l_partkey, epoch_us(l_shipdate) / 1e6, coalesce(l_extendedprice, 0) FROM lineitem
UNION ALL SELECT 'ORDER_' || l_orderkey, 'HAS_SUPP_VIA_lineitem', 'SUPP_' || l_suppkey, epoch_us(l_shipdate) / 1e6, coalesce(l_extendedprice, 0) FROM lineitem)"""


def tables(s: SparkSession, d: str, names: list[str] = TABLES) -> dict[str, DataFrame]:
    return {t: read(s, d, t) for t in names}


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def triples(s: SparkSession, d: str) -> DataFrame:
    o, li = read(s, d, "orders"), read(s, d, "lineitem")
    return S.triples(o, "orders", "o_orderkey", ["o_custkey"], "o_orderdate", ["o_totalprice"]).union(S.triples(li, "lineitem", "l_orderkey", ["l_partkey", "l_suppkey"], "l_shipdate", ["l_extendedprice"]))


def profiles(s: SparkSession, d: str) -> DataFrame:
    return union(S.profile(read(s, d, t).select(*c), t, approximate=False) for t, c in PROFILED.items())


def f01(s, d):
    return profiles(s, d).select("table", "column", "kind", "rows", "nulls", "distinct_values", F.when(F.col("kind") == "string", F.col("low")).alias("low"), r("mean", 4).alias("mean"))


def f02(s, d):
    return S.keys(profiles(s, d)).where("is_id").select("table", "column", "primary", "foreign")


def f03(s, d):
    return S.foreign_keys(tables(s, d)).select("name", "parent", "child", "overlap", r("confidence", 6).alias("confidence"))


def counts(s: SparkSession, d: str) -> DataFrame:
    return union(df.agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("rows")) for t, df in tables(s, d).items())


def f04(s, d):
    return counts(s, d).select("name", "rows", S.size_bucket(F.col("rows")).alias("size"))


def f05(s, d):
    return read(s, d, "part").select(F.concat_ws("_", F.lit("agg_tb"), F.translate(F.lower("p_name"), " ", "_")).alias("name")).groupBy(S.domain(F.col("name")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def f06(s, d):
    return S.fingerprint(counts(s, d))


def f07(s, d):
    """The snapshot: tables with their sizes, columns and id columns."""
    per = S.keys(profiles(s, d)).groupBy("table").agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.count_if("is_id").alias("ids"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("primary"), F.col("column")))), ",").alias("primary_keys"))
    return per.withColumn("size", S.size_bucket(F.col("rows")))


def f08(s, d):
    return S.foreign_keys(tables(s, d)).where((F.col("confidence") >= 0.3) & (F.col("child").contains("lineitem") | F.col("parent").contains("lineitem"))).select("parent", "child")


CATALOG = '[{"name": "visits", "domain": "care", "keys": ["patient", "site"]}, {"name": "bills", "domain": "money", "keys": ["patient"]}, {"name": "sites", "domain": "care", "keys": ["site"]}]'


def f09(s, d):
    """Domains and shared keys that a JSON catalog names."""
    t = s.range(1).select(F.explode(F.from_json(F.lit(CATALOG), "array<struct<name:string,domain:string,keys:array<string>>>")).alias("t")).select("t.*")
    a = t.select("name", "domain", F.explode("keys").alias("key"))
    b = a.select(F.col("name").alias("other"), "key")
    return a.join(b, "key").where("name < other").select("domain", "name", "other", "key")


def f10(s, d):
    found = S.temporal_tables(tables(s, d, ["events", *TABLES]), ["user_id", "o_custkey", "l_orderkey"], ["ts", "o_orderdate"])
    return s.createDataFrame([(t, e, c, len(x)) for t, e, c, x in found], "table string, entity string, time string, context long")


def f11(s, d):
    found = S.temporal_tables(tables(s, d, ["events", *TABLES]), ["user_id", "o_custkey", "l_orderkey"], ["ts", "o_orderdate"])
    return union(read(s, d, t).agg(F.lit(e).alias("entity"), F.count(F.lit(1)).alias("rows"), F.count_distinct(e).alias("entities")) for t, e, _, _ in found)


def f12(s, d):
    e = read(s, d, "events").where(F.col("value").isNotNull())
    whole = F.concat(F.array(S.encode_number(F.col("value"))), S.encode_time(F.col("ts")), S.encode_text(F.col("event_type"), 8), F.array(S.encode_other(F.col("props"))))
    return e.select("event_id", whole.alias("v")).select("event_id", F.posexplode("v").alias("dim", "val")).select("event_id", "dim", r("val", 6).alias("val"))


def f13(s, d):
    e = read(s, d, "embeddings").select("vec_id", S.project(F.col("embedding").cast("array<double>"), 64, 16).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("dim", "val")).select("vec_id", "dim", r("val", 5).alias("val"))


def per_customer(s: SparkSession, d: str) -> DataFrame:
    o, e = read(s, d, "orders"), read(s, d, "events")
    return union([o.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("rows")), e.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))])


def f14(s, d):
    return S.richest(per_customer(s, d), 25)


#: (entity, time, context) of the tables that timelines are made of.
TIMELINE = {"events": ("user_id", "ts", ["event_type", "value"]), "orders": ("o_custkey", "o_orderdate", ["o_orderstatus", "o_totalprice"])}


def timeline_dims(s: SparkSession, d: str, most: int = 64) -> int:
    """Dimensions of a timeline's events: those of the widest table, ``most`` at most."""
    return min(most, max(sum(S.width(read(s, d, t).schema[c].dataType) for c in context) for t, (_, _, context) in TIMELINE.items()))


def timelines(s: SparkSession, d: str, ids: int | None = None, events: int = 5000) -> DataFrame:
    """The newest events of the richest entities over two tables; of all entities without ``ids``."""
    dims = timeline_dims(s, d)
    who = None if ids is None else F.broadcast(S.richest(per_customer(s, d), ids).select(F.col("id").alias("_who")))
    parts = []
    for t, (entity, time, context) in TIMELINE.items():
        df = read(s, d, t)
        parts.append(S.events_of(df if who is None else df.join(who, F.col(entity) == F.col("_who"), "left_semi"), entity, time, context, t, dims))
    return S.newest(Q.spread(union(parts)), events, "source", "embedding")


def spans(t: DataFrame) -> DataFrame:
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("events"), r((F.max("ts") - F.min("ts")) / 86400.0, 4).alias("span_days"), F.count_distinct("source").alias("sources"))


def f15(s, d):
    return spans(timelines(s, d))


def f16(s, d):
    """Salient dimensions of the processed timelines of two or more events."""
    t = timelines(s, d).select("id", F.col("ts") / 86400.0, "embedding", F.col("source").alias("modality"), F.hash("embedding").alias("tie")).toDF("id", "ts", "embedding", "modality", "tie")
    t = t.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("_n >= 2").drop("_n")
    return Q.process(t, timeline_dims(s, d), Q.Config(2)).select("id", F.size("representation").alias("dims"), F.size("patterns").alias("salient"), F.size("predictions").alias("steps"))


def f17(s, d):
    t = timelines(s, d).select("id", F.col("ts") / 86400.0, "embedding", F.col("source").alias("modality"), F.hash("embedding").alias("tie")).toDF("id", "ts", "embedding", "modality", "tie")
    n = t.groupBy("id").agg(F.count(F.lit(1)).alias("events"))
    dims = timeline_dims(s, d)
    return Q.representation(t, dims, Q.Config(2)).join(n, "id").select("id", "events", r(V.norm("embedding", dims), 4).alias("norm")).orderBy(F.desc("events"), "id")


def texts(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    line = S.row_text("events", "ts", [e.schema[c] for c in ("event_type", "value", "props")])
    return e.select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("tie"), line.alias("line"))


def f18(s, d):
    return S.joined_text(texts(s, d), 3000)


def text_events(s: SparkSession, d: str, ids: int = 100, events: int = 500) -> DataFrame:
    who = S.richest(per_customer(s, d), ids).select("id")
    return S.newest(texts(s, d).join(F.broadcast(who), "id", "left_semi"), events, "tie").select("id", "line")


def f19(s, d):
    return text_events(s, d)


def f20(s, d):
    """Tables with two or more of the core entities and a time."""
    core = {"custkey", "orderkey", "partkey", "suppkey"}
    rows = []
    for name, df in tables(s, d).items():
        held = sorted(c for c in df.columns if S.plain(c) in core)
        if len(held) >= 2 and any(isinstance(f.dataType, S.TEMPORAL) for f in df.schema.fields):
            rows.append((name, ",".join(held)))
    return s.createDataFrame(rows, "table string, entities string")


def related(s: SparkSession, d: str, who: DataFrame, most: int = 50) -> DataFrame:
    """(id, kind, other): at most ``most`` related entities of each kind, the smallest ids."""
    o = read(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey").join(F.broadcast(who), "id", "left_semi")
    li = read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    pairs = o.join(li, "o_orderkey").select("id", F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("other")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("other")), F.struct(F.lit("order").alias("kind"), F.col("o_orderkey").alias("other")))).alias("e")).select("id", "e.*").distinct()
    w = Window.partitionBy("id", "kind").orderBy("other")
    return pairs.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def f21(s, d):
    return related(s, d, S.richest(per_customer(s, d), 5).select("id"))


def context(s: SparkSession, d: str, who: DataFrame, most: int = 500) -> DataFrame:
    """(id, source, ts, key): own events and shipments of related orders, the newest ``most`` of each id."""
    own = read(s, d, "events").select(F.col("user_id").alias("id"), F.lit("events").alias("source"), "ts", F.col("event_id").alias("key")).join(F.broadcast(who), "id", "left_semi")
    orders = related(s, d, who).where("kind = 'order'").select("id", F.col("other").alias("l_orderkey"))
    li = read(s, d, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey").join(orders, "l_orderkey").select("id", F.lit("lineitem").alias("source"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("key"))
    both = own.union(li)
    w = Window.partitionBy("id").orderBy(F.desc("ts"), "source", "key")
    return both.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def f22(s, d):
    return context(s, d, S.richest(per_customer(s, d), 1).select("id"))


def contexts(s: SparkSession, d: str, ids: int = 50) -> DataFrame:
    return context(s, d, S.richest(per_customer(s, d), ids).select("id")).groupBy("id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("source").alias("sources"), F.max("ts").alias("newest"))


def f23(s, d):
    return contexts(s, d)


def f24(s, d):
    return triples(s, d).select("subject_id", "predicate", "object_id", r("t_epoch", 3).alias("t_epoch"))


def f25(s, d):
    return triples(s, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), r(F.sum("numeric_value"), 1).alias("total"))


def f26(s, d):
    """Rows of tables with one id column and a name, as texts of nodes."""
    p, rg = read(s, d, "part"), read(s, d, "region")
    a = p.select(F.concat(F.lit("PART_"), F.col("p_partkey")).alias("node_id"), F.lit("PART").alias("entity_type"), F.concat_ws(" | ", "p_name", "p_brand", "p_type").alias("text_payload"))
    return a.union(rg.select(F.concat(F.lit("REGION_"), F.col("r_regionkey")), F.lit("REGION"), "r_name"))


def indexed(t: DataFrame) -> DataFrame:
    """The edges with the dense index of either end."""
    nodes = S.dense_index(t.select(F.explode(F.array("subject_id", "object_id")).alias("node")), "node")
    a, b = nodes.toDF("subject_id", "src"), nodes.toDF("object_id", "dst")
    return t.join(a, "subject_id").join(b, "object_id").select("subject_id", "object_id", "src", "dst")


def f27(s, d):
    return indexed(triples(s, d))


def f28(s, d):
    graph = triples(s, d).select(F.col("object_id").alias("node_id")).distinct()
    return f26(s, d).join(graph, "node_id", "left_semi").groupBy("entity_type").agg(F.count(F.lit(1)).alias("matched"))


def f29(s, d):
    t = triples(s, d)
    start = t.where("predicate = 'HAS_CUST_VIA_orders'").select(F.col("object_id").alias("node")).distinct().orderBy("node").limit(5)
    return S.hops(t, start, [3, 2])


def f30(s, d):
    e = read(s, d, "events")
    rows = [(f.name, S.width(f.dataType)) for f in e.schema.fields]
    return s.createDataFrame(rows, "column string, dims int")


def f31(s, d):
    e = read(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(0.5)).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))
    return e.select("event_id", S.json_safe(e, "event_id", "value", "kind").alias("json"))


def f32(s, d):
    """One entity's timeline: the id is filtered in the scan."""
    e = read(s, d, "events").where("user_id = 7")
    return e.select("event_id", "ts", "event_type", r("value", 4).alias("value"))


def e42(s, d):
    return S.node_times(triples(s, d)).select("node", r("t_epoch", 3).alias("t_epoch"))


def one_profile(t: str, c: str) -> str:
    kind = KIND.get(c, "string")
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{kind}' AS kind, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, {'NULL::VARCHAR' if c in NUMBERS else f'min({c})'} AS low, {f'round(avg({c}), 4)' if c in NUMBERS else 'NULL::DOUBLE'} AS mean FROM {t}"


PROFILE_SQL = " UNION ALL ".join(one_profile(t, c) for t, cs in PROFILED.items() for c in cs)
FLAGS = "(rows = distinct_values AND nulls = 0) AS \"primary\", (distinct_values > 1 AND distinct_values < 0.9 * rows) AS \"foreign\""
SIZE = "CASE WHEN rows < 100 THEN 'tiny' WHEN rows < 10000 THEN 'small' WHEN rows < 100000 THEN 'medium' WHEN rows < 1000000 THEN 'large' ELSE 'xlarge' END"
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES)
FK_SQL = "WITH vals AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{S.plain(c)}' AS name, '{t}.{c}' AS col, {c}::VARCHAR AS value FROM {t} WHERE {c} IS NOT NULL" for t, cs in KEYS.items() for c in cs) + """),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY col) AS n, row_number() OVER (PARTITION BY col ORDER BY md5(value), value) AS place FROM vals) WHERE place <= 200 AND n > 1),
fk AS (SELECT a.name, a.col AS parent, b.col AS child, count(*) AS overlap, round(count(*) / least(200, a.n, b.n)::DOUBLE, 6) AS confidence FROM kept a JOIN kept b ON a.name = b.name AND a.value = b.value AND (a.n < b.n OR (a.n = b.n AND a.col < b.col)) GROUP BY a.name, a.col, b.col, a.n, b.n)"""
WHO = "cnt AS (SELECT o_custkey AS id FROM orders UNION ALL SELECT user_id FROM events), rich AS (SELECT id, count(*) AS rows FROM cnt GROUP BY 1 ORDER BY rows DESC, id LIMIT {n})"
LINE = "'[events|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ']' || coalesce(' event_type=' || substr(event_type, 1, 48), '') || coalesce(' value=' || printf('%.2f', value), '') || coalesce(' props=' || substr(props, 1, 48), '')"
GRAMS = "grams AS (SELECT DISTINCT event_type, i, ('0x' || substr(md5(substr(lower(trim(event_type)), i, 3)), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT event_type, unnest(range(1, greatest(1, length(trim(event_type)) - 2) + 1)) AS i FROM events)), cell AS (SELECT event_type, h % 8 AS dim, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM grams GROUP BY 1, 2), txt AS (SELECT event_type, dim, v / sqrt(sum(v * v) OVER (PARTITION BY event_type)) AS v FROM cell)"
TIME_DIMS = [(f"{f}(2 * pi() * {x})") for x in ("hour(ts) / 24.0::DOUBLE", "(isodow(ts) - 1) / 7.0::DOUBLE", "(month(ts) - 1) / 12.0::DOUBLE") for f in ("sin", "cos")]
F12_SQL = f"WITH {GRAMS}, e AS (SELECT * FROM events WHERE value IS NOT NULL) " + " UNION ALL ".join(
    ["SELECT event_id, 0 AS dim, round(sign(value) * ln(1 + abs(value)) / 20.0::DOUBLE, 6) AS val FROM e"]
    + [f"SELECT event_id, {k + 1}, round({x}, 6) FROM e" for k, x in enumerate(TIME_DIMS)]
    + [f"SELECT event_id, {k + 7}, round(coalesce((SELECT v FROM txt WHERE txt.event_type = e.event_type AND dim = {k}), 0), 6) FROM e" for k in range(8)]
    + ["SELECT event_id, 15, round(('0x' || substr(md5(props), 7, 2) || substr(md5(props), 5, 2) || substr(md5(props), 3, 2) || substr(md5(props), 1, 2))::BIGINT / 4294967296.0::DOUBLE * 2 - 1, 6) FROM e"]
)
RELATED = "rel AS (SELECT id, kind, other FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY other) AS place FROM (SELECT o_custkey AS id, 'part' AS kind, l_partkey AS other FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT o_custkey, 'supplier', l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT o_custkey, 'order', o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE id IN (SELECT id FROM rich)) WHERE place <= 50)"
CONTEXT = "ctx AS (SELECT id, source, ts, key FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, source, key) AS place FROM (SELECT user_id AS id, 'events' AS source, ts, event_id AS key FROM events WHERE user_id IN (SELECT id FROM rich) UNION ALL SELECT id, 'lineitem', l_shipdate, l_partkey FROM lineitem JOIN rel ON kind = 'order' AND other = l_orderkey)) WHERE place <= {n})"
#: Timelines of both tables as vectors: 16 dimensions of the text's trigrams, then the number.
EVENT_VECTORS = """words AS (SELECT DISTINCT event_type AS w FROM events UNION SELECT o_orderstatus FROM orders),
grams AS (SELECT w, ('0x' || substr(md5(substr(lower(trim(w)), i, 3)), 1, 8))::BIGINT AS h FROM (SELECT w, unnest(range(1, greatest(1, length(trim(w)) - 2) + 1)) AS i FROM words)),
cells AS (SELECT w, h % 16 AS dim, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM grams GROUP BY 1, 2),
every AS (SELECT w, dim, coalesce(v, 0) AS v FROM words CROSS JOIN range(16) r(dim) LEFT JOIN cells USING (w, dim)),
texts AS (SELECT w, list(v / CASE WHEN n > 0 THEN n ELSE 1 END ORDER BY dim) AS e FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY w)) AS n FROM every) GROUP BY w),
rows_ AS (SELECT user_id AS id, ts, event_type AS w, value::DOUBLE AS x FROM events UNION ALL SELECT o_custkey, o_orderdate, o_orderstatus, o_totalprice FROM orders),
events_ AS (SELECT id::VARCHAR AS id, epoch_us(ts) / 1e6 / 86400.0::DOUBLE AS ts, row_number() OVER () AS tie, list_concat(e, [coalesce(sign(x) * ln(1 + abs(x)) / 20.0::DOUBLE, 0)]) AS v FROM rows_ JOIN texts USING (w)),
counted AS (SELECT id, count(*) AS events FROM events_ GROUP BY id)"""


def decayed_vectors(source: str, to: str, by: str) -> str:
    """CTE ``to``: decayed mean vectors of ``source`` by the columns ``by``, with the newest time."""
    return f"""{to} AS (SELECT {by}, max(t) AS ts, list(x ORDER BY dim) AS v FROM (SELECT {by}, dim, max(ts) AS t, sum(exp(ts - newest) * x) / sum(exp(ts - newest)) AS x
  FROM (SELECT {by}, ts, max(ts) OVER (PARTITION BY {by}) AS newest, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM {source}) GROUP BY {by}, dim) GROUP BY {by})"""


REPRESENTED = ",\n".join([
    EVENT_VECTORS, adaptive("events_", "cut0"), decayed_vectors("cut0", "agg0", "id, win"), "lev0 AS (SELECT id, win AS tie, ts, v FROM agg0)",
    adaptive("lev0", "cut1"), decayed_vectors("cut1", "agg1", "id, win"), "lev1 AS (SELECT id, win AS tie, ts, v FROM agg1)", decayed_vectors("lev1", "rep", "id"),
])

NEAR = "near AS (SELECT node, neighbour, row_number() OVER (PARTITION BY node ORDER BY md5('42|' || node || '|' || neighbour)) AS place FROM (SELECT subject_id AS node, object_id AS neighbour FROM tri UNION SELECT object_id, subject_id FROM tri))"

QUERIES = {
    "f01_profile": f01, "f02_key_candidates": f02, "f03_foreign_keys": f03, "f04_size_buckets": f04, "f05_domains": f05, "f06_fingerprint": f06, "f07_snapshot": f07, "f08_key_filter": f08,
    "f09_catalog": f09, "f10_temporal_tables": f10, "f11_entity_types": f11, "f12_value_encoders": f12, "f13_projection": f13, "f14_richest": f14, "f15_timelines": f15,
    "f16_process_timelines": f16, "f17_timeline_summary": f17, "f18_row_text": f18, "f19_text_events": f19, "f20_bridges": f20, "f21_related": f21, "f22_context": f22, "f23_contexts": f23,
    "f24_triples": f24, "f25_numeric_triples": f25, "f26_ontology": f26, "f27_dictionary": f27, "f28_ontology_match": f28, "f29_hops": f29, "f30_widths": f30, "f31_json": f31, "f32_one_timeline": f32,
    "e42_node_time": e42,
}

SQL = {
    "f01_profile": PROFILE_SQL,
    "f02_key_candidates": f"SELECT \"table\", \"column\", {FLAGS} FROM ({PROFILE_SQL}) WHERE \"column\" LIKE '%key'",
    "f03_foreign_keys": FK_SQL + " SELECT * FROM fk",
    "f04_size_buckets": f"SELECT *, {SIZE} AS size FROM ({COUNTS})",
    "f05_domains": "SELECT split_part(lower(p_name), ' ', 1) AS domain, count(*) AS n FROM part GROUP BY 1",
    "f06_fingerprint": f"SELECT substr(sha256(string_agg(name || ':' || rows, '|' ORDER BY name)), 1, 16) AS fingerprint FROM ({COUNTS})",
    "f07_snapshot": f"SELECT *, {SIZE} AS size FROM (SELECT \"table\", max(rows) AS rows, count(*) AS columns, count(*) FILTER (\"column\" LIKE '%key') AS ids, coalesce(string_agg(\"column\", ',' ORDER BY \"column\") FILTER (\"column\" LIKE '%key' AND \"primary\"), '') AS primary_keys FROM (SELECT *, {FLAGS} FROM ({PROFILE_SQL})) GROUP BY 1)",
    "f08_key_filter": FK_SQL + " SELECT parent, child FROM fk WHERE confidence >= 0.3 AND (parent LIKE '%lineitem%' OR child LIKE '%lineitem%')",
    "f09_catalog": "SELECT * FROM (VALUES ('money', 'bills', 'visits', 'patient'), ('care', 'sites', 'visits', 'site')) t(domain, name, other, key)",
    "f10_temporal_tables": "SELECT * FROM (VALUES ('events', 'user_id', 'ts', 4::BIGINT), ('lineitem', 'l_orderkey', 'l_shipdate', 9), ('orders', 'o_custkey', 'o_orderdate', 4)) t(\"table\", entity, time, context)",
    "f11_entity_types": "SELECT 'user_id' AS entity, count(*) AS rows, count(DISTINCT user_id) AS entities FROM events UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'l_orderkey', count(*), count(DISTINCT l_orderkey) FROM lineitem",
    "f12_value_encoders": F12_SQL,
    "f13_projection": "SELECT vec_id, h % 16 AS dim, round(sum(CASE WHEN (h >> 16) & 1 = 1 THEN x ELSE -x END), 5) AS val FROM (SELECT vec_id, x, (i * 2654435761::BIGINT) & 4294967295 AS h FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY 1, 2 UNION ALL SELECT vec_id, dim, 0.0 FROM embeddings, range(16) t(dim) WHERE dim NOT IN (SELECT ((i * 2654435761::BIGINT) & 4294967295) % 16 FROM range(1, 65) u(i))",
    "f14_richest": f"WITH {WHO.format(n=25)} SELECT * FROM rich",
    "f15_timelines": "WITH ev AS (SELECT user_id AS id, epoch_us(ts) / 1e6 AS t, 'events' AS source FROM events UNION ALL SELECT o_custkey, epoch_us(o_orderdate) / 1e6, 'orders' FROM orders), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, source) AS place FROM ev) WHERE place <= 5000) SELECT id::VARCHAR AS id, count(*) AS events, round((max(t) - min(t)) / 86400.0::DOUBLE, 4) AS span_days, count(DISTINCT source) AS sources FROM k GROUP BY 1",
    "f16_process_timelines": f"WITH {REPRESENTED}, z AS (SELECT id, abs(x - avg(x) OVER p) / nullif(stddev_pop(x) OVER p, 0) AS z FROM (SELECT id, unnest(v) AS x FROM rep) WINDOW p AS (PARTITION BY id)), h AS (SELECT id, count(*) FILTER (z > 1.5) AS hits FROM z GROUP BY id) SELECT id, 17::INTEGER AS dims, CASE WHEN hits < 2 THEN 5 ELSE hits END::INTEGER AS salient, 3::INTEGER AS steps FROM h JOIN counted USING (id) WHERE events >= 2",
    "f17_timeline_summary": f"WITH {REPRESENTED} SELECT id, events, round(sqrt(list_inner_product(v, v)), 4) AS norm FROM rep JOIN counted USING (id)",
    "f18_row_text": f"WITH l AS (SELECT user_id AS id, ts, event_id AS tie, {LINE} AS line FROM events), k AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY ts DESC, tie ROWS UNBOUNDED PRECEDING) AS size FROM l) SELECT id, string_agg(line, chr(10) ORDER BY ts, tie) AS text FROM k WHERE size <= 3001 GROUP BY 1",
    "f19_text_events": f"WITH {WHO.format(n=100)} SELECT id, line FROM (SELECT user_id AS id, {LINE} AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE user_id IN (SELECT id FROM rich)) WHERE place <= 500",
    "f20_bridges": "SELECT * FROM (VALUES ('lineitem', 'l_orderkey,l_partkey,l_suppkey'), ('orders', 'o_custkey,o_orderkey')) t(\"table\", entities)",
    "f21_related": f"WITH {WHO.format(n=5)}, {RELATED} SELECT * FROM rel",
    "f22_context": f"WITH {WHO.format(n=1)}, {RELATED}, {CONTEXT.format(n=500)} SELECT * FROM ctx",
    "f23_contexts": f"WITH {WHO.format(n=50)}, {RELATED}, {CONTEXT.format(n=500)} SELECT id, count(*) AS events, count(DISTINCT source) AS sources, max(ts) AS newest FROM ctx GROUP BY 1",
    "f24_triples": f"WITH {TRIPLE_SQL} SELECT subject_id, predicate, object_id, round(t_epoch, 3) AS t_epoch FROM tri",
    "f25_numeric_triples": f"WITH {TRIPLE_SQL} SELECT predicate, count(*) AS n, round(sum(numeric_value), 1) AS total FROM tri GROUP BY 1",
    "f26_ontology": "SELECT 'PART_' || p_partkey AS node_id, 'PART' AS entity_type, concat_ws(' | ', p_name, p_brand, p_type) AS text_payload FROM part UNION ALL SELECT 'REGION_' || r_regionkey, 'REGION', r_name FROM region",
    "f27_dictionary": f"WITH {TRIPLE_SQL}, t AS (SELECT subject_id, object_id FROM tri), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS index FROM (SELECT subject_id AS node FROM t UNION SELECT object_id FROM t)) SELECT subject_id, object_id, a.index AS src, b.index AS dst FROM t JOIN n a ON a.node = subject_id JOIN n b ON b.node = object_id",
    "f28_ontology_match": f"WITH {TRIPLE_SQL} SELECT 'PART' AS entity_type, count(*) AS matched FROM part WHERE 'PART_' || p_partkey IN (SELECT object_id FROM tri)",
    "f29_hops": f"WITH {TRIPLE_SQL}, {NEAR}, h0 AS (SELECT DISTINCT object_id AS node FROM tri WHERE predicate = 'HAS_CUST_VIA_orders' ORDER BY 1 LIMIT 5), h1 AS (SELECT DISTINCT neighbour AS node FROM near JOIN h0 USING (node) WHERE place <= 3 AND neighbour NOT IN (SELECT node FROM h0)), h2 AS (SELECT DISTINCT neighbour AS node FROM near JOIN h1 USING (node) WHERE place <= 2 AND neighbour NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1)) SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2",
    "f30_widths": "SELECT * FROM (VALUES ('event_id', 1), ('ts', 6), ('user_id', 1), ('event_type', 16), ('value', 1), ('props', 16)) t(\"column\", dims)",
    "f31_json": "SELECT event_id, '{\"event_id\":' || event_id || ',\"value\":' || CASE event_id % 3 WHEN 0 THEN '\"NaN\"' WHEN 1 THEN '\"Infinity\"' ELSE '0.5' END || ',\"kind\":' || CASE WHEN event_id % 2 = 0 THEN '\"' || event_type || '\"' ELSE 'null' END || '}' AS json FROM events",
    "f32_one_timeline": "SELECT event_id, ts, event_type, round(value, 4) AS value FROM events WHERE user_id = 7",
    "e42_node_time": f"WITH {TRIPLE_SQL} SELECT node, round(max(t_epoch), 3) AS t_epoch FROM (SELECT subject_id AS node, t_epoch FROM tri UNION ALL SELECT object_id, t_epoch FROM tri) GROUP BY 1",
}
