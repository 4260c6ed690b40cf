"""KPI queries over visits, with their SQL.

An order is a visit of a customer (the entity) at the customer's nation (the site). Its discharge is the first shipment on or after the order
date, its bill the sum of the discounted prices; an order without such a shipment is open. Its code, actor and brand are type, supplier and
brand of its first line. Status F is the adverse outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators import kpi as K
from eventloom.plans.q_population import half_up, r, read

AS_OF = "2001-12-01"
FIRST, LAST = "1998-02-01", "1998-02-28"
EDGES = [1, 4, 8, 15, 31, 61]


def lines(s: SparkSession, d: str) -> DataFrame:
    li = read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    return li.join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("code"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product")), "l_partkey")


def visits(s: SparkSession, d: str) -> DataFrame:
    """One join of lines and orders; first shipment, bill and the first line's attributes come from a single aggregate."""
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("visit"), F.col("o_custkey").alias("patient"), F.to_date("o_orderdate").alias("begin_on"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("urgency"))
    head = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "code", "brand"))
    ends = F.min(F.when(F.to_date("l_shipdate") >= F.col("begin_on"), F.to_date("l_shipdate")))
    li = lines(s, d).withColumnRenamed("l_orderkey", "visit")
    per = o.join(li, "visit", "left").groupBy(*o.columns).agg(ends.alias("end_on"), F.sum(money("price")).cast("double").alias("bill"), F.count("l_partkey").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("denied"), head.alias("h"))
    c = read(s, d, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("payer"))
    return per.join(c, "patient").select("visit", "patient", "site", "payer", "begin_on", "end_on", "status", "urgency", "bill", "items", "denied", F.col("h.code").alias("code"), F.col("h.brand").alias("brand"), F.col("h.l_suppkey").alias("actor")).withColumn("los", K.stay("begin_on", "end_on", AS_OF))


def money(c: Column | str) -> Column:
    """An exact value: sums of decimals don't depend on the order of addition."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(28,6)")


def mean_of(c: Column | str) -> Column:
    """Aggregate: the mean as one division of an exact sum."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(money(c)).cast("double") / F.count(c)


def history(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events")


L = "li AS (SELECT l_orderkey AS visit, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus, l_extendedprice * (1 - l_discount) AS price, p_type AS code, p_brand AS brand, p_name AS product FROM lineitem JOIN part ON p_partkey = l_partkey)"
V = f"""{L},
head AS (SELECT visit, min({{a: l_linenumber, b: l_partkey, c: l_suppkey, d: code, e: brand}}) AS h FROM li GROUP BY visit),
per AS (SELECT o_orderkey AS visit, min(CASE WHEN l_shipdate::DATE >= o_orderdate::DATE THEN l_shipdate::DATE END) AS end_on, sum(price::DECIMAL(28, 6))::DOUBLE AS bill, count(l_partkey) AS items, count(*) FILTER (l_returnflag = 'R') AS denied FROM orders LEFT JOIN li ON li.visit = o_orderkey GROUP BY o_orderkey),
v AS (SELECT o_orderkey AS visit, o_custkey AS patient, c_nationkey AS site, c_mktsegment AS payer, o_orderdate::DATE AS begin_on, end_on, o_orderstatus AS status, o_orderpriority AS urgency, bill, items, denied, h.d AS code, h.e AS brand, h.c AS actor, (coalesce(end_on, DATE '{AS_OF}') - o_orderdate::DATE)::BIGINT AS los
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN per ON per.visit = o_orderkey LEFT JOIN head ON head.visit = o_orderkey),
ret AS (SELECT *, (begin_on - lag(end_on) OVER (PARTITION BY patient ORDER BY begin_on, visit))::BIGINT AS gap FROM v),
rt AS (SELECT *, gap BETWEEN 1 AND 30 AS returned FROM ret)"""


def returns(s: SparkSession, d: str) -> DataFrame:
    return K.with_returns(visits(s, d), "patient", "begin_on", "end_on", "visit")


def bad() -> Column:
    return F.col("status") == "F"


def g01(s, d):
    return visits(s, d).agg(F.count_distinct("visit").alias("visits"), F.count_distinct("patient").alias("patients"), F.min("begin_on").alias("first"), F.max("begin_on").alias("last"), r(F.avg("los"), 4).alias("avg_los"), F.median("los").alias("median_los"), F.count_if(F.col("end_on").isNull()).alias("open"))


def g02(s, d):
    return lines(s, d).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("total"), r(F.avg("price"), 4).alias("mean"))


def g03(s, d):
    return returns(s, d).agg(F.count_if(F.col("gap").isNotNull()).alias("with_prior"), F.count_if("returned").alias("returned"), r(K.share(F.col("returned"), F.col("gap").isNotNull()), 4).alias("rate"))


CODES = [("error", "ADVERSE ERROR"), ("view", "VIEWED"), ("click", "CLICKED"), ("signup", "JOINED"), ("purchase", "BOUGHT")]


def code_table(s: SparkSession) -> DataFrame:
    return s.createDataFrame(CODES, "event_type string, name string")


def g04(s, d):
    last = K.latest(history(s, d), ["user_id"], ["ts", "event_id"], ["event_type"]).join(F.broadcast(code_table(s)), "event_type")
    return last.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.upper("name").like("ADVERSE%")).alias("adverse"))


def g05(s, d):
    return visits(s, d).groupBy(F.trunc("begin_on", "month").alias("month")).agg(F.count_distinct("visit").alias("visits"), F.count_distinct("patient").alias("patients"), r(F.sum("bill"), 2).alias("bill"))


def g06(s, d):
    per = lines(s, d).groupBy("product").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("cost"))
    volume = per.orderBy(F.desc("n"), "product").limit(10).withColumn("list", F.lit("volume"))
    return volume.unionByName(per.orderBy(F.desc("cost"), "product").limit(10).withColumn("list", F.lit("cost")))


def g07(s, d):
    return visits(s, d).groupBy(K.bucket("los", EDGES).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("los").alias("low"), F.max("los").alias("high"))


def g08(s, d):
    groups = s.createDataFrame([("F", "bad"), ("O", "good"), ("P", "open")], "status string, outcome string")
    return visits(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(groups), "status", "left").groupBy(F.coalesce("outcome", F.lit("other")).alias("outcome")).agg(F.sum("n").alias("n"))


def g09(s, d):
    return visits(s, d).where("brand is not null").groupBy("brand").agg(F.count_distinct("visit").alias("n"), r(F.avg("los"), 4).alias("mean"), F.median("los").alias("med"), F.max("los").alias("high")).where("n >= 10")


def g10(s, d):
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("site"), "n_name")
    return visits(s, d).join(n, "site").groupBy("status", "n_name").agg(F.count(F.lit(1)).alias("n"), r(F.avg("los"), 4).alias("mean"), F.median("los").alias("med"))


def g11(s, d):
    v = visits(s, d).where("code is not null")
    return K.excess(v, "code", "los").groupBy("code", "med").agg(F.count_distinct("visit").alias("n"), r(F.avg("los"), 4).alias("mean"), F.sum("over").alias("excess_days"))


def g12(s, d):
    denied = lines(s, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("visit"), "brand", F.col("price").alias("denied_price"))
    return denied.join(lines(s, d).select(F.col("l_orderkey").alias("visit"), "price"), "visit").groupBy("brand").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("denied_price"), 1).alias("denied"), r(F.sum("price"), 1).alias("billed"))


def g13(s, d):
    open_ = F.col("l_linestatus") == "O"
    return lines(s, d).groupBy("code").agg(r(F.sum(F.when(open_, F.col("price"))), 2).alias("open"), r(F.sum(F.when(~open_, F.col("price"))), 2).alias("done"), r(F.sum(F.when(F.col("l_returnflag") == "R", F.col("price")).otherwise(0.0)), 2).alias("denied"))


def g14(s, d):
    return returns(s, d).where("code is not null").groupBy("code").agg(F.count_if(F.col("gap").isNotNull()).alias("with_prior"), F.count_if("returned").alias("returned"), r(K.share(F.col("returned"), F.col("gap").isNotNull()), 4).alias("rate"))


def frequent(s, d, as_of: str = "2000-06-01") -> DataFrame:
    since = F.add_months(F.lit(as_of).cast("date"), -12)
    return visits(s, d).where((F.col("begin_on") >= since) & (F.col("begin_on") <= F.lit(as_of).cast("date"))).groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bill"), F.lit(0.0)).alias("cost")).where("n >= 3")


def g15(s, d):
    f = frequent(s, d)
    top = f.orderBy(F.desc("n"), "patient").limit(10).select(F.col("patient").cast("string").alias("who"), "n", r("cost", 2).alias("cost"))
    return top.unionByName(f.agg(F.lit("all").alias("who"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), r(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost")))


def g16(s, d):
    return returns(s, d).where("returned").groupBy("site").agg(F.count(F.lit(1)).alias("n"), half_up(F.coalesce(F.sum(money("bill")).cast("double"), F.lit(0.0)), 2).alias("cost"), half_up(mean_of("bill"), 4).alias("mean"))


def g17(s, d):
    """The visits with a strange bill, with what their lines and their entity have: one pass each over lines and visits."""
    v = returns(s, d)
    w = Window.partitionBy("site")
    odd = v.withColumn("z", (F.col("bill") - F.avg("bill").over(w)) / F.stddev_pop("bill").over(w)).where("z > 2.5")
    sums = v.groupBy("patient").agg(F.count(F.lit(1)).alias("visits"), F.sum(money(F.coalesce("bill", F.lit(0.0)))).cast("double").alias("spent"), F.max("los").alias("longest"))
    per = lines(s, d).groupBy(F.col("l_orderkey").alias("visit")).agg(F.count_distinct("l_suppkey").alias("actors"), F.count_distinct("code").alias("codes"), F.max("price").alias("dearest"))
    return odd.join(sums, "patient", "left").join(per, "visit", "left").select("visit", r("z", 4).alias("z"), "los", "denied", "visits", half_up(F.col("spent"), 2).alias("spent"), "longest", "actors", "codes", half_up(F.col("dearest"), 2).alias("dearest"), F.coalesce("returned", F.lit(False)).alias("returned"))


def g18(s, d):
    v = visits(s, d)
    bills = lines(s, d).groupBy(F.col("l_orderkey").alias("visit")).agg(F.sum(money("price")).cast("double").alias("x"))
    denials = lines(s, d).where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("visit")).agg(F.count(F.lit(1)).alias("y"))
    done = lines(s, d).where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("visit")).agg(F.count(F.lit(1)).alias("z"))
    zero = lambda c: half_up(mean_of(F.coalesce(c, F.lit(0.0))), 4)
    return v.select("visit", "site").join(bills, "visit", "left").join(denials, "visit", "left").join(done, "visit", "left").groupBy("site").agg(zero("x").alias("bill"), zero("y").alias("denials"), zero("z").alias("done"))


RANK = {"error": 5, "purchase": 4, "signup": 3, "click": 2, "view": 1}


def ranked(c: str = "event_type") -> Column:
    return F.coalesce(*[F.when(F.col(c) == k, n) for k, n in RANK.items()], F.lit(0))


def g19(s, d):
    return history(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("event_type", ranked()).alias("worst"))


def g20(s, d):
    v = visits(s, d)
    last = v.groupBy("patient").agg(F.max("end_on").alias("last_end"))
    return v.join(last, "patient").where(F.date_diff("begin_on", "last_end").between(0, 30)).select("visit", "last_end", F.date_diff("begin_on", "last_end").cast("long").alias("days"))


def g21(s, d):
    li = lines(s, d).select(F.col("l_orderkey").alias("visit"), "brand", "l_returnflag")
    g = li.groupBy("visit").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("brand", F.lit("?")))), " | ").alias("brands"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("brand")))), " | ").alias("denied"))
    return g.select("visit", "brands", F.nullif("denied", F.lit("")).alias("denied"))


def census(v: DataFrame, by: str, first: str, last: str) -> DataFrame:
    inside = lambda c: F.col(c).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    late = F.lit(last).cast("date")
    open_ = F.col("end_on").isNull() | (F.col("end_on") > late)
    return K.overlapping(v, "begin_on", "end_on", first, last).groupBy(by).agg(
        F.count(F.lit(1)).alias("active"), F.count_if(inside("begin_on")).alias("new"), F.count_if(inside("end_on")).alias("discharged"), F.count_if(open_).alias("open"),
        F.max(F.when(open_, F.date_diff(late, "begin_on"))).cast("long").alias("oldest"), F.count_if(open_ & (F.date_diff(late, "begin_on") > 60)).alias("over_60"),
    )


def g22(s, d):
    return census(visits(s, d), "site", FIRST, LAST)


def by_month(v: DataFrame) -> DataFrame:
    """Per site and month: volume, stay, adverse and returned visits in one grouped pass."""
    return v.groupBy("site", F.trunc("begin_on", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("los").alias("los"), F.count_if(bad()).alias("adverse"), F.count_if("returned").alias("returned"))


def g23(s, d):
    m = by_month(returns(s, d))
    before = m.select("site", F.add_months("month", 1).alias("month"), F.col("n").alias("n_before"))
    return m.where(F.col("month") == F.lit("1998-03-01").cast("date")).join(before, ["site", "month"], "left").select("site", "n", r("los", 4).alias("los"), "adverse", "returned", r(100.0 * (F.col("n") - F.col("n_before")) / F.nullif("n_before", F.lit(0)), 4).alias("delta"))


def g24(s, d):
    first, last = F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date")
    one = lambda c: F.count_distinct(F.when(c, F.col("visit")))
    return returns(s, d).where(F.col("begin_on").between(first, last)).groupBy(F.trunc("begin_on", "month").alias("month")).agg(F.count_distinct("visit").alias("n"), one(bad()).alias("adverse"), one(F.col("returned")).alias("returned"), one(F.col("los") > 60).alias("long"), one(F.col("end_on").isNull()).alias("open"))


def g25(s, d):
    v = visits(s, d).where("brand is not null")
    codes = v.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.median("los").alias("med")).orderBy(F.desc("n"), "brand").limit(10).drop("n")
    cells = v.join(F.broadcast(codes), "brand").groupBy("site", "brand", "med").agg(F.count(F.lit(1)).alias("n"), F.avg("los").alias("mean"), F.count_if(bad()).alias("adverse")).where("n >= 3")
    sites = cells.groupBy("site").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "site").limit(10).select("site")
    return cells.join(sites, "site", "left_semi").select("site", "brand", "n", r("mean", 4).alias("mean"), "med", "adverse")


def g26(s, d):
    v = visits(s, d).where("code is not null")
    code = v.groupBy("code").agg(F.median("los").alias("med"), F.count(F.lit(1)).alias("k")).where("k >= 10").drop("k")
    return v.groupBy("actor", "code").agg(F.count(F.lit(1)).alias("n"), F.avg("los").alias("mean")).where("n >= 5").join(code, "code").select("actor", "code", "n", r("mean", 4).alias("mean"), "med", r(F.col("mean") - F.col("med"), 4).alias("over"))


def g27(s, d):
    li = lines(s, d)
    per = li.groupBy("brand", F.col("l_orderkey").alias("visit")).agg(F.count(F.lit(1)).alias("k"))
    denied = li.where("l_returnflag = 'R'").groupBy("brand").agg(F.count(F.lit(1)).alias("denied"))
    whole = per.agg(F.avg("k").alias("whole"))
    g = per.groupBy("brand").agg(F.avg("k").alias("mean"), F.count(F.lit(1)).alias("visits")).crossJoin(F.broadcast(whole)).withColumn("ratio", F.col("mean") / F.nullif("whole", F.lit(0.0))).where("ratio > 1.0")
    return g.join(denied, "brand", "left").select("brand", "visits", r("ratio", 6).alias("ratio"), F.coalesce("denied", F.lit(0)).alias("denied"))


def g28(s, d):
    v = visits(s, d).where("actor is not null")
    return v.groupBy("actor").agg(F.count(F.lit(1)).alias("n"), r(F.avg("los"), 4).alias("mean"), r(F.stddev_pop("los"), 4).alias("spread"), r(F.stddev_pop("los") / F.nullif(F.avg("los"), F.lit(0.0)), 4).alias("variation"), r(K.share(bad(), F.col("end_on").isNotNull()), 4).alias("adverse_rate"))


def g29(s, d):
    h = history(s, d).where("event_type <> 'view'").select("user_id", "event_type")
    names = read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("site"))
    who = h.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ", ").alias("kinds")).where("n >= 2")
    return who.join(names, "user_id", "left").groupBy("site", "kinds").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"))


def g30(s, d):
    return lines(s, d).groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("visits"), r(F.count(F.lit(1)).cast("double") / F.count_distinct("l_orderkey"), 4).alias("intensity")).orderBy(F.desc("n"), "product").limit(20)


def g31(s, d):
    """One pass over the visits of the month with two presence flags, grouped by site."""
    v = K.overlapping(visits(s, d), "begin_on", "end_on", FIRST, LAST)
    done = lines(s, d).where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("visit")).distinct().withColumn("has", F.lit(True))
    g = v.join(done, "visit", "left").groupBy("site").agg(F.count(F.lit(1)).alias("n"), K.share(F.col("status") == "P", F.col("end_on").isNotNull()).alias("a"), K.share(F.col("has").isNull()).alias("b"), K.share(F.coalesce(F.col("urgency").like("4%"), F.lit(True))).alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("site", "n", r(zero("a"), 4).alias("no_type"), r(zero("b"), 4).alias("no_principal"), r(zero("c"), 4).alias("invalid"), r(100.0 - (zero("a") + zero("b") + zero("c")) / 3.0, 4).alias("score"))


def g32(s, d):
    h = history(s, d)
    ends = h.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("came"), F.max_by("event_type", F.struct("ts", "event_id")).alias("went"))
    n = ends.groupBy("came", "went").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("came").orderBy(F.desc("n"), "went")).cast("long")).where("place <= 3")


def g33(s, d):
    hit = lines(s, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("visit")).distinct().withColumn("hit", F.lit(True))
    g = visits(s, d).join(hit, "visit", "left").groupBy("site", F.col("hit").isNotNull().alias("with_event"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("los").alias("days"), r(F.avg("los"), 4).alias("mean"), r(1000.0 * F.sum("denied") / F.nullif(F.sum("los"), F.lit(0)), 4).alias("per_1000_days"))


def g34(s, d):
    w = Window.partitionBy("patient").orderBy("begin_on", "visit")
    done = F.col("end_on").isNotNull()
    return visits(s, d).select("visit", (F.dayofweek("begin_on") - 1).cast("long").alias("weekday"), F.month("begin_on").cast("long").alias("month"), F.year("begin_on").cast("long").alias("year"), F.when(done, F.col("los")).alias("los"), "code", (F.row_number().over(w) - 1).cast("long").alias("prior"))


def g35(s, d):
    return read(s, d, "orders").groupBy(K.category(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), {"HIGH": "severe"}, [("URG", "severe"), ("SPEC", "unspecified"), ("MED", "moderate")], other="mild").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def g36(s, d):
    closed = F.col("end_on").isNotNull()
    g = visits(s, d).where("brand is not null").groupBy("brand").agg(F.count(F.lit(1)).alias("n"), K.share(bad(), closed).alias("adverse"), K.share(F.col("status") == "P", closed).alias("moved"), F.avg("los").alias("los"))
    return g.select("brand", "n", r("adverse", 4).alias("adverse"), r("moved", 4).alias("moved"), r("los", 4).alias("los"), K.traffic_light((F.col("adverse"), 34.0), (F.col("moved"), 36.0)).alias("light"))


def g37(s, d):
    li = lines(s, d).where(F.col("l_partkey").cast("string").rlike("^[0-9]{2,8}$") & ~F.col("brand").isin("Brand#1", "Brand#2"))
    return li.select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("visit"), "brand").distinct().groupBy("actor", "brand").agg(F.count(F.lit(1)).alias("n"))


def g38(s, d):
    return K.with_sequence(visits(s, d), "patient", "begin_on", "visit").where("visits >= 3").select("visit", "visit_no", "visits")


def g39(s, d):
    return K.with_next(visits(s, d), "patient", "begin_on", "end_on", "visit").groupBy("site", "back").agg(F.count(F.lit(1)).alias("n"), r(F.avg("los"), 4).alias("los"))


def g40(s, d):
    v = visits(s, d)
    top = v.where("actor is not null").groupBy("actor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "actor").limit(20).select("actor")
    return v.join(F.broadcast(top), "actor", "left_semi").groupBy("actor", "code").agg(F.count(F.lit(1)).alias("n"))


def g41(s, d):
    g = visits(s, d).groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("begin_on", "visit", "status"))).alias("h")).where("n >= 3")
    return g.select("patient", "n", F.array_join("h.status", ">").alias("path"))


def listed(s: SparkSession, d: str, v: DataFrame) -> DataFrame:
    """(visit, codes): the sorted codes of each visit's lines."""
    codes = lines(s, d).groupBy(F.col("l_orderkey").alias("visit")).agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return v.join(codes, "visit", "left").select("visit", "codes")


def g42(s, d):
    """The codes of every visit of every patient."""
    return listed(s, d, visits(s, d))


def g43(s, d):
    """Characteristics of clusters of entities; a cluster is the entity's id modulo 7."""
    v = returns(s, d).withColumn("cluster", F.col("patient") % 7)
    g = v.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.avg("los"), 4).alias("los"), r(F.avg("bill"), 4).alias("bill"), r(K.share(bad()), 4).alias("adverse"), r(K.share(F.col("returned"), F.col("gap").isNotNull()), 4).alias("returned"))
    top = v.where("code is not null").groupBy("cluster", "code").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("code", F.struct("k", "code")).alias("top_code"))
    return g.join(top, "cluster", "left")


def g44(s, d):
    li = lines(s, d).groupBy(F.col("l_orderkey").alias("visit")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("price")).otherwise(0.0)).alias("lost"), F.max(F.when(F.col("product").ilike("%RING%"), 1).otherwise(0)).alias("ring")).where("lost > 0")
    return visits(s, d).where(F.col("los").between(1, 365)).join(li, "visit", "left").select("visit", "los", F.col("lost").isNotNull().alias("denied"), F.coalesce("ring", F.lit(0)).cast("long").alias("ring"))


def g45(s, d, first: str = "2005-01-01", n: int = 20):
    """The newest visits of the window, or the newest of all if it has none: one ranked scan."""
    v = visits(s, d).withColumn("inside", F.col("begin_on") >= F.lit(first).cast("date"))
    top = v.orderBy(F.desc("inside"), F.desc("begin_on"), F.desc("visit")).limit(n)
    any_inside = top.agg(F.coalesce(F.bool_or("inside"), F.lit(False)).alias("some"))
    return top.crossJoin(F.broadcast(any_inside)).where(F.col("inside") == F.col("some")).select("visit", "begin_on", "site")


def g46(s, d):
    return census(visits(s, d).withColumn("everything", F.lit("all")), "everything", "1999-03-01", "1999-03-31")


def g47(s, d):
    return history(s, d).groupBy(K.category("event_type", {"PURCHASE": "bought"}, [("ERR", "failed"), ("SIGN", "joined")], other="looked").alias("class")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


def g48(s, d):
    n = read(s, d, "nation").where("n_nationkey < 20").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = read(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.groupBy(F.coalesce("n_name", F.lit("unknown")).alias("site"), F.coalesce("r_name", F.lit("none")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "g01_headline": g01, "g02_billing": g02, "g03_readmission_30d": g03, "g04_last_status": g04, "g05_monthly": g05, "g06_top_products": g06, "g07_los_buckets": g07,
    "g08_outcomes": g08, "g09_los_by_code": g09, "g10_los_by_outcome": g10, "g11_excess_stay": g11, "g12_fanout_costs": g12, "g13_conditional_sums": g13,
    "g14_readmission_by_code": g14, "g15_frequent": g15, "g16_readmission_cost": g16, "g17_enriched_anomalies": g17, "g18_baselines": g18, "g19_severity": g19,
    "g20_prior_discharge": g20, "g21_text_lists": g21, "g22_census": g22, "g23_site_ranking": g23, "g24_trend": g24, "g25_risk_matrix": g25, "g26_actor_by_code": g26,
    "g27_intensity": g27, "g28_actor_variation": g28, "g29_multi_events": g29, "g30_products": g30, "g31_data_quality": g31, "g32_first_last": g32, "g33_event_rates": g33,
    "g34_feature_table": g34, "g35_folded_category": g35, "g36_traffic_light": g36, "g37_actor_codes": g37, "g38_visit_sequence": g38, "g39_next_visit": g39,
    "g40_top_actors": g40, "g41_paths": g41, "g42_correlated_list": g42, "g43_clusters": g43, "g44_probe_labels": g44, "g45_recent": g45, "g46_executive": g46,
    "g47_outcome_class": g47, "g48_dimension_lookup": g48,
}

CENSUS = """SELECT {by}, count(*) AS active, count(*) FILTER (begin_on BETWEEN DATE '{a}' AND DATE '{b}') AS new, count(*) FILTER (end_on BETWEEN DATE '{a}' AND DATE '{b}') AS discharged,
count(*) FILTER (end_on IS NULL OR end_on > DATE '{b}') AS open, max(CASE WHEN end_on IS NULL OR end_on > DATE '{b}' THEN DATE '{b}' - begin_on END)::BIGINT AS oldest,
count(*) FILTER ((end_on IS NULL OR end_on > DATE '{b}') AND DATE '{b}' - begin_on > 60) AS over_60 FROM v WHERE begin_on <= DATE '{b}' AND (end_on IS NULL OR end_on >= DATE '{a}') GROUP BY 1"""
MED = "SELECT {by}, median(los) AS med, count(*) AS k FROM v WHERE {by} IS NOT NULL GROUP BY 1"
NAMES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CODES) + ") t(event_type, name)"
SHARE = "100.0::DOUBLE * count(*) FILTER ({c}) / nullif(count(*) FILTER ({o}), 0)"

SQL = {
    "g01_headline": f"WITH {V} SELECT count(DISTINCT visit) AS visits, count(DISTINCT patient) AS patients, min(begin_on) AS first, max(begin_on) AS last, round(avg(los), 4) AS avg_los, median(los) AS median_los, count(*) FILTER (end_on IS NULL) AS open FROM v",
    "g02_billing": f"WITH {L} SELECT l_returnflag, count(*) AS n, round(sum(price), 2) AS total, round(avg(price), 4) AS mean FROM li GROUP BY 1",
    "g03_readmission_30d": f"WITH {V} SELECT count(gap) AS with_prior, count(*) FILTER (returned) AS returned, round(100.0::DOUBLE * count(*) FILTER (returned) / nullif(count(gap), 0), 4) AS rate FROM rt",
    "g04_last_status": f"SELECT name, count(*) AS n, count(*) FILTER (upper(name) LIKE 'ADVERSE%') AS adverse FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) e JOIN {NAMES} USING (event_type) WHERE k = 1 GROUP BY name",
    "g05_monthly": f"WITH {V} SELECT date_trunc('month', begin_on)::DATE AS month, count(DISTINCT visit) AS visits, count(DISTINCT patient) AS patients, round(sum(bill), 2) AS bill FROM v GROUP BY 1",
    "g06_top_products": f"WITH {L}, p AS (SELECT product, count(*) AS n, round(sum(price), 2) AS cost FROM li GROUP BY 1) (SELECT *, 'volume' AS list FROM p ORDER BY n DESC, product LIMIT 10) UNION ALL (SELECT *, 'cost' AS list FROM p ORDER BY cost DESC, product LIMIT 10)",
    "g07_los_buckets": f"WITH {V} SELECT (CASE WHEN los < 1 THEN 0 WHEN los < 4 THEN 1 WHEN los < 8 THEN 2 WHEN los < 15 THEN 3 WHEN los < 31 THEN 4 WHEN los < 61 THEN 5 ELSE 6 END)::INTEGER AS bucket, count(*) AS n, min(los) AS low, max(los) AS high FROM v GROUP BY 1",
    "g08_outcomes": "SELECT CASE o_orderstatus WHEN 'F' THEN 'bad' WHEN 'O' THEN 'good' WHEN 'P' THEN 'open' ELSE 'other' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "g09_los_by_code": f"WITH {V} SELECT brand, count(DISTINCT visit) AS n, round(avg(los), 4) AS mean, median(los) AS med, max(los) AS high FROM v WHERE brand IS NOT NULL GROUP BY 1 HAVING count(DISTINCT visit) >= 10",
    "g10_los_by_outcome": f"WITH {V} SELECT status, n_name, count(*) AS n, round(avg(los), 4) AS mean, median(los) AS med FROM v JOIN nation ON n_nationkey = site GROUP BY 1, 2",
    "g11_excess_stay": f"WITH {V}, m AS ({MED.format(by='code')}) SELECT code, med, count(DISTINCT visit) AS n, round(avg(los), 4) AS mean, sum(los - med) AS excess_days FROM v JOIN m USING (code) WHERE k >= 10 AND los > 2 * med GROUP BY 1, 2",
    "g12_fanout_costs": f"WITH {L} SELECT a.brand, count(*) AS rows, round(sum(a.price), 1) AS denied, round(sum(b.price), 1) AS billed FROM li a JOIN li b USING (visit) WHERE a.l_returnflag = 'R' GROUP BY 1",
    "g13_conditional_sums": f"WITH {L} SELECT code, round(sum(price) FILTER (l_linestatus = 'O'), 2) AS open, round(sum(price) FILTER (l_linestatus <> 'O'), 2) AS done, round(sum(CASE WHEN l_returnflag = 'R' THEN price ELSE 0 END), 2) AS denied FROM li GROUP BY 1",
    "g14_readmission_by_code": f"WITH {V} SELECT code, count(gap) AS with_prior, count(*) FILTER (returned) AS returned, round(100.0::DOUBLE * count(*) FILTER (returned) / nullif(count(gap), 0), 4) AS rate FROM rt WHERE code IS NOT NULL GROUP BY 1",
    "g15_frequent": f"WITH {V}, f AS (SELECT patient, count(*) AS n, coalesce(sum(bill), 0) AS cost FROM v WHERE begin_on BETWEEN DATE '1999-06-01' AND DATE '2000-06-01' GROUP BY 1 HAVING count(*) >= 3) (SELECT patient::VARCHAR AS who, n, round(cost, 2) AS cost FROM f ORDER BY n DESC, patient LIMIT 10) UNION ALL SELECT 'all', coalesce(sum(n), 0)::BIGINT, round(coalesce(sum(cost), 0), 2) FROM f",
    "g16_readmission_cost": f"WITH {V} SELECT site, count(*) AS n, round(coalesce(sum(bill::DECIMAL(28, 6))::DOUBLE, 0), 2) AS cost, round(sum(bill::DECIMAL(28, 6))::DOUBLE / count(bill), 4) AS mean FROM rt WHERE returned GROUP BY 1",
    "g17_enriched_anomalies": f"WITH {V}, o AS (SELECT * FROM (SELECT *, (bill - avg(bill) OVER w) / stddev_pop(bill) OVER w AS z FROM rt WINDOW w AS (PARTITION BY site)) WHERE z > 2.5), p AS (SELECT patient, count(*) AS visits, sum(coalesce(bill, 0)::DECIMAL(28, 6))::DOUBLE AS spent, max(los) AS longest FROM v GROUP BY 1), q AS (SELECT visit, count(DISTINCT l_suppkey) AS actors, count(DISTINCT code) AS codes, max(price) AS dearest FROM li GROUP BY 1) SELECT visit, round(z, 4) AS z, los, denied, visits, round(spent, 2) AS spent, longest, actors, codes, round(dearest, 2) AS dearest, coalesce(returned, false) AS returned FROM o LEFT JOIN p USING (patient) LEFT JOIN q USING (visit)",
    "g18_baselines": f"WITH {V}, a AS (SELECT visit, sum(price::DECIMAL(28, 6))::DOUBLE AS x FROM li GROUP BY 1), b AS (SELECT visit, count(*) AS y FROM li WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT visit, count(*) AS z FROM li WHERE l_linestatus = 'F' GROUP BY 1) SELECT site, round(sum(coalesce(x, 0)::DECIMAL(28, 6))::DOUBLE / count(*), 4) AS bill, round(sum(coalesce(y, 0)::DECIMAL(28, 6))::DOUBLE / count(*), 4) AS denials, round(sum(coalesce(z, 0)::DECIMAL(28, 6))::DOUBLE / count(*), 4) AS done FROM v LEFT JOIN a USING (visit) LEFT JOIN b USING (visit) LEFT JOIN c USING (visit) GROUP BY 1",
    "g19_severity": "SELECT user_id, ts::DATE AS day, arg_max(event_type, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS worst FROM events GROUP BY 1, 2",
    "g20_prior_discharge": f"WITH {V}, m AS (SELECT patient, max(end_on) AS last_end FROM v GROUP BY 1) SELECT visit, last_end, (begin_on - last_end)::BIGINT AS days FROM v JOIN m USING (patient) WHERE begin_on - last_end BETWEEN 0 AND 30",
    "g21_text_lists": f"WITH {L} SELECT visit, string_agg(DISTINCT coalesce(brand, '?'), ' | ' ORDER BY coalesce(brand, '?')) AS brands, string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN brand END, ' | ' ORDER BY CASE WHEN l_returnflag = 'R' THEN brand END) AS denied FROM li GROUP BY 1",
    "g22_census": f"WITH {V} {CENSUS.format(by='site', a=FIRST, b=LAST)}",
    "g23_site_ranking": f"WITH {V}, m AS (SELECT site, date_trunc('month', begin_on)::DATE AS month, count(*) AS n, avg(los) AS los, count(*) FILTER (status = 'F') AS adverse, count(*) FILTER (returned) AS returned FROM rt GROUP BY 1, 2) SELECT a.site, a.n, round(a.los, 4) AS los, a.adverse, a.returned, round(100.0::DOUBLE * (a.n - b.n) / nullif(b.n, 0), 4) AS delta FROM m a LEFT JOIN m b ON b.site = a.site AND b.month = DATE '1998-02-01' WHERE a.month = DATE '1998-03-01'",
    "g24_trend": f"WITH {V} SELECT date_trunc('month', begin_on)::DATE AS month, count(DISTINCT visit) AS n, count(DISTINCT CASE WHEN status = 'F' THEN visit END) AS adverse, count(DISTINCT CASE WHEN returned THEN visit END) AS returned, count(DISTINCT CASE WHEN los > 60 THEN visit END) AS long, count(DISTINCT CASE WHEN end_on IS NULL THEN visit END) AS open FROM rt WHERE begin_on BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' GROUP BY 1",
    "g25_risk_matrix": f"WITH {V}, m AS ({MED.format(by='brand')} ORDER BY k DESC, brand LIMIT 10), c AS (SELECT site, brand, med, count(*) AS n, avg(los) AS mean, count(*) FILTER (status = 'F') AS adverse FROM v JOIN m USING (brand) GROUP BY 1, 2, 3 HAVING count(*) >= 3), t AS (SELECT site FROM c GROUP BY site ORDER BY sum(n) DESC, site LIMIT 10) SELECT site, brand, n, round(mean, 4) AS mean, med, adverse FROM c WHERE site IN (SELECT site FROM t)",
    "g26_actor_by_code": f"WITH {V}, m AS ({MED.format(by='code')}) SELECT actor, code, n, round(mean, 4) AS mean, med, round(mean - med, 4) AS over FROM (SELECT actor, code, count(*) AS n, avg(los) AS mean FROM v WHERE code IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) JOIN m USING (code) WHERE k >= 10",
    "g27_intensity": f"WITH {L}, p AS (SELECT brand, visit, count(*) AS k FROM li GROUP BY 1, 2), g AS (SELECT brand, count(*) AS visits, avg(k) / nullif((SELECT avg(k) FROM p), 0) AS ratio FROM p GROUP BY 1 HAVING avg(k) / nullif((SELECT avg(k) FROM p), 0) > 1.0) SELECT brand, visits, round(ratio, 6) AS ratio, coalesce(denied, 0) AS denied FROM g LEFT JOIN (SELECT brand, count(*) AS denied FROM li WHERE l_returnflag = 'R' GROUP BY 1) USING (brand)",
    "g28_actor_variation": f"WITH {V} SELECT actor, count(*) AS n, round(avg(los), 4) AS mean, round(stddev_pop(los), 4) AS spread, round(stddev_pop(los) / nullif(avg(los), 0), 4) AS variation, round({SHARE.format(c='status = $$F$$ AND end_on IS NOT NULL', o='end_on IS NOT NULL')}, 4) AS adverse_rate FROM v WHERE actor IS NOT NULL GROUP BY 1",
    "g29_multi_events": "WITH w AS (SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING count(*) >= 2) SELECT c_nationkey AS site, kinds, count(*) AS users, sum(n)::BIGINT AS events FROM w LEFT JOIN customer ON c_custkey = user_id GROUP BY 1, 2",
    "g30_products": f"WITH {L} SELECT product, count(*) AS n, count(DISTINCT visit) AS visits, round(count(*)::DOUBLE / count(DISTINCT visit), 4) AS intensity FROM li GROUP BY 1 ORDER BY n DESC, product LIMIT 20",
    "g31_data_quality": f"WITH {V}, a AS (SELECT * FROM v WHERE begin_on <= DATE '{LAST}' AND (end_on IS NULL OR end_on >= DATE '{FIRST}')), f AS (SELECT DISTINCT visit FROM li WHERE l_linestatus = 'F'), g AS (SELECT site, count(*) AS n, coalesce({SHARE.format(c='end_on IS NOT NULL AND status = $$P$$', o='end_on IS NOT NULL')}, 0) AS a, {SHARE.format(c='visit NOT IN (SELECT visit FROM f)', o='true')} AS b, {SHARE.format(c='urgency IS NULL OR urgency LIKE $$4%$$', o='true')} AS c FROM a GROUP BY 1) SELECT site, n, round(a, 4) AS no_type, round(b, 4) AS no_principal, round(c, 4) AS invalid, round(100.0::DOUBLE - (a + b + c) / 3.0::DOUBLE, 4) AS score FROM g",
    "g32_first_last": "WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events), p AS (SELECT f.event_type AS came, l.event_type AS went, count(*) AS n FROM x f JOIN x l ON f.user_id = l.user_id AND f.a = 1 AND l.b = 1 GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY came ORDER BY n DESC, went) AS place FROM p) WHERE place <= 3",
    "g33_event_rates": f"WITH {V}, f AS (SELECT DISTINCT visit AS hit FROM li WHERE l_returnflag = 'R') SELECT site, hit IS NOT NULL AS with_event, count(*) AS n, sum(los)::BIGINT AS days, round(avg(los), 4) AS mean, round(1000.0::DOUBLE * sum(denied) / nullif(sum(los), 0), 4) AS per_1000_days FROM v LEFT JOIN f ON hit = visit GROUP BY 1, 2",
    "g34_feature_table": f"WITH {V} SELECT visit, dayofweek(begin_on) AS weekday, month(begin_on) AS month, year(begin_on) AS year, CASE WHEN end_on IS NOT NULL THEN los END AS los, code, row_number() OVER (PARTITION BY patient ORDER BY begin_on, visit) - 1 AS prior FROM v",
    "g35_folded_category": "SELECT CASE WHEN o_orderpriority LIKE '%HIGH' OR o_orderpriority LIKE '%URG%' THEN 'severe' WHEN o_orderpriority LIKE '%SPEC%' THEN 'unspecified' WHEN o_orderpriority LIKE '%MED%' THEN 'moderate' ELSE 'mild' END AS class, count(*) AS n FROM orders GROUP BY 1",
    "g36_traffic_light": f"WITH {V}, g AS (SELECT brand, count(*) AS n, {SHARE.format(c='status = $$F$$ AND end_on IS NOT NULL', o='end_on IS NOT NULL')} AS adverse, {SHARE.format(c='status = $$P$$ AND end_on IS NOT NULL', o='end_on IS NOT NULL')} AS moved, avg(los) AS los FROM v WHERE brand IS NOT NULL GROUP BY 1) SELECT brand, n, round(adverse, 4) AS adverse, round(moved, 4) AS moved, round(los, 4) AS los, CASE WHEN adverse > 34 OR moved > 36 THEN 'red' WHEN adverse > 17 OR moved > 18 THEN 'amber' ELSE 'green' END AS light FROM g",
    "g37_actor_codes": f"WITH {L} SELECT actor, brand, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS actor, visit, brand FROM li WHERE regexp_matches(l_partkey::VARCHAR, '^[0-9]{{2,8}}$') AND brand NOT IN ('Brand#1', 'Brand#2')) GROUP BY 1, 2",
    "g38_visit_sequence": "SELECT * FROM (SELECT o_orderkey AS visit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS visit_no, count(*) OVER (PARTITION BY o_custkey) AS visits FROM orders JOIN customer ON c_custkey = o_custkey) WHERE visits >= 3",
    "g39_next_visit": f"WITH {V}, n AS (SELECT *, lead(begin_on) OVER (PARTITION BY patient ORDER BY begin_on, visit) AS nb FROM v) SELECT site, coalesce(nb - end_on BETWEEN 0 AND 30, false) AS back, count(*) AS n, round(avg(los), 4) AS los FROM n GROUP BY 1, 2",
    "g40_top_actors": f"WITH {V} SELECT actor, code, count(*) AS n FROM v WHERE actor IN (SELECT actor FROM (SELECT actor, count(*) AS n FROM v WHERE actor IS NOT NULL GROUP BY 1 ORDER BY n DESC, actor LIMIT 20)) GROUP BY 1, 2",
    "g41_paths": f"WITH {V} SELECT patient, count(*) AS n, array_to_string(array_agg(status ORDER BY begin_on, visit), '>') AS path FROM v GROUP BY 1 HAVING count(*) >= 3",
    "g42_correlated_list": f"WITH {V} SELECT visit, (SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM li WHERE li.visit = v.visit) AS codes FROM v",
    "g43_clusters": f"WITH {V}, x AS (SELECT *, patient % 7 AS cluster FROM rt), t AS (SELECT cluster, code AS top_code FROM (SELECT cluster, code, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, code DESC) AS place FROM x WHERE code IS NOT NULL GROUP BY 1, 2) WHERE place = 1) SELECT cluster, n, los, bill, adverse, returned, top_code FROM (SELECT cluster, count(*) AS n, round(avg(los), 4) AS los, round(avg(bill), 4) AS bill, round({SHARE.format(c='status = $$F$$', o='true')}, 4) AS adverse, round({SHARE.format(c='returned', o='gap IS NOT NULL')}, 4) AS returned FROM x GROUP BY 1) LEFT JOIN t USING (cluster)",
    "g44_probe_labels": f"WITH {V}, b AS (SELECT visit, max(CASE WHEN product ILIKE '%RING%' THEN 1 ELSE 0 END) AS ring FROM li GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'R' THEN price ELSE 0 END) > 0) SELECT v.visit, los, b.visit IS NOT NULL AS denied, coalesce(ring, 0)::BIGINT AS ring FROM v LEFT JOIN b ON b.visit = v.visit WHERE los BETWEEN 1 AND 365",
    "g45_recent": "WITH v AS (SELECT o_orderkey AS visit, o_orderdate::DATE AS begin_on, c_nationkey AS site FROM orders JOIN customer ON c_custkey = o_custkey), w AS (SELECT * FROM v WHERE begin_on >= DATE '2005-01-01') SELECT * FROM (SELECT * FROM w UNION ALL SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM w)) ORDER BY begin_on DESC, visit DESC LIMIT 20",
    "g46_executive": f"WITH {V} {CENSUS.format(by='$$all$$ AS everything', a='1999-03-01', b='1999-03-31')}",
    "g47_outcome_class": "SELECT CASE event_type WHEN 'purchase' THEN 'bought' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'joined' ELSE 'looked' END AS class, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "g48_dimension_lookup": "SELECT coalesce(n_name, 'unknown') AS site, coalesce(r_name, 'none') AS region, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
}
