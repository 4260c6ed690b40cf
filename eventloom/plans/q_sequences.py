"""Queries of the sequence operators over the events, with their SQL. Times are in days; embeddings are [value, props.k]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import vectors as V
from eventloom.operators import sequences as S

DAY = 86400.0


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    vector = F.array(F.col("value").cast("double"), F.get_json_object("props", "$.k").cast("double"))
    return e.select(F.col("user_id").cast("string").alias("id"), (V.seconds("ts") / DAY).alias("ts"), vector.alias("embedding"), F.col("event_type").alias("modality"), F.col("event_id").alias("tie"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def long(df: DataFrame, *keep: str, vector: str = "embedding") -> DataFrame:
    return V.long_form(df, vector, *keep)


SEQ = """seq AS (SELECT user_id::VARCHAR AS id, epoch_us(ts) / 1e6 / 86400.0::DOUBLE AS ts, value::DOUBLE AS d0, (props->>'$.k')::DOUBLE AS d1, event_type AS modality, event_id AS tie FROM events)"""


def unpivot(source: str, *keep: str, dims: tuple[str, ...] = ("d0", "d1")) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(keep)}, {i}::INTEGER AS dim, round({c}, 6) AS val FROM {source}" for i, c in enumerate(dims))


def decayed(source: str, to: str, by: str, alpha: str = "1.0") -> str:
    """CTE ``to``: decayed means of ``source`` by the columns ``by``; carries the newest time as ts."""
    keys = by.split(", ")
    same = " AND ".join(f"s.{k} = m.{k}" for k in keys)
    cols = ", ".join(f"s.{k}" for k in keys)
    w = f"exp(-({alpha}) * (m.t - s.ts))"
    return f"""{to} AS (SELECT {cols}, max(s.ts) AS ts, min(s.modality) AS modality, sum({w} * s.d0) / sum({w}) AS d0, sum({w} * s.d1) / sum({w}) AS d1
  FROM {source} s JOIN (SELECT {by}, max(ts) AS t FROM {source} GROUP BY {by}) m ON {same} GROUP BY {cols})"""


def adaptive(source: str, to: str) -> str:
    return f"""{to}_g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY id ORDER BY ts, tie) AS gap FROM {source}),
{to}_m AS (SELECT g.*, m.med FROM {to}_g g JOIN (SELECT id, median(gap) AS med FROM {to}_g GROUP BY id) m ON g.id = m.id),
{to} AS (SELECT * EXCLUDE (gap, med), sum(CASE WHEN gap > med THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS win FROM {to}_m)"""


def fixed(source: str, to: str) -> str:
    return f"""{to}_b AS (SELECT *, greatest(2, count(*) OVER p // 2) AS bins, min(ts) OVER p AS low, max(ts) OVER p AS high FROM {source} WINDOW p AS (PARTITION BY id)),
{to} AS (SELECT * EXCLUDE (bins, low, high), CASE WHEN high = low THEN 0 ELSE least(floor((ts - low) / ((high - low) / bins)), bins - 1) END::BIGINT AS win FROM {to}_b)"""


def levels(n: int, source: str = "seq", alpha: str = "1.0") -> str:
    """CTEs lev0 .. lev{n-1}: the window aggregates of each level, with tie = window."""
    parts, at = [], source
    for k in range(n):
        parts += [adaptive(at, f"cut{k}"), decayed(f"cut{k}", f"agg{k}", "id, win", alpha), f"lev{k} AS (SELECT * EXCLUDE (win), win AS tie FROM agg{k})"]
        at = f"lev{k}"
    return ",\n".join(parts)


TREND = """moves AS (SELECT *, d0 - lag(d0) OVER o AS m0, d1 - lag(d1) OVER o AS m1, max(ts) OVER (PARTITION BY id) AS t, row_number() OVER o AS place FROM seq WINDOW o AS (PARTITION BY id ORDER BY ts, tie)),
trend AS (SELECT id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max_by(d0, place) AS l0, max_by(d1, place) AS l1,
  coalesce(sum(exp(-(t - ts)) * m0) / sum(exp(-(t - ts))) FILTER (m0 IS NOT NULL), 0) AS t0, coalesce(sum(exp(-(t - ts)) * m1) / sum(exp(-(t - ts))) FILTER (m1 IS NOT NULL), 0) AS t1 FROM moves GROUP BY id)"""

ALPHAS = {"view": 0.5, "click": 2.0}
RESOLUTIONS = {"signup": "fixed"}
OFFSETS = {"view": [1.0, -1.0], "error": [0.5, 2.0]}
MODAL = "CASE modality WHEN 'view' THEN 0.5 WHEN 'click' THEN 2.0 ELSE 1.0 END::DOUBLE"


def first_modality(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).withColumn("modality", F.first("modality").over(S.in_order()))


FIRST = "first_seq AS (SELECT * EXCLUDE (modality), first_value(modality) OVER (PARTITION BY id ORDER BY ts, tie) AS modality FROM seq)"


def b07(spark: SparkSession, sf: str) -> DataFrame:
    config = S.Config(1, modality_aware=True, alphas=ALPHAS, resolutions=RESOLUTIONS)
    seq = first_modality(spark, sf)
    keyed = config.windowed(seq)
    keyed = keyed.withColumn("_newest", F.max("ts").over(S.Window.partitionBy("id", "window"))).withColumn("_w", S.decay(config.alpha(), F.col("_newest"), F.col("ts")))
    return long(keyed.groupBy("id", "window").agg(V.weighted_mean("embedding", "_w", 2).alias("embedding")), "id", "window")


def b09(spark: SparkSession, sf: str) -> DataFrame:
    e = vectors(spark, sf)
    return e.select("vec_id", F.posexplode(S.salient("embedding")).alias("place", "dim"))


def pairs_in_order(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf)
    return s.select(F.lag("embedding").over(S.in_order()).alias("predicted"), F.col("embedding").alias("actual"), (F.col("ts") - F.lag("ts").over(S.in_order())).alias("distance")).where("predicted is not null")


def b17(spark: SparkSession, sf: str) -> DataFrame:
    """prediction error + 0.1 * sum over levels of 1/levels * mean squared length of the level's aggregates."""
    levels_ = S.multilevel(S.spread(sequences(spark, sf)), 2, S.Config(2))
    reg = levels_.groupBy("level").agg(F.avg(V.dot("embedding", "embedding", 2)).alias("r")).agg(F.avg("r").alias("r"))
    return pairs_in_order(spark, sf).agg(F.avg(F.pow(V.euclidean("predicted", "actual", 2), 2.0) / 2).alias("p")).crossJoin(F.broadcast(reg)).select(F.round(F.col("p") + 0.1 * F.col("r"), 4).alias("loss"))


def b20(spark: SparkSession, sf: str) -> DataFrame:
    p = S.process(S.spread(sequences(spark, sf)), 2, S.Config(1), 2)
    return p.select("id", *[F.round(F.col("representation")[i], 6).alias(f"r{i}") for i in range(2)], F.array_join("patterns", ",").alias("patterns"), *[F.round(F.col("predictions")[s][i], 6).alias(f"p{s}{i}") for s in range(2) for i in range(2)])


def b22(spark: SparkSession, sf: str) -> DataFrame:
    w = S.sliding(sequences(spark, sf), 3, 1)
    return w.select("id", F.col("place").cast("int").alias("place"), *[F.col("context")[k][0].alias(f"c{k}") for k in range(3)], F.col("target")[0][0].alias("t0"))


def c04(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions from the newest 10 events with the stream's own alpha."""
    recent = sequences(spark, sf).withColumn("_p", F.row_number().over(S.Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("tie")))).where("_p <= 10").drop("_p")
    return long(S.predict_next(recent, 2, 2, alpha=0.5), "id", "step", vector="prediction")


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = S.prediction_metrics(pairs_in_order(spark, sf), 2)
    return m.select(F.round("mse", 4).alias("mse"), F.round("mae", 6).alias("mae"), F.round("cosine", 6).alias("cosine"))


QUERIES = {
    "b01_decay_mean": lambda s, d: long(S.weighted_aggregate(sequences(s, d), 2), "id"),
    "b02_adaptive_windows": lambda s, d: S.adaptive_windows(sequences(s, d)).select(F.col("tie").alias("event_id"), F.col("window").cast("long").alias("win")),
    "b03_fixed_windows": lambda s, d: S.fixed_windows(sequences(s, d)).select(F.col("tie").alias("event_id"), F.col("window").cast("long").alias("win")),
    "b04_multilevel": lambda s, d: long(S.multilevel(S.spread(sequences(s, d)), 2, S.Config(2)), "id", "level"),
    "b05_representation": lambda s, d: long(S.representation(S.spread(sequences(s, d)), 2, S.Config(2)), "id"),
    "b06_fuse_levels": lambda s, d: long(S.fuse(S.multilevel(S.spread(sequences(s, d)), 2, S.Config(2)), 2), "id"),
    "b07_modality_config": lambda s, d: b07(s, d).withColumn("window", F.col("window").cast("long")).withColumnRenamed("window", "win"),
    "b08_modality_offset": lambda s, d: long(S.representation(first_modality(s, d), 2, S.Config(1, modality_aware=True, offsets=OFFSETS)), "id"),
    "b09_salient_dimensions": b09,
    "b10_trend": lambda s, d: long(S.trend(sequences(s, d), 2), "id", vector="trend"),
    "b11_extrapolate": lambda s, d: long(S.predict_next(sequences(s, d), 2, 5, alpha=0.25), "id", "step", vector="prediction"),
    "b12_predict_next": lambda s, d: long(S.predict_next(sequences(s, d), 2, 3), "id", "step", vector="prediction"),
    "b13_position_encoding": lambda s, d: long(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", S.position_encoding(F.col("n_nationkey").cast("double"), 8).alias("embedding")), "n_nationkey"),
    "b14_predict_at": lambda s, d: long(S.predict_at(sequences(s, d), 2, [0.5, 2.0]), "id", "target", vector="prediction"),
    "b15_temporal_distance": lambda s, d: S.temporal_distances(sequences(s, d).where("modality <> 'purchase'"), sequences(s, d).where("modality = 'purchase'")).select("id", F.round("ts", 6).alias("ts"), F.round("distance", 6).alias("distance")),
    "b16_dense_loss": lambda s, d: S.dense_loss(pairs_in_order(s, d), 2, 0.5, 0.1).select(F.round("loss", 4).alias("loss")),
    "b17_multilevel_loss": b17,
    "b18_lambda_schedule": lambda s, d: s.range(200).select(F.col("id").alias("step"), F.round(S.warm_up(F.col("id"), 0.5, 50, 100), 6).alias("lam")),
    "b19_learning_rate": lambda s, d: s.range(300).select(F.col("id").alias("step"), F.round(S.learning_rate(F.col("id"), 0.001, 50, 150, 100, 1e-5), 9).alias("rate")),
    "b20_process_sequence": b20,
    "b21_relational_decay": lambda s, d: long(S.relational_aggregate(sequences(s, d).withColumn("kind", F.col("modality")), 2, "purchase"), "id"),
    "b22_sliding_windows": b22,
    "b23_prediction_metrics": metrics,
    "b24_context_split": lambda s, d: S.split_context(sequences(s, d), 0.7).select(F.col("tie").alias("event_id"), "part"),
    "c01_ema": lambda s, d: long(S.ema(sequences(s, d), 2), "id"),
    "c03_stream_salient": lambda s, d: S.stream_salient(sequences(s, d), 2),
    "c04_stream_predict": c04,
}

LEVELS = f"WITH {SEQ},\n{levels(2)},\n{decayed('lev0', 'fin0', 'id')},\n{decayed('lev1', 'fin1', 'id')}"

SQL = {
    "b01_decay_mean": f"WITH {SEQ}, {decayed('seq', 'r', 'id')} {unpivot('r', 'id')}",
    "b02_adaptive_windows": f"WITH {SEQ}, {adaptive('seq', 'c')} SELECT tie AS event_id, win::BIGINT AS win FROM c",
    "b03_fixed_windows": f"WITH {SEQ}, {fixed('seq', 'c')} SELECT tie AS event_id, win FROM c",
    "b04_multilevel": f"{LEVELS} {unpivot('fin0', 'id', '0::INTEGER AS level')} UNION ALL {unpivot('fin1', 'id', '1::INTEGER AS level')} UNION ALL {unpivot('fin1', 'id', '2::INTEGER AS level')}",
    "b05_representation": f"{LEVELS} {unpivot('fin1', 'id')}",
    "b06_fuse_levels": f"{LEVELS}, f AS (SELECT a.id, (a.d0 + 2 * b.d0) / 3 AS d0, (a.d1 + 2 * b.d1) / 3 AS d1 FROM fin0 a JOIN fin1 b ON a.id = b.id) {unpivot('f', 'id')}",
    "b07_modality_config": f"WITH {SEQ}, {FIRST}, {adaptive('first_seq', 'ca')}, {fixed('first_seq', 'cf')}, both_ AS (SELECT * FROM ca WHERE modality <> 'signup' UNION ALL BY NAME SELECT * FROM cf WHERE modality = 'signup'), {decayed('both_', 'r', 'id, win', MODAL.replace('modality', 's.modality'))} SELECT id, win::BIGINT AS win, dim, val FROM ({unpivot('r', 'id', 'win')})",
    "b08_modality_offset": f"WITH {SEQ}, {FIRST}, moved AS (SELECT * REPLACE (d0 + CASE modality WHEN 'view' THEN 1.0 WHEN 'error' THEN 0.5 ELSE 0 END AS d0, d1 + CASE modality WHEN 'view' THEN -1.0 WHEN 'error' THEN 2.0 ELSE 0 END AS d1) FROM first_seq), {levels(1, 'moved')}, {decayed('lev0', 'fin0', 'id')} {unpivot('fin0', 'id')}",
    "b09_salient_dimensions": """
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
z AS (SELECT *, abs(v - avg(v) OVER p) / stddev_pop(v) OVER p AS z FROM l WINDOW p AS (PARTITION BY vec_id)),
h AS (SELECT *, count(*) FILTER (z > 1.5) OVER (PARTITION BY vec_id) AS hits, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, dim) AS r FROM z)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN hits < 2 THEN r ELSE dim END) - 1)::INTEGER AS place, dim::INTEGER AS dim
FROM h WHERE CASE WHEN hits < 2 THEN r <= 5 ELSE z > 1.5 END""",
    "b10_trend": f"WITH {SEQ}, {TREND} {unpivot('trend', 'id', dims=('t0', 't1'))}",
    "b11_extrapolate": f"WITH {SEQ}, {TREND.replace('exp(-(t - ts))', 'exp(-0.25 * (t - ts))')}, p AS (SELECT id, step::INTEGER AS step, l0 + t0 * step AS p0, l1 + t1 * step AS p1 FROM trend, range(1, 6) r(step)) {unpivot('p', 'id', 'step', dims=('p0', 'p1'))}",
    "b12_predict_next": f"WITH {SEQ}, {TREND}, p AS (SELECT id, step::INTEGER AS step, l0 + t0 * step AS p0, l1 + t1 * step AS p1 FROM trend, range(1, 4) r(step)) {unpivot('p', 'id', 'step', dims=('p0', 'p1'))}",
    "b13_position_encoding": "SELECT n_nationkey, i::INTEGER AS dim, round(CASE WHEN i % 2 = 0 THEN sin(n_nationkey / pow(10000.0::DOUBLE, i / 8.0::DOUBLE)) ELSE cos(n_nationkey / pow(10000.0::DOUBLE, (i - 1) / 8.0::DOUBLE)) END, 6) AS val FROM nation, range(8) r(i)",
    "b14_predict_at": f"""WITH {SEQ}, {TREND}, g AS (SELECT *, CASE WHEN n > 1 AND last_ts > first_ts THEN (last_ts - first_ts) / (n - 1) ELSE 1.0 END AS gap FROM trend),
p AS (SELECT id, target, l0 + t0 * (target / gap) * (1 + 0.1 * sin(target)) AS p0, l1 + t1 * (target / gap) * (1 + 0.1 * cos(target)) AS p1 FROM g, (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) v(target)) {unpivot('p', 'id', 'target', dims=('p0', 'p1'))}""",
    "b15_temporal_distance": f"WITH {SEQ} SELECT m.id, round(m.ts, 6) AS ts, round(min(abs(m.ts - c.ts)), 6) AS distance FROM seq m LEFT JOIN seq c ON m.id = c.id AND c.modality <> 'purchase' WHERE m.modality = 'purchase' GROUP BY m.id, m.ts, m.tie",
    "b16_dense_loss": f"WITH {SEQ}, p AS (SELECT (abs(d0 - lag(d0) OVER o) + abs(d1 - lag(d1) OVER o)) / 2 AS e, ts - lag(ts) OVER o AS dist FROM seq WINDOW o AS (PARTITION BY id ORDER BY ts, tie)) SELECT round(sum(0.5 / sqrt(greatest(dist, 0.1)) * e) / sum(0.5 / sqrt(greatest(dist, 0.1))), 4) AS loss FROM p WHERE e IS NOT NULL",
    "b17_multilevel_loss": f"{LEVELS}, p AS (SELECT (pow(d0 - lag(d0) OVER o, 2) + pow(d1 - lag(d1) OVER o, 2)) / 2 AS e FROM seq WINDOW o AS (PARTITION BY id ORDER BY ts, tie)) SELECT round((SELECT avg(e) FROM p) + 0.1 * ((SELECT avg(d0 * d0 + d1 * d1) FROM fin0) + 2 * (SELECT avg(d0 * d0 + d1 * d1) FROM fin1)) / 3, 4) AS loss",
    "b18_lambda_schedule": "SELECT step, round(CASE WHEN step < 50 THEN 0.0 WHEN step >= 100 THEN 0.5 ELSE 0.5::DOUBLE * (step - 50) / 50 END::DOUBLE, 6) AS lam FROM range(200) r(step)",
    "b19_learning_rate": "SELECT step, round(CASE WHEN step < 50 THEN 0.001::DOUBLE * (step + 1) / 50 WHEN step < 200 THEN 0.001 ELSE 1e-5 + 0.5 * (0.001 - 1e-5) * (1 + cos(pi() * least((step - 200) / 100.0::DOUBLE, 1.0))) END::DOUBLE, 9) AS rate FROM range(300) r(step)",
    "b20_process_sequence": f"""WITH {SEQ}, {levels(1)}, {decayed('lev0', 'fin0', 'id')}, {TREND}
SELECT f.id, round(d0, 6) AS r0, round(d1, 6) AS r1, CASE WHEN d0 = d1 THEN '0,1' WHEN abs(d0) >= abs(d1) THEN '0,1' ELSE '1,0' END AS patterns, round(l0 + t0, 6) AS p00, round(l1 + t1, 6) AS p01, round(l0 + 2 * t0, 6) AS p10, round(l1 + 2 * t1, 6) AS p11 FROM fin0 f JOIN trend t ON f.id = t.id""",
    "b21_relational_decay": f"""WITH {SEQ}, b AS (SELECT *, min(ts) OVER p AS low, max(ts) OVER p AS high FROM seq WINDOW p AS (PARTITION BY id)),
w AS (SELECT *, exp(-(1.0 - CASE WHEN high > low THEN (ts - low) / (high - low) ELSE 1.0 END)) * CASE WHEN modality = 'purchase' THEN 1.0 ELSE 0.5 END AS w FROM b), r AS (SELECT id, sum(w * d0) / sum(w) AS d0, sum(w * d1) / sum(w) AS d1 FROM w GROUP BY id) {unpivot('r', 'id')}""",
    "b22_sliding_windows": f"WITH {SEQ}, w AS (SELECT id, row_number() OVER o::INTEGER AS place, d0 AS c0, lead(d0, 1) OVER o AS c1, lead(d0, 2) OVER o AS c2, lead(d0, 3) OVER o AS t0 FROM seq WINDOW o AS (PARTITION BY id ORDER BY ts, tie)) SELECT * FROM w WHERE t0 IS NOT NULL",
    "b23_prediction_metrics": f"WITH {SEQ}, p AS (SELECT d0, d1, lag(d0) OVER o AS q0, lag(d1) OVER o AS q1 FROM seq WINDOW o AS (PARTITION BY id ORDER BY ts, tie)) SELECT round(avg((pow(d0 - q0, 2) + pow(d1 - q1, 2)) / 2), 4) AS mse, round(avg((abs(d0 - q0) + abs(d1 - q1)) / 2), 6) AS mae, round(avg(CASE WHEN (d0 * d0 + d1 * d1) * (q0 * q0 + q1 * q1) > 0 THEN (d0 * q0 + d1 * q1) / (sqrt(d0 * d0 + d1 * d1) * sqrt(q0 * q0 + q1 * q1)) ELSE 0 END), 6) AS cosine FROM p WHERE q0 IS NOT NULL",
    "b24_context_split": f"WITH {SEQ}, n AS (SELECT tie, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY ts, tie) AS place FROM seq) SELECT tie AS event_id, CASE WHEN place <= greatest(2, floor(n * 0.7::DOUBLE)) THEN 'context' ELSE 'target' END AS part FROM n WHERE n >= 4",
    "c01_ema": f"WITH {SEQ}, l AS (SELECT *, lag(ts) OVER (PARTITION BY id ORDER BY ts, tie) AS t0, max(ts) OVER (PARTITION BY id) AS t FROM seq), w AS (SELECT *, exp(-(t - ts)) - coalesce(exp(-(t - t0)), 0) AS w FROM l), r AS (SELECT id, sum(w * d0) AS d0, sum(w * d1) AS d1 FROM w GROUP BY id) {unpivot('r', 'id')}",
    "c03_stream_salient": f"""WITH {SEQ}, l AS (SELECT *, lag(ts) OVER (PARTITION BY id ORDER BY ts, tie) AS t0, max(ts) OVER (PARTITION BY id) AS t FROM seq), w AS (SELECT *, exp(-(t - ts)) - coalesce(exp(-(t - t0)), 0) AS w FROM l),
r AS (SELECT id, count(*) AS n, sum(w * d0) AS d0, sum(w * d1) AS d1, avg(d0) AS m0, avg(d1) AS m1, stddev_samp(d0) AS s0, stddev_samp(d1) AS s1 FROM w GROUP BY id) SELECT id, unnest([0, 1])::INTEGER AS dim FROM r""",
    "c04_stream_predict": f"WITH seq0 AS (SELECT * FROM (WITH {SEQ} SELECT * FROM seq)), seq AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, tie DESC) AS r FROM seq0) WHERE r <= 10), {TREND.replace('exp(-(t - ts))', 'exp(-0.5 * (t - ts))')}, p AS (SELECT id, step::INTEGER AS step, l0 + t0 * step AS p0, l1 + t1 * step AS p1 FROM trend, range(1, 3) r(step)) {unpivot('p', 'id', 'step', dims=('p0', 'p1'))}",
}
