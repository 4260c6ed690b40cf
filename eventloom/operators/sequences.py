"""Event sequences: time windows, recency-weighted aggregation over levels, salient dimensions, trend and extrapolation.

A sequence table has the columns id, ts (double), embedding (array<double> of ``d`` values), modality, and ``tie`` to order equal ts. All
operators partition by id alone, so that a chain of them needs one shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventloom.functions import vectors as V


def by_id() -> WindowSpec:
    return Window.partitionBy("id")


def in_order() -> WindowSpec:
    return Window.partitionBy("id").orderBy("ts", "tie")


#: Events of a task, about.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` partitioned by id in as many parts as its events need: windows and groups by id that follow stay in them, and a task's memory doesn't
    grow with the table (adaptive execution joins small partitions by their compressed size, which says little about what a chain of sorts holds)."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), "id")


def from_table(df: DataFrame, columns: dict[str, str], tie: str | None = None) -> DataFrame:
    """A table as sequences: ``columns`` maps id, ts, embedding and perhaps modality to names; a missing one raises ``ValueError``."""
    missing = [v for k, v in columns.items() if v not in df.columns] + [k for k in ("id", "ts", "embedding") if k not in columns]
    if missing:
        raise ValueError(f"Required columns not found: {missing}")
    ts = F.col(columns["ts"])
    ts = V.seconds(ts) if dict(df.dtypes)[columns["ts"]].startswith("timestamp") else ts.cast("double")
    modality = F.col(columns["modality"]).cast("string") if "modality" in columns else F.lit("text")
    first = F.col(tie) if tie else F.xxhash64(columns["embedding"])
    out = df.select(F.col(columns["id"]).cast("string").alias("id"), ts.alias("ts"), F.col(columns["embedding"]).cast("array<double>").alias("embedding"), modality.alias("modality"), first.alias("tie"))
    return out.withColumn("modality", F.first("modality").over(in_order()))


def decay(alpha: Column | float, newest: Column, ts: Column) -> Column:
    return F.exp(-(F.lit(alpha) if isinstance(alpha, (int, float)) else alpha) * (newest - ts))


def weighted_aggregate(df: DataFrame, d: int, alpha: Column | float = 1.0, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Exponentially decayed mean of each group, with the time of its newest event."""
    keyed = df.withColumn("_newest", F.max("ts").over(Window.partitionBy(*by)))
    keyed = keyed.withColumn("_w", decay(alpha, F.col("_newest"), F.col("ts")))
    return keyed.groupBy(*by).agg(F.max("ts").alias("ts"), V.weighted_mean("embedding", "_w", d).alias("embedding"))


def adaptive_windows(df: DataFrame) -> DataFrame:
    """``df`` with ``window``: a new one begins where the gap is larger than the median gap of the sequence."""
    gaps = df.withColumn("_gap", F.col("ts") - F.lag("ts").over(in_order()))
    marked = gaps.withColumn("_median", F.median("_gap").over(by_id()))
    opens = F.sum(F.when(F.col("_gap") > F.col("_median"), 1).otherwise(0)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("window", opens).drop("_gap", "_median")


def fixed_windows(df: DataFrame) -> DataFrame:
    """``df`` with ``window``: max(2, n // 2) bins of equal width; equal times all fall in bin 0."""
    bins = F.greatest(F.lit(2), F.floor(F.count(F.lit(1)).over(by_id()) / 2))
    low, high = F.min("ts").over(by_id()), F.max("ts").over(by_id())
    wide = df.withColumn("_low", low).withColumn("_high", high).withColumn("_bins", bins)
    place = F.floor((F.col("ts") - F.col("_low")) / ((F.col("_high") - F.col("_low")) / F.col("_bins")))
    return wide.withColumn("window", F.when(F.col("_high") == F.col("_low"), F.lit(0)).otherwise(F.least(place, F.col("_bins") - 1)).cast("long")).drop("_low", "_high", "_bins")


def windows(df: DataFrame, resolution: str = "adaptive") -> DataFrame:
    return adaptive_windows(df) if resolution == "adaptive" else fixed_windows(df)


@dataclass
class Config:
    """How sequences are processed; ``resolutions``, ``alphas`` and ``offsets`` by modality count only if ``modality_aware``."""

    levels: int = 1
    resolution: str = "adaptive"
    modality_aware: bool = False
    resolutions: dict[str, str] = field(default_factory=dict)
    alphas: dict[str, float] = field(default_factory=dict)
    offsets: dict[str, list[float]] = field(default_factory=dict)

    def alpha(self) -> Column | float:
        if not self.modality_aware or not self.alphas:
            return 1.0
        out = F.lit(1.0)
        for m, a in self.alphas.items():
            out = F.when(F.col("modality") == m, F.lit(float(a))).otherwise(out)
        return out

    def with_offset(self, df: DataFrame) -> DataFrame:
        if not self.modality_aware:
            return df
        moved = F.col("embedding")
        for m, off in self.offsets.items():
            moved = F.when(F.col("modality") == m, V.add("embedding", F.array(*[F.lit(float(x)) for x in off]))).otherwise(moved)
        return df.withColumn("embedding", moved)

    def windowed(self, df: DataFrame) -> DataFrame:
        names = {self.resolutions.get(m, self.resolution) for m in self.resolutions} | {self.resolution} if self.modality_aware else {self.resolution}
        if len(names) == 1:
            return windows(df, names.pop())
        which = F.lit(self.resolution)
        for m, r in self.resolutions.items():
            which = F.when(F.col("modality") == m, F.lit(r)).otherwise(which)
        both = fixed_windows(adaptive_windows(df).withColumnRenamed("window", "_adaptive"))
        return both.withColumn("window", F.when(which == "adaptive", F.col("_adaptive")).otherwise(F.col("window"))).drop("_adaptive")


def multilevel(df: DataFrame, d: int, config: Config | None = None) -> DataFrame:
    """(id, level, embedding) for level 0 .. levels: each level aggregates windows of the one before; the last is one more aggregate.

    The windows of a level are the events of the next one. Levels are few and known, so the plan is unrolled; it has one shuffle.
    """
    config = config or Config()
    events, out = config.with_offset(df), []
    for level in range(config.levels):
        cut = config.windowed(events)
        keyed = cut.withColumn("_newest", F.max("ts").over(Window.partitionBy("id", "window"))).withColumn("_w", decay(config.alpha(), F.col("_newest"), F.col("ts")))
        grouped = keyed.groupBy("id", "window").agg(F.max("ts").alias("ts"), F.first("modality").alias("modality"), V.weighted_mean("embedding", "_w", d).alias("embedding"))
        events = grouped.withColumnRenamed("window", "tie")
        out.append(final(events, d, config).withColumn("level", F.lit(level)))
    out.append(final(events, d, config).withColumn("level", F.lit(config.levels)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("id", "level", "embedding")


def final(events: DataFrame, d: int, config: Config) -> DataFrame:
    return weighted_aggregate(events, d, config.alpha())


def representation(df: DataFrame, d: int, config: Config | None = None) -> DataFrame:
    """(id, embedding): the last level of ``multilevel``, without computing the others' aggregates."""
    config = config or Config()
    events = config.with_offset(df)
    for _ in range(config.levels):
        cut = config.windowed(events)
        keyed = cut.withColumn("_newest", F.max("ts").over(Window.partitionBy("id", "window"))).withColumn("_w", decay(config.alpha(), F.col("_newest"), F.col("ts")))
        grouped = keyed.groupBy("id", "window").agg(F.max("ts").alias("ts"), F.first("modality").alias("modality"), V.weighted_mean("embedding", "_w", d).alias("embedding"))
        events = grouped.withColumnRenamed("window", "tie")
    return final(events, d, config).select("id", "embedding")


def fuse(levels: DataFrame, d: int) -> DataFrame:
    """(id, embedding): the mean of all levels (the last one is there twice)."""
    return levels.groupBy("id").agg(V.mean("embedding", d).alias("embedding"))


def salient(vector: Column | str, threshold: float = 1.5, fallback: int = 5) -> Column:
    """Dimensions whose z-score (population deviation) is above ``threshold``; with fewer than two, the largest by magnitude.

    Without deviation the first ``fallback``; of fewer than two values all.
    """
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))

    def chosen(s: Column) -> Column:
        v, mu, sd, n = s.getField("v"), s.getField("mu"), s.getField("sd"), F.size(s.getField("v"))
        places = F.sequence(F.lit(0), n - 1)
        hits = F.filter(places, lambda i: F.abs(v[i] - mu) / sd > threshold)
        ranked = F.array_sort(F.transform(places, lambda i: F.struct((-F.abs(v[i])).alias("m"), i.alias("i"))))
        largest = F.transform(F.slice(ranked, 1, fallback), lambda x: x.getField("i"))
        many = V.let(hits, lambda h: F.when(F.size(h) < 2, largest).otherwise(h))
        return F.when(n < 1, F.array().cast("array<int>")).when(n < 2, places).when(sd == 0, F.slice(places, 1, fallback)).otherwise(many)

    def spread(s: Column) -> Column:
        v, mu = s.getField("v"), s.getField("mu")
        total = F.aggregate(v, F.lit(0.0), lambda t, x: t + (x - mu) * (x - mu))
        return F.struct(v.alias("v"), mu.alias("mu"), F.sqrt(total / F.size(v)).alias("sd"))

    centred = V.let(v, lambda x: F.struct(x.alias("v"), (F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / F.size(x)).alias("mu")))
    return V.let(V.let(centred, spread), chosen)


def trend(df: DataFrame, d: int, alpha: float = 1.0) -> DataFrame:
    """(id, n, last, last_ts, trend): decayed mean of the steps between consecutive events, and the newest event."""
    moves = df.withColumn("_before", F.lag("embedding").over(in_order())).withColumn("_newest", F.max("ts").over(by_id())).withColumn("_place", F.row_number().over(in_order()))
    w = F.when(F.col("_before").isNotNull(), decay(alpha, F.col("_newest"), F.col("ts"))).otherwise(0.0)
    total = F.when(F.sum(w) > 0, F.sum(w)).otherwise(1.0)
    steps = [F.coalesce(F.sum(w * (F.col("embedding")[i] - F.col("_before")[i])), F.lit(0.0)) / total for i in range(d)]
    return moves.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("embedding", "_place").alias("last"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), F.array(*steps).alias("trend"))


def predict_next(df: DataFrame, d: int, steps: int = 1, alpha: float = 1.0) -> DataFrame:
    """(id, step, prediction): last + trend * step for step 1 .. steps; a single event repeats itself."""
    got = trend(df, d, alpha).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return got.select("id", "step", F.zip_with("last", "trend", lambda x, t: x + t * F.col("step")).alias("prediction"))


def position_encoding(t: Column, d: int) -> Column:
    """Sinusoidal encoding of a time: sine on even places, cosine on odd ones."""
    return F.array(*[(F.sin if i % 2 == 0 else F.cos)(t / F.lit(10000.0 ** ((i - i % 2) / d))) for i in range(d)])


def predict_at(df: DataFrame, d: int, targets: list[float], alpha: float = 1.0) -> DataFrame:
    """(id, target, prediction) at times ``targets`` after the last event: the trend by average gaps, modulated by the encoding of the time."""
    got = trend(df, d, alpha).withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    gap = F.when(F.col("n") > 1, (F.col("last_ts") - F.col("first_ts")) / (F.col("n") - 1)).otherwise(0.0)
    away = F.col("target")
    moved = got.withColumn("_dt", away / F.when(gap > 0, gap).otherwise(1.0)).withColumn("_pe", position_encoding(away, d))
    out = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.col("last")[i] + F.col("trend")[i] * F.col("_dt") * (1 + 0.1 * F.col("_pe")[i]))
    return moved.select("id", "target", out.alias("prediction"))


def temporal_distances(context: DataFrame, masked: DataFrame) -> DataFrame:
    """(id, ts, distance) of each masked event to the nearest context event of its sequence.

    The nearest one is the last before or the first after: two running windows over the union, not a join of all pairs.
    """
    both = context.select("id", "ts", F.lit(True).alias("_c")).unionByName(masked.select("id", "ts", F.lit(False).alias("_c")))
    at = F.when(F.col("_c"), F.col("ts"))
    before = F.max(at).over(Window.partitionBy("id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(at).over(Window.partitionBy("id").orderBy("ts").rangeBetween(0, Window.unboundedFollowing))
    return both.withColumn("_b", before).withColumn("_a", after).where("not _c").select("id", "ts", F.least(F.col("ts") - F.col("_b"), F.col("_a") - F.col("ts")).alias("distance"))


def dense_loss(pairs: DataFrame, d: int, lam: float = 0.5, floor: float = 1.0) -> DataFrame:
    """One row: mean L1 error of (predicted, actual), weighted by lam / sqrt(max(distance, floor)); 0 without weight."""
    error = sum((F.abs(F.col("predicted")[i] - F.col("actual")[i]) for i in range(d)), F.lit(0.0)) / d
    w = F.lit(float(lam)) / F.sqrt(F.greatest(F.col("distance"), F.lit(float(floor))))
    return pairs.agg(F.when(F.sum(w) > 0, F.sum(w * error) / F.sum(w)).otherwise(0.0).alias("loss"))


def warm_up(step: Column, most: float, start: float, end: float) -> Column:
    """0 before ``start``, then linear, ``most`` from ``end``."""
    return F.when(step < start, 0.0).when(step >= end, float(most)).otherwise(F.lit(float(most)) * (step - start) / (end - start))


def learning_rate(step: Column, base: float, warm: int, steady: int, cool: int, least: float = 0.0) -> Column:
    """Linear warm-up, constant, then a cosine down to ``least``."""
    share = F.least((step - (warm + steady)) / F.lit(float(max(cool, 1))), F.lit(1.0))
    return F.when(step < warm, F.lit(base) * (step + 1) / F.lit(float(max(warm, 1)))).when(step < warm + steady, F.lit(base)).otherwise(F.lit(least) + 0.5 * (base - least) * (1 + F.cos(F.lit(math.pi) * share)))


def sliding(df: DataFrame, context: int, steps: int) -> DataFrame:
    """(id, place, context, target): complete windows of ``context`` events and the ``steps`` that follow."""
    frame = in_order().rowsBetween(0, context + steps - 1)
    got = df.select("id", F.row_number().over(in_order()).alias("place"), F.collect_list("embedding").over(frame).alias("_all"))
    return got.where(F.size("_all") == context + steps).select("id", "place", F.slice("_all", 1, context).alias("context"), F.slice("_all", context + 1, steps).alias("target"))


def prediction_metrics(pairs: DataFrame, d: int) -> DataFrame:
    """One row: mse, mae and mean cosine of (predicted, actual)."""
    p, a = F.col("predicted"), F.col("actual")
    squares = sum((F.pow(p[i] - a[i], 2.0) for i in range(d)), F.lit(0.0)) / d
    absolute = sum((F.abs(p[i] - a[i]) for i in range(d)), F.lit(0.0)) / d
    return pairs.agg(F.avg(squares).alias("mse"), F.avg(absolute).alias("mae"), F.avg(V.cosine(p, a, d)).alias("cosine"))


def split_context(df: DataFrame, ratio: float) -> DataFrame:
    """``df`` with ``part``: 'context' for the first max(2, int(n * ratio)) events, 'target' for the rest; sequences of under 4 are left out."""
    n = F.count(F.lit(1)).over(by_id())
    got = df.withColumn("_n", n).withColumn("_place", F.row_number().over(in_order())).where("_n >= 4")
    return got.withColumn("part", F.when(F.col("_place") <= F.greatest(F.lit(2), F.floor(F.col("_n") * ratio)), "context").otherwise("target")).drop("_n", "_place")


def relational_aggregate(df: DataFrame, d: int, primary: str, alpha: float = 1.0, related: float = 0.5) -> DataFrame:
    """Decayed mean over times scaled to [0, 1], with weight 1 for events of type ``primary`` and ``related`` for others."""
    low, high = F.min("ts").over(by_id()), F.max("ts").over(by_id())
    scaled = df.withColumn("_t", F.when(high > low, (F.col("ts") - low) / (high - low)).otherwise(1.0))
    w = decay(alpha, F.lit(1.0), F.col("_t")) * F.when(F.col("kind") == primary, 1.0).otherwise(related)
    return scaled.withColumn("_w", w).groupBy("id").agg(V.weighted_mean("embedding", "_w", d).alias("embedding"))


def ema(df: DataFrame, d: int, alpha: float = 1.0) -> DataFrame:
    """(id, n, last_ts, embedding): the incremental average e <- q e + (1 - q) v with q = exp(-alpha dt), without a sequential pass.

    The decays telescope: an event's weight is exp(-alpha (t_n - t_i)) - exp(-alpha (t_n - t_(i-1))), and the first one's the former alone.
    """
    lagged = df.withColumn("_t0", F.lag("ts").over(in_order())).withColumn("_newest", F.last("ts").over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    w = decay(alpha, F.col("_newest"), F.col("ts")) - F.when(F.col("_t0").isNotNull(), decay(alpha, F.col("_newest"), F.col("_t0"))).otherwise(0.0)
    vector = F.array(*[F.sum(F.col("_w") * F.col("embedding")[i]) for i in range(d)])
    return lagged.withColumn("_w", w).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("_newest").alias("last_ts"), vector.alias("embedding"))


def stream_salient(df: DataFrame, d: int, alpha: float = 1.0, threshold: float = 1.5, fallback: int = 5) -> DataFrame:
    """(id, dim): dimensions where the average is more than ``threshold`` sample deviations from the mean of the events.

    Fewer than two: the ``fallback`` largest by magnitude; fewer than two events: the first ``fallback``.
    """
    stats = df.groupBy("id").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(d)]).alias("_mu"), F.array(*[F.stddev_samp(F.col("embedding")[i]) for i in range(d)]).alias("_sd"))
    got = ema(df, d, alpha).join(stats, "id")
    places = F.sequence(F.lit(0), F.lit(d - 1))
    hits = F.filter(places, lambda i: (F.col("_sd")[i] > 0) & (F.abs(F.col("embedding")[i] - F.col("_mu")[i]) / F.col("_sd")[i] > threshold))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct((-F.abs(F.col("embedding")[i])).alias("m"), i.alias("i"))))
    chosen = F.when(F.col("n") < 2, F.slice(places, 1, fallback)).when(F.size(hits) < 2, F.transform(F.slice(ranked, 1, fallback), lambda s: s.getField("i"))).otherwise(hits)
    return got.select("id", F.explode(chosen).alias("dim"))


def process(df: DataFrame, d: int, config: Config | None = None, steps: int = 3) -> DataFrame:
    """(id, representation, patterns, predictions) of each sequence."""
    rep = representation(df, d, config).withColumnRenamed("embedding", "representation")
    nexts = predict_next(df, d, steps).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "prediction"))), lambda s: s.getField("prediction")).alias("predictions"))
    return rep.join(nexts, "id").select("id", "representation", salient("representation").alias("patterns"), "predictions")
