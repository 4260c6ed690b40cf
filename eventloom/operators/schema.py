"""Schema profiling, key discovery, value encoders, materialised timelines and triples.

Column profiles are one aggregate for each table. Triples come from one scan for each table: the edges of a row are exploded from an array
rather than read in a scan each. Choices that a sample without order would leave open are ordered by a hash of the value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import vectors as V
from eventloom.session import reach, small_enough, stored

#: Tables of more rows get approximate distinct counts.
EXACT_ROWS = 500_000
#: Distinct values that are compared to find foreign keys.
SAMPLE = 200
#: Values that one task makes distinct, about.
DISTINCT_ROWS = 1_000_000
IDS = r"key$"
NUMERIC = (T.NumericType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
BUCKETS = [(100, "tiny"), (10_000, "small"), (100_000, "medium"), (1_000_000, "large")]


def size_bucket(rows: Column) -> Column:
    out = F.when(rows < BUCKETS[0][0], BUCKETS[0][1])
    for limit, name in BUCKETS[1:]:
        out = out.when(rows < limit, name)
    return out.otherwise("xlarge")


def domain(name: Column) -> Column:
    """The first part of a table's name that is neither agg nor tb."""
    return F.element_at(F.filter(F.split(F.lower(name), "_"), lambda x: ~x.isin("agg", "tb")), 1)


def profile(df: DataFrame, table: str, approximate: bool | None = False) -> DataFrame:
    """(table, column, kind, rows, nulls, distinct_values, low, high, mean, exact): a row a column, from a single pass.

    Distinct counts are exact, or HyperLogLog's if ``approximate``; None says by the table's size (beyond ``EXACT_ROWS`` rows). ``exact`` says which.
    """
    if approximate is None:
        approximate = df.count() > EXACT_ROWS
    columns = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    parts = [F.count(F.lit(1)).alias("rows")]
    for k, f in enumerate(columns):
        c, text = F.col(f"`{f.name}`"), F.lit(None).cast("string")
        ordered = isinstance(f.dataType, (*NUMERIC, *TEMPORAL, T.StringType))
        distinct = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
        mean = F.avg(c).cast("double") if isinstance(f.dataType, NUMERIC) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.count_if(c.isNull()).alias("nulls"), distinct.alias("distinct_values"), (F.min(c).cast("string") if ordered else text).alias("low"), (F.max(c).cast("string") if ordered else text).alias("high"), mean.alias("mean")).alias(f"_{k}"))
    one = df.agg(*parts)
    return one.select(F.lit(table).alias("table"), "rows", F.explode(F.array(*[F.col(f"_{k}") for k in range(len(columns))])).alias("c")).select("table", "c.column", "c.kind", "rows", "c.nulls", "c.distinct_values", "c.low", "c.high", "c.mean", F.lit(not approximate).alias("exact"))


def keys(profiles: DataFrame, pattern: str = IDS) -> DataFrame:
    """``profiles`` with ``is_id``, ``primary`` and ``foreign``."""
    is_id = F.lower("column").rlike(pattern)
    return profiles.withColumns({"is_id": is_id, "primary": is_id & (F.col("distinct_values") == F.col("rows")) & (F.col("nulls") == 0), "foreign": is_id & (F.col("distinct_values") > 1) & (F.col("distinct_values") < 0.9 * F.col("rows"))})


def plain(column: str) -> str:
    """A key's name without its table's prefix, in lower case."""
    return re.sub(r"^[a-z]{1,2}_", "", column.lower())


def distinct_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = pa.Table.from_batches([batch]).group_by(["c", "value"]).aggregate([])
        yield from got.select(["c", "value"]).combine_chunks().to_batches()


def first_of(sample: int) -> Callable:
    """(c, value, digest, n) of a partition's distinct values: of each ``c`` the ``sample`` of the smallest digests, and a row with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, counts = None, {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            table = pa.Table.from_batches([batch])
            table = table if best is None else pa.concat_tables([best, table])
            table = table.sort_by([("c", "ascending"), ("digest", "ascending"), ("value", "ascending")]).combine_chunks()
            c = table["c"].to_numpy()
            best = table.filter(pa.array(np.arange(len(c)) - np.searchsorted(c, c) < sample))
        if best is not None:
            for batch in best.append_column("n", pa.array(np.zeros(best.num_rows, np.int64))).combine_chunks().to_batches():
                yield batch
            none = pa.array([None] * len(counts), pa.string())
            yield pa.record_batch([pa.array(list(counts), pa.int32()), none, none, pa.array(list(counts.values()), pa.int64())], names=["c", "value", "digest", "n"])

    return run


def foreign_keys(tables: dict[str, DataFrame], pattern: str = IDS, sample: int = SAMPLE) -> DataFrame:
    """(name, parent, child, overlap, confidence) for id columns of one name in two tables; the one of fewer distinct values is the parent.

    Each column is reduced to its ``sample`` distinct values of smallest md5, so that samples of equal columns are equal; confidence is the
    share of the smaller sample that is in the other.
    """
    columns = [(t, c) for t, df in sorted(tables.items()) for c in df.columns if re.search(pattern, c, re.I)]
    reach(next(iter(tables.values())).sparkSession)
    values = reduce(DataFrame.union, (tables[t].select(F.lit(k).alias("c"), F.col(c).cast("string").alias("value")).where("value is not null") for k, (t, c) in enumerate(columns)))
    rows = sum(tables[t].count() for t, _ in columns)
    parts = max(1, -(-rows // DISTINCT_ROWS))
    # repeats inside a batch go before the shuffle, the others inside their partition; a partition hands on its first ones and how many it has
    apart = values.mapInArrow(distinct_of_batches, "c int, value string").repartition(parts, "c", "value").distinct()
    firsts = stored(apart.select("c", "value", F.md5("value").alias("digest")).mapInArrow(first_of(sample), "c int, value string, digest string, n long"), "keys")
    n = firsts.groupBy("c").agg(F.sum("n").alias("n")).where("n > 1")
    first = firsts.where("value is not null").drop("n").withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("digest", "value"))).where(F.col("place") <= sample)
    names = F.array(*[F.struct(F.lit(plain(c)).alias("name"), F.lit(f"{t}.{c}").alias("column")) for t, c in columns])
    kept = stored(first.join(n, "c").select(names[F.col("c")].alias("_n"), "value", "n").select("_n.name", "_n.column", "value", "n"), "keys")
    a, b = kept.select("name", F.col("column").alias("parent"), "value", F.col("n").alias("na")), kept.select("name", F.col("column").alias("child"), "value", F.col("n").alias("nb"))
    pairs = a.join(b, ["name", "value"]).where("na < nb or (na = nb and parent < child)")
    least = F.least(F.lit(sample), F.col("na"), F.col("nb"))
    return pairs.groupBy("name", "parent", "child", "na", "nb").agg(F.count(F.lit(1)).alias("overlap")).select("name", "parent", "child", "overlap", (F.col("overlap") / least).alias("confidence"))


def fingerprint(counts: DataFrame) -> DataFrame:
    """One row: the first 16 hex digits of the SHA-256 of name:rows|name:rows..., names in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "rows"))), lambda x: F.concat_ws(":", x["name"], x["rows"].cast("string"))), "|")
    return counts.agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def temporal_tables(tables: dict[str, DataFrame], entities: list[str], times: list[str]) -> list[tuple[str, str, str, list[str]]]:
    """(table, entity column, time column, context columns) of the tables that have both; the first of each list wins, else the first temporal column."""
    out = []
    for name, df in sorted(tables.items()):
        held = {c.lower(): c for c in df.columns}
        entity = next((held[e.lower()] for e in entities if e.lower() in held), None)
        temporal = [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]
        time = next((held[t.lower()] for t in times if t.lower() in held), temporal[0] if temporal else None)
        if entity and time:
            out.append((name, entity, time, [c for c in df.columns if c not in (entity, time, "source_db")]))
    return out


def width(kind: T.DataType, is_time: bool = False, text_dims: int = 16) -> int:
    """How many dimensions a column takes."""
    return 6 if is_time or isinstance(kind, TEMPORAL) else text_dims if isinstance(kind, T.StringType) else 1


def encode_number(c: Column) -> Column:
    return F.coalesce(F.signum(c.cast("double")) * F.log1p(F.abs(c.cast("double"))) / 20.0, F.lit(0.0))


def encode_time(c: Column) -> Column:
    """Sine and cosine of the hour, the weekday (Monday 0) and the month."""
    turn = [F.hour(c) / 24.0, F.weekday(c) / 7.0, (F.month(c) - 1) / 12.0]
    flat = [F.coalesce(f(2 * F.pi() * x), F.lit(0.0)) for x in turn for f in (F.sin, F.cos)]
    return F.array(*flat)


def hash32(c: Column) -> Column:
    """The first 8 hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def encode_text(c: Column, d: int = 16) -> Column:
    """Signed counts of hashed character trigrams (of the whole text, lower case, trimmed) at length 1; zeros for null or empty."""
    text = F.trim(F.lower(c))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: hash32(F.substring(text, i, F.lit(3))))
    zeros = F.array_repeat(F.lit(0.0), d)

    def put(v: Column, h: Column) -> Column:
        at = (h % d).cast("int")
        return F.transform(v, lambda x, i: x + F.when(i == at, F.when(h >= 1 << 31, 1.0).otherwise(-1.0)).otherwise(0.0))

    return F.when(F.coalesce(c, F.lit("")) == "", zeros).otherwise(V.let(F.aggregate(grams, zeros, put), lambda v: V.unit(v)))


def encode_other(c: Column) -> Column:
    """A value's md5 as a number in [-1, 1): the first four bytes, little end first."""
    h = F.md5(c.cast("string"))
    turned = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return F.coalesce(F.conv(turned, 16, 10).cast("double") / 4294967296.0 * 2 - 1, F.lit(0.0))


def encode_column(field: T.StructField, text_dims: int = 16) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, TEMPORAL):
        return encode_time(c)
    if isinstance(field.dataType, T.BooleanType):
        return F.array(F.coalesce(c.cast("double"), F.lit(0.0)))
    if isinstance(field.dataType, NUMERIC):
        return F.array(encode_number(c))
    return encode_text(c, text_dims) if isinstance(field.dataType, T.StringType) else F.array(encode_other(c))


def project(vector: Column, source: int, target: int) -> Column:
    """Count-sketch of ``source`` dimensions in ``target``, each added with a sign; shorter vectors get zeros."""
    if source <= target:
        return F.concat(vector, F.array_repeat(F.lit(0.0), target - source))
    parts: list[list[Column]] = [[] for _ in range(target)]
    for i in range(source):
        h = ((i + 1) * 2654435761) & 0xFFFFFFFF
        parts[h % target].append(vector[i] if (h >> 16) & 1 else -vector[i])
    return F.array(*[reduce(lambda a, b: a + b, p) if p else F.lit(0.0) for p in parts])


def events_of(df: DataFrame, entity: str, time: str, context: list[str], table: str, d: int = 64) -> DataFrame:
    """(id, ts, embedding, source): the rows of a table with an entity and a time, encoded and projected."""
    fields = [df.schema[c] for c in context]
    whole = F.concat(*[encode_column(f) for f in fields]) if fields else F.array().cast("array<double>")
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    return rows.select(F.col(entity).cast("string").alias("id"), V.seconds(time).alias("ts"), V.let(whole, lambda v: project(v, sum(width(f.dataType) for f in fields), d)).alias("embedding"), F.lit(table).alias("source"))


def richest(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` ids with the most rows over all tables; ties by id."""
    return counts.groupBy("id").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "id").limit(n)


def newest(df: DataFrame, n: int, *tie: str) -> DataFrame:
    """The ``n`` newest events of each id."""
    w = Window.partitionBy("id").orderBy(F.desc("ts"), *tie)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def row_text(table: str, time: str, fields: list[T.StructField], longest: int = 48) -> Column:
    """[table|time] name=value ...: nulls left out, floats with two decimals, texts cut to ``longest``, booleans T or F."""
    parts = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            shown = F.format_string("%.2f", c)
        elif isinstance(f.dataType, T.BooleanType):
            shown = F.when(c, "T").otherwise("F")
        else:
            shown = F.substring(c.cast("string"), 1, longest)
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{f.name}="), shown)))
    return F.concat_ws(" ", F.concat(F.lit(f"[{table}|"), F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit("]")), *parts)


def joined_text(rows: DataFrame, longest: int = 3000) -> DataFrame:
    """(id, text): an id's newest lines, oldest first, as many as fit in ``longest`` characters with their line ends."""
    w = Window.partitionBy("id").orderBy(F.desc("ts"), "tie")
    kept = rows.withColumn("_size", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_size") <= longest + 1)
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "tie", "line"))), lambda x: x["line"]), "\n").alias("text"))


def triples(df: DataFrame, table: str, subject: str, objects: list[str], time: str, number: list[str] | None = None, instance: dict[str, Column] | None = None) -> DataFrame:
    """(subject_id, predicate, object_id, t_epoch[, numeric_value]) of one table, in a single scan.

    ``instance`` gives the prefix of id columns that are unique only inside a source. ``number`` lists columns of which the first non-null is taken (0 without any).
    """
    def node(c: str) -> Column:
        plain_id = F.concat(F.lit(f"{plain(c).removesuffix('key').upper()}_"), F.col(c).cast("string"))
        return F.concat(instance[c], F.lit("/"), plain_id) if instance and c in instance else plain_id

    edges = [F.when(F.col(o).isNotNull(), F.struct(F.lit(f"HAS_{plain(o).removesuffix('key').upper()}_VIA_{table}").alias("predicate"), node(o).alias("object_id"))) for o in objects]
    rows = df.where(F.col(subject).isNotNull() & F.col(time).isNotNull())
    value = [F.coalesce(*[F.col(c).cast("double") for c in number], F.lit(0.0)).alias("numeric_value")] if number is not None else []
    out = rows.select(node(subject).alias("subject_id"), F.explode(F.array_compact(F.array(*edges))).alias("e"), V.seconds(time).alias("t_epoch"), *value)
    return out.select("subject_id", "e.predicate", "e.object_id", "t_epoch", *(["numeric_value"] if value else []))


def dense_index(df: DataFrame, column: str, name: str = "index") -> DataFrame:
    """(column, index) of the distinct non-null values, numbered from 0 in order, without a sort in one partition.

    Range partitions are sorted and stored with their rows' places; the partitions' sizes, one row each, give what to add.
    """
    values = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    ranged = values.repartitionByRange(column).sortWithinPartitions(column)
    placed = stored(ranged.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "index")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(column, (F.col("_at") + F.col("_before")).alias(name))


def node_times(edges: DataFrame) -> DataFrame:
    """(node, t_epoch): the newest time of the edges at either end."""
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("node"), "t_epoch")
    return ends.groupBy("node").agg(F.max("t_epoch").alias("t_epoch"))


def neighbours(edges: DataFrame, k: int, seed: int = 42, of: DataFrame | None = None) -> DataFrame:
    """(node, neighbour): at most ``k`` neighbours of each node, those of the smallest hash of the pair and the seed.

    With ``of`` (a stored table of nodes) only theirs: edges of other nodes are passed over in the scan, if the nodes are few, and before the sort.
    """
    both = edges.select(F.col("subject_id").alias("node"), F.col("object_id").alias("neighbour")).union(edges.select("object_id", "subject_id"))
    if of is not None:
        both = both.join(F.broadcast(of) if small_enough(of) else of, "node", "left_semi")
    both = both.distinct()
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "node", "neighbour"))
    return both.withColumn("_place", F.row_number().over(Window.partitionBy("node").orderBy(order))).where(F.col("_place") <= k).drop("_place")


def hops(edges: DataFrame, start: DataFrame, sizes: list[int], seed: int = 42) -> DataFrame:
    """(node, hop): what sampled neighbours reach from ``start`` (a column node), each node at its first hop.

    A hop looks for the neighbours of the nodes just reached only.
    """
    start = stored(start.select("node").distinct(), "start")
    seen = at = start.withColumn("hop", F.lit(0))
    for h, k in enumerate(sizes, 1):
        reached = stored(at.select("node"), "frontier")
        near = neighbours(edges, k, seed, reached)
        at = stored(near.select(F.col("neighbour").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(h)), "hop")
        seen = seen.union(at)
    return seen


def json_safe(df: DataFrame, *columns: str) -> Column:
    """The columns as a JSON object; NaN and infinite numbers as texts."""
    parts = []
    for c in columns:
        kind = df.schema[c].dataType
        odd = F.col(c).isNull() if not isinstance(kind, (T.DoubleType, T.FloatType)) else F.isnan(c) | F.abs(F.col(c)).eqNullSafe(F.lit(float("inf")))
        parts.append(F.concat(F.lit(f'"{c}":'), F.when(F.col(c).isNull(), "null").when(odd, F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.get(F.split(F.substring(F.to_json(F.struct(F.col(c).alias("v"))), 6, 1_000_000_000), r"}$"), 0))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
