"""Building blocks of the KPI queries: stays, returns, last states, buckets, excess over a group's median, categories of texts.

A visit has an entity, a begin and an end; a missing end is an open case, which counts up to ``as_of`` (a parameter, so results don't change
from day to day). Aggregates are conditional sums in one pass over the visits; medians are the only ones without map-side combining.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stay(begin: Column | str, end: Column | str, as_of: str) -> Column:
    """Days from begin to end, by calendar dates; an open case ends at ``as_of``."""
    return F.date_diff(F.coalesce(F.to_date(end), F.lit(as_of).cast("date")), F.to_date(begin)).cast("long")


def with_returns(df: DataFrame, entity: str, begin: str, end: str, key: str, within: int = 30) -> DataFrame:
    """``df`` with ``gap`` (days since the entity's previous end) and ``returned`` (1 to ``within`` days; null without a previous visit)."""
    w = Window.partitionBy(entity).orderBy(begin, key)
    gap = F.date_diff(F.to_date(begin), F.to_date(F.lag(end).over(w))).cast("long")
    return df.withColumn("gap", gap).withColumn("returned", F.col("gap").between(1, within))


def with_next(df: DataFrame, entity: str, begin: str, end: str, key: str, within: int = 30) -> DataFrame:
    """``df`` with ``next_begin`` of the entity and ``back``: whether it is at most ``within`` days after the end."""
    w = Window.partitionBy(entity).orderBy(begin, key)
    return df.withColumn("next_begin", F.lead(begin).over(w)).withColumn("back", F.coalesce(F.date_diff(F.to_date("next_begin"), F.to_date(end)).between(0, within), F.lit(False)))


def with_sequence(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """``df`` with ``visit_no`` from 1, and ``visits`` of the entity in all."""
    return df.withColumn("visit_no", F.row_number().over(Window.partitionBy(entity).orderBy(*order)).cast("long")).withColumn("visits", F.count(F.lit(1)).over(Window.partitionBy(entity)))


def latest(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each group by ``order`` (the last of which must break ties): an aggregate that combines on the map side, no sort."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_last")).select(*by, "_last.*")


def bucket(value: Column | str, edges: list[float]) -> Column:
    """The number of the edges that ``value`` reaches: 0 under the first one; null for null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges]))


def excess(df: DataFrame, by: str, value: str, factor: float = 2.0, least: int = 10) -> DataFrame:
    """Rows over ``factor`` times the median of their group (of at least ``least`` rows), with ``med`` and ``over`` = value - median."""
    medians = df.groupBy(by).agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(medians, by).where(F.col(value) > factor * F.col("med")).withColumn("over", F.col(value) - F.col("med"))


def share(condition: Column, of: Column | None = None) -> Column:
    """Aggregate: the percentage of rows with ``condition`` among those with ``of`` (null without any)."""
    total = F.count(F.lit(1)) if of is None else F.count_if(of)
    hit = F.count_if(condition if of is None else condition & of)
    return 100.0 * hit / F.nullif(total, F.lit(0))


def category(text: Column | str, exact: dict[str, str], rules: list[tuple[str, str]], empty: str = "undefined", other: str = "other") -> Column:
    """The class of a text: without accents and in upper case it is looked up, then searched by the ordered keyword rules."""
    text = F.col(text) if isinstance(text, str) else text
    folded = F.translate(F.upper(F.trim(text)), "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN")
    out = F.when(F.coalesce(folded, F.lit("")) == "", empty)
    for word, name in exact.items():
        out = out.when(folded == word, name)
    for word, name in rules:
        out = out.when(folded.contains(word), name)
    return out.otherwise(other)


def traffic_light(*rates: tuple[Column, float]) -> Column:
    """red if any rate is over its limit, amber if one is over half of it, else green."""
    red = reduce(lambda a, b: a | b, [F.coalesce(r > limit, F.lit(False)) for r, limit in rates])
    amber = reduce(lambda a, b: a | b, [F.coalesce(r > limit / 2, F.lit(False)) for r, limit in rates])
    return F.when(red, "red").when(amber, "amber").otherwise("green")


def overlapping(df: DataFrame, begin: str, end: str, first: str, last: str) -> DataFrame:
    """Rows whose interval meets the days ``first`` to ``last``; a missing end is open."""
    return df.where((F.to_date(begin) <= F.lit(last).cast("date")) & (F.col(end).isNull() | (F.to_date(end) >= F.lit(first).cast("date"))))
