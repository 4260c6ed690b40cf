"""Mixing sources to target weights.

The tokens of each source give its repetition rate, (weight / all weights) * budget / tokens of the source. Each document is emitted
floor(rate) times and once more with probability rate - floor(rate), drawn from a hash of the seed and its id.

A token is a longest run of characters other than space, tab and line ends. Defined cases: a null source is a source of its own; sources
that ``weights`` doesn't name have ``default``; a source without tokens can't reach a weight, so its documents are not emitted and it is left
out of the sum of weights; a null or empty text counts no tokens and is emitted at the rate of its source; a null id draws by its text;
repeated rows draw alike, each. Further columns pass through whatever their names and types; ids may be of any type that has a text form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import columns_of, named, small_enough, stored
from eventloom.session import unused


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(named(text), F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, budget: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tokens, rate) of each source; ``budget`` is what to emit, as a multiple of all tokens."""
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = docs.select(named(source).alias("source"), tokens(text).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0")
    per = stored(per.withColumn("weight", weight), "sources")
    whole = per.agg(F.sum("tokens").alias("all_tokens"), F.sum("weight").alias("all_weights"))
    rate = F.col("weight") * (F.lit(float(budget)) * F.col("all_tokens")) / (F.col("all_weights") * F.col("tokens"))
    return per.crossJoin(F.broadcast(whole)).select("source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, budget: float = 1.0, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", copies: str | None = None) -> DataFrame:
    """The documents as often as their sources' rates say, with the number of the copy (from 1) in column ``copies`` if named.

    Two scans and no shuffle of texts: the rates are broadcast up to ``BROADCAST_ROWS`` sources, and joined by a shuffle beyond.
    """
    s, r, n = (unused(docs, x) for x in ("_source", "_rate", "_copies"))
    per = stored(rates(docs, weights, default, budget, source, text), "rates").select(F.col("source").alias(s), F.col("rate").alias(r))
    joined = docs.join(F.broadcast(per) if small_enough(per) else per, named(source).eqNullSafe(F.col(s)))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(named(key).cast("string"), F.md5(named(text)), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    times = F.floor(r) + F.when(drawn < F.col(r) - F.floor(r), 1).otherwise(0)
    out = unused(docs, copies or "_copy")
    many = joined.withColumn(n, times.cast("int")).where(F.col(n) > 0).select(*columns_of(docs), F.explode(F.sequence(F.lit(1), F.col(n))).alias(out))
    return many if copies else many.select(*columns_of(docs))
