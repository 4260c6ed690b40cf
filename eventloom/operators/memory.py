"""Memories of graph nodes over batches of timed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def messages(edges: DataFrame, seconds: float, value: str = "numeric_value") -> DataFrame:
    """(node, batch, n, message, last): the mean of the values of the edges at either end of a node, by batch of ``seconds`` of time.

    An edge to itself counts once. The mean combines on the map side, so a node that has most edges is no bottleneck.
    """
    batch = F.floor(F.col("t_epoch") / F.lit(float(seconds)))
    ends = edges.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("node"), batch.alias("batch"), "t_epoch", F.col(value).cast("double").alias("v"))
    return ends.where("node is not null and batch is not null").groupBy("node", "batch").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("message"), F.max("t_epoch").alias("last"))


def memories(edges: DataFrame, seconds: float, gate: float = 0.5, value: str = "numeric_value") -> DataFrame:
    """(node, batches, memory, last): each node's memory after its last batch, memory <- (1 - gate) memory + gate message, from 0.

    In closed form: the message of the k-th batch from the end has weight gate (1 - gate)^(k - 1).
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("batch")))
    weighted = messages(edges, seconds, value).withColumn("_w", F.lit(float(gate)) * F.pow(F.lit(1.0 - gate), place - 1))
    return weighted.groupBy("node").agg(F.count(F.lit(1)).alias("batches"), F.sum(F.col("_w") * F.coalesce("message", F.lit(0.0))).alias("memory"), F.max("last").alias("last"))
