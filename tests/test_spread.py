"""Timelines, trajectories and table functions: memory and reads of a task don't follow the table's size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import population as P
from eventloom.operators import sequences as S
from eventloom.plans import q_schema, registry
from eventloom.plans import q_sequences as QS

Q = registry.queries()


def used(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["b04_multilevel", "b06_fuse_levels", "f16_process_timelines", "f17_timeline_summary"])
def test_sequences_take_tasks_by_their_events(spark, sf, monkeypatch, name):
    whole = sorted(map(str, Q[name](spark, sf).collect()))
    monkeypatch.setattr(S, "TASK_ROWS", 100)
    source = q_schema.timelines(spark, sf) if name[0] == "f" else S.spread(QS.sequences(spark, sf))
    assert used(source) >= 5
    assert len(Q[name](spark, sf).collect()) == len(whole)
    if name[0] == "b":
        assert used(Q[name](spark, sf)) >= 5


def test_moves_give_the_trajectories(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(int(rng.integers(0, 8)), i, i % 23) for i in range(120)], "who long, at long, vec_id long")
    vectors = spark.createDataFrame([(k, [float(np.float32(x)) for x in rng.normal(size=3)] if k % 7 else None) for k in range(20)], "vec_id long, embedding array<float>")
    old = P.trajectories(rows.join(vectors.withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id"), "who", ["at"])
    new = P.with_deltas(P.moves(rows, vectors, "vec_id", "who", ["at"]), vectors, "vec_id")
    pick = lambda df: sorted((r["at"], r.visit, r.before, r.delta) for r in df.where("embedding is not null").collect())
    assert pick(new) == pick(old) and new.count() == old.count() > 50
    assert "embedding" not in P.moves(rows, vectors, "vec_id", "who", ["at"]).columns


def test_few_means_are_broadcast(spark, sf):
    plan = Q["e12_anomalous_trajectories"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [o_orderpriority" in plan and "SortMergeJoin [o_orderpriority" not in plan


def test_the_table_function_sees_distinct_texts(spark, sf):
    plan = Q["l01_extensions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[" in plan.split("PythonUDTF", 1)[1]
