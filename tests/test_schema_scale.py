"""Keys, hops and counts: what one task holds doesn't grow with the table."""

import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.operators import schema as S
from eventloom.plans import registry


def test_first_of_hands_on_a_sample_of_each_column_and_counts():
    batches = [pa.record_batch([pa.array([k % 2 for k in range(a, a + 50)], pa.int32()), pa.array([str(k) for k in range(a, a + 50)]), pa.array([f"{(k * 37) % 1000:04d}" for k in range(a, a + 50)])], names=["c", "value", "digest"]) for a in range(0, 1000, 50)]
    got = [r for b in S.first_of(5)(iter(batches)) for r in b.to_pylist()]
    want = sorted((k % 2, f"{(k * 37) % 1000:04d}", str(k)) for k in range(1000))
    firsts = [w for c in (0, 1) for w in [x for x in want if x[0] == c][:5]]
    assert sorted((r["c"], r["digest"], r["value"]) for r in got if r["value"]) == firsts
    assert {r["c"]: r["n"] for r in got if r["value"] is None} == {0: 500, 1: 500} and len(got) == 12


def test_keys_are_made_distinct_in_parts(spark, monkeypatch):
    """As before in parts of 1,000 values: nothing depends on how many there are."""
    a, b = spark.range(5000).select(F.col("id").alias("x_key")), spark.range(0, 9000, 2).select(F.col("id").cast("int").alias("y_key")).union(spark.range(50).select(F.lit(None).cast("int")))
    whole = S.foreign_keys({"a": a, "b": b}).collect()
    monkeypatch.setattr(S, "DISTINCT_ROWS", 1000)
    assert S.foreign_keys({"a": a, "b": b}).collect() == whole and len(whole) == 1 and whole[0].parent == "b.y_key"


def test_hops_sort_the_neighbours_of_reached_nodes_only(spark, monkeypatch):
    rows = [(f"s{i}", f"o{i % 40}") for i in range(400)]
    edges, seen, real = spark.createDataFrame(rows, "subject_id string, object_id string"), [], S.neighbours

    def neighbours(edges, k, seed=42, of=None):
        near = real(edges, k, seed, of)
        seen.append(near.select("node").distinct().count())
        assert set(near.collect()) == set(real(edges, k, seed).join(of, "node", "left_semi").collect())
        return near

    monkeypatch.setattr(S, "neighbours", neighbours)
    start = spark.createDataFrame([("o1",), ("o2",)], "node string")
    got = {r.node: r.hop for r in S.hops(edges, start, [3, 2]).collect()}
    assert seen == [2, 6] and sorted(got.values()) == [0] * 2 + [1] * 6


def test_no_sketch_is_kept_for_each_value(spark, sf):
    """The sketch's aggregate isn't one of the distinct values."""
    plan = registry.queries()["j07_approximate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan and not [line for line in plan.splitlines() if "keys=[l_partkey" in line and "approx_count_distinct" in line]
