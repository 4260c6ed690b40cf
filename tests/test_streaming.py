import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import sequences as S
from eventloom.streaming import buffer, incremental
from eventloom.streaming.incremental import Incremental
from eventloom.streaming.triggers import Cascade, Level, Rule, TriggerEngine, register_action, windowed

SCHEMA = "id string, ts double, embedding array<double>, modality string, tie long"


def test_incremental_average():
    s = Incremental(0.5)
    for v, t in (([1, 0], 1), ([0.5, 0.5], 2), ([0, 1], 3)):
        s.update(v, t)
    assert s.rep == pytest.approx([0.487205, 0.512795], abs=1e-6)
    before = s.rep.copy()
    s.update([9, 9], 3)
    assert s.rep == pytest.approx(before)
    late = s.rep.copy()
    s.update([5, 5], 1)
    assert s.rep == pytest.approx(late) and s.n == 5


def test_batch_snapshot_and_prediction():
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=(30, 4)), np.sort(rng.uniform(0, 9, 30))
    one, two = Incremental(), Incremental()
    for v, w in zip(x, t):
        one.update(v, w)
    two.update_batch(x[:10], t[:10])
    two = Incremental.restored(two.snapshot())
    two.update_batch(x[10:], t[10:])
    order = rng.permutation(30)
    three = Incremental.of(x[order], t[order])
    assert one.rep == pytest.approx(two.rep) and one.rep == pytest.approx(three.rep)
    assert one.m2 / 29 == pytest.approx(x.var(0, ddof=1)) and one.salient() == two.salient()
    w = np.exp(-(t[-1] - t[1:]))
    assert one.predict(2)[1] == pytest.approx(x[-1] + 2 * (np.diff(x, axis=0) * w[:, None]).sum(0) / w.sum())
    assert len(Incremental().update_batch([], [])) == 0 and Incremental().predict() == []
    one.reset()
    assert one.n == 0


def test_buffer():
    b = buffer.StreamBuffer(3)
    assert [b.add([k], float(k)) is None for k in range(3)] == [True, True, False]
    b = buffer.StreamBuffer(99, 5.0)
    assert b.add([1], 1.0) is None and b.add([1], 3.0) is None
    assert b.add([1], 6.0, "image") == {"embeddings": [[1], [1], [1]], "timestamps": [1.0, 3.0, 6.0], "modality": "image"}
    assert b.flush() is None


def test_batches_restart_at_each_flush(spark):
    times = [0, 1, 2, 7, 8, 9, 20, 21, 22, 23, 24]
    df = spark.createDataFrame([("a", float(t), k) for k, t in enumerate(times)], "id string, ts double, tie long")
    got = [r.batch for r in buffer.batches(df, 4, 5.0).orderBy("ts").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"u{k % 3}", float(k) + rng.random() / 2, [rng.random(), rng.random()], "text", k) for k in range(24)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        df.where((F.col("tie") >= 8 * k) & (F.col("tie") < 8 * k + 8)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got: dict = {}
    query = incremental.representations(stream, 0.3).writeStream.outputMode("update").foreachBatch(lambda b, n: got.update({r.id: r for r in b.collect()}) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {r.id: r for r in S.ema(df, 2, 0.3).collect()}
    assert {k: r.n for k, r in got.items()} == {k: r.n for k, r in want.items()}
    for k, r in want.items():
        assert got[k].representation == pytest.approx(r.embedding)


def table(spark, rows):
    return spark.createDataFrame([(i, float(t), [float(x) for x in v], "text", k) for k, (i, t, v) in enumerate(rows)], SCHEMA)


FIRST = [("a", 1, [1, 0, 0]), ("a", 2, [0, 1, 0])]


def test_trigger_engine(spark):
    now, said = [table(spark, FIRST)], []
    register_action("tell", said.append)
    engine = TriggerEngine(spark, lambda: now[0], 3, rules=[Rule("any", "size(predictions) > 0", "warning", "{sequence_id} has {num_predictions}", ["tell"]), Rule("broken", "no_such_column > 1")], num_steps=2, clock=lambda: 50.0)
    assert engine.poll() == [] and engine.mark == 2.0
    assert engine.poll() == []
    now[0] = table(spark, [*FIRST, ("a", 3, [0, 0, 1]), ("b", 2, [1, 1, 1])])
    alerts = engine.poll()
    assert engine.mark == 3.0 and [a["message"] for a in alerts] == ["a has 2"] and len(said) == 1
    live = engine.live().collect()
    assert [(r.sequence_id, r.step, r.updated_at) for r in live] == [("a", 1, 50.0), ("a", 2, 50.0)]
    assert live[0].prediction == pytest.approx([-0.268941, -0.462117, 1.731059], abs=1e-6)
    now[0] = table(spark, [*FIRST, ("a", 3, [0, 0, 1]), ("c", 4, [1, 0, 0]), ("c", 5, [0, 0, 1])])
    engine.poll()
    assert {r.sequence_id for r in engine.live().collect()} == {"a", "c"}
    assert engine.alerts("a").count() == 1 and engine.alerts(limit=1).count() == 1
    assert engine.remove_rule("any") and not engine.remove_rule("any")


def test_empty_table_stays_at_the_start(spark):
    now = [table(spark, FIRST).limit(0)]
    engine = TriggerEngine(spark, lambda: now[0], 3)
    assert engine.poll() == [] and engine.mark == 0.0
    now[0] = table(spark, FIRST)
    assert engine.poll() == [] and engine.mark == 2.0 and engine.live().count() == 0


def test_watch(spark, tmp_path):
    path = str(tmp_path / "events")
    table(spark, FIRST).write.parquet(path)
    engine = TriggerEngine(spark, lambda: spark.read.schema(SCHEMA).parquet(path), 3)
    for rows in (None, [("a", 3, [0, 0, 1])]):
        if rows:
            table(spark, rows).write.mode("append").parquet(path)
        engine.watch(spark.readStream.schema(SCHEMA).parquet(path), str(tmp_path / "c")).awaitTermination(120)
    assert engine.live().count() == 3


def test_cascade(spark):
    now, at = [table(spark, FIRST)], [100.0]
    cascade = Cascade(spark, lambda: now[0], [Level("near", 3), Level("far", 3, "SELECT sequence_id AS id, updated_at AS ts, prediction AS embedding, 'f' AS modality, CAST(step AS BIGINT) AS tie FROM {upstream_table}", 2)], clock=lambda: at[0])
    for k, more in enumerate(([], [("a", 3, [0, 0, 1])], [("a", 4, [0, 0, 1])])):
        now[0], at[0] = table(spark, now[0].select("id", "ts", "embedding").collect() + more), 100.0 + k
        cascade.poll()
        assert (cascade.predictions("near").count(), cascade.predictions("far").count()) == [(0, 0), (3, 0), (3, 2)][k]
    with pytest.raises(ValueError):
        cascade.add_level(Level("near", 3))
    with pytest.raises(ValueError):
        cascade.add_level(Level("no good", 3))
    with pytest.raises(ValueError):
        cascade.engine("absent")
    cascade.add_rule("far", Rule("r", "true"))
    assert cascade.alerts().count() == 0


def test_event_time_windows(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS id, timestamp_seconds(60 * id) AS ts, array(double(id), 1D) AS embedding FROM range(120)")
    df.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    got = []
    windowed(stream, "0 seconds").writeStream.outputMode("complete").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "wc")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in got[-2:]) == [60, 60] and math.isclose(min(r["mean"][0] for r in got[-2:]), 29.5)


def test_engine_goes_on_where_it_ended(spark, tmp_path):
    root, now = f"file://{tmp_path}/engine", [table(spark, FIRST)]
    make = lambda: TriggerEngine(spark, lambda: now[0], 3, root=root, rules=[Rule("any", "true")], clock=lambda: 50.0, buckets=4)
    make().poll()
    now[0] = table(spark, [*FIRST, ("a", 3, [0, 0, 1])])
    assert len(make().poll()) == 1  # rows since the last poll of an engine that is gone
    again = make()
    assert again.mark == 3.0 and again.live().count() == 3 and again.live("a").count() == 3 and again.poll() == []
    now[0] = table(spark, [*FIRST, ("a", 3, [0, 0, 1]), *[(f"x{k}", 4, [1, 0, 0]) for k in range(8)]])
    assert len(again.poll()) == 8 and make().live().count() == 27 and make().alerts().count() == 9
    assert {r.step for r in make().live("x3").collect()} == {1, 2, 3} and make().live("none").count() == 0


def test_a_failed_poll_is_done_again(spark, tmp_path, monkeypatch):
    root, now = f"file://{tmp_path}/engine", [table(spark, FIRST)]
    engine = TriggerEngine(spark, lambda: now[0], 3, root=root, rules=[Rule("any", "true")], clock=lambda: 50.0)
    engine.poll()
    now[0] = table(spark, [*FIRST, ("a", 3, [0, 0, 1])])
    commit = TriggerEngine._commit
    monkeypatch.setattr(TriggerEngine, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        engine.poll()
    monkeypatch.setattr(TriggerEngine, "_commit", commit)
    engine = TriggerEngine(spark, lambda: now[0], 3, root=root, rules=[Rule("any", "true")], clock=lambda: 50.0)
    assert engine.alerts().count() == 0 and engine.live().count() == 0
    assert len(engine.poll()) == 1 and engine.alerts().count() == 1 and engine.live().count() == 3


def test_polling_in_the_background_stops(spark):
    now = [table(spark, FIRST)]
    engine = TriggerEngine(spark, lambda: now[0], 3)
    handle = engine.start(0.05)
    for _ in range(600):
        if engine.mark:
            break
        import time

        time.sleep(0.05)
    assert engine.mark == 2.0 and handle.running and handle.stop(30) and not handle.running


def test_batches_of_any_size_give_one_state():
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(40, 3)), rng.uniform(0, 9, 40)  # late events too
    one, two = Incremental(0.7, 10), Incremental(0.7, 10)
    rep, last = x[0], t[0]
    for v, w in zip(x, t):
        one.update(v, w)
    for v, w in zip(x[1:], t[1:]):
        q = math.exp(-0.7 * max(0.0, w - last))
        rep, last = q * rep + (1 - q) * v, max(last, w)
    two.update_batch(x[:13], t[:13])
    two.update_batch(x[13:], t[13:])
    assert one.rep == pytest.approx(rep) and two.rep == pytest.approx(rep) and two.last_ts == last and len(two.recent) == 10
    assert two.m2 / 39 == pytest.approx(x.var(0, ddof=1)) and one.m2 == pytest.approx(two.m2)


def test_batches_against_the_buffer(spark):
    rng = random.Random(9)
    rows = [(f"u{k % 2}", round(rng.uniform(0, 40), 1), k) for k in range(120)]
    got = {r.tie: r.batch for r in buffer.batches(spark.createDataFrame(rows, "id string, ts double, tie long"), 7, 3.0).collect()}
    for i in ("u0", "u1"):
        held, n = buffer.StreamBuffer(7, 3.0), 0
        for _, ts, tie in sorted((r for r in rows if r[0] == i), key=lambda r: r[1:]):
            assert got[tie] == n
            n += held.add([0], ts) is not None
