import pytest
from pyspark.sql import functions as F

from eventloom.operators import probes, regularizers, schema
from eventloom.pipeline import Pipeline
from eventloom.sources import files, warehouse

EVENTS = "sequence_id int, embedding array<double>, timestamp double, modality string"


@pytest.fixture
def sources(spark, tmp_path):
    for name, rows in {"one": [(1, [1.0, 0.0], 1.0, "text"), (1, [0.0, 1.0], 2.0, "text")], "two": [(2, [1.0, 1.0], 1.0, "image")]}.items():
        spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / name / "event_sequences.parquet"))
    e = [("e1", "text", [0.8, 0.2], "x"), ("e2", "text", [0.6, 0.4], "x"), ("e1", "image", [1.0, 0.0], "x")]
    spark.createDataFrame(e, "entity_id string, modality string, embedding array<double>, category string").write.parquet(str(tmp_path / "two" / "entities.parquet"))
    return {n: str(tmp_path / n) for n in ("one", "two")}


def test_warehouse(spark, sources):
    with warehouse.Warehouse(spark) as w:
        for n, p in sources.items():
            w.attach(n, p)
        assert w.attached == ["one", "two"] and w.tables("two") == ["entities", "event_sequences"]
        assert w.build(["event_sequences", "entities", "absent"]) == {"event_sequences": 3, "entities": 3, "absent": 0}
        assert {r.sourcedb for r in w.query("SELECT DISTINCT sourcedb FROM event_sequences").collect()} == {"one", "two"}
        assert w.build(["event_sequences"], only=["one"]) == {"event_sequences": 2}
        assert w.load_sequences().count() == 2
        assert w.load_sequences(query="SELECT sequence_id AS s, embedding, timestamp FROM event_sequences", columns={"id": "s"}).count() == 2
        for bad in (lambda: w.attach("one", "x"), lambda: w.attach("no good", "x"), lambda: w.query("DROP TABLE x"), lambda: w.load_sequences(query="SELECT 1 AS x"), lambda: warehouse.checked("a;b")):
            with pytest.raises(ValueError):
                bad()
        with pytest.raises(KeyError):
            w.build(["event_sequences"], only=["three"])
        w.detach("one")
        with pytest.raises(KeyError):
            w.detach("one")
    with pytest.raises(RuntimeError):
        w.build(["entities"])


def test_filters_reach_the_scans(spark, sources):
    w = warehouse.Warehouse(spark)
    for n, p in sources.items():
        w.attach(n, p)
    plan = w.union("event_sequences").where("sourcedb = 'one' and timestamp > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThan(timestamp,1.0)" in plan


def test_pipeline(spark, sources, tmp_path):
    p = Pipeline(spark, 2)
    got = p.run(sources, str(tmp_path / "out"))
    assert got["counts"] == {"event_sequences": 3, "entities": 3} and got["results"].count() == 2
    assert {(r.entity_id, r.related_entity_id) for r in got["relationships"].collect()} == {("e1", "e2"), ("e2", "e1")}
    assert spark.read.parquet(str(tmp_path / "out" / "predictions.parquet")).agg(F.min("step"), F.max("step")).first() == (1, 3)


def test_files(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.array(F.col("id").cast("double")))
    a = files.materialize(df, str(tmp_path / "a"))
    assert files.materialize(df.limit(1), str(tmp_path / "a")).count() == a.count() == 10
    assert files.materialize(df.limit(1), str(tmp_path / "a"), again=True).count() == 1
    assert files.to_ipc(df, str(tmp_path / "x.arrow")) == 10
    assert sorted(r.id for r in files.from_ipc(spark, str(tmp_path / "x.arrow")).collect()) == list(range(10))
    with pytest.raises(ValueError):
        files.to_ipc(df, str(tmp_path / "y.arrow"), limit=5)


def test_encoders(spark):
    df = spark.createDataFrame([(None, None, None), (-3.5, "Ab c", True), (0.0, "", False)], "n double, s string, b boolean")
    got = [r.v for r in df.select(F.concat(*[schema.encode_column(f, 8) for f in df.schema.fields]).alias("v")).collect()]
    assert got[0] == [0.0] * 10 and got[1][0] == pytest.approx(-0.0752039) and got[1][9] == 1.0 and got[2][1:9] == [0.0] * 8
    assert sum(x * x for x in got[1][1:9]) == pytest.approx(1.0)


def test_dense_index(spark):
    df = spark.createDataFrame([(f"n{k % 50:02}",) for k in range(500)] + [(None,)], "node string").repartition(7)
    assert sorted((r.node, r["index"]) for r in schema.dense_index(df, "node").collect()) == [(f"n{k:02}", k) for k in range(50)]


def test_probes(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = probes.features(spark.createDataFrame([(k, v.tolist(), float(t), int(t > 3)) for k, (v, t) in enumerate(zip(x, y))], "id long, embedding array<double>, y double, c int"))
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))
    assert probes.ridge(df, "y").coefficients.toArray() == pytest.approx(want, abs=1e-6)
    model = probes.logistic(df, "c", 0.01)
    scored = probes.positive(model.transform(df))
    p = np.array([r.score for r in scored.orderBy("id").collect()])
    a, b = p[y > 3], p[y <= 3]
    assert probes.roc_auc(scored, "c").first().auc == pytest.approx(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))
    assert probes.roc_auc(scored.where("c = 1"), "c").first().auc == 0.5
    assert [i for i, _ in probes.top_weights(model.coefficients, 1)] == [1]
    with pytest.raises(ValueError):
        probes.labelled(df, spark.createDataFrame([(999, 1)], "id long, z int"), "id")


def test_regularizers(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(300, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    t, u = np.linspace(-5, 5, 17), regularizers.directions(6, 64, 42)
    phi = np.exp(1j * (z @ u)[:, :, None] * t).mean(0)
    want = (300 * np.trapezoid(np.abs(phi - np.exp(-0.5 * t**2)) ** 2 * np.exp(-(t**2)), t, axis=1)).mean()
    assert regularizers.sigreg(df, 6) == pytest.approx(want)
    s = np.random.default_rng(42).normal(size=(32, 6)) / np.sqrt(6)
    assert regularizers.weak_sigreg(df, 6) == pytest.approx(((s @ np.cov(x.T, bias=True) @ s.T - s @ s.T) ** 2).sum())
    assert regularizers.rdmreg(df, 6) < regularizers.rdmreg(df.withColumn("embedding", F.transform("embedding", lambda v: v * 5 + 3)), 6)


def test_scans_read_what_is_asked_for(spark, sf):
    """Columns and filters reach the Parquet scan, through a source, the warehouse's union and the column profile."""
    w = warehouse.Warehouse(spark)
    w.attach("files", sf)
    plan = w.union("orders").where("o_totalprice > 400000 and sourcedb = 'files'").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan and "GreaterThan(o_totalprice,400000.0)" in plan
    none = w.union("orders").where("sourcedb = 'other'")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in none  # a source that is filtered out isn't read
    from eventloom.operators import schema

    few = schema.profile(spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey"), "orders", approximate=True)
    assert "ReadSchema: struct<o_custkey:bigint>" in few._jdf.queryExecution().executedPlan().toString() and few.first().exact is False
