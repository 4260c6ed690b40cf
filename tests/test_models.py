"""Predictors, density clusters, memories, losses, the vector store and Flight against plain numpy and Python."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.operators import density, memory, predictors, probes
from eventloom.operators import regularizers as G
from eventloom.plans import q_population, q_probes, registry
from eventloom.sources import flight as FL
from eventloom.sources import warehouse
from eventloom.sources.vectors import VectorStore

SEQ = "id string, ts double, embedding array<double>, modality string, tie long"
SF = "/root/testdata/sf0.01"


def walks(rng, step, n=12, length=40):
    rows = []
    for i in range(n):
        x = rng.normal(size=2)
        for t in range(length):
            rows.append((f"s{i}", float(t), [float(v) for v in x], "text", t))
            x = step(x)
    return rows


def windows(rows, context, steps):
    held, x, y = {}, [], []
    for i, _, v, _, _ in rows:
        held.setdefault(i, []).append(v)
    for v in held.values():
        for k in range(len(v) - context - steps + 1):
            x.append(np.ravel(v[k : k + context]))
            y.append(np.ravel(v[k + context : k + context + steps]))
    return np.array(x), np.array(y)


def test_predictor_is_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = walks(rng, lambda x: np.array([[0.8, 0.3], [-0.2, 0.9]]) @ x + [0.1, 0.0] + rng.normal(size=2) * 0.05)
    df = spark.createDataFrame(rows, SEQ).repartition(3)
    got = predictors.fit(df, 2, context=3, steps=2)
    x, y = windows(rows, 3, 2)
    f = np.c_[np.ones(len(x)), x]
    want = np.linalg.solve(f.T @ f + np.diag([0, *[1e-6 * len(x)] * 6]), f.T @ y)
    assert got.rows == len(x) and got.weights == pytest.approx(want, abs=1e-6)
    last = {r.id: {} for r in df.select("id").distinct().collect()}
    for r in got.predict(df, 5).collect():
        last[r.id][r.step] = r.prediction
    mine = [r[2] for r in rows if r[0] == "s3"]
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in last.values()) and [last["s3"][k] for k in range(1, 6)] == [pytest.approx(v) for v in got.next(mine, 5)]


def test_hidden_layer_learns_what_a_line_does_not(spark):
    rng = np.random.default_rng(2)
    rows = walks(rng, lambda x: np.array([np.sin(3 * x[1]), np.cos(2 * x[0])]) + rng.normal(size=2) * 0.02)
    df = spark.createDataFrame(rows, SEQ)
    line, hidden = predictors.fit(df, 2, context=1), predictors.fit(df, 2, context=1, hidden=80)
    x, y = windows(walks(rng, lambda x: np.array([np.sin(3 * x[1]), np.cos(2 * x[0])])), 1, 1)
    error = lambda p: ((p.features(x) @ p.weights - y) ** 2).mean()
    assert error(hidden) < 0.2 * error(line)


def test_predictor_of_little(spark):
    df = spark.createDataFrame([("a", 1.0, [1.0, 2.0], "t", 0)], SEQ)
    got = predictors.fit(df, 2, context=3)
    assert got.rows == 0 and got.predict(df).first().prediction == [0.0, 0.0] and predictors.fit(df.limit(0), 2).next([]) == [[0.0, 0.0]]


def test_dbscan_against_a_walk(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1, 3)) * 4 + rng.normal(size=(n, 3)) * 0.3 for n in (20, 12, 3)] + [rng.normal(size=(15, 3))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 1 - 0.02) & ~np.eye(len(x), dtype=bool)
    core = near.sum(1) + 1 >= 4
    cluster = np.full(len(x), -1)
    for i in range(len(x)):
        todo = [i] if core[i] and cluster[i] < 0 else []
        while todo:
            k = todo.pop()
            if cluster[k] < 0:
                cluster[k] = i
                todo += [j for j in np.flatnonzero(near[k]) if core[j]]
    for i in np.flatnonzero(~core):
        by = [j for j in np.flatnonzero(near[i]) if core[j]]
        cluster[i] = cluster[by[0]] if by else -1
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "id long, embedding array<double>")
    got = {r.id: (r.cluster, r.core) for r in density.dbscan(df, 0.02, 4).collect()}
    assert len(set(cluster)) > 2 and got == {i: (cluster[i], core[i]) for i in range(len(x))} | {999: (-1, False)}
    assert density.dbscan(df.limit(0), 0.1, 2).count() == 0


def test_memories_against_a_loop(spark):
    rng = np.random.default_rng(4)
    edges = [(f"n{rng.integers(6)}", f"n{rng.integers(6)}", float(rng.uniform(0, 50)), float(rng.normal())) for _ in range(80)] + [("n0", None, 1.0, 1.0)]
    df = spark.createDataFrame(edges, "subject_id string, object_id string, t_epoch double, numeric_value double")
    by = {}
    for a, b, t, v in edges:
        for n in {a, b} - {None}:
            by.setdefault(n, {}).setdefault(int(t // 10), []).append(v)
    for r in memory.memories(df, 10, 0.3).collect():
        m = 0.0
        for k in sorted(by[r.node]):
            m = 0.7 * m + 0.3 * np.mean(by[r.node][k])
        assert r.memory == pytest.approx(m) and r.batches == len(by[r.node])


def test_vicreg(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 4)) * [0.5, 1, 2, 0.1], rng.normal(size=(60, 4))
    df = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    off = lambda c: ((c - np.diag(np.diag(c))) ** 2).sum() / 4
    variance = sum(np.maximum(0, 1 - np.sqrt(x.var(0, ddof=1) + 1e-4)).mean() for x in (a, b))
    want = {"invariance": ((a - b) ** 2).mean(), "variance": variance, "covariance": off(np.cov(a.T)) + off(np.cov(b.T))}
    want["loss"] = 25 * want["invariance"] + 25 * want["variance"] + want["covariance"]
    got = G.vicreg(df(a), df(b), 4)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert G.vicreg(df(a).limit(0), df(b), 4)["loss"] == 0.0


def test_vector_store(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, f"file://{tmp_path}/store", 3)
    rows = spark.createDataFrame([(f"v{k}", [float(k), 1.0], "ab"[k % 2]) for k in range(10)], "id string, embedding array<float>, tag string")
    assert store.create("one", 2) and not store.create("one", 2) and store.collections() == ["one"]
    with pytest.raises(ValueError):
        store.create("one", 3)
    assert store.put("one", rows) == 10 and store.put("one", rows.where("tag = 'a'").withColumn("tag", F.lit("c"))) == 5
    for bad in ([("x", [1.0])], [(None, [1.0, 2.0])], [("x", None)]):
        with pytest.raises(ValueError):
            store.put("one", spark.createDataFrame(bad, "id string, embedding array<float>"))
    assert store.describe("one") == {"name": "one", "width": 2, "count": 10}
    assert store.delete("one", spark.createDataFrame([("v1",), ("none",), (None,)], "x string")) == 2
    assert {r.id: r.tag for r in store.table("one").collect()} == {f"v{k}": "c" if k % 2 == 0 else "b" for k in range(10) if k != 1}
    assert [r.id for r in store.search("one", [9.0, 1.0], 2).collect()][0] == "v9" and [r.id for r in store.search("one", [9.0, 1.0], 1, "c").collect()] == ["v8"]
    with pytest.raises(ValueError):
        store.search("one", [1.0])
    assert [r.id for r in store.get("one", spark.createDataFrame([("v2",)], "x string")).collect()] == ["v2"]
    assert store.copy("one", "two", "b") == 4 and store.table("two").count() == 4
    before = store.table("two").collect()
    monkeypatch.setattr("eventloom.sources.vectors.write_text", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        store.put("two", rows)
    monkeypatch.undo()
    assert sorted(store.table("two").collect()) == sorted(before) and store.put("two", rows) == 10
    store.delete("two", rows.select("id"))
    assert store.table("two").count() == 0
    store.drop("two")
    with pytest.raises(KeyError):
        store.table("two")


class Endpoint:
    """A Flight server of tables in memory, two endpoints a table, that filters by tag and asks for a token."""

    def __new__(cls):
        from pyarrow import flight

        class Server(flight.FlightServerBase):
            def __init__(self):
                super().__init__("grpc://127.0.0.1:0")
                self.tables, self.seen, self.lock = {}, set(), threading.Lock()

            def _asked(self, d):
                import json

                if d.descriptor_type == flight.DescriptorType.CMD:
                    c = json.loads(d.command)
                    return c["path"], c["filter_tag"]
                return d.path[0].decode(), None

            def list_flights(self, context, criteria):
                for name, t in self.tables.items():
                    yield flight.FlightInfo(t.schema, flight.FlightDescriptor.for_path(name), [], t.num_rows, -1)

            def get_flight_info(self, context, d):
                name, tag = self._asked(d)
                if name not in self.tables:
                    raise flight.FlightUnavailableError("no such flight")
                ends = [flight.FlightEndpoint(f"{name}|{tag or ''}|{k}".encode(), []) for k in range(2)]
                return flight.FlightInfo(self.tables[name].schema, d, ends, -1, -1)

            def do_get(self, context, ticket):
                name, tag, k = ticket.ticket.decode().split("|")
                t = self.tables[name]
                t = t.filter(pa.compute.equal(t["tag"], tag)) if tag else t
                half = t.num_rows // 2
                return flight.RecordBatchStream(t.slice(0, half) if k == "0" else t.slice(half))

            def do_put(self, context, d, reader, writer):
                got = reader.read_all()
                with self.lock:
                    name = self._asked(d)[0]
                    self.tables[name] = pa.concat_tables([self.tables[name], got.cast(self.tables[name].schema)]) if name in self.tables else got

        return Server()


def test_flight(spark):
    server = Endpoint()
    server.tables["vectors"] = pa.table({"id": [f"v{k}" for k in range(9)], "embedding": pa.array([[float(k), 0.5] for k in range(9)], pa.list_(pa.float32())), "tag": list("abcabcabc")})
    at = f"grpc://127.0.0.1:{server.port}"
    try:
        w = warehouse.Warehouse(spark)
        w.attach("far", FL.source(spark, at, token="secret"))
        assert w.tables("far") == ["vectors"]
        got = w.union("vectors")
        assert got.rdd.getNumPartitions() == 2 and {r.id: r.embedding for r in got.collect()} == {f"v{k}": [float(k), 0.5] for k in range(9)}
        w.detach("far")
        some = FL.source(spark, at, filter_tag="b").table("vectors")
        assert sorted(r.id for r in some.collect()) == ["v1", "v4", "v7"]
        FL.send(some.repartition(2), at, "copied")
        assert sorted(server.tables["copied"]["id"].to_pylist()) == ["v1", "v4", "v7"]
        store = VectorStore(spark)
        store.create("from_far", 2)
        assert store.put("from_far", FL.source(spark, at).table("vectors")) == 9
        store.drop("from_far")
        with pytest.raises(Exception, match="no such flight"):
            FL.source(spark, at).table("absent")
    finally:
        server.shutdown()


def split_rows(df):
    rows = df.collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([r.y for r in rows], float)
    held = np.array([r.held for r in rows], bool)
    return x[~held], y[~held], x[held], y[held]


def ridge(x, y, z):
    m, c = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + np.eye(x.shape[1]), (x - m).T @ (y - c))
    return (z - m) @ w + c


@pytest.mark.parametrize("name,value,where", [("h02_stay_probe", "log1p(double(los))", "true"), ("h03_cost_probe", "log1p(bill)", "true"), ("h07_site_probe", "log1p(bill)", "site < 5")])
def test_regression_probes_are_ridge(spark, name, value, where):
    x, y, z, w = split_rows(q_probes.cases(spark, SF).where(where).withColumn("y", F.expr(value)).where("y is not null"))
    e = np.abs(ridge(x, y, z) - w)
    got = registry.queries()[name](spark, SF).first()
    assert got.n == len(w) and got.mae == pytest.approx(e.mean(), abs=6e-4)
    if name != "h07_site_probe":
        assert got.r2 == pytest.approx(1 - (e * e).sum() / ((w - w.mean()) ** 2).sum(), abs=6e-4) and got.median_error == pytest.approx(np.median(e), abs=6e-4)
        both = {r.probe: r.mae for r in registry.queries()["h06_all_probes"](spark, SF).collect()}
        assert both["stay" if name[:3] == "h02" else "bill"] == got.mae


def test_risk_probe_is_penalised_logistic(spark):
    x, y, z, w = split_rows(q_probes.cases(spark, SF).withColumn("y", (F.col("denied") > 0).cast("double")))
    weight = np.where(y == 1, len(y) / 2 / max(y.sum(), 1), len(y) / 2 / max((1 - y).sum(), 1))
    sd = x.std(0, ddof=1)
    f, b = np.c_[np.ones(len(x)), x / sd], np.zeros(x.shape[1] + 1)
    penalty = np.r_[0, np.full(x.shape[1], 0.01)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-f @ b))
        b -= np.linalg.solve((f * (weight * p * (1 - p))[:, None]).T @ f / weight.sum() + np.diag(penalty), f.T @ (weight * (p - y)) / weight.sum() + penalty * b)
    s = np.c_[np.ones(len(z)), z / sd] @ b
    order = np.argsort(np.argsort(s)) + 1
    auc = (order[w == 1].sum() - w.sum() * (w.sum() + 1) / 2) / (w.sum() * (1 - w).sum())
    assert registry.queries()["h04_risk_probe"](spark, SF).first().auc == pytest.approx(auc, abs=0.01)


def test_forest_counts_every_held_row(spark):
    rows = registry.queries()["h05_forest"](spark, SF).collect()
    held = probes.split(q_population.emb(spark, SF), "vec_id").where("held").groupBy("label").count().collect()
    assert {r["class"]: r.support for r in rows} == {float(r["label"]): r["count"] for r in held}
    assert all(r.recall is None or 0 <= r.recall <= 1 for r in rows)


def test_clusters_are_nearest_means(spark):
    e = {r.vec_id: np.array(r.embedding) for r in q_population.emb(spark, SF).collect()}
    got = {r.vec_id: r.cluster for r in registry.queries()["e48_cluster_codes"](spark, SF).collect()}
    assert got.keys() == e.keys()
    means = {c: np.mean([e[i] for i in e if got[i] == c], 0) for c in set(got.values())}
    nearest = {i: min(means, key=lambda c: np.linalg.norm(e[i] - means[c])) for i in e}
    assert len(means) == 8 and np.mean([nearest[i] == got[i] for i in e]) >= 0.9
    for name, k, n in (("e18_cluster_entities", 10, len(e)), ("e20_cluster_fallback", 12, len(e)), ("e17_cluster_deltas", 10, None)):
        rows = registry.queries()[name](spark, SF).collect()
        assert len(rows) == k and (n is None or sum(r.n for r in rows) == n)
    moves = q_population.tra(spark, SF).count()
    assert sum(r.n for r in rows) == moves


def test_regularizers_query_is_numpy(spark):
    x = np.array([r.embedding for r in q_population.emb(spark, SF).collect()])
    got = {r.name: r.loss for r in registry.queries()["m01_regularizers"](spark, SF).collect()}
    u, t = G.directions(64, 64, 42), np.linspace(-5, 5, 17)
    z = ((x - x.mean(0)) / np.maximum(x.std(0, ddof=1), 1e-8)) @ u
    phase = z[:, :, None] * t
    off = ((np.cos(phase).mean(0) - np.exp(-0.5 * t**2)) ** 2 + np.sin(phase).mean(0) ** 2) * np.exp(-(t**2))
    assert got["sigreg"] == pytest.approx(len(x) * np.trapezoid(off, t, axis=1).mean(), abs=1e-3)
    s = np.random.default_rng(42).normal(size=(32, 64)) / 8
    assert got["weak_sigreg"] == pytest.approx(((s @ np.cov(x.T, bias=True) @ s.T - s @ s.T) ** 2).sum(), abs=1e-3)
    assert got["rdmreg"] > 0


def test_evolved_search_is_no_worse_than_its_seed(spark):
    e = {r.vec_id: np.array(r.embedding) for r in q_population.emb(spark, SF).collect()}
    hits = registry.queries()["d13_evolutionary_search"](spark, SF).collect()
    assert len(hits) == 10 and [h.similarity for h in hits] == sorted((h.similarity for h in hits), reverse=True)
    seed = e[0] / np.linalg.norm(e[0])
    assert len({h.id for h in hits} & set(sorted(e, key=lambda i: -(e[i] @ seed) / np.linalg.norm(e[i]))[:30])) >= 5


def test_sweep_leaves_out_probes_without_labels(spark):
    e = q_population.emb(spark, SF)
    none = e.limit(0)
    mean = lambda v: probes.labelled(v.select("vec_id", "embedding"), e.select("vec_id", "label"), "vec_id").agg(F.avg("label").alias("mean"))
    count = lambda v: v.agg(F.count(F.lit(1)).alias("n"))
    got = {(r.checkpoint, r.probe): (r["mean"], r.n) for r in probes.sweep({"a": e, "empty": none}, {"mean": mean, "count": count}).collect()}
    assert set(got) == {("a", "mean"), ("a", "count"), ("empty", "count")} and got["empty", "count"] == (None, 0)
    with pytest.raises(ValueError):
        probes.sweep({"empty": none}, {"mean": mean})


def test_database_source(spark, tmp_path):
    """An embedded database over JDBC: listed, read in partitions, only read columns asked for, and united with a folder."""
    url = f"jdbc:derby:{tmp_path}/base;create=true"
    rows = spark.range(20).selectExpr("id AS k", "concat('v', id) AS v", "id * 1.5D AS x")
    rows.write.format("jdbc").options(url=url, dbtable="things", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    listing = "SELECT tablename FROM sys.systables WHERE tabletype = 'T'"
    source = warehouse.Source.jdbc(spark, url, listing, driver="org.apache.derby.jdbc.EmbeddedDriver", partitionColumn="k", lowerBound="0", upperBound="20", numPartitions="4")
    w = warehouse.Warehouse(spark)
    w.attach("base", source)
    w.attach("near", warehouse.Source.memory({"THINGS": rows.where("k < 3").drop("x")}))
    assert w.tables("base") == ["THINGS"]
    got = source.table("THINGS")
    assert got.rdd.getNumPartitions() == 4 and {(r.k, r.v, r.x) for r in got.collect()} == {(k, f"v{k}", k * 1.5) for k in range(20)}
    plan = got.where("k > 10").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "x" not in plan.split("ReadSchema")[-1].split("<")[-1].split(">")[0].split(",")[0].split(":")[0]
    assert {(r.sourcedb, r.n) for r in w.union("THINGS").groupBy("sourcedb").agg(F.count("*").alias("n")).collect()} == {("base", 20), ("near", 3)}
    with pytest.raises(ValueError):
        source.table("no good")
