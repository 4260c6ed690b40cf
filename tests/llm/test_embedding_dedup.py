from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from eventloom.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, bucket int, `i.d` string"


def brute(ids, x, least=0.9):
    """{id: (group, links)} by all pairs and a walk."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    group = {}
    for i in np.argsort(ids):
        todo = [i] if ids[i] not in group else []
        while todo:
            k = todo.pop()
            if ids[k] not in group:
                group[ids[k]] = ids[i]
                todo += list(np.flatnonzero(near[k]))
    return {ids[i]: (group[ids[i]], int(near[i].sum()) - 1) for i in range(len(ids))}


def got(docs, **more):
    rows = E.groups(docs, **more).collect()
    assert len(rows) == len({r.vec_id for r in rows})
    return {r.vec_id: (r.group_id, r.links) for r in rows}


def planted(n=300, copies=900, d=48, widest=0.5):
    """Vectors with copies at many angles, some over the threshold only by way of others."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, d))
    x = np.concatenate([base, base[rng.integers(0, n, copies)] + rng.normal(size=(copies, d)) * rng.uniform(0.0, widest, (copies, 1))]).astype(np.float32)
    x[-40:] = x[5]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(E.rotate(x, 0, 0, 1), axis=1), np.linalg.norm(x, axis=1))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    y = np.random.default_rng(2).normal(size=(3, 8))
    assert np.allclose(E.hadamard(y), y @ h)


def test_sign_sketches_keep_every_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    flips = [int(a ^ b & (1 << 64) - 1).bit_count() for a, b in zip(E.signs(x, 1).view(np.uint64).tolist(), E.signs(y, 1).view(np.uint64).tolist())]
    assert max(flips) <= E.most_flips(0.9) and np.mean(flips) > 5


def test_recall_against_brute_force(spark):
    x = planted()
    want = brute(list(range(len(x))), x.astype(float))
    found = got(frame(spark, x))
    links = sum(n for _, n in want.values()) // 2
    assert links > 500 and all(found[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in found.values()) // 2 >= 0.95 * links
    assert np.mean([found[i] == want[i] for i in want]) >= 0.95


def test_query_against_its_sql(spark, tmp_path):
    """Over 500 links, some by way of others: the query and its SQL agree."""
    from eventloom.llm.registry import SQL, queries

    x = planted(200, 700, 64, 0.35)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.zeros(len(x), np.int32)})
    Path(tmp_path, "embeddings.parquet").write_bytes(b"")
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {a: (g, n) for a, g, n in con.execute(SQL["op4_embedding_dedup"]).fetchall()}
    assert sum(n for _, n in want.values()) // 2 > 500
    rows = queries()["op4_embedding_dedup"](spark, str(tmp_path)).collect()
    found = {r.vec_id: (r.group_id, r.links) for r in rows}
    assert np.mean([found[i] == want[i] for i in want]) >= 0.99


def test_one_dense_group(spark):
    """A third of all rows in one group; wide enough that its links are counted."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 32)).astype(np.float32)
    x[:800] = x[0] + rng.normal(size=(800, 32)) * rng.uniform(0.05, 0.4, (800, 1))
    want, found = brute(list(range(len(x))), x.astype(float)), got(frame(spark, x))
    assert np.mean([found[i] == want[i] for i in want]) >= 0.99


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [1e30, 0.0]), (9, [0.0, 1.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    alone = {i: (i, 0) for i in (3, 4, 5, 6, 7, 9)}
    assert got(docs) == alone | {1: (1, 2), 2: (1, 2), 8: (1, 2)}
    assert E.groups(docs.limit(0)).count() == 0
    named = docs.selectExpr("concat('v', vec_id) as vec_id", "embedding")
    assert got(named) == {f"v{i}": (f"v{g}", n) for i, (g, n) in got(docs).items()}


def test_whole_table(spark, sf):
    from eventloom.llm.registry import queries

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    assert {r.vec_id: (r.group_id, r.links) for r in queries()["op4_embedding_dedup"](spark, sf).collect()} == want
