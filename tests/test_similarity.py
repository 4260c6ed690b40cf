"""Block-wise similarity and Arrow sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import index as I
from eventloom.operators import population as P
from eventloom.operators import similarity as M


def rows_of(rng, n, widths=(2, 5)):
    return [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=widths[i % 3 % len(widths)])]) for i in range(n)]


def cosine(a, b):
    if len(a) != len(b):
        return None
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def test_nearest_of_mixed_lengths(spark):
    rows = [*rows_of(np.random.default_rng(1), 60), (100, "a", [0.0, 0.0]), (101, "b", None), (102, None, [1.0, 2.0]), (103, "a", [])]
    df = spark.createDataFrame(rows, "id long, kind string, embedding array<double>").repartition(3)
    for options, ok in (({}, lambda p, q: True), ({"kind": "kind", "same_kind": True}, lambda p, q: p == q and p is not None), ({"kind": "kind", "target": "b"}, lambda p, q: q == "b")):
        got = {}
        for r in M.nearest(df, df, 4, **options).collect():
            got.setdefault(r["query"], []).append((r.place, r.neighbour, round(r.similarity, 9)))
        for i, kind, v in rows:
            if v is None or not v:
                assert i not in got
                continue
            found = [(-round(cosine(v, w), 10), j, round(cosine(v, w), 9)) for j, other, w in rows if j != i and w and ok(kind, other) and cosine(v, w) is not None]
            want = [(k + 1, j, s) for k, (_, j, s) in enumerate(sorted(found)[:4])]
            assert sorted(got.get(i, [])) == want


def test_ties_are_cut_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(200)], "id long, embedding array<double>")
    got = {}
    for r in M.nearest(df, df, 3).collect():
        got.setdefault(r["query"], []).append(r.neighbour)
    assert all(sorted(v) == [j for j in range(4) if j != i][:3] for i, v in got.items()) and len(got) == 200


def test_relationships_of_entities_that_share_some_modalities(spark):
    rng, rows = np.random.default_rng(2), []
    for e in range(40):
        for m in ("text", "image", "sound"):
            if rng.random() < 0.6:
                rows.append((e, m, [float(x) for x in rng.normal(size=3 if m != "sound" or e % 4 else 2)], "xy"[e % 2] if e % 3 else None))
    rows.append((rows[0][0], "blank", None, None))
    df = spark.createDataFrame(rows, "entity_id long, modality string, embedding array<double>, category string").repartition(3)
    held, kind = {}, {}
    for e, m, v, c in rows:
        if v:
            held.setdefault(e, {})[m] = v
        kind[e] = c or kind.get(e)
    want = {}
    for a in held:
        for b in held:
            got = [s for m in held[a].keys() & held[b].keys() if (s := cosine(held[a][m], held[b][m])) is not None]
            if a != b and got:
                s = np.mean(got)
                s = min(1.0, s + 0.1) if kind[a] and kind[a] == kind[b] else s
                if s >= 0.2:
                    want[a, b] = s
    got = {(r.entity_id, r.related_entity_id): r.similarity for r in M.relationships(df, 0.2).collect()}
    assert len(want) > 50 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    some = M.relationships(df, 0.2, spark.createDataFrame([(3,), (5,)], "id long")).collect()
    assert {(r.entity_id, r.related_entity_id) for r in some} == {k for k in want if k[0] in (3, 5)}
    texts = df.withColumn("entity_id", F.concat(F.lit("e"), "entity_id"))
    assert M.relationships(texts, 0.2).count() == len(want) and M.relationships(df.limit(0)).count() == 0


def test_centroids_and_covariance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    rows = [(k % 3 if k % 7 else None, [float(v) for v in r]) for k, r in enumerate(x)] + [(0, None), (5, None), (1, [1.0])]
    df = spark.createDataFrame(rows, "k int, embedding array<double>").repartition(4)
    got = {r.k: r for r in P.centroids(df, 4, "k").collect()}
    assert got[5].n == 1 and got[5].centroid is None
    for k in (0, 1, 2, None):
        mine = [v for j, v in rows if j == k and v and len(v) == 4]
        assert got[k].n == sum(j == k for j, _ in rows) and got[k].centroid == pytest.approx(np.mean(mine, 0))
    cov = np.cov(x.T)
    want = ((cov - np.diag(np.diag(cov))) ** 2).sum() / 4
    assert P.covariance_penalty(df, 4).first().penalty == pytest.approx(want)
    whole = P.mean_of(df, 4).first()
    assert whole.centre == pytest.approx(x.mean(0)) and whole.n_centre == 53
    none = P.mean_of(df.limit(0), 4).first()
    assert none.centre is None and none.n_centre == 0


def test_index_search_is_exact_and_passes_cells_over(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 3
    x = np.concatenate([centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8)) * 0.1, rng.normal(size=(200, 8))])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(5000, [0.0] * 8), (5001, None), (5002, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    index = I.build(df, 8)
    assert index.size.sum() == 3200
    got = {}
    for r in I.search(index, df.where("id % 50 = 0"), 10).collect():
        got.setdefault(r["query"], {})[r.place] = r.neighbour
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 10)
    np.fill_diagonal(s, -2)
    for q in range(0, 3200, 50):
        assert [got[q][k] for k in range(1, 11)] == np.lexsort((np.arange(3200), -s[q]))[:10].tolist()
    assert 5000 not in got and len(got) == 64
    # cells that a query has to look into, of all
    a = I.angles(unit[0:3000:50] @ index.means.T)
    bound = I.angles(np.sort(s[0:3000:50], axis=1)[:, -10])
    assert ((a - index.widest <= bound[:, None]) & (index.size > 0)).mean() < 0.3
    assert I.search(I.build(df.limit(0), 8), df, 3).count() == 0
    assert I.search(I.build(df.where("id < 4"), 8), df.where("id = 1"), 10).count() == 3
