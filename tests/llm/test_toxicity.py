import numpy as np
import pyarrow as pa

from eventloom.llm import kernels as K
from eventloom.llm import toxicity as T

SCHEMA = "doc_id long, text string, severity int, _toxicity string"


def labelled(spark, n=400):
    rng = np.random.default_rng(8)
    words, bad = [f"w{k}" for k in range(300)], ["vile", "grubling", "grublast"]
    docs, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, 40))
        toxic = int(k % 5 == 0)
        for _ in range(toxic * int(rng.integers(1, 8))):
            text.insert(int(rng.integers(0, 40)), str(rng.choice(bad)))
        docs.append((k, " ".join(text)))
        labels.append((k, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_fit_and_order_of_severity(spark):
    docs, labels = labelled(spark)
    model = T.fit(docs, labels)
    assert len(model.words) >= 2 and (np.diff(model.thresholds) >= 0).all()
    some = spark.createDataFrame([(0, "w1 w2"), (1, "w1 vile"), (2, "vile grublast vile w3"), (3, "vile grubling grublast " * 5), (4, None), (5, ""), (6, "VILE!"), (6, "VILE!"), (7, "w1 " * 300000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.severity) for r in T.score(some, model).collect())
    s = dict(got)
    assert s[0] == s[4] == s[5] == s[7] < s[1] < s[2] < s[3] <= 3
    assert s[6] == s[1] or s[6] > s[0]
    assert [x for i, x in got if i == 6][0] == [x for i, x in got if i == 6][1]


def test_model_does_not_depend_on_partitions(spark):
    docs, labels = labelled(spark)
    a, b = T.fit(docs.repartition(1), labels), T.fit(docs.repartition(5), labels.repartition(3))
    assert (a.words == b.words).all() and np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)


def test_gradient_matches_likelihood():
    rng = np.random.default_rng(1)
    n, p = 60, 3
    x = rng.poisson(0.7, (n, p)).astype(float)
    grade = np.clip(rng.poisson(x @ [0.8, 0.1, 0.4]), 0, 3)
    rows, cols = np.nonzero(x)
    weights, t = T._fit_ordinal(rows, cols, x[rows, cols], grade, p, 1e-4, 600)

    def loss(w, t):
        over = 1 / (1 + np.exp(-(x @ w)[:, None] + t[None, :]))
        e = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], 1)
        return -np.log(e[np.arange(n), grade] - e[np.arange(n), grade + 1]).mean() + 0.5e-4 * (w**2).sum()

    best = loss(weights, t)
    for k in range(p):
        for d in (-0.05, 0.05):
            w = weights.copy()
            w[k] += d
            assert loss(w, t) > best - 1e-6
    for k in range(3):
        for d in (-0.05, 0.05):
            u = t.copy()
            u[k] += d
            assert loss(weights, np.sort(u)) > best - 1e-6


def test_awkward_labels_and_columns(spark):
    docs = spark.createDataFrame([(1, "a", 1, "x"), (None, "b", 1, "x"), (2, None, 1, "x")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (9, 1)], "doc_id long, toxic int")
    got = T.keep_clean(docs, labels)
    assert got.columns == docs.columns and got.count() == 3
    scored = T.score(docs, T.fit(docs, labels))
    assert scored.columns == [*docs.columns, "severity_", "grade", "rejected"]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.severity_ for r in T.score(docs, T.fit(docs, none)).collect()} == {0.0}
    empty = spark.createDataFrame([], SCHEMA)
    assert T.keep_clean(empty, labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    model = T.fit(docs, labels.where("doc_id % 2 = 0"))
    held = T.score(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).select("toxic", "rejected").toPandas()
    assert held[held.toxic == 1].rejected.mean() >= 0.9
    assert held[held.toxic == 0].rejected.mean() <= 0.01


def test_boilerplate_makes_no_copies(spark):
    docs, labels = labelled(spark)
    header = " ".join(f"header{k}" for k in range(20))
    rows = [(r.doc_id, f"{header} {r.text}") for r in docs.collect()]
    copies = [(1000 + i, t + " end") for i, t in rows[:50]]
    table = pa.table({"_k": [i for i, _ in rows + copies], "_y": [0] * (len(rows) + 50), "mins": T._min_hashes(*K.text_parts(pa.array([t for _, t in rows + copies])))[0]})
    kept = {table["_k"][i].as_py() % 1000 for i in T.distinct(table)}
    assert len(T.distinct(table)) == len(rows) and kept == {i for i, _ in rows}
    assert len(T.fit(spark.createDataFrame(rows, docs.schema), labels).words) >= 2


def test_short_texts_are_no_copies():
    mins = T._min_hashes(*K.text_parts(pa.array(["vile", "fine", "", "vile", "a b"])))[0]
    assert len(T.distinct(pa.table({"_k": range(5), "_y": [1, 0, 0, 1, 0], "mins": mins}))) == 4


def hash_of(word):
    """The 64-bit hash of a word's bytes, in plain integers."""
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    base, total, power = 0x9E3779B97F4A7C15, 0, 1
    for b in word:
        total, power = total + (b + 1) * power, power * base & m
    stems = []
    for size in (4, 5, 6, 7, 8):
        if len(word) > size:
            packed = size
            for b in word[:size]:
                packed = (packed * 257 + b + 1) & m
            stems.append(mix(packed * base & m) ^ m)
    return [mix((total & m) ^ len(word)), *stems]


def test_scores_against_brute_force(spark):
    """Each severity is the sum over thresholds of a logistic of the weights of the words and stems that a plain loop finds."""
    import math
    import re
    from collections import Counter

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.fit(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    assert len(weight) >= 5
    got = {r.doc_id: r for r in T.score(docs.select("doc_id", "text"), model).collect()}
    rejected = 0
    for i, r in got.items():
        counts = Counter(h for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode().lower()) for h in hash_of(w) if h in weight)
        x = sum(math.log1p(c) * weight[h] for h, c in counts.items())
        over = [1 / (1 + math.exp(-max(-50, min(50, x - t)))) for t in model.thresholds]
        assert abs(r.severity - sum(over)) < 1e-5 and r.grade == sum(p > 0.5 for p in over) and r.rejected == (r.severity >= 0.5)
        rejected += r.rejected
    assert rejected >= 20


def graded(spark, n=900):
    """Texts whose grade is the number of strengths that their worst word has."""
    rng, docs, labels = np.random.default_rng(12), [], []
    words, bad = [f"w{k}" for k in range(300)], [["mildo", "softy"], ["grubling", "grublast"], ["vileness", "horrid"]]
    for k in range(n):
        text, grade = list(rng.choice(words, 40)), int(rng.integers(0, 4))
        for level in range(grade):
            for _ in range(2):
                text.insert(int(rng.integers(0, 40)), str(rng.choice(bad[level])))
        docs.append((k, " ".join(text)))
        labels.append((k, grade))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_real_grades_are_learnt(spark):
    """Grades from the labels, held out: the expected severity is near the grade and keeps its order."""
    docs, labels = graded(spark)
    model = T.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = T.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).toPandas()
    assert (held.severity - held.toxic).abs().mean() <= 0.25 and (held.grade == held.toxic).mean() >= 0.85
    means = held.groupby("toxic").severity.mean().tolist()
    assert means == sorted(means) and means[0] < 0.3 and means[3] > 2.5


def test_made_grades_come_from_the_other_half():
    """A row's words have no part in the score that grades it: a word that only one row has scores nothing."""
    doc, cols, vals = np.array([0, 1, 2, 3, 4, 5]), np.array([0, 1, 0, 1, 2, 1]), np.ones(6)
    toxic = np.array([1, 0, 1, 1, 1, 0])
    score = T.out_of_fold(doc, cols, vals, toxic, 3, 1e-4, 200)
    assert score[4] == 0


def test_repeated_ids_and_text_ids(spark):
    docs, labels = labelled(spark)
    one = T.fit(docs, labels)
    again = T.fit(docs.union(docs).union(docs), labels.union(labels))
    named = T.fit(docs.selectExpr("concat('d', doc_id) as doc_id", "text"), labels.selectExpr("concat('d', doc_id) as doc_id", "toxic"))
    assert (one.words == again.words).all() and np.allclose(one.weights, again.weights) and (one.words == named.words).all()
