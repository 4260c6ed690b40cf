import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from eventloom.llm import minhash as M
from eventloom.operators.components import components

SCHEMA = "doc_id long, text string, id string, bands int"


def shingles(text):
    w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.lower().encode())
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def exact(a, b):
    a, b = shingles(a), shingles(b)
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a.keys() & b.keys())


def brute(rows, least=0.5):
    """Groups by comparing every pair."""
    rows = [(i, t) for i, t in rows if i is not None and t and shingles(t)]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for x in range(len(rows)):
        for y in range(x):
            if rows[x][0] != rows[y][0]:
                s = exact(rows[x][1], rows[y][1])
                if s >= least:
                    pairs.append((rows[x][0], rows[y][0], s))
                    a, b = find(rows[x][0]), find(rows[y][0])
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}, pairs


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            copy = list(text)
            for _ in range(max(1, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


def test_similarity_is_exact():
    rng = random.Random(1)
    left = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    right = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    got = M.similarity(pa.array(left), pa.array(right))
    assert np.allclose(got, [exact(a, b) if shingles(a) and shingles(b) else 0 for a, b in zip(left, right)], atol=1e-12)


def test_registers_estimate_similarity():
    rng = random.Random(2)
    base = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(200)]
    other = base[:120] + [rng.choice("mnop") for _ in range(80)]
    texts = [" ".join(base), " ".join(other)]
    data, offsets = M.K.text_parts(pa.array(texts))
    t, s, c = M.shingles(data, offsets)
    sig = M.signatures(t, s, c.astype(float), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact(*texts)) < 0.04


def test_groups_against_brute_force(spark):
    rows = corpus()
    want, pairs = brute(rows)
    got = {r.doc_id: r.group_id for r in M.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(got.get(a, a) == got.get(b, b) for a, b, _ in pairs) / len(pairs)
    assert recall >= 0.95
    for i, g in got.items():
        assert want[i] == want[g]


def test_awkward_rows(spark):
    same = "one two three four five"
    rows = [(1, same), (2, same.upper() + "!"), (2, same), (3, None), (4, ""), (5, " .,"), (None, same), (6, "word"), (7, "Word"), (8, "x " * 200000), (9, "x " * 200000), (10, "quite another text here")]
    docs = spark.createDataFrame([(*r, "i", 1) for r in rows], SCHEMA)
    got = {(r.doc_id, r.group_id) for r in M.groups(docs).collect()}
    assert got == {(1, 1), (2, 1), (6, 6), (7, 6), (8, 8), (9, 8)}
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 8), (False, 10), (True, 0)]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert M.groups(docs).count() == 0 and M.keep_one(docs).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(64)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if any(find(i) == find(j) for j in root if j != i)}


def test_whole_table(spark, sf):
    from eventloom.llm.registry import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    grams = {i: shingles(t) for i, t in rows}
    got = {r.doc_id: r.group_id for r in queries()["op6_minhash"](spark, sf).collect()}
    n = found = 0
    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            p, q = grams[i], grams[j]
            if not p or not q or sum((p & q).values()) < 0.33 * max(sum(p.values()), sum(q.values())):
                continue
            s = M.similarity(pa.array([a]), pa.array([b]))[0]
            if s >= 0.5:
                n += 1
                found += got.get(i, i) == got.get(j, j)
    assert n and found / n >= 0.9


def test_bands_meet_pairs_at_the_threshold():
    """Of 400 isolated pairs whose similarity is the threshold, nine of ten or more share a band."""
    assert 1 - (1 - 0.5 ** (M.SIZE // M.BANDS)) ** M.BANDS >= 0.92
    rng, texts = np.random.default_rng(5), []
    for k in range(400):
        shared = [int(x) for x in rng.integers(0, 1 << 40, 80)]
        for _ in range(2):
            texts.append([*shared, *(int(x) for x in rng.integers(0, 1 << 40, 40))])  # 80 of 160 shingles are shared
    shingle = np.array(texts, np.uint64)
    text = np.repeat(np.arange(len(texts)), 120)
    found = M.bands(M.signatures(text, shingle.ravel(), np.ones(shingle.size), len(texts)))
    assert (found[::2] == found[1::2]).any(axis=1).mean() >= 0.95
