import random
import re

from eventloom.llm import substring as S

SCHEMA = "doc_id long, text string, word string, h1 int"


def brute(rows, width=50):
    """Spans of words that repeated windows cover, from (doc_id, text)."""
    where, words = {}, []
    for i, t in rows:
        w = [x for x in re.split(r"[ \t\n\x0b\f\r\x1c-\x1f]+", t or "") if x] if i is not None else []
        words.append(w)
        for k in range(len(w) - width + 1):
            where.setdefault(tuple(w[k : k + width]), set()).add(i)
    starts = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            if len(where[tuple(w[k : k + width])]) > 1:
                starts.setdefault(i, set()).add(k)
    out = []
    for i, at in starts.items():
        run = None
        for k in sorted(at):
            if run and k <= run[2] + width:
                run[2] = k
            else:
                run = [i, k, k]
                out.append(run)
    return sorted((i, a, b + width) for i, a, b in out)


def got(docs, **more):
    return sorted((r.doc_id, r.begin_word, r.end_word) for r in S.spans(docs, **more).collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(50)]
    shared = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 30))] + (rng.choice(shared) if rng.random() < 0.6 else [])
        rows.append((k, rng.choice([" ", "\n", "  "]).join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs, width=12, gram=6) == brute(rows, 12)
    # a sketch too narrow for the corpus lets more through to the exact pass and loses nothing
    assert got(docs, width=12, gram=6, most_cells=1 << 16) == brute(rows, 12)


def test_awkward_rows(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, "a b " + passage), (2, passage + " c"), (3, None), (4, ""), (None, passage), (5, " ".join(["same"] * 200)), (6, passage.upper()), (7, "x " * 100000 + passage), (8, "short"), (9, "rep " + passage), (9, "rep " + passage)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA)
    assert got(docs) == [(1, 2, 57), (2, 0, 55), (7, 100000, 100055), (9, 1, 56)]
    twice = spark.createDataFrame([(1, passage), (1, passage), (2, "z")], "doc_id long, text string")
    assert got(twice) == []


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_whole_table(spark, sf):
    from eventloom.llm.registry import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.begin_word, r.end_word) for r in queries()["op5_substring"](spark, sf).collect()) == brute(rows)
