import random

from eventloom.llm import licenses as L

SCHEMA = "doc_id long, text string, license string, s int"


def distance(pattern, text):
    """The fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        at = rng.randrange(len(s))
        s[at : at + 1] = rng.choice([[], ["q"], [s[at], "q"]])
    return "".join(s)


def test_same_as_brute_force():
    rng, f = random.Random(2), L.finder()
    for _ in range(60):
        name = rng.choice(list(L.NOTICES))
        k = rng.randint(0, 2 * f.edits[name])
        text = "some words " + edited(rng, L.NOTICES[name], k) + " more words"
        near = {n for n in L.NOTICES if distance(L.NOTICES[n], text) <= f.edits[n]}
        found = f.spans(text)
        assert bool(found) == bool(near)
        assert {n for n, *_ in found} <= near
        for n, a, b, e in found:
            assert e <= f.edits[n] and distance(L.NOTICES[n], text[a:b]) <= e


def test_awkward_rows(spark):
    text = "İ🙂 Licensed under the APACHE License, Version 2.0."
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "released under the mit licence"), (4, "z " * 100000 + "Released under the MIT License")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license, r.begin, r.edits) for r in L.scan(docs).collect())
    assert got == [(False, 1, "Apache-2.0", 3, 0)] * 2 + [(False, 4, "MIT", 200000, 0), (True, 0, "MIT", 0, 1)]
    assert L.scan(docs.limit(0)).count() == 0


def test_whole_table(spark):
    from eventloom.llm.registry import queries

    d, f = "/root/testdata/sf0.01", L.finder()
    want = sorted((r.doc_id, *s) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for s in f.spans(r.text))
    assert sorted((r.doc_id, r.license, r.begin, r.end, r.edits) for r in queries()["op10_licenses"](spark, d).collect()) == want


def test_notices_side_by_side():
    f, exact = L.finder(), "Licensed under the Apache License, Version 2.0"
    once, twice = exact.replace("nsed", "nced", 1), exact.replace("under", "undr", 1).replace("Apache", "Apach", 1)
    for copies in ([once, exact], [exact, once], [twice, once, exact, once, twice], [once, exact] * 40):
        text = "\n".join(copies)
        assert [(text[a:b], e) for _, a, b, e in f.spans(text)] == [(c, 0 if c == exact else 1 if c == once else 2) for c in copies]


def places(pattern, text, most):
    """(end, edits) of the places where a part of the text within ``most`` edits of the pattern ends, by dynamic programming."""
    row, out = list(range(len(pattern) + 1)), []
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        if row[-1] <= most:
            out.append((j, row[-1]))
    return out


def test_the_prefilter_is_the_edit_distance():
    rng = random.Random(11)
    for _ in range(150):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(20, 90)))
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) + edited(rng, pattern, rng.randint(0, 12)) + "".join(rng.choice("abcd ") for _ in range(20))
        most = rng.randint(0, 10)
        if most < len(pattern):
            assert L.Nearest(pattern, most)(text, 0, len(text)) == bool(places(pattern, text, most))


def test_several_edited_notices_in_a_row():
    """Each of several notices of one kind, edited differently, is found where it is, in any order."""
    rng, f = random.Random(7), L.finder()
    for _ in range(120):
        name = rng.choice(list(L.NOTICES))
        notice, most = L.NOTICES[name], L.finder().edits[name]
        text, want = "", []
        for _ in range(rng.randint(2, 5)):
            copy = edited(rng, notice, rng.randint(0, most))
            want.append((len(text), len(text) + len(copy)))
            text += copy + rng.choice(["\n", ".\n", " and ", "\n\n# "])
        found = [(a, b) for n, a, b, _ in f.spans(text) if n == name]
        for a, b in want:  # one span for each, that shares most of it
            assert sum(min(b, y) - max(a, x) > (b - a) / 2 for x, y in found) == 1, (name, text, found)
        ends = places(notice, text, most)
        assert all(any(abs(e - y) <= most for e, _ in ends) for _, y in found)
