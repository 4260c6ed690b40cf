import hashlib
import math
import re
from collections import Counter, defaultdict

from eventloom.llm import mixing
from eventloom.llm.registry import MIX_WEIGHTS

SCHEMA = "doc_id long, text string, source string, _rate int, copy string"


def brute(rows, weights, default=1.0, seed=17):
    """Copies of each row, from (doc_id, text, source)."""
    tokens = defaultdict(int)
    for _, text, source in rows:
        tokens[source] += len(re.findall(r"[^ \t\n\r]+", text or ""))
    tokens = {s: n for s, n in tokens.items() if n}
    weight = {s: weights.get(s, default) for s in tokens}
    out = []
    for doc_id, text, source in rows:
        if source not in tokens:
            out.append(0)
            continue
        rate = weight[source] * sum(tokens.values()) / (sum(weight.values()) * tokens[source])
        key = str(doc_id) if doc_id is not None else hashlib.md5(text.encode()).hexdigest() if text is not None else ""
        u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 2**32
        out.append(math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def test_awkward_rows(spark):
    rows = [(1, "a b c", "x"), (2, "a b", "x"), (2, "a b", "x"), (3, None, "x"), (4, "", "y"), (5, "w " * 40, None), (None, "q r", "z"), (None, None, "z"), (6, "e", "empty"), (7, " \n", "none")]
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], SCHEMA)
    got = mixing.mix(docs, {"x": 3.0, "z": 0.5})
    assert got.columns == docs.columns
    want = Counter()
    for row, n in zip(rows, brute(rows, {"x": 3.0, "z": 0.5})):
        want[row] += n
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +want
    named = mixing.mix(docs, {"x": 3.0}, copies="copy")
    assert named.columns == [*docs.columns, "copy_"]


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), {"x": 1.0}).count() == 0


def test_whole_table(spark, sf):
    from eventloom.llm.registry import queries

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter({r[0]: n for r, n in zip(rows, brute(rows, MIX_WEIGHTS)) if n})
    got = queries()["op1_mix"](spark, sf).collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(1 <= r["copy"] <= want[r.doc_id] for r in got)
