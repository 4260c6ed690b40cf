from collections import Counter

from eventloom.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, digest int, _same string, note string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", n) for i, t, n in rows], SCHEMA)


ROWS = [(5, "a", "p"), (3, "a", "q"), (3, "a", "q"), (None, "a", "r"), (7, None, "s"), (8, None, "t"), (9, "", "u"), (2, "", "v"), (None, "only", "w"), (None, "only", "w"), (4, "long " * 50000, "x"), (1, "long " * 50000, "y"), (6, "a ", "z")]


def test_awkward_rows(spark):
    docs = docs_of(spark, ROWS)
    got = E.dedup(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, (r.text or "")[:4], r.text is None) for r in got.collect())
    assert kept == Counter([(3, "a", False), (7, "", True), (8, "", True), (2, "", False), (None, "only", False), (1, "long", False), (6, "a ", False)])


def test_empty(spark):
    index = E.new_index(spark, 4)
    E.ingest(docs_of(spark, []), index, lambda rows: rows.count())
    assert E.dedup(docs_of(spark, []), index).count() == 0


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_index_over_batches(spark):
    index = E.new_index(spark, 4)
    out = []
    E.ingest(docs_of(spark, [(1, "a", ""), (2, "b", ""), (3, "b", "")]), index, lambda rows: out.append(ids(rows)))
    E.ingest(docs_of(spark, [(0, "b", ""), (4, "c", ""), (5, None, ""), (6, "c", "")]), index, lambda rows: out.append(ids(rows)))
    assert out == [[1, 2], [4, 5]]
    assert index.table().count() == 3
    again = E.DigestIndex(spark, index.path, index.name + "_again")
    assert again.buckets == 4 and ids(E.dedup(docs_of(spark, [(8, "a", ""), (9, "d", "")]), again)) == [9]


def test_a_failed_batch_loses_nothing(spark):
    index, docs = E.new_index(spark, 4), docs_of(spark, [(1, "a", ""), (2, "b", "")])

    def fail(rows):
        raise OSError("full")

    for _ in range(2):
        try:
            E.ingest(docs, index, fail)
        except OSError:
            pass
    assert ids(E.dedup(docs, index)) == [1, 2]
    first = E.batch(docs, index)
    first.commit()
    first.commit()  # repeated: no change
    assert ids(first.rows) == [1, 2] and ids(E.dedup(docs, index)) == []


def test_rewriting_keeps_the_digests_and_the_index_side_unshuffled_and_unsorted(spark):
    index = E.DigestIndex(spark, E.new_index(spark, 4).path + "_c", "digests_compacted", 4, compact_after=3)
    for k in range(7):
        E.ingest(docs_of(spark, [(10 * k + j, f"text {k} {j}", "") for j in range(20)]), index, lambda rows: rows.count())
    assert index.generation >= 1 and index.table().count() == 140
    index.compact()
    assert index.files_a_bucket() == 1 and index.table().count() == 140
    with E.sorted_buckets(spark):
        plan = index.unseen(spark.createDataFrame([(b"x",)], "digest binary"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    join = next(k for k, x in enumerate(lines) if "SortMergeJoin" in x)
    assert sum("Exchange" in x for x in lines[join:]) == 1 and sum("Sort " in x for x in lines[join:]) == 1, plan
    assert E.DigestIndex(spark, index.path, "digests_reopened").table().count() == 140


def test_awkward_columns(spark):
    rows = [("d1", "x", {"k": 1}, 1), ("d1", "x", {"k": 1}, 1), ("d0", "x", {"k": 2}, 2), ("d2", None, None, 3), (None, "y", {}, 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, `a.b` map<string,int>, `c``d` int")
    got = E.dedup(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or "", r[3]) for r in got.collect()) == [("", 4), ("d0", 2), ("d2", 3)]
    assert sorted(r.doc_id or "" for r in E.dedup_batches(docs).collect()) == ["", "d0", "d2"]
    assert sorted(r.doc_id for r in E.dedup(docs.where("doc_id = 'd1'")).collect()) == ["d1"]


def test_whole_table(spark, sf):
    from eventloom.llm.registry import queries

    best = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        best[r.text] = min(best.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in queries()["op3_exact_dedup"](spark, sf).collect()) == sorted(best.values())


def test_batches_cover_the_table(spark):
    index, docs = E.new_index(spark, 4), docs_of(spark, ROWS)
    got = E.dedup_batches(docs, index)
    kept = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert got.columns == docs.columns and kept(got) == kept(E.dedup(docs))
    assert index.table().count() == len({t for _, t, _ in ROWS} - {None})
    assert E.dedup_batches(docs.limit(0), index).count() == 0


def test_query_reads_the_index_again(spark, sf, monkeypatch):
    from eventloom.llm.registry import queries

    held, unseen = [], E.DigestIndex.unseen

    def noted(self, digests):
        held.append(self.table() is not None)
        return unseen(self, digests)

    monkeypatch.setattr(E.DigestIndex, "unseen", noted)
    queries()["op3_exact_dedup"](spark, sf).count()
    assert held == [True]  # the second batch; the first finds no index
