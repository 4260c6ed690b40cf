"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

P(grade > k | x) = sigmoid(w.x - t_k) for ordered thresholds t_0 <= t_1 <= ...; every threshold shares the weights w. The expected severity
of a text is the sum of these probabilities. Features are log(1 + count) of the words, and of the stems (the first ``STEMS`` bytes) of longer
words, that go with toxic labels (64-bit hashes, no dictionary). Words and stems are counted in Spark; the driver gets the chosen ones only.

Labels may be grades, 0 (clean) to ``GRADES``, and are fitted as they are. Where they only say 0 or 1, grades are made for the toxic rows: each half of
the rows is scored by a regression of the toxic against the clean rows of the other half, and the terciles of these scores are grades 1 to 3. So a
row's grade says how surely rows that it had no part in give it away; it is no human judgement of severity.

Defined cases: a null or empty text has no features and gets the severity of a text without toxic words; null labels or ids, and labels that are no
grade, are not trained on; of an id's labels the highest counts, of its texts (if rows repeat it) the smallest; ids may be whole numbers or texts; without toxic or without clean labels the model has no features and every severity is 0; repeated rows are scored alike, each; texts are
scored whole whatever their length. Columns that an output would repeat keep their name and the new one gets underscores after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import kernels as K
from eventloom.llm.common import arrow_batches, columns_of, id_type, named, narrow, stored
from eventloom.session import unused

GRADES = 3
#: Min-hashes that tell near copies among the labelled rows: copies agree in half of them or more.
MINS = 64
#: Bytes of a word's stems, features beside the word.
STEMS = (4, 5, 6, 7, 8)
#: A feature is a word or stem whose likelihood ratio (G squared) with the label is at least this, and that occurs in at least 3 toxic rows.
LEAST_G2 = 24.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word and of each stem of a longer word."""
    first, end, words, text = K.words(data, offsets, K.PUNCT, K.LOWER)
    stems, of = K.stems(data, first, end, STEMS, K.LOWER)
    return np.concatenate([words, ~stems]), np.concatenate([text, text[of]])


def counted(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count), sorted; of the sorted hashes ``chosen`` only, if given."""
    hashes, text = features(data, offsets)
    if chosen is not None:
        hit = held(hashes, chosen)
        hashes, text = hashes[hit], text[hit]
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])) if len(h) else np.zeros(0, np.int64)
    return t[new], h[new], np.diff(np.append(new, len(h)))


def held(hashes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where ``hashes`` are in the sorted ``chosen``: most are told by their first 16 bits."""
    if not len(chosen):
        return np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(chosen >> np.uint64(48)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(chosen, hashes[hit]), len(chosen) - 1)
    return hit[chosen[at] == hashes[hit]]


@dataclass
class OrdinalModel:
    """``words``: sorted hashes of the feature words; ``weights`` of these; ``thresholds`` in order."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 50.0))

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))

    def scores(self, column: pa.Array) -> np.ndarray:
        """w.x of each text."""
        data, offsets = K.text_parts(column)
        n = len(offsets) - 1
        if not len(self.words):
            return np.zeros(n)
        text, hashes, counts = counted(data, offsets, self.words)
        return np.bincount(text, np.log1p(counts) * self.weights[np.searchsorted(self.words, hashes)], n)


def _fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, p: int, l2: float, steps: int, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the penalised log-likelihood of the cumulative-link model; thresholds are t_0 + cumulated exp(.)."""
    n, weights = len(grade), np.zeros(p)
    above = np.array([np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(grades)])
    start = -np.log(above / (1 - above))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    params = np.concatenate([weights, free])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:p], np.exp(params[p + 1 :])
        t = params[p] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, vals * w[cols], n)
        over = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1)
        slope = edges * (1 - edges)
        i = np.arange(n)
        prob = np.maximum(edges[i, grade] - edges[i, grade + 1], 1e-12)
        by_score = (slope[i, grade] - slope[i, grade + 1]) / prob
        by_t = np.zeros((n, grades + 2))
        by_t[i, grade] -= slope[i, grade] / prob
        by_t[i, grade + 1] += slope[i, grade + 1] / prob
        g_t = by_t[:, 1:-1].sum(0)
        grad = np.concatenate([np.bincount(cols, vals * by_score[rows], p), [g_t.sum()], [g_t[k + 1 :].sum() * gaps[k] for k in range(grades - 1)]]) / n
        grad[:p] -= l2 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:p], params[p] + np.concatenate([[0.0], np.cumsum(np.exp(params[p + 1 :]))])


def g2(df: Column, k1: Column, n: int, n1: int) -> Column:
    """The likelihood ratio of a feature in ``df`` of ``n`` rows, ``k1`` of them among the ``n1`` toxic ones; 0 if it goes with the clean ones."""
    share, rate = k1 / df, n1 / n
    toxic, clean = k1 * F.log(share / rate), F.when(df > k1, (df - k1) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when(share > rate, 2 * (toxic + clean)).otherwise(0.0)


def out_of_fold(doc: np.ndarray, cols: np.ndarray, vals: np.ndarray, toxic: np.ndarray, p: int, l2: float, steps: int) -> np.ndarray:
    """The score of each row by a fit of the toxic against the clean rows of the other half (even against odd places)."""
    n, score = len(toxic), np.zeros(len(toxic))
    for half in (0, 1):
        train = np.arange(n) % 2 != half
        if 0 < toxic[train].sum() < train.sum():
            number = np.cumsum(train) - 1
            mine = train[doc]
            weights, _ = _fit_ordinal(number[doc[mine]], cols[mine], vals[mine], toxic[train], p, l2, steps, 1)
            score += np.where(train, 0.0, np.bincount(doc, vals * weights[cols], n))
    return score


def fit_counts(doc: np.ndarray, word: np.ndarray, count: np.ndarray, label: np.ndarray, words: np.ndarray, l2: float = 1e-4, steps: int = 400) -> OrdinalModel:
    """Fit to counts of the feature ``words`` (sorted): ``doc``, ``word``, ``count`` in parallel; ``label`` of each document, grades or 0 and 1."""
    cols, vals = np.searchsorted(words, word), np.log1p(count)
    grade = label.astype(np.int64)
    toxic = grade > 0
    if grade.max() == 1:
        score = out_of_fold(doc, cols, vals, toxic.astype(np.int64), len(words), l2, steps // 2)
        low, high = np.quantile(score[toxic], [1 / 3, 2 / 3])
        grade[toxic] = 1 + (score[toxic] > low) + (score[toxic] > high)
    return OrdinalModel(words, *_fit_ordinal(doc, cols, vals, grade, len(words), l2, steps))


def distinct(rows: pa.Table) -> list[int]:
    """Rows that are no (near) copy of another: one goes if half or more of its min-hashes are those of a row that stays, whatever the rows' order.

    Else the words of a passage that was copied often would pass for signs of its label. Rows that agree in two neighbouring min-hashes are
    compared (a pair of Jaccard 0.5 is missed with chance 0.0001).
    """
    mins = rows["mins"].to_pylist()
    table = np.array(mins, np.int64).reshape(len(mins), MINS)
    near: dict[tuple[int, int, int], list[int]] = {}
    kept = []
    for i in sorted(range(len(mins)), key=lambda i: (mins[i], rows["_y"][i].as_py(), rows["_k"][i].as_py())):
        pairs = [(k, *mins[i][k : k + 2]) for k in range(0, MINS, 2)]
        others = list({j for p in pairs for j in near.get(p, ())})
        if others and ((table[others] == table[i]).sum(axis=1) * 2 >= MINS).any():
            continue
        kept.append(i)
        for p in pairs:
            near.setdefault(p, []).append(i)
    return kept


def _passes(docs: DataFrame, what: Callable[[np.ndarray, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """(_k, _y, ...) with what ``what`` makes of the texts."""
    names = ["_k", "_y", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "_t"):
            yield pa.record_batch([batch.column(0), batch.column(2), *what(*K.text_parts(batch.column(1)))], names=names)

    return docs.select("_k", "_t", "_y").mapInArrow(run, f"_k {dict(docs.dtypes)['_k']}, _y int, {schema}")


def _min_hashes(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Of the word pairs of each text, or of its only word."""
    mins = np.full((len(offsets) - 1, MINS), np.uint64(K.MASK))
    _, _, hashes, text = K.words(data, offsets, K.PUNCT, K.LOWER)
    pairs = K.rolling(hashes, 2)
    inside = text[1:] == text[:-1]
    alone = np.bincount(text, minlength=len(mins))[text] == 1
    pairs, text = np.concatenate([pairs[inside], hashes[alone]]), np.concatenate([text[:-1][inside], text[alone]])
    order = np.argsort(text, kind="stable")
    pairs, text = pairs[order], text[order]
    if len(text):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        with np.errstate(over="ignore"):
            for k in range(MINS):
                mins[text[first], k] = np.minimum.reduceat(K.mix(pairs + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & K.MASK)), first)
    return [pa.array(list(mins.view(np.int64)), pa.list_(pa.int64()))]


def _lists(text: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    ends = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in values]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, seed: int = 7) -> OrdinalModel:
    """Fit to at most ``max_labelled`` labelled rows (those of the smallest hash of id and seed), whose texts are stored once."""
    arrow_batches(docs.sparkSession)
    kind = id_type(docs)
    sample = (
        labels.select(F.col("doc_id").cast(kind).alias("_k"), F.col("toxic").cast("int").alias("_y"))
        .where(F.col("_k").isNotNull() & F.col("_y").between(0, GRADES))
        .groupBy("_k").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64(F.col("_k"), F.lit(seed)), "_k")
        .limit(max_labelled)
    )
    rows = stored(narrow(docs).join(F.broadcast(sample), "_k").groupBy("_k").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y")), "labelled")
    got = _passes(rows, _min_hashes, "mins array<long>").toArrow()
    if not got.num_rows:
        return OrdinalModel()
    kept = got.take(pa.array(distinct(got)))
    n, n1 = kept.num_rows, int((kept["_y"].to_numpy() > 0).sum())
    if not 0 < n1 < n:
        return OrdinalModel()
    ids = docs.sparkSession.createDataFrame(pa.table({"_k": pa.array(sorted(kept["_k"].to_pylist()), kept["_k"].type)}))
    rows = rows.join(F.broadcast(ids), "_k", "left_semi")

    def every(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        text, h, _ = counted(data, offsets)
        return _lists(text, len(offsets) - 1, h.view(np.int64))

    seen = _passes(rows, every, "words array<long>").select("_y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("_y") > 0).alias("k1"))
    chosen = seen.where("k1 >= 3").where(g2(F.col("df"), F.col("k1"), n, n1) >= LEAST_G2).select("word").toArrow()["word"]
    words = np.sort(chosen.to_numpy().view(np.uint64))
    if not len(words):
        return OrdinalModel()

    def some(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        text, h, c = counted(data, offsets, words)
        return _lists(text, len(offsets) - 1, h.view(np.int64), c)

    got = _passes(rows, some, "words array<long>, counts array<long>").toArrow().sort_by("_k").combine_chunks()  # rows come in any order; the fit should not depend on it
    lists = [pa.concat_arrays(got[c].chunks) for c in ("words", "counts")]
    doc = np.repeat(np.arange(got.num_rows), lists[0].value_lengths().to_numpy())
    word, count = (x.flatten().to_numpy() for x in lists)
    return fit_counts(doc, word.view(np.uint64), count, got["_y"].to_numpy(), words)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", reject_from: float = 0.5) -> DataFrame:
    """``docs`` with ``severity`` (expected grade, 0 to 3), ``grade`` (thresholds more likely passed than not) and ``rejected``."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("struct<severity:double,grade:int>")
    def severity(column: pa.Array) -> pa.Array:
        parts = [model.scores(b.column(0)) for b in K.slices(iter([pa.record_batch([column], names=["t"])]), "t")]
        over = model.exceed(np.concatenate(parts) if parts else np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(np.round(over.sum(1), 6)), pa.array((over > 0.5).sum(1), pa.int32())], names=["severity", "grade"])

    held = unused(docs, "_toxicity")
    names = [unused(docs, n) for n in ("severity", "grade", "rejected")]
    got = docs.withColumn(held, severity(F.coalesce(named(text).cast("string"), F.lit(""))))
    return got.select(*columns_of(docs), F.col(f"{held}.severity").alias(names[0]), F.col(f"{held}.grade").alias(names[1]), (F.col(f"{held}.severity") >= reject_from).alias(names[2]))


def keep_clean(docs: DataFrame, labels: DataFrame, reject_from: float = 0.5) -> DataFrame:
    """The documents whose expected severity is under ``reject_from``, with their own columns."""
    scored = score(docs, fit(docs, labels), reject_from=reject_from)
    return scored.where(~named(scored.columns[-1])).select(*columns_of(docs))
