"""Toxicity severity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, column, documents, strings

#: Labelled rows that a fit uses at most, half of them toxic ones at most, taken in order of a hash of doc_id.
FIT_ROWS = 20_000
#: Text features that a model holds at most, those that speak for toxicity, and those that speak against it.
MAX_FEATURES, MAX_AGAINST = 4_096, 1_024
GRADES = 4

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


def word_features(word: str) -> tuple[str, ...]:
    """A lower-case word itself, and its beginnings, which inflected forms of a stem share."""
    return (word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n))


def text_features(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(word_features(w))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - cut_k): one weight vector for all ordered thresholds."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def exceed(self, found: list[set[int]]) -> np.ndarray:
        score = np.array([self.weights[list(f)].sum() if f else 0.0 for f in found])
        return _sigmoid(score[:, None] - self.cuts[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_cumulative_link(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 0.02, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood of the cumulative-link model by Adam; cuts stay ordered by construction.

    rows: feature indices of each text. The l2 penalty is for the sum over all rows.
    """
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(n_features), [first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, free = theta[:n_features], theta[n_features:]
        cuts = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(at, w[col], n)
        over = _sigmoid(score[:, None] - cuts)  # P(grade > k)
        upper = np.hstack([np.ones((n, 1)), over])
        lower = np.hstack([over, np.zeros((n, 1))])
        i = np.arange(n)
        p = np.maximum(upper[i, grades] - lower[i, grades], 1e-12)
        d_over = over * (1 - over)
        d_upper = np.where(grades > 0, d_over[i, np.maximum(grades - 1, 0)], 0.0)
        d_lower = np.where(grades < n_grades - 1, d_over[i, np.minimum(grades, n_grades - 2)], 0.0)
        g_score = -(d_upper - d_lower) / p
        g_cut = np.zeros(n_grades - 1)
        np.add.at(g_cut, np.maximum(grades - 1, 0), np.where(grades > 0, d_upper / p, 0.0))
        np.add.at(g_cut, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -d_lower / p, 0.0))
        g_free = np.concatenate([[g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(free[1:])])
        g = np.concatenate([np.bincount(col, g_score[at], n_features) + l2 * w, g_free]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    free = theta[n_features:]
    return theta[:n_features], np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = FIT_ROWS, max_features: int = MAX_FEATURES, max_against: int = MAX_AGAINST) -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Toxic rows are half of the sample at most and others fill it up, so that rare toxicity has its rows; the cuts are then
    moved to the shares that all usable labels have. Features: words and word beginnings that at least 3 toxic
    rows hold and that occur in toxic rows for the greater part (against their share of rows), at most ``max_features`` by the
    G2 statistic, and ``max_against`` of those that other rows hold and toxic rows hardly do, by the same statistic; their weights tell
    for or against.

    ``labels`` marks rows 0 or 1, so there are no grades above 1 to learn from. They are made: of the toxic rows, those with 2
    or 3 selected words are grade 2, those with more grade 3. With labels of one kind only, or none, the model gives 0
    (or 1) throughout.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = chosen.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    known = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    least = min(known.get(1, 0), max_rows // 2)
    some = lambda y, n: chosen.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = some(1, max(least, max_rows - known.get(0, 0))).unionByName(some(0, max_rows - least))
    # At most max_rows small rows, so that they can be sent to every task; the texts stay where they are.
    # Of rows that share a doc_id one text is used, so that the bound holds; the aggregate spreads the sample over tasks.
    sample = scratch.keep(documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")

    def make_counts():
        def one(batch: pa.RecordBatch) -> dict:
            toxic: Counter = Counter()
            other: Counter = Counter()
            for text, y in zip(strings(batch), column(batch, "y").to_pylist(), strict=True):
                (toxic if y > 0 else other).update(text_features(text))
            names = [f for f in {*toxic, *other}]
            return {"feature": names, "toxic": [toxic[f] for f in names], "other": [other[f] for f in names]}

        return one

    sizes = {r["y"]: r["n"] for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos or not neg:
        return OrdinalModel({}, np.zeros(0), np.full(GRADES - 1, -40.0 if pos else 40.0))
    seen = arrow_map(sample.select("text", "y"), make_counts, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    seen = scratch.keep(seen, "seen")  # both choices below read it
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g2 = lambda x, n: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    every = a + b
    strength = 2 * (g2(a, every * pos / (pos + neg)) + g2(b, every * neg / (pos + neg)))
    share = lambda x, n: (x + 0.5) / (n + 1)
    strong = seen.withColumn("g2", strength).orderBy(F.desc("g2"), "feature")
    best = strong.where("a >= 3").where(share(a, pos) > 4 * share(b, neg)).where(share(a, 1) > share(b, 1)).limit(max_features).collect()
    against = strong.where("b >= 3").where(share(b, neg) > 4 * share(a, pos)).limit(max_against).collect()
    vocabulary = {r["feature"]: i for i, r in enumerate([*best, *against])}
    scratch.drop("seen")
    whole = {i for f, i in vocabulary.items() if i < len(best) and not f.endswith("-")}
    rows, y = [], []
    matched = arrow_map(sample.select("text", "y"), lambda: _matcher(vocabulary, keep="y"), "found array<int>, y int")
    for r in matched.toLocalIterator():  # at most max_rows rows of selected features
        rows.append(sorted(r["found"]))
        y.append(r["y"])
    order = sorted(range(len(rows)), key=lambda i: (rows[i], y[i]))  # sums don't depend on the order of partitions
    rows, y = [rows[i] for i in order], [y[i] for i in order]
    words = np.array([len(whole.intersection(r)) for r in rows])
    grades = np.where(np.array(y) > 0, 1 + (words >= 2) + (words >= 4), 0)
    for g in range(1, GRADES):  # an empty grade would put a cut at infinity
        if not (grades == g).any():
            grades = np.where(grades > g, grades - 1, grades)
    weights, cuts = fit_cumulative_link(rows, grades, len(vocabulary), int(grades.max()) + 1)
    scratch.drop("sample")
    # The sample's odds against all usable labels' odds.
    cuts = cuts + np.log(pos / neg) - np.log(known[1] / known[0])
    return OrdinalModel(vocabulary, weights, np.concatenate([cuts, np.full(GRADES - 1 - len(cuts), 40.0)]))


class _Finder:
    """Selected features of whole texts; what a word gives is remembered."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        words = set(_WORD.findall(text.lower()))
        new = words.difference(self.known)
        if new:
            if len(self.known) + len(new) > _CACHE:
                self.known.clear()
                new = words
            get = self.vocabulary.get
            for w in new:
                self.known[w] = tuple(i for i in map(get, word_features(w)) if i is not None)
        known = self.known
        return {i for w in words for i in known[w]}


def _matcher(vocabulary: dict[str, int], keep: str):
    find = _Finder(vocabulary)
    return lambda batch: {"found": [list(find(t)) for t in strings(batch)], keep: column(batch, keep)}


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity (0 to 3), grade (the likeliest), p_toxic and toxic for every whole text.

    expected_severity is the sum over the ordered thresholds of P(grade > k); toxic where
    P(grade > 0) is at least one half. Null and empty texts have no features and get what the model gives then: a low
    severity. Every row of the input has its row in the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        find = _Finder(model.vocabulary)

        def one(batch: pa.RecordBatch) -> dict:
            over = model.exceed([find(t) for t in strings(batch)])
            p = np.hstack([np.ones((len(over), 1)), over]) - np.hstack([over, np.zeros((len(over), 1))])
            return {"doc_id": column(batch, "doc_id"), "expected_severity": over.sum(axis=1), "grade": p.argmax(axis=1).astype(np.int32), "p_toxic": over[:, 0], "toxic": over[:, 0] >= 0.5}

        return one

    return arrow_map(documents(docs), make, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled part of ``docs`` and score all of it."""
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with their columns as they were."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        model = sent.value
        find = _Finder(model.vocabulary)
        for batch in batches:
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            clean = model.exceed([find(t) for t in texts])[:, 0] < 0.5 if texts else np.zeros(0, bool)
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, schema)
