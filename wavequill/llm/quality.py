"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, column, documents, strings

#: Labelled rows that a fit uses at most, taken in order of a hash of doc_id, and their lines (the driver holds some 500 bytes for each).
FIT_ROWS, FIT_LINES = 4_000, 400_000

FEATURES = ("bias", "upper", "digit", "mark", "symbol", "pipe", "loud", "other", "blank", "repeat", "again", "log_length", "short", "word_length", "no_letters")

_UPPER, _LOWER, _DIGIT, _BLANK, _MARK, _SYMBOL, _PIPE, _LOUD = (np.zeros(256, bool) for _ in range(8))
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[128:256] = True
_DIGIT[48:58] = True
_BLANK[[9, 11, 12, 13, 32]] = True
_MARK[list(b".,;:'\"-()?")] = True
_SYMBOL[list(b"*%$&#@^~=+<>{}[]\\/_`")] = True
_PIPE[ord("|")] = True
_LOUD[ord("!")] = True


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines of the texts, bytes of each line, and the number of lines of each text.

    Whole arrays at once: character classes are sums over line ranges of the UTF-8 bytes, words are
    compared by polynomial hashes. Every text has one line at least, which may be empty.
    """
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    length = (ends - starts).astype(float)
    # A sum over [start, end] holds the line end, which is in no class.
    counts = lambda flags: np.add.reduceat(flags.astype(np.int32), starts).astype(float)
    second = np.zeros(len(data), bool)  # capital letters of two bytes: C3 80 to C3 9E
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = counts(_UPPER[data]) + counts(second)
    letters = np.maximum(counts(_UPPER[data] | _LOWER[data]), 1)
    digit, mark, symbol, pipe, loud, blank = (counts(c[data]) for c in (_DIGIT, _MARK, _SYMBOL, _PIPE, _LOUD, _BLANK))
    has_letters = counts(_UPPER[data] | _LOWER[data]) > 0

    # Words: runs of bytes that are neither blank nor line end.
    inside = ~(_BLANK[data] | (data == 10))
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    words = np.zeros(len(ends))
    same = np.zeros(len(ends))
    with np.errstate(over="ignore"):
        if len(first):
            marks = np.zeros(len(data), np.int64)
            marks[first] = 1
            which = np.cumsum(marks) - 1
            place = np.arange(len(data)) - first[np.maximum(which, 0)]
            power = _powers(int(place.max()) + 1)
            value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * power[np.maximum(place, 0)], np.uint64(0))
            hashed = np.add.reduceat(value, first)
            line = np.searchsorted(ends, first)
            words = np.bincount(line, minlength=len(ends)).astype(float)
            equal = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
            same += np.bincount(line[1:][equal], minlength=len(ends))
            line_hash = np.zeros(len(ends), np.uint64)
            np.add.at(line_hash, line, hashed * power[np.minimum(np.arange(len(first)) - np.searchsorted(line, line), len(power) - 1)])
        else:
            line_hash = np.zeros(len(ends), np.uint64)
    # Lines that an earlier line of the same text equals.
    doc = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((np.arange(len(ends)), line_hash, doc))
    again = np.zeros(len(ends))
    if len(ends) > 1:
        a, b = order[:-1], order[1:]
        again[b] = (doc[a] == doc[b]) & (line_hash[a] == line_hash[b]) & (length[b] > 0)
    size = np.maximum(length, 1)
    x = np.stack([
        np.ones(len(ends)), upper / letters, digit / size, mark / size, np.sqrt(symbol / size), np.sqrt(pipe / size), np.sqrt(loud / size),
        np.maximum(size - letters - digit - mark - symbol - pipe - loud - blank, 0) / size, blank / size, same / np.maximum(words - 1, 1), again,
        np.log1p(length), (words < 4).astype(float), np.minimum(length / np.maximum(words, 1), 40) / 10, 1.0 - has_letters,
    ], axis=1)
    return x, np.maximum(length, 1), lines


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    return np.multiply.accumulate(out)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and the line after; zeros beyond a text's ends."""
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])
    last = np.cumsum(lines) - 1
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after])


def forward_backward(unary: np.ndarray, lines: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1 (bad) by line, expected transition counts, and the log partition function.

    unary: a score of being bad for each line; step: 2x2 scores of moving between states. All texts
    go forward together, a line at a time; longer ones come first, so that the active ones are a prefix.
    """
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    long = lines[order]
    depth = int(long[0]) if len(long) else 0
    active = np.searchsorted(-long, -np.arange(depth), side="left") if depth else np.zeros(0, int)
    n = len(unary)
    alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.zeros(n)
    top = np.maximum(unary, 0)
    emit = np.stack([np.exp(-top), np.exp(unary - top)], axis=1)
    move = np.exp(step)
    for t in range(depth):
        at = first[: active[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
    pairs = np.zeros((2, 2))
    for t in range(depth - 1, 0, -1):
        at = first[: active[t]] + t
        b = beta[at] * emit[at] / scale[at][:, None]
        beta[at - 1] = b @ move.T
        pairs += move * (alpha[at - 1].T @ b)
    return alpha[:, 1] * beta[:, 1], pairs, float(np.log(scale).sum() + top.sum())


@dataclass(frozen=True)
class LineCrf:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    slope: float
    base: float

    def bad(self, texts: list[str]) -> np.ndarray:
        """Share of each text, by bytes of its lines, that lies in bad lines."""
        x, length, lines = line_features(texts)
        z = (with_neighbours(x, lines) - self.mean) / self.spread
        p, _, _ = forward_backward(z @ self.weights, lines, self.step)
        at = np.cumsum(lines) - lines
        return np.add.reduceat(p * length, at) / np.add.reduceat(length, at)

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.base + self.slope * self.bad(texts)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 25) -> np.ndarray:
    """Penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def train(x: np.ndarray, length: np.ndarray, lines: np.ndarray, good: np.ndarray, steps: int = 150) -> LineCrf:
    """Fit the field to texts of which only the whole is labelled.

    Lines of good texts are good. Those of bad texts start as bad; a logistic regression over the
    lines then says which of them look like the good texts' lines, and they become good, but for
    the worst line of each text. The field is fitted to these labels by gradient ascent; at last
    the share of bad lines is calibrated against the labels of the texts.
    """
    z = with_neighbours(x, lines)
    mean, spread = z.mean(axis=0), z.std(axis=0)
    mean[0], spread = 0.0, np.where(spread < 1e-6, 1.0, spread)
    spread[0] = 1.0
    z = (z - mean) / spread
    at = np.cumsum(lines) - lines
    bad_text = np.repeat(1 - good, lines).astype(float)
    y = bad_text.copy()
    for _ in range(3):
        w = _logistic(z, y, 1.0)
        s = z @ w
        worst = s >= np.repeat(np.maximum.reduceat(s, at), lines)
        y = bad_text * ((s > 0) | worst)
    step = np.zeros((2, 2))
    n = len(y)
    before = np.concatenate([[0], y[:-1]]).astype(int)
    starts = np.zeros(n, bool)
    starts[at] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (before[~starts], y.astype(int)[~starts]), 1)
    m = v = np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        p, pairs, _ = forward_backward(z @ w, lines, step)
        g = np.concatenate([z.T @ (p - y) + 1.0 * w, (pairs - seen + 1.0 * step).ravel()]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
        w, step = w - d[:-4], step - d[-4:].reshape(2, 2)
    p, _, _ = forward_backward(z @ w, lines, step)
    share = np.add.reduceat(p * length, at) / np.add.reduceat(length, at)
    base, slope = _logistic(np.stack([np.ones(len(share)), share], axis=1), good.astype(float), 0.01, 50)
    return LineCrf(mean, spread, w, step, float(slope), float(base))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = FIT_ROWS, max_lines: int = FIT_LINES) -> LineCrf:
    """Fit on at most ``max_rows`` labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Half of the rows are bad ones at most and half good ones at most, as far as there are so many.
    The driver gets the features of these rows' lines; rows are taken while their lines fit into ``max_lines``, each kind
    into half of it, and a row that doesn't fit is left out for those after it. With labels of one kind only, or
    none, the model gives 1 (or 0) throughout.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y"))
    sides = [chosen.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for c in ("y > 0", "y <= 0")]
    # At most max_rows small rows, so that they can be sent to every task; the texts stay where they are.
    # Of rows that share a doc_id one text is used, so that the bound holds; the aggregate spreads the sample over tasks.
    sample = documents(docs).join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            x, length, lines = line_features(strings(batch))
            cuts = np.cumsum(lines)[:-1]
            return {"y": column(batch, "y"), "x": [a.astype(np.float32).tobytes() for a in np.split(x, cuts)], "length": [a.astype(np.float32).tobytes() for a in np.split(length, cuts)], "key": column(batch, "key")}

        return one

    scratch = Scratch(spark, "quality")
    kept = scratch.keep(sample.select("text", "y", F.xxhash64("doc_id", "text").alias("key")), "sample")
    room, taken = {True: max_lines // 2, False: max_lines // 2}, []
    for r in kept.select("key", (F.col("y") > 0).alias("side"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines")).orderBy("key", "lines").collect():  # max_rows rows
        n = r["lines"] or 1
        if n <= room[r["side"]]:
            room[r["side"]] -= n
            taken.append((r["key"],))
    fits = kept.join(F.broadcast(spark.createDataFrame(taken, "key long").distinct()), "key", "left_semi")
    rows = sorted((r["key"], r["y"], r["x"], r["length"]) for r in arrow_map(fits, make, "y int, x binary, length binary, key long").collect())
    scratch.drop("sample")
    good = np.array([r[1] > 0 for r in rows], int)
    if not len(good) or good.min() == good.max():
        d = 3 * len(FEATURES)
        return LineCrf(np.zeros(d), np.ones(d), np.zeros(d), np.zeros((2, 2)), 0.0, 40.0 if not len(good) or good[0] else -40.0)
    x = np.concatenate([np.frombuffer(r[2], np.float32).reshape(-1, len(FEATURES)) for r in rows]).astype(float)
    length = np.concatenate([np.frombuffer(r[3], np.float32) for r in rows]).astype(float)
    lines = np.array([len(r[3]) // 4 for r in rows], np.int64)
    return train(x, length, lines, good)


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    score: 0 to 1, higher where quality is likelier; null and empty texts are one empty line and
    get what the field gives that line. held_out: crc32(doc_id as text) mod 3 is 1 (null doc_id: false).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            s = model.score(strings(batch))
            return {"doc_id": column(batch, "doc_id"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return one

    scored = arrow_map(documents(docs), make, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled part of ``docs`` and score all of it."""
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with their columns as they were."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from ._common import slices

        model = sent.value
        for batch in batches:
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            good = np.zeros(len(texts), bool)
            for a, b in slices(texts):
                good[a:b] = model.score(texts[a:b]) >= 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
