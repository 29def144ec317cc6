"""Ordinal patterns: permutation entropy and symbolic mutual information."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import let, window

#: Channel pairs that leave a Python task at once.
PAIRS = 1 << 16


def alphabet(kernel: int) -> list[tuple[int, ...]]:
    """All patterns, ordered so that a pattern and its reverse stand at i and n! - 1 - i."""
    forward: list[tuple[int, ...]] = []
    for p in permutations(range(kernel)):
        if p not in forward and p[::-1] not in forward:
            forward.append(p)
    return forward + [p[::-1] for p in reversed(forward)]


def weight(i: Column, j: Column, n_symbols: int) -> Column:
    """0 for equal and for mirrored symbols, else 1."""
    return F.when((i == j) | (i + j == n_symbols - 1), 0.0).otherwise(1.0)


def _pattern(values: Sequence[Column]) -> Column:
    """Order of the values as a number in base kernel: argsort digits, ties by position."""
    k = len(values)
    rank = [sum(((values[j] < values[i]) if j > i else (values[j] <= values[i])).cast("int") for j in range(k) if j != i) for i in range(k)]
    # The digit at a value's rank is its position.
    return sum((F.pow(F.lit(float(k)), F.lit(float(k - 1)) - r.cast("double")).cast("int") * i for i, r in enumerate(rank)), F.lit(0))


def symbols(data: Column, kernel: int, tau: int) -> Column:
    """Symbol of every embedded vector x[t], x[t + tau], ... as its place in the alphabet; empty for short signals."""
    n = F.size(data) - tau * (kernel - 1)
    code = {sum(d * kernel ** (kernel - 1 - j) for j, d in enumerate(p)): s for s, p in enumerate(alphabet(kernel))}
    table = F.array(*(F.lit(code.get(c, -1)) for c in range(kernel**kernel)))
    shifted = [F.slice(data, 1 + j * tau, F.greatest(n, F.lit(0))).alias(f"x{j}") for j in range(kernel)]
    embedded = F.arrays_zip(*shifted)
    return F.transform(embedded, lambda e: F.element_at(table, _pattern([e[f"x{j}"] for j in range(kernel)]) + 1))


def permutation_entropy(signals: DataFrame, taus: Sequence[int] = (8,), kernel: int = 3, tmin: float | None = None, tmax: float | None = None) -> DataFrame:
    """Entropy of pattern shares over ln(kernel!) for each row and tau; NaN where no vector fits. Filtered input is the caller's."""
    _check(kernel, taus)
    n_symbols = math.factorial(kernel)
    keep = [c for c in signals.columns if c != "data"]
    data = window(F.col("data"), F.col("sfreq"), F.col("tmin"), tmin, tmax)
    out = signals.select(*keep, data.alias("data")).select(*keep, F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), symbols(F.col("data"), kernel, t).alias("sym")) for t in taus))).alias("e"))
    out = out.select(*keep, "e.tau", "e.sym")
    counts = F.array(*(F.size(F.filter("sym", lambda x: x == s)) for s in range(n_symbols)))
    n = F.size("sym")
    entropy = let(n.cast("double"), lambda n: F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / n * F.ln(c / n)).otherwise(0.0)))
    return out.select(*keep, "tau", F.when(n > 0, entropy / math.log(n_symbols)).otherwise(float("nan")).alias("value"))


def mutual_information(signals: DataFrame, taus: Sequence[int] = (8,), kernel: int = 3, weighted: bool = True, tmin: float | None = None, tmax: float | None = None, keys: Sequence[str] = ("element", "epoch"), full: bool = True) -> DataFrame:
    """Symbolic mutual information of all channel pairs of an epoch: keys, tau, channel_i, channel_j, value.

    ``full`` gives the symmetric matrix with its zero diagonal. Channels of an epoch meet in one
    group, whose pairs are counted by products of indicator matrices; epochs are the unit of
    distribution, and a recording has as many as it likes. Pairs leave Python in batches of at most
    PAIRS, or of one epoch, so that the memory depends on neither the epochs of a batch nor the size of the input.
    """
    import pyarrow as pa

    _check(kernel, taus)
    n_symbols = math.factorial(kernel)
    patterns = np.array(alphabet(kernel))
    code = {int(sum(d * kernel ** (kernel - 1 - j) for j, d in enumerate(p))): s for s, p in enumerate(patterns.tolist())}
    table = np.full(kernel**kernel, -1)
    table[list(code)] = list(code.values())
    i = np.arange(n_symbols)
    weights = np.where((i[:, None] == i[None, :]) | (i[:, None] + i[None, :] == n_symbols - 1), 0.0, 1.0) if weighted else np.ones((n_symbols, n_symbols))
    types = {f.name: f.dataType.simpleString() for f in signals.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", tau int, channel_i string, channel_j string, ch_i int, ch_j int, value double"

    def matrix(x: np.ndarray, tau: int) -> np.ndarray:
        n = x.shape[1] - tau * (kernel - 1)
        if n <= 0:
            raise ValueError(f"{x.shape[1]} samples are too few for kernel {kernel} and tau {tau}")
        embedded = np.stack([x[:, j * tau : j * tau + n] for j in range(kernel)], axis=2)
        sym = table[(np.argsort(embedded, axis=2, kind="stable") * kernel ** np.arange(kernel - 1, -1, -1)).sum(axis=2)]
        one = (sym[:, :, None] == np.arange(n_symbols)).astype(float)
        own = np.log(one.mean(axis=1) + 1e-15)
        flat = one.transpose(0, 2, 1).reshape(-1, n)
        joint = (flat @ flat.T / n).reshape(len(x), n_symbols, len(x), n_symbols)
        with np.errstate(divide="ignore", invalid="ignore"):
            term = joint * (np.log(joint) - own[:, :, None, None] - own[None, None, :, :])
        term = np.where(joint > 1e-15, term, 0.0) * weights[None, :, None, :]
        out = term.sum(axis=(1, 3)) / math.log(n_symbols)
        upper = np.triu(out, 1)
        return upper + upper.T

    def pairs(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        row, tau, a, b, value = (np.concatenate(v) for v in zip(*held, strict=True))
        names, ix = batch.column("__names"), batch.column("__ix")
        first = names.offsets.to_numpy()[row]
        a, b = pa.array(first + a), pa.array(first + b)
        columns = [*(batch.column(k).take(pa.array(row)) for k in keys), pa.array(tau, pa.int32()), names.values.take(a), names.values.take(b), *(ix.values.take(i).cast(pa.int32()) for i in (a, b)), pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "tau", "channel_i", "channel_j", "ch_i", "ch_j", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("__data")
            first, cuts, flat = rows.offsets.to_numpy(), rows.values.offsets.to_numpy(), rows.values.values.to_numpy(zero_copy_only=False)
            held: list[tuple] = []
            n = 0
            for k in range(len(batch)):
                ends = cuts[first[k] : first[k + 1] + 1]
                if len(set(np.diff(ends))) > 1:
                    raise ValueError("channels of an epoch differ in their number of samples")
                x = flat[ends[0] : ends[-1]].reshape(len(ends) - 1, -1)
                a, b = (g.ravel() for g in np.indices((len(x), len(x)))) if full else np.triu_indices(len(x), 1)
                for tau in taus:
                    if held and n + len(a) > PAIRS:
                        yield pairs(batch, held)
                        held, n = [], 0
                    held.append((np.full(len(a), k), np.full(len(a), tau), a, b, matrix(x, tau)[a, b]))
                    n += len(a)
            if held:
                yield pairs(batch, held)

    cut = signals.withColumn("data", window(F.col("data"), F.col("sfreq"), F.col("tmin"), tmin, tmax))
    # An epoch becomes one row of arrays, so that a Python batch holds many epochs.
    epochs = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch_idx", "channel", "data"))).alias("__rows"))
    part = lambda c: F.transform("__rows", lambda r: r[c])
    return epochs.select(*keys, part("channel").alias("__names"), part("ch_idx").alias("__ix"), part("data").alias("__data")).mapInArrow(run, schema)


def mutual_information_sql(signals: DataFrame, tau: int, kernel: int = 3, weighted: bool = True, keys: Sequence[str] = ("element", "epoch")) -> DataFrame:
    """The same for few channels (up to some 32) by joins: pairs i < j of an epoch with their values.

    Joined by epoch, each pair of rows gives its own joint histogram from two symbol arrays, so that samples are never rows.
    """
    n_symbols = math.factorial(kernel)
    sym = signals.select(*keys, "ch_idx", "channel", symbols(F.col("data"), kernel, tau).alias("sym"))
    a, b = sym.alias("a"), sym.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, [*on, F.col("a.ch_idx") < F.col("b.ch_idx")])
    n = F.size("a.sym").cast("double")
    px = lambda side, s: F.size(F.filter(F.col(f"{side}.sym"), lambda x: x == s)) / n
    joint = F.zip_with("a.sym", "b.sym", lambda x, y: x * n_symbols + y)
    both = both.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.channel").alias("channel_i"), F.col("b.channel").alias("channel_j"), n.alias("n"), joint.alias("joint"), F.array(*(px("a", s) for s in range(n_symbols))).alias("px"), F.array(*(px("b", s) for s in range(n_symbols))).alias("py"))
    cells = []
    for i in range(n_symbols):
        for j in range(n_symbols):
            if weighted and (i == j or i + j == n_symbols - 1):
                continue
            p = F.size(F.filter("joint", lambda x: x == i * n_symbols + j)) / F.col("n")
            cells.append(F.struct(p.alias("p"), F.element_at("px", i + 1).alias("x"), F.element_at("py", j + 1).alias("y")))
    value = F.aggregate(F.array(*cells), F.lit(0.0), lambda s, c: s + F.when(c["p"] > 1e-15, c["p"] * (F.ln(c["p"]) - F.ln(c["x"] + 1e-15) - F.ln(c["y"] + 1e-15))).otherwise(0.0))
    return both.select(*keys, "channel_i", "channel_j", (value / math.log(n_symbols)).alias("value"))


def _check(kernel: int, taus: Sequence[int]) -> None:
    if kernel < 2:
        raise ValueError("the kernel must be at least 2")
    if not taus or any(t <= 0 for t in taus):
        raise ValueError("taus must be positive numbers, one at least")
