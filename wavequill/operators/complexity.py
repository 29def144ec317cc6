"""Complexity by compression: signals become letters by range, and the letters are deflated."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import let


def letters(data: Column, n_bins: int = 16) -> Column:
    """Bin of every sample between the first and last decile, as numbers 0 to n_bins - 1; a flat signal is all 0."""
    n = F.size(data)
    first = F.floor(n / 10).cast("int")
    last = F.when(first > 1, n - first).otherwise(n - 1)
    edges = let(F.array_sort(data), lambda o: F.struct(F.element_at(o, first + 1).alias("lower"), ((F.element_at(o, last + 1) - F.element_at(o, first + 1)) / n_bins).alias("size")))
    # A cast cuts towards zero, so that values a little below the range fall in bin 0 as well.
    return let(edges, lambda e: F.transform(data, lambda x: F.when(e["size"] > 0, F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), ((x - e["lower"]) / e["size"]).cast("int")))).otherwise(0)))


def kolmogorov(signals: DataFrame, n_bins: int = 16) -> DataFrame:
    """Deflated over plain length of each row's letters; NaN for empty rows. Letters are made by Spark, only deflating is Python."""
    keep = [c for c in signals.columns if c != "data"]
    rows = signals.select(*keep, letters(F.col("data"), n_bins).alias("__letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema if f.name != "data") + ", value double"

    def ratio(bins: np.ndarray) -> float:
        text = (np.asarray(bins, np.uint8) + ord("A")).tobytes()
        return len(zlib.compress(text)) / len(text) if text else float("nan")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(value=pdf["__letters"].map(ratio))

    return rows.mapInPandas(run, schema)
