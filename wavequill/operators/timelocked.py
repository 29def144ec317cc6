"""Event-locked averages, contrasts and linear drifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregate import method
from .select import in_condition
from .signals import baseline as subtract
from .signals import crop, first_index, let, mean, window


def topography(signals: DataFrame, tmin: float | None = None, tmax: float | None = None, base: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Mean over time of each epoch and channel, after a baseline; bounds beyond the epoch mean its ends."""
    if base is not None:
        signals = subtract(signals, *base)
    return crop(signals, tmin, tmax).withColumn("value", mean(F.col("data"))).drop("data")


def contrast(signals: DataFrame, condition_a: str | Sequence[str], condition_b: str | Sequence[str], tmin: float | None = None, tmax: float | None = None, base: tuple[float | None, float | None] | None = None, keys: Sequence[str] = ("element", "channel"), channel_method: str | None = None) -> DataFrame:
    """Mean over epochs of condition A minus that of B, by channel; both averages in one pass. channel_method may be mean or median."""
    if channel_method not in (None, "mean", "median"):
        raise ValueError("contrasts aggregate channels by mean or median only")
    by = topography(signals, tmin, tmax, base)
    a, b = (F.avg(F.when(in_condition(F.col("condition"), c), F.col("value"))) for c in (condition_a, condition_b))
    out = by.groupBy(*keys).agg((a - b).alias("value"))
    if channel_method is None:
        return out
    return out.groupBy(*(k for k in keys if k != "channel")).agg(method(channel_method, "value").alias("value"))


def linear_drift(signals: DataFrame, tmin: float | None = None, tmax: float | None = None, scale: float = 1.0) -> DataFrame:
    """Least-squares intercept and slope of each row's scaled samples over the time since tmin; two samples are needed.

    Closed sums over the array: no samples become rows.
    """
    s, t0 = F.col("sfreq"), F.col("tmin")
    begin = F.lit(0.0) if tmin is None else (t0 + first_index(tmin, s, t0) / s) - F.lit(float(tmin))
    cut = signals.withColumn("y", window(F.col("data"), s, t0, tmin, tmax)).withColumn("__t", begin)
    cut = cut.withColumn("y", F.when(F.size("y") >= 2, F.col("y")).otherwise(F.raise_error(F.lit("a drift needs two samples at least")).cast("array<double>")))
    n = F.size("y").cast("double")
    x_mean = F.col("__t") + (n - 1) / 2 / s
    sxx = n * (n * n - 1) / 12 / (s * s)
    pairs = let(x_mean - F.col("__t"), lambda middle: F.transform("y", lambda y, i: (i / s - middle) * y))
    slope = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / sxx * scale
    level = mean(F.col("y")) * scale
    out = cut.withColumn("slope", slope).withColumn("intercept", level - F.col("slope") * x_mean)
    return out.drop("data", "y", "__t")
