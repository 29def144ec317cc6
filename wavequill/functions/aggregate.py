"""Axis aggregation: one method reduces one axis of a feature table at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of values cut at each end by the trimmed means.
TRIMMED = {"trim_mean80": 0.1, "trim_mean90": 0.05}
METHODS = ("mean", "std", "median", "min", "max", "sum", *TRIMMED)


def trimmed_mean(values: Column, cut: float) -> Column:
    """Mean of an array without its floor(cut * n) smallest and largest values."""
    n = F.size(values)
    k = F.floor(n * F.lit(cut)).cast("int")
    inner = F.slice(F.array_sort(values), k + 1, n - 2 * k)
    return F.aggregate(inner, F.lit(0.0), lambda s, x: s + x) / F.size(inner)


def method(name: str, value: str | Column) -> Column:
    """The aggregate of a method name. Standard deviations are those of the population; NaN is a value like any other."""
    v = F.col(value) if isinstance(value, str) else value
    plain = {"mean": F.avg, "std": F.stddev_pop, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}
    if name in plain:
        return plain[name](v)
    if name in TRIMMED:
        return trimmed_mean(F.collect_list(v), TRIMMED[name])
    raise ValueError(f"unknown aggregation method {name!r}; known are {', '.join(METHODS)}")


def reduce_axis(df: DataFrame, axis: str | Sequence[str], how: str | None, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Aggregate over ``axis``, within ``keys`` and every other axis; None leaves the table as it is."""
    if how is None:
        return df
    axes = [axis] if isinstance(axis, str) else list(axis)
    by = [k for k in keys if k not in axes]
    return df.groupBy(*by).agg(method(how, value).alias(value))


def aggregate(df: DataFrame, keys: Sequence[str], channel_method: str | None = None, trial_method: str | None = None, order: str = "channel_trial", value: str = "value") -> DataFrame:
    """Reduce channels and epochs one after the other; the order matters to medians, deviations and trimmed means."""
    steps = {"channel_trial": (("channel", channel_method), ("epoch", trial_method)), "trial_channel": (("epoch", trial_method), ("channel", channel_method))}
    if order not in steps:
        raise ValueError(f"unknown order {order!r}")
    left = list(keys)
    for axis, how in steps[order]:
        if how is not None:
            df = reduce_axis(df, axis, how, left, value)
            left = [k for k in left if k != axis]
    return df


def aggregate_pairs(df: DataFrame, keys: Sequence[str], connectivity_method: str | None = None, channel_method: str | None = None, trial_method: str | None = None, value: str = "value") -> DataFrame:
    """Reduce a full pair matrix: second channel, then first channel, then epochs."""
    left = list(keys)
    for axis, how in (("channel_j", connectivity_method), ("channel_i", channel_method), ("epoch", trial_method)):
        if how is not None:
            df = reduce_axis(df, axis, how, left, value)
            left = [k for k in left if k != axis]
    return df
