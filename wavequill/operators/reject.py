"""Finding and dropping bad channels and bad epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import at_least, enough
from .signals import let, mean


def span(data: Column) -> Column:
    return F.array_max(data) - F.array_min(data)


def _share(limit: float | int, n: Column) -> Column:
    return F.floor(F.lit(limit) * n) if isinstance(limit, float) else F.lit(limit)


def _over(signals: DataFrame, reject: Mapping[str, float]) -> Column:
    """Whether a row's range exceeds the threshold of its kind; rows of other kinds never do."""
    if not reject:
        raise ValueError("no rejection thresholds")
    kind = F.col("kind") if "kind" in signals.columns else F.lit("eeg")
    out = F.lit(False)
    for k, limit in reject.items():
        out = out | ((kind == k) & (span(F.col("data")) > limit))
    return out


def bad_channels_by_range(signals: DataFrame, reject: Mapping[str, float], n_epochs_bad: float | int = 0.5, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Channels whose range is over its threshold in more than floor(share * epochs) epochs, or more than a number of them."""
    by = signals.withColumn("__over", _over(signals, reject)).groupBy(*keys, "channel").agg(F.count_if("__over").alias("n_bad"), F.count("*").alias("n_epochs"))
    return by.where(F.col("n_bad") > _share(n_epochs_bad, F.col("n_epochs"))).select(*keys, "channel", "n_bad")


def bad_epochs_by_range(signals: DataFrame, reject: Mapping[str, float], n_channels_bad: float | int = 0.1, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Epochs in which more than floor(share * channels) channels are over their thresholds; all kinds of channels count."""
    by = signals.withColumn("__over", _over(signals, reject)).groupBy(*keys, "epoch").agg(F.count_if("__over").alias("n_bad"), F.count("*").alias("n_channels"))
    return by.where(F.col("n_bad") > _share(n_channels_bad, F.col("n_channels"))).select(*keys, "epoch", "n_bad")


def outliers(stats: DataFrame, value: str = "value", threshold: float = 4.0, rounds: int = 2, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Flag rows whose z score, among rows not flagged before, exceeds the threshold; ``rounds`` times, each a joined aggregate."""
    out = stats.withColumn("is_bad", F.lit(False))
    for _ in range(rounds):
        level = out.where(~F.col("is_bad")).groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
        out = out.join(level, list(keys)).withColumn("is_bad", F.col("is_bad") | (F.col("__s") > 0) & (F.abs(F.col(value) - F.col("__m")) > threshold * F.col("__s"))).drop("__m", "__s")
    return out


def channel_spread(signals: DataFrame, how: str = "variance", keys: Sequence[str] = ("element",)) -> DataFrame:
    """Population variance or deviation of each channel over the samples of all its epochs.

    Rows give counts, means and sums of squares about their own means, which merge exactly; no samples are shuffled.
    """
    squares = let(mean(F.col("data")), lambda m: F.struct(m.alias("m"), F.aggregate("data", F.lit(0.0), lambda s, x: s + (x - m) * (x - m)).alias("q")))
    row = signals.select(*keys, "channel", F.size("data").alias("n"), squares.alias("s")).select(*keys, "channel", "n", "s.m", "s.q")
    by = row.groupBy(*keys, "channel").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("q") + F.col("n") * F.col("m") * F.col("m")).alias("ss"))
    variance = F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))
    return by.select(*keys, "channel", (variance if how == "variance" else F.sqrt(variance)).alias("value"))


def bad_channels_by_variance(signals: DataFrame, threshold: float = 4.0, rounds: int = 2, keys: Sequence[str] = ("element",)) -> DataFrame:
    return outliers(channel_spread(signals, "variance", keys), "value", threshold, rounds, keys)


def bad_channels_by_high_frequencies(signals: DataFrame, threshold: float = 4.0, rounds: int = 2, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Deviation of each channel above 25 Hz (order 4, forwards and backwards over its joined epochs), iterated z scores."""
    from .filters import over_epochs

    return outliers(channel_spread(over_epochs(signals, order=4, edges=(25.0,), kind="high", keys=keys), "deviation", keys), "value", threshold, rounds, keys)


def drop_channels(signals: DataFrame, bad: DataFrame, keys: Sequence[str] = ("element",), min_channels: int | float | None = None) -> DataFrame:
    """Rows of other channels; an element that keeps fewer than ``min_channels`` (a number, or a share of all) fails the query."""
    left = signals.join(bad, [*keys, "channel"], "left_anti")
    if min_channels is None:
        return left
    total = signals.select(*keys, "channel").distinct().groupBy(*keys).agg(F.count("*").alias("__all"))
    gone = bad.select(*keys, "channel").distinct().groupBy(*keys).agg(F.count("*").alias("__gone"))
    counts = total.join(gone, list(keys), "left").withColumn("__left", F.col("__all") - F.coalesce("__gone", F.lit(0)))
    # From the counts' side, so that elements of which nothing is left are seen as well.
    return counts.where(enough(F.col("__left"), F.col("__all"), min_channels, "channels")).select(*keys).join(left, list(keys)).select(*signals.columns)


def drop_epochs(signals: DataFrame, bad: DataFrame, keys: Sequence[str] = ("element",)) -> DataFrame:
    return signals.join(bad, [*keys, "epoch"], "left_anti")


def reject_epochs(signals: DataFrame, reject: Mapping[str, float], n_channels_bad: float | int = 0.1, min_events: float | int = 0.3, keys: Sequence[str] = ("element",), now: bool = True) -> tuple[DataFrame, DataFrame]:
    """Epochs that are left, and a report row for each element. Too few left in any element is an error, at once or, with ``now`` false,
    when the query runs: then nothing is computed while it is planned."""
    bad = bad_epochs_by_range(signals, reject, n_channels_bad, keys)
    before = signals.groupBy(*keys).agg(F.countDistinct("epoch").alias("n_epochs_before"))
    gone = bad.groupBy(*keys).agg(F.count("*").alias("n_bad_epochs"), F.array_sort(F.collect_list("epoch")).alias("bad_epochs"))
    report = before.join(gone, list(keys), "left").withColumn("n_bad_epochs", F.coalesce("n_bad_epochs", F.lit(0))).withColumn("n_epochs_after", F.col("n_epochs_before") - F.col("n_bad_epochs"))
    if now:
        for r in report.select("n_epochs_before", "n_epochs_after").toLocalIterator():
            at_least(r["n_epochs_after"], r["n_epochs_before"], min_events, "epochs")
        return drop_epochs(signals, bad, keys), report
    report = report.where(enough(F.col("n_epochs_after"), F.col("n_epochs_before"), min_events, "epochs"))
    return report.select(*keys).join(drop_epochs(signals, bad, keys), list(keys)).select(*signals.columns), report
