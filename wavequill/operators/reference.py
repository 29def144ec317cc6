"""Re-referencing: a mean over channels is subtracted from every channel, sample by sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEYS = ("element", "epoch")


def reference(samples: DataFrame, channels: str | Sequence[str] = "average", keys: Sequence[str] = _KEYS, bads: Sequence[str] = (), now: bool = True) -> DataFrame:
    """Subtract the mean of the reference channels; "average" means all channels that are not bad. Names that the data lack are an error
    at once or, with ``now`` false, when the query runs and an epoch lacks one: then nothing is computed while it is planned.

    The mean is an aggregate joined back by sample, so that the first shuffle carries partial sums only.
    """
    c = F.col("channel")
    if channels == "average":
        used = ~c.isin(list(bads)) if bads else F.lit(True)
    else:
        names = [channels] if isinstance(channels, str) else list(channels)
        used = c.isin(names)
        have = {r["channel"] for r in samples.select("channel").where(used).distinct().collect()} if now else set(names)
        if missing := [n for n in names if n not in have]:
            raise ValueError(f"reference channels {missing} are not in the data")
    at = [*keys, "t_idx"]
    level = samples.groupBy(*at).agg(F.avg(F.when(used, F.col("value"))).alias("__ref"), F.count_distinct(F.when(used, c)).alias("__n")) if channels != "average" else samples.where(used).groupBy(*at).agg(F.avg("value").alias("__ref"))
    if channels != "average":
        lacking = F.raise_error(F.lit(f"some of the reference channels {sorted(set(names))} are not in the data")).cast("double")
        level = level.withColumn("__ref", F.when(F.col("__n") == len(set(names)), F.col("__ref")).otherwise(lacking)).drop("__n")
    return samples.join(level, at).withColumn("value", F.col("value") - F.col("__ref")).select(*samples.columns)


def reference_if_any(samples: DataFrame, channels: Sequence[str], keys: Sequence[str] = _KEYS) -> DataFrame:
    """As ``reference``, but epochs whose reference channels are missing or flat stay as they are."""
    at = [*keys, "t_idx"]
    ref = samples.where(F.col("channel").isin(list(channels)))
    usable = ref.groupBy(*keys).agg(F.countDistinct("channel").alias("n"), F.max(F.abs("value")).alias("peak")).where((F.col("n") == len(set(channels))) & (F.col("peak") > 0)).select(*keys)
    level = ref.join(usable, list(keys), "left_semi").groupBy(*at).agg(F.avg("value").alias("__ref"))
    return samples.join(level, at, "left").withColumn("value", F.col("value") - F.coalesce("__ref", F.lit(0.0))).select(*samples.columns)


def project_rest(signals: DataFrame, gain: Sequence[Sequence[float]]) -> DataFrame:
    """Reference at infinity by a given lead field (channels x sources): G pinv(G - mean G) applied to average-referenced data."""
    import numpy as np

    from .interpolate import mix_channels

    g = np.asarray(gain, float)
    m = g @ np.linalg.pinv(g - g.mean(axis=0, keepdims=True), rcond=1e-4)
    centre = np.eye(len(g)) - 1 / len(g)
    return mix_channels(signals, m @ centre)
