"""Streams of samples: tumbling epochs with late data, artifact sessions, and symbols across batch borders.

An extension: batch results over the same rows are equal, which the tests check.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean and range of each channel in time windows; rows later than ``late`` are not waited for."""
    by = [F.window("ts", width, slide) if slide else F.window("ts", width), F.col("channel")]
    out = stream.withWatermark("ts", late).groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("span"))
    return out.select(F.col("window.start").alias("start"), "channel", "n", "mean", "span")


def artifact_sessions(stream: DataFrame, limit: float, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Runs of samples beyond a limit, joined while no more than ``gap`` lies between them."""
    beyond = stream.where(F.abs("value") > limit).withWatermark("ts", late)
    out = beyond.groupBy(F.session_window("ts", gap), "channel").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "channel", "n", "peak")


def half_waves(stream: DataFrame) -> DataFrame:
    """Finished half waves of each channel: the state is the running one, so that batch borders don't cut any.

    Samples of a channel must come in order from batch to batch; within a batch they are sorted by ts.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sign, start, peak, n = state.get if state.exists else (0, 0, 0.0, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values("ts")
        for ts, v in zip(rows["ts"].astype("int64").to_numpy() // 1000, rows["value"].to_numpy(), strict=True):
            s = -1 if v < 0 else 1
            if s != sign:
                if n:
                    out.append((key[0], int(start), int(n), float(peak)))
                sign, start, peak, n = s, int(ts), float(v), 0
            n += 1
            peak = max(peak, v) if s > 0 else min(peak, v)
        state.update((sign, int(start), float(peak), int(n)))
        yield pd.DataFrame(out, columns=["channel", "start_us", "n", "peak"])

    return stream.groupBy("channel").applyInPandasWithState(run, "channel string, start_us long, n long, peak double", "sign int, start long, peak double, n long", "append", GroupStateTimeout.NoTimeout)
