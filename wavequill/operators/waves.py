"""Slow waves: zero-crossing detection, the filter cascade, and features by epoch and channel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.names import normalise_subject
from .filters import slow_wave_band
from .signals import let

#: Columns of a wave, in seconds, microvolts and hertz.
WAVE = ("Start", "End", "MidCrossing", "Duration", "ValNegPeak", "ValPosPeak", "PTP", "Frequency", "Slope", "DescendingSlope", "AscendingSlope")
WAVE_SCHEMA = "Channel string, Epoch int, ChanIdx int, " + ", ".join(f"{c} double" for c in WAVE)
_EPS = float(np.finfo(float).eps)
#: Amplitudes nearer to a limit than this share of it are equal to it.
_TIE = 1e-12


def zero_crossing_waves(signals: DataFrame, min_ptp: float = 0.0) -> DataFrame:
    """Waves of already filtered signal rows, by higher-order functions alone.

    Sign changes cut a row into half waves. A wave is a half wave that begins at a crossing and
    the next one, if the first has a negative minimum and the second a positive maximum, first
    places winning ties. Everything stays in one row's arrays: no window, no shuffle.
    """
    n = F.size("data")
    down = lambda x: F.when(x == 0, F.lit(False)).otherwise(x < 0)
    turns = F.zip_with(F.slice("data", 1, n - 1), F.slice("data", 2, n - 1), lambda x, y: down(x) != down(y))
    crossing = F.filter(F.transform(turns, lambda turn, i: F.when(turn, i + 1)), lambda i: i.isNotNull())
    keys = [c for c in signals.columns if c not in ("data", "sfreq", "tmin", "epoch", "channel", "ch_idx", "condition")]
    heads = [*keys, "channel", "epoch", "ch_idx", "sfreq"]
    # Crossing i (from 1) lies between samples i - 1 and i from 0, so that i is the index of the sample after it.
    halves = F.struct(F.col("data"), F.when(n > 1, crossing).otherwise(F.array().cast("array<int>")).alias("cross"))

    def wave(row: Column, k: Column) -> Column:
        a, m, z = (F.element_at(row["cross"], k + j) for j in range(3))
        parts = F.struct(F.slice(row["data"], a + 1, m - a).alias("neg"), F.slice(row["data"], m + 1, z - m).alias("pos"))
        return let(parts, lambda p: F.struct(
            a.alias("a"), m.alias("m"), z.alias("z"), F.array_min(p["neg"]).alias("lo"), F.array_max(p["pos"]).alias("hi"),
            (a + F.array_position(p["neg"], F.array_min(p["neg"])) - 1).alias("at_lo"), (m + F.array_position(p["pos"], F.array_max(p["pos"])) - 1).alias("at_hi"),
        ))

    found = let(halves, lambda row: F.when(F.size(row["cross"]) >= 3, F.transform(F.sequence(F.lit(1), F.size(row["cross"]) - 2), lambda k: wave(row, k))))
    each = signals.select(*heads, F.explode(found).alias("w")).select(*heads, "w.*").where((F.col("lo") < 0) & (F.col("hi") > 0) & (F.col("hi") - F.col("lo") >= min_ptp))
    at_lo, at_hi = F.col("at_lo"), F.col("at_hi")
    s = F.col("sfreq")
    span = lambda x, y: F.greatest((y - x) / s, F.lit(_EPS))
    ptp, duration = F.col("hi") - F.col("lo"), (F.col("z") - F.col("a")) / s
    made = {
        "Start": F.col("a") / s, "End": F.col("z") / s, "MidCrossing": F.col("m") / s, "Duration": duration, "ValNegPeak": F.col("lo"), "ValPosPeak": F.col("hi"), "PTP": ptp,
        "Frequency": 1.0 / duration, "Slope": ptp / span(at_lo, at_hi), "DescendingSlope": F.abs("lo") / span(F.col("a"), at_lo), "AscendingSlope": F.abs("lo") / span(at_lo, F.col("m")),
    }
    return each.select(*keys, F.col("channel").alias("Channel"), F.col("epoch").alias("Epoch"), F.col("ch_idx").alias("ChanIdx"), *(c.alias(k) for k, c in made.items()))


def band_pass_rows(signals: DataFrame, band: tuple[float, float] = (0.3, 1.5), design: str = "chebyshev2", scale: float = 1.0, downsample_to: float | None = None) -> DataFrame:
    """Filter each row by itself, a narrow map; first resampled where that lowers its rate."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data, rates = [], []
            for x, fs in zip(pdf["data"], pdf["sfreq"], strict=True):
                y = np.asarray(x, float) * scale
                if downsample_to is not None and downsample_to < fs:
                    y, fs = dsp.fft_resample(y, downsample_to, fs), downsample_to
                data.append(slow_wave_band(y, fs, band, design))
                rates.append(fs)
            yield pdf.assign(data=data, sfreq=rates)

    return signals.mapInPandas(run, signals.schema)


def negative_peak_waves(signals: DataFrame, dur_neg: tuple[float, float] = (0.3, 1.5), dur_pos: tuple[float, float] = (0.1, 1.0), amp_neg: tuple[float, float] = (40, 200), amp_pos: tuple[float, float] = (10, 150), amp_ptp: tuple[float, float] = (75, 350)) -> DataFrame:
    """Waves of filtered rows by the published peak method: half waves whose durations and amplitudes lie within bounds."""
    w = zero_crossing_waves(signals)
    d_neg, d_pos = F.col("MidCrossing") - F.col("Start"), F.col("End") - F.col("MidCrossing")
    inside = d_neg.between(*dur_neg) & d_pos.between(*dur_pos) & F.abs("ValNegPeak").between(*amp_neg) & F.col("ValPosPeak").between(*amp_pos) & F.col("PTP").between(*amp_ptp)
    return w.where(inside)


def cascade(waves: DataFrame, freq_threshold: float = 7.0, max_ptp: float = 150.0, artifact_threshold: float = 75.0, slope_range: tuple[float, float] | None = None, mode: str = "adaptive", ptp_percentile: float = 90.0, thresholds: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Keep plausible waves, then those above their channel's amplitude threshold.

    Fixed mode stops before the threshold. Else it comes from ``thresholds`` (keys, channel,
    ptp_threshold), where channels without one lose all waves, or is the exact percentile of
    the amplitudes of all epochs that are left. Comparisons are strict, and an amplitude that differs from
    a limit by rounding alone is equal to it: equal differences of samples differ in their last digit.
    """
    out = waves.where((F.col("Frequency") <= freq_threshold) & (F.col("PTP") < max_ptp * (1 - _TIE)))
    if "ValPosPeak" in waves.columns:
        out = out.where(F.col("ValPosPeak") < artifact_threshold * (1 - _TIE))
    for c in ("pos_halfway_period", "PosHalfPeriod"):
        if c in waves.columns:
            out = out.where(F.col(c).between(0.143, 2.0))
            break
    if slope_range is not None:
        out = out.where(F.col("AscendingSlope").between(*slope_range) & F.col("DescendingSlope").between(*slope_range))
    if mode == "fixed":
        return out
    at = [*keys, "Channel"]
    if thresholds is None:
        limit = out.groupBy(*at).agg(F.percentile("PTP", F.lit(ptp_percentile / 100)).alias("__limit"))
    else:
        limit = thresholds.select(*keys, F.col("channel").alias("Channel"), F.col("ptp_threshold").alias("__limit"))
    return out.join(limit, at).where(F.col("PTP") > F.col("__limit") * (1 + _TIE)).drop("__limit")


def subject_thresholds(table: DataFrame, subject: str, strict: bool = True) -> DataFrame:
    """channel and ptp_threshold of a subject in a table of thresholds; none is an error, or an empty table if not strict."""
    one = table.where(normalise_subject(F.col("subject").cast("string")) == normalise_subject(F.lit(subject))).select("channel", F.col("ptp_threshold").cast("double").alias("ptp_threshold"))
    if strict and one.isEmpty():
        raise ValueError(f"no thresholds for subject {subject!r}")
    return one


def far_from_artifacts(waves: DataFrame, signals: DataFrame, amplitude: float, seconds: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Drop waves whose middle lies within some seconds of a sample beyond the amplitude, in the same epoch and channel.

    Time is cut into cells as long as the whole stretch around a middle, which then reaches from its first cell into the next one at most:
    a wave looks for its first cell alone, which tells that cell's last sample beyond the amplitude and the next one's first.
    """
    n = F.greatest(F.lit(1), F.round(seconds * F.col("sfreq")).cast("int"))
    at = [*keys, "Epoch", "Channel"]
    rows = signals.select(*keys, F.col("epoch").alias("Epoch"), F.col("channel").alias("Channel"), F.col("sfreq").alias("__fs"), n.alias("__n"), "data")
    beyond = F.filter(F.transform("data", lambda x, i: F.when(F.abs(x) > amplitude, i)), lambda i: i.isNotNull())
    cell = lambda i: F.floor(i / (2 * F.col("__n") + 1))
    each = rows.select(*at, "__n", F.explode(beyond).alias("__i")).withColumn("__k", F.explode(F.array(cell(F.col("__i")), cell(F.col("__i")) - 1)))
    own = F.col("__k") == cell(F.col("__i"))
    far = each.groupBy(*at, "__k").agg(F.max(F.when(own, F.col("__i"))).alias("__last"), F.min(F.when(~own, F.col("__i"))).alias("__first"))
    centre = F.round(F.coalesce("MidCrossing", (F.col("Start") + F.col("End")) / 2) * F.col("__fs")).cast("int")
    placed = waves.join(rows.drop("data"), at).withColumn("__c", centre).withColumn("__k", cell(F.col("__c") - F.col("__n")))
    w, f = placed.alias("w"), far.alias("f")
    near = (F.col("f.__last") >= F.col("w.__c") - F.col("w.__n")) | (F.col("f.__first") <= F.col("w.__c") + F.col("w.__n"))
    return w.join(f, [*(F.col(f"w.{c}") == F.col(f"f.{c}") for c in (*at, "__k")), near], "left_anti").drop("__fs", "__n", "__c", "__k")


def features(waves: DataFrame, grid: DataFrame, columns: Sequence[str] = ("Duration", "PTP", "Frequency", "Slope"), keys: Sequence[str] = ()) -> DataFrame:
    """Means by epoch and channel, NaN without waves, and Density, their number, 0 without; grid has all epochs and channels."""
    at = [*keys, "Epoch", "Channel"]
    by = waves.groupBy(*at).agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("Density"))
    out = grid.join(by, at, "left")
    return out.select(*at, *(F.coalesce(c, F.lit(float("nan"))).alias(c) for c in columns), F.coalesce("Density", F.lit(0)).cast("double").alias("Density"))
