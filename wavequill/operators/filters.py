"""Filters: each group of a key and channel goes through numpy as one continuous signal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dsp


def per_channel(signals: DataFrame, change: Callable[[np.ndarray, float], np.ndarray], keys: Sequence[str] = ("element",), sfreq: float | None = None) -> DataFrame:
    """Join each channel's epochs in order, change the whole, and cut it again; lengths change in the ratio of rates.

    Filtering the joined signal is intended: responses cross the borders of epochs.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch")
        parts = pdf["data"].to_list()
        fs = float(pdf["sfreq"].iloc[0])
        whole = change(np.concatenate(parts), fs)
        new = fs if sfreq is None else sfreq
        ends = np.cumsum([round(len(p) * new / fs) for p in parts])[:-1]
        return pdf.assign(data=np.split(whole, ends), sfreq=new)

    return signals.groupBy(*keys, "channel").applyInPandas(run, signals.schema)


def over_epochs(signals: DataFrame, order: int, edges: tuple[float, ...], kind: str, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Forward-backward Butterworth filter over joined epochs."""
    return per_channel(signals, lambda x, fs: dsp.zero_phase(dsp.butter(order, edges, kind, fs), x, dsp.filtfilt_pad(order, kind == "band")), keys)


def clean(signals: DataFrame, high_pass: float | None = None, low_pass: float | None = None, notches: Sequence[float] = (), resample: float | None = None, hp_order: int = 4, lp_order: int = 8, keys: Sequence[str] = ("element",)) -> DataFrame:
    """High-pass, low-pass, notches and resampling, in this order; notches from half the rate on are left out.

    ``high_pass`` and ``low_pass`` are the cut-off frequencies of the filters that they name.
    """

    def change(x: np.ndarray, fs: float) -> np.ndarray:
        if high_pass is not None:
            x = dsp.zero_phase(dsp.butter(hp_order, (float(high_pass),), "high", fs), x, dsp.filtfilt_pad(hp_order))
        if low_pass is not None:
            x = dsp.zero_phase(dsp.butter(lp_order, (float(low_pass),), "low", fs), x, dsp.filtfilt_pad(lp_order))
        if notches:
            x = dsp.fft_notch(x, fs, [f for f in notches if f < fs / 2])
        return dsp.fft_resample(x, resample, fs) if resample and resample != fs else x

    return per_channel(signals, change, keys, resample)


def ordinal_low_pass(signals: DataFrame, kernel: int, tau: int, band: tuple[float, float] | None = None, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Order 6 Butterworth at sfreq / kernel / tau (or a band), before ordinal patterns are taken."""

    def change(x: np.ndarray, fs: float) -> np.ndarray:
        sos = dsp.butter(6, band, "band", fs) if band else dsp.butter(6, (fs / kernel / tau,), "low", fs)
        return dsp.zero_phase(sos, x, dsp.filtfilt_pad(6, band is not None))

    return per_channel(signals, change, keys)


def slow_wave_band(x: np.ndarray, fs: float, band: tuple[float, float], design: str = "chebyshev2") -> np.ndarray:
    """Band-pass of the slow-wave detector: Chebyshev II between derived stop edges, or a zero-phase FIR."""
    lo, hi = float(band[0]), float(band[1])
    if design == "fir":
        return dsp.fir_band(x, fs, lo, hi)
    stop = (max(0.01, 0.1 * lo), min(fs / 2 - 0.5, max(hi + 5, 1.5 * hi)))
    if not 0 < stop[0] < lo < hi < stop[1] < fs / 2:
        raise ValueError(f"no filter for the band {band} at {fs} Hz")
    sos = dsp.cheby2_band((lo, hi), stop, 3.0, 25.0, fs)
    return dsp.zero_phase(sos, x, 3 * (2 * len(sos) + 1))
