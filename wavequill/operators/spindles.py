"""Sleep spindles: relative sigma power, moving correlation and moving root mean square, combined softly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dsp

SCHEMA = "Channel string, Epoch int, ChanIdx int, Start double, Peak double, End double, Duration double, Amplitude double, RMS double, Frequency double, Oscillations int"


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    """Mean over a centred window, shorter at the ends."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    a = np.maximum(np.arange(len(x)) - n // 2, 0)
    b = np.minimum(np.arange(len(x)) + n - n // 2, len(x))
    return (total[b] - total[a]) / (b - a)


def detect(x: np.ndarray, fs: float, freq_sp: tuple[float, float] = (12, 15), freq_broad: tuple[float, float] = (1, 30), duration: tuple[float, float] = (0.5, 2.5), min_distance: float = 500, thresh_rms: float | None = 1.5, thresh_corr: float | None = 0.65, thresh_rel: float | None = 0.2) -> list[dict]:
    """Spindles of one signal in microvolts.

    Three measures are compared to their thresholds: sigma over broad-band power of a sliding
    spectrum, correlation of the sigma and the broad signal over 300 ms, and the root mean square of
    the sigma signal over 300 ms against its trimmed mean and deviation. Where (after smoothing over
    100 ms) more than all but one third of a measure agree, a spindle may lie; neighbours within ``min_distance`` ms
    are joined, and the duration decides.
    """
    if len(x) < fs or not np.any(x != x[0]):
        return []
    pad = 3 * 9
    broad = dsp.zero_phase(dsp.butter(4, tuple(map(float, freq_broad)), "band", fs), x, pad)
    sigma = dsp.zero_phase(dsp.butter(4, tuple(map(float, freq_sp)), "band", fs), x, pad)
    votes, used = np.zeros(len(x)), 0
    if thresh_rel is not None:
        n = int(2 * fs) if len(x) >= 2 * fs else len(x)
        hop = max(1, int(0.2 * fs))
        starts = np.arange(0, max(len(x) - n, 0) + 1, hop)
        power = np.abs(np.fft.rfft(np.stack([broad[s : s + n] for s in starts]) * np.hamming(n), axis=1)) ** 2
        f = np.fft.rfftfreq(n, 1 / fs)
        share = power[:, (f >= freq_sp[0]) & (f <= freq_sp[1])].sum(axis=1) / np.maximum(power[:, (f >= freq_broad[0]) & (f <= freq_broad[1])].sum(axis=1), 1e-30)
        votes += np.interp(np.arange(len(x)), starts + n / 2, share) >= thresh_rel
        used += 1
    w = max(2, int(0.3 * fs))
    if thresh_corr is not None:
        ms, mb = _moving(sigma, w), _moving(broad, w)
        cov = _moving(sigma * broad, w) - ms * mb
        spread = np.sqrt(np.maximum(_moving(sigma**2, w) - ms**2, 0) * np.maximum(_moving(broad**2, w) - mb**2, 0))
        votes += np.where(spread > 0, cov / np.maximum(spread, 1e-30), 0) >= thresh_corr
        used += 1
    rms = np.sqrt(_moving(sigma**2, w))
    if thresh_rms is not None:
        ordered = np.sort(rms)
        cut = int(0.025 * len(rms))
        inner = ordered[cut : len(rms) - cut]
        votes += rms >= inner.mean() + thresh_rms * inner.std()
        used += 1
    smooth = _moving(votes, max(1, int(0.1 * fs)))
    where = np.flatnonzero(smooth > used - 0.7)
    if not len(where):
        return []
    runs = np.split(where, np.flatnonzero(np.diff(where) > max(1, min_distance / 1000 * fs)) + 1)
    amplitude = dsp.envelope(sigma)
    phase_step = np.angle(np.exp(1j * np.diff(np.unwrap(np.angle(_analytic(sigma))))))
    out = []
    for r in runs:
        a, b = r[0], r[-1]
        length = (b - a) / fs
        if not duration[0] < length < duration[1]:
            continue
        part = sigma[a : b + 1]
        freq = np.median(phase_step[a:b]) * fs / (2 * np.pi)
        peaks = int(((part[1:-1] > part[:-2]) & (part[1:-1] >= part[2:])).sum())
        trend = np.polyval(np.polyfit(np.arange(b + 1 - a), broad[a : b + 1], 1), np.arange(b + 1 - a))
        level = broad[a : b + 1] - trend
        out.append({"Start": a / fs, "Peak": (a + int(amplitude[a : b + 1].argmax())) / fs, "End": b / fs, "Duration": length, "Amplitude": float(np.ptp(level)), "RMS": float(np.sqrt((level**2).mean())), "Frequency": float(freq), "Oscillations": peaks})
    return out


def _analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def spindles(signals: DataFrame, scale: float = 1.0, keys: Sequence[str] = (), **options) -> DataFrame:
    """Spindles of every signal row, a narrow map over Arrow batches; options go to ``detect``."""
    import pandas as pd

    types = {f.name: f.dataType.simpleString() for f in signals.schema}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + SCHEMA
    names = [*keys, *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                head = {k: r[k] for k in keys} | {"Channel": r["channel"], "Epoch": r["epoch"], "ChanIdx": r["ch_idx"]}
                rows += [head | s for s in detect(np.asarray(r["data"], float) * scale, float(r["sfreq"]), **options)]
            yield pd.DataFrame(rows, columns=names)

    return signals.mapInPandas(run, schema)


def features(found: DataFrame, grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean Duration, Amplitude and Frequency by epoch and channel (NaN without spindles) and Density, their number."""
    from .waves import features as by_grid

    return by_grid(found, grid, ("Duration", "Amplitude", "Frequency"), keys)
