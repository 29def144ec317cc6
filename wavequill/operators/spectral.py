"""Spectral power: densities, bands, normalisation, entropy, decibels and spectral edges."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from .signals import crop, let

BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "beta": (12.0, 30.0), "gamma": (30.0, 45.0)}


def segment_sizes(n: int, n_per_seg: int | None = None, n_overlap: int | None = None) -> tuple[int, int]:
    """Segment length and overlap for n samples, counted before any cropping."""
    per = min(64, n // 2) if n_per_seg is None else n_per_seg
    return per, min(32, per // 2) if n_overlap is None else n_overlap


def psd(signals: DataFrame, fmin: float = 0.0, fmax: float | None = None, n_fft: int | None = 256, n_per_seg: int | None = None, n_overlap: int | None = None, tmin: float | None = None, tmax: float | None = None) -> DataFrame:
    """Welch densities of every signal row: column ``psd`` of structs (freq, power), fmin <= freq <= fmax.

    A narrow map over Arrow batches: rows of equal length go through one FFT, nothing is shuffled. Python gives two plain arrays,
    which Spark zips.
    """
    import pandas as pd

    cropped = crop(signals.withColumn("__n", F.size("data")), tmin, tmax)
    keep = [c for c in signals.columns if c != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema if f.name != "data") + ", __freq array<double>, __power array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (n, fs, size), part in pdf.groupby(["__n", "sfreq", pdf["data"].map(len)], sort=False):
                per, overlap = segment_sizes(int(n), n_per_seg, n_overlap)
                fft = max(256 if n_fft is None else n_fft, min(per, int(size)))
                freqs, power = dsp.welch(np.stack(part["data"].to_numpy()), float(fs), fft, per, overlap)
                inside = (freqs >= fmin) & (freqs <= (np.inf if fmax is None else fmax))
                yield part[keep].assign(__freq=[freqs[inside]] * len(part), __power=list(power[:, inside]))

    made = cropped.mapInPandas(run, schema)
    return made.select(*keep, F.arrays_zip("__freq", "__power").cast("array<struct<freq:double,power:double>>").alias("psd"))


def within(spectra: DataFrame, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """Spectra cut to fmin <= freq <= fmax."""
    return spectra.withColumn("psd", F.filter("psd", lambda x: (x["freq"] >= fmin) & (x["freq"] <= (float("inf") if fmax is None else fmax))))


def psd_sql(signals: DataFrame, n_per_seg: int, n_overlap: int, n_fft: int, n_samples: int, sfreq: float, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """The same densities by higher-order functions, for short signals: segments and a cosine and sine sum for each frequency."""
    step = n_per_seg - n_overlap
    starts = range(0, n_samples - n_per_seg + 1, step)
    window = dsp.hamming(n_per_seg)
    freqs = [(k, k * sfreq / n_fft) for k in range(n_fft // 2 + 1) if fmin <= k * sfreq / n_fft <= (fmax if fmax is not None else sfreq)]
    lit = lambda values: F.array(*(F.lit(float(v)) for v in values))
    segs = signals.withColumn("seg", F.explode(F.array(*(F.slice("data", s + 1, n_per_seg) for s in starts))))
    m = F.aggregate("seg", F.lit(0.0), lambda s, x: s + x) / n_per_seg
    segs = segs.withColumn("seg", let(m, lambda m: F.zip_with("seg", lit(window), lambda x, w: (x - m) * w)))
    scale = 1.0 / (sfreq * float((window**2).sum()))

    def power(k: int) -> Column:
        angle = 2 * np.pi * k * np.arange(n_per_seg) / n_fft
        part = lambda basis: F.aggregate(F.zip_with("seg", lit(basis), lambda x, b: x * b), F.lit(0.0), lambda s, x: s + x)
        re, im = part(np.cos(angle)), part(np.sin(angle))
        return (re * re + im * im) * scale * (1.0 if k == 0 or 2 * k == n_fft else 2.0)

    keep = [c for c in signals.columns if c != "data"]
    each = segs.select(*keep, F.posexplode(F.array(*(F.struct(F.lit(float(f)).alias("freq"), power(k).alias("power")) for k, f in freqs))).alias("bin", "p"))
    return each.groupBy(*keep, F.col("p.freq").alias("freq")).agg(F.avg("p.power").alias("power"))


def total_power(spectrum: Column) -> Column:
    return F.aggregate(spectrum, F.lit(0.0), lambda s, x: s + x["power"])


def normalise(spectra: DataFrame, floor: float | None = 1e-12) -> DataFrame:
    """Divide by the sum over all bins, which is not taken below the floor."""
    total = total_power(F.col("psd"))
    total = total if floor is None else F.greatest(total, F.lit(floor))
    return spectra.withColumn("psd", let(total, lambda t: F.transform("psd", lambda x: F.struct(x["freq"].alias("freq"), (x["power"] / t).alias("power")))))


def band_range(bands: Mapping[str, tuple[float, float]], normalised: bool, sfreq: float) -> tuple[float, float]:
    """Frequencies that a set of bands needs; normalised power needs 1 to 45 Hz."""
    if normalised:
        return 1.0, min(45.0, sfreq / 2 - 1)
    return min(b[0] for b in bands.values()), min(max(b[1] for b in bands.values()), sfreq / 2 - 1)


def band_power(spectra: DataFrame, bands: Mapping[str, tuple[float, float]] = BANDS, entropy: bool = False) -> DataFrame:
    """A row for each band: the sum of its bins (lo <= f < hi), 0 without bins; or their entropy over ln(bins).

    Entropy takes powers that are not positive as 1e-12 and needs normalised spectra; a band of one bin has none (NaN).
    """
    out = []
    for name, (lo, hi) in bands.items():
        if not lo < hi:
            raise ValueError(f"band {name} is empty")
        bins = F.filter("psd", lambda x: (x["freq"] >= lo) & (x["freq"] < hi))
        if entropy:
            safe = F.transform(bins, lambda x: F.greatest(x["power"], F.lit(0.0)))
            safe = F.transform(safe, lambda p: F.when(p > 0, p).otherwise(1e-12))
            value = F.when(F.size(bins) > 1, -F.aggregate(safe, F.lit(0.0), lambda s, p: s + p * F.ln(p)) / F.ln(F.size(bins))).when(F.size(bins) == 1, float("nan")).otherwise(0.0)
        else:
            value = total_power(bins)
        out.append(F.struct(F.lit(name).alias("band"), value.alias("value")))
    keep = [c for c in spectra.columns if c != "psd"]
    return spectra.select(*keep, F.explode(F.array(*out)).alias("b")).select(*keep, "b.band", "b.value")


def decibels(powers: DataFrame, threshold: float | None = None, keys: Sequence[str] = ("element",)) -> DataFrame:
    """10 log10 of powers, floored at the threshold, or at a hundredth of the least positive power of the element.

    The adaptive floor is one small aggregate by element that is joined back; an element without any power is an error.
    """
    if threshold is not None:
        return powers.withColumn("value", 10 * F.log10(F.greatest("value", F.lit(threshold))))
    least = F.min(F.when(F.col("value") > 0, F.col("value")))
    floor = powers.groupBy(*keys).agg(F.greatest(F.coalesce(least, F.raise_error(F.lit("no power above 0")).cast("double")) * 0.01, F.lit(float(np.finfo(float).eps))).alias("__floor"))
    return powers.join(floor, list(keys)).withColumn("value", 10 * F.log10(F.greatest("value", "__floor"))).drop("__floor")


def spectral_edge(spectra: DataFrame, percentile: float = 0.5) -> DataFrame:
    """First frequency at which the running power reaches a share of the whole; the first one without power, the last if never."""
    total = total_power(F.col("psd"))
    walk = lambda t: F.aggregate(
        "psd", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at")),
        lambda s, x: F.struct((s["sum"] + x["power"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + x["power"] >= t * percentile, x["freq"])).alias("at")),
    )
    first, last = F.element_at("psd", 1)["freq"], F.element_at("psd", -1)["freq"]
    value = let(total, lambda t: F.when(F.size("psd") == 0, 0.0).when(t > 0, F.coalesce(walk(t)["at"], last)).otherwise(first))
    return spectra.withColumn("value", value).drop("psd")


def mean_spectrum(spectra: DataFrame, keys: Sequence[str] = ("element", "channel")) -> DataFrame:
    """Densities averaged over epochs, with those divided by their sum as ``norm``: keys, freq, power, norm."""
    mean = spectra.select(*keys, F.explode("psd").alias("p")).groupBy(*keys, F.col("p.freq").alias("freq")).agg(F.avg("p.power").alias("power"))
    total = mean.groupBy(*keys).agg(F.sum("power").alias("__total"))
    return mean.join(total, list(keys)).withColumn("norm", F.col("power") / F.col("__total")).drop("__total")
