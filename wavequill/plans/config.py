"""Declarative pipelines: a dictionary (or YAML text) of source, preprocessing and markers becomes one DataFrame plan."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable, Mapping
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregate import aggregate, aggregate_pairs
from ..functions.names import normalise_subject, subject_of
from ..operators import complexity, decoding, filters, interpolate, ordinal, reference, reject, signals, spectral, spindles, timelocked, waves
from ..operators.select import eeg_channels, resolve_rois, select_channels
from ..sources import recordings, shared, store, tables

Step = Callable[[DataFrame, dict[str, Any]], DataFrame]


def _pattern(p: Mapping[str, Any]) -> str:
    patterns = p.get("patterns")
    if isinstance(patterns, Mapping):
        recordings.check_patterns(patterns)
    return patterns.get("EEG", {}).get("pattern", "{subject}/*.fif") if isinstance(patterns, Mapping) else p.get("pattern", "{subject}/*.fif")


def _element(p: Mapping[str, Any]) -> Column:
    """The placeholders' values, joined: an element is a subject, or one of its sessions, tasks and so on."""
    known = [c for c in ("subject", "session", "task", "acq", "run") if c in p.get("replacements", ["subject"])]
    return F.concat_ws("_", *(F.col(c) for c in known))


PREPROCESSORS: dict[str, Step] = {}
MARKERS: dict[str, tuple[str, Step]] = {}
SOURCES: dict[str, Callable[[SparkSession, dict[str, Any]], DataFrame]] = {
    "EEGDataGrabber": lambda s, p: recordings.grab(s, p["datadir"], _pattern(p), p.get("replacements", ["subject"])).withColumn("element", _element(p)),
    "EventTable": lambda s, p: tables.event_epochs(s, p["datadir"]),
    "EventRecording": lambda s, p: tables.event_recording(s, p["datadir"]),
    "VectorTable": lambda s, p: tables.vector_epochs(s, p["datadir"]),
}
#: Former parameter names.
RENAMED = {"channel_aggregation_method": "channel_method", "trial_aggregation_method": "trial_method", "connectivity_aggregation_method": "connectivity_method", "tau": "taus"}


def preprocessor(name: str) -> Callable[[Step], Step]:
    return lambda f: PREPROCESSORS.setdefault(name, f)


def marker(name: str, feature: str) -> Callable[[Step], Step]:
    def add(f: Step) -> Step:
        MARKERS[name] = (feature, f)
        return f

    return add


def _times(p: Mapping[str, Any]) -> dict[str, Any]:
    return {"tmin": p.get("tmin"), "tmax": p.get("tmax")}


def _taus(p: Mapping[str, Any]) -> list[int]:
    t = p.get("taus", 8)
    return [t] if isinstance(t, int) else list(t)


@preprocessor("EEGFilter")
def _filter(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """high_freq is the high-pass cut-off and low_freq the low-pass cut-off, as in existing configurations."""
    return filters.clean(df, p.get("high_freq"), p.get("low_freq"), p.get("notches") or (), p.get("resample_freq"), p.get("hp_order", 4), p.get("lp_order", 8))


@preprocessor("EEGEpoching")
def _epoching(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Fixed-length epochs of continuous signal rows, or epochs around events; then the EEG channels and the baseline.

    Events come from ``events`` (a table or CSV path of element, sample, code, name), else from stimulus channels, else, for
    elements without one, from the recordings' annotations.
    """
    plain = df.where(~F.col("channel").rlike(signals.STIMULUS) & ~F.col("channel").isin(list(p.get("exclude_channels") or [])))
    if p.get("duration") is None:
        plain = signals.cut_events(plain, _events(df, p), p.get("tmin", -0.2), p.get("tmax", 1.0))
    else:
        n, step = F.round(F.lit(float(p["duration"])) * F.col("sfreq")).cast("int"), F.round(F.lit(float(p["duration"]) - float(p.get("overlap", 0.0))) * F.col("sfreq")).cast("int")
        starts = F.when(F.size("data") >= n, F.sequence(F.lit(0), F.size("data") - n, step)).otherwise(F.array().cast("array<int>"))
        cut = plain.withColumn("__n", n).select("*", F.posexplode(starts).alias("__epoch", "__start"))
        plain = cut.withColumn("data", F.slice("data", F.col("__start") + 1, F.col("__n"))).withColumn("epoch", F.col("__epoch")).drop("__n", "__epoch", "__start")
    base = p.get("baseline", (None, 0.0))
    return signals.baseline(eeg_channels(plain), *base) if base else eeg_channels(plain)


def _events(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    wanted = p.get("event_id")
    given = p.get("events")
    if given is not None:
        rows = given if isinstance(given, DataFrame) else df.sparkSession.read.csv(given, header=True, inferSchema=True)
        rows = rows.select(F.col("element").cast(df.schema["element"].dataType).alias("element"), F.col("sample").cast("long").alias("sample"), F.col("code").cast("int").alias("code"), (F.col("name") if "name" in rows.columns else F.lit(None)).cast("string").alias("name"))
    else:
        rows = signals.stimulus_events(df, p.get("stim_channel", signals.STIMULUS)).withColumn("name", F.lit(None).cast("string"))
        if p.get("__annotations") is not None:
            with_stim = df.where(F.col("channel").rlike(signals.STIMULUS)).select("element").distinct()
            rows = rows.unionByName(p["__annotations"].join(with_stim, "element", "left_anti").select("element", "sample", "code", "name"))
    if wanted is None:
        return rows.withColumn("name", F.coalesce("name", F.col("code").cast("string")))
    # By code where an event has no name of its own, else by name.
    by_code = F.lit(None).cast("string")
    for name, code in wanted.items():
        by_code = F.coalesce(by_code, F.when(F.col("code") == int(code), F.lit(name)))
    named = F.when(F.col("name").isNull(), by_code).when(F.col("name").isin(list(wanted)), F.col("name"))
    return rows.withColumn("name", named).where("name is not null")


@preprocessor("EEGReference")
def _reference(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    at = ["element", "epoch", "condition", "ch_idx", "channel", "sfreq", "tmin"]
    s = reference.reference(signals.explode_samples(df.select(*at, "data")), p.get("ref_channels", "average"), now=False)
    return signals.collect_signals(s, at)


@preprocessor("BadChannelsThreshold")
def _bad_threshold(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return reject.drop_channels(df, reject.bad_channels_by_range(df, p.get("reject", {"eeg": 100e-6}), p.get("n_epochs_bad_ch", 0.5)), min_channels=p.get("min_channels", 0.7))


@preprocessor("BadChannelsVariance")
def _bad_variance(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return reject.drop_channels(df, reject.bad_channels_by_variance(df, p.get("zscore_thresh", 4), p.get("max_iter", 2)).where("is_bad"), min_channels=p.get("min_channels", 0.7))


@preprocessor("BadChannelsHighFrequency")
def _bad_high(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return reject.drop_channels(df, reject.bad_channels_by_high_frequencies(df, p.get("zscore_thresh", 4), p.get("max_iter", 2)).where("is_bad"), min_channels=p.get("min_channels", 0.7))


@preprocessor("BadEpochsThreshold")
def _bad_epochs(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return reject.reject_epochs(df, p.get("reject", {"eeg": 100e-6}), p.get("n_channels_bad_epoch", 0.1), p.get("min_events", 0.3), now=False)[0]


@preprocessor("EEGInterpolation")
def _interpolate(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    at = ["element", "epoch", "condition", "ch_idx", "channel", "sfreq", "tmin"]
    s = interpolate.interpolate(signals.explode_samples(df.select(*at, "data")), p["positions"], p.get("bads", []))
    return signals.collect_signals(s, at)


def _spectral_key(p: Mapping[str, Any]) -> tuple:
    return ("psd", str(p.get("rois")), p.get("equipment"), *(p.get(k) for k in ("n_fft", "n_per_seg", "n_overlap", "tmin", "tmax")))


def _spectra(df: DataFrame, p: dict[str, Any], fmin: float, fmax: float | None) -> DataFrame:
    """Spectra between two frequencies; markers with equal settings share one table of whole spectra."""
    make = partial(spectral.psd, df, n_fft=p.get("n_fft"), n_per_seg=p.get("n_per_seg"), n_overlap=p.get("n_overlap"), tmin=p.get("tmin"), tmax=p.get("tmax"))
    if "__shared" not in p:
        return make(fmin=fmin, fmax=fmax)
    return spectral.within(p["__shared"](_spectral_key(p), make), fmin, fmax)


def _low_passed(df: DataFrame, p: dict[str, Any], tau: int, csd: bool = False) -> DataFrame:
    make = partial(filters.ordinal_low_pass, df, p.get("kernel", 3), tau)
    return p["__shared"](_ordinal_key(p, tau, csd), make) if "__shared" in p else make()


def _ordinal_key(p: Mapping[str, Any], tau: int, csd: bool) -> tuple:
    return ("low", str(p.get("rois")), p.get("equipment"), p.get("kernel", 3), tau, csd)


def _rate(df: DataFrame) -> float:
    row = df.select("sfreq").first()
    return float(row["sfreq"]) if row else 250.0


@marker("SpectralPowerBands", "spectralpower")
def _bands(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    bands = {k: tuple(v) for k, v in (p.get("bands") or spectral.BANDS).items()}
    relative, entropy = p.get("normalize", False), p.get("entropy", False)
    if entropy and not relative:
        raise ValueError("entropy needs normalize")
    s = _spectra(df, p, *spectral.band_range(bands, relative, _rate(df)))
    out = spectral.band_power(spectral.normalise(s) if relative else s, bands, entropy)
    return spectral.decibels(out, p.get("db_threshold")) if p.get("dB", True) and not entropy else out


@marker("PowerSpectralDensitySummary", "psdsummary")
def _edge(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return spectral.spectral_edge(_spectra(df, p, p.get("fmin", 0.0), p.get("fmax")), p.get("percentile", 0.5))


@marker("PowerSpectralDensityEstimator", "psd_data")
def _estimate(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return spectral.mean_spectrum(_spectra(df, p, p.get("fmin", 0.0), p.get("fmax")), ["element", "ch_idx", "channel"]).withColumnRenamed("power", "value").drop("norm")


@marker("PermutationEntropy", "permutationentropy")
def _entropy(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    parts = [ordinal.permutation_entropy(_low_passed(df, p, t), [t], p.get("kernel", 3), **_times(p)) for t in _taus(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _smi(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """CSD is on by default. Asked for without positions it is an error; not mentioned at all, it is left out with a warning."""
    if p.get("csd") and "positions" not in p:
        raise ValueError(f"{p['kind']}: csd needs positions")
    csd = bool("positions" in p and p.get("csd", True))
    if "csd" not in p and "positions" not in p:
        warnings.warn(f"{p['kind']}: no CSD without positions; csd: false says so", stacklevel=2)
    elif csd:
        import numpy as np

        df = interpolate.mix_channels(df, interpolate.csd_matrix(np.array(list(p["positions"].values()))))
    parts = [ordinal.mutual_information(_low_passed(df, p, t, csd), [t], p.get("kernel", 3), p.get("weighted", True), **_times(p)) for t in _taus(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


MARKERS["SymbolicMutualInformation"] = MARKERS["SymbolicMutualInformationROIs"] = ("symbolicmutualinformation", _smi)


@marker("KolmogorovComplexity", "kolmogorovcomplexity")
def _complexity(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return complexity.kolmogorov(signals.crop(df, p.get("tmin"), p.get("tmax")), p.get("nbins", 16))


@marker("ContingentNegativeVariation", "cnvslope")
def _drift(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return timelocked.linear_drift(df, p.get("tmin"), p.get("tmax"), p.get("scale", 1e6)).withColumnRenamed("slope", "value").drop("intercept")


@marker("TimeLockedTopography", "timelockedtopo")
def _topography(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return timelocked.topography(df, p.get("tmin"), p.get("tmax"), tuple(p["baseline"]) if p.get("baseline") else None)


@marker("TimeLockedContrast", "timelockedcontrast")
def _contrast(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return timelocked.contrast(df, p["condition_a"], p["condition_b"], p.get("tmin"), p.get("tmax"), tuple(p["baseline"]) if p.get("baseline") else None, ["element", "ch_idx", "channel"])


def _waves(found: DataFrame, df: DataFrame, p: dict[str, Any], columns: tuple[str, ...]) -> DataFrame:
    grid = df.select("element", F.col("epoch").alias("Epoch"), F.col("channel").alias("Channel"), F.col("ch_idx")).distinct()
    out = waves.features(found.drop("ChanIdx"), grid, columns, ["element"]).join(grid, ["element", "Epoch", "Channel"])
    return out.select("element", F.col("Epoch").alias("epoch"), "ch_idx", F.col("Channel").alias("channel"), F.col(p["feature"]).alias("value"))


def _thresholds(df: DataFrame, p: dict[str, Any]) -> DataFrame | None:
    """element, channel, ptp_threshold of a CSV table by subject: the rows' own, or the element where they tell none."""
    if not p.get("ptp_thresholds_path") or p.get("ptp_threshold_mode", "adaptive") == "fixed":
        return None
    who = lambda c: normalise_subject(c).alias("__who")
    given = df.sparkSession.read.csv(p["ptp_thresholds_path"], header=True).select(who(F.col("subject").cast("string")), "channel", F.col("ptp_threshold").cast("double").alias("ptp_threshold"))
    if twice := given.groupBy("__who", "channel").count().where("count > 1").first():
        raise ValueError(f"more than one threshold for subject {twice['__who']!r}, channel {twice['channel']!r}")
    elements = df.select("element", who(subject_of(df.columns))).distinct()
    if p.get("ptp_thresholds_strict", True) and (lacking := elements.join(given, "__who", "left_anti").first()):
        raise ValueError(f"no thresholds for subject {lacking['element']!r}")
    return elements.join(given, "__who").drop("__who")


@marker("SlowWavesDetection", "slowwavesdetection")
def _slow(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Epochs that lack a reference channel, or where all are flat, keep their reference."""
    at = ["element", "epoch", "condition", "ch_idx", "channel", "sfreq", "tmin"]
    names = p.get("reference_channels", ("TP7", "TP8"))
    names = [names] if isinstance(names, str) else list(names or ())
    if names and not df.where(F.col("channel").isin(names)).isEmpty():
        df = signals.collect_signals(reference.reference_if_any(signals.explode_samples(df.select(*at, "data")), names), at)
    band = tuple(p.get("freq_sw", (0.3, 1.5)))
    filtered = waves.band_pass_rows(df, band, p.get("filter_design", "chebyshev2"), p.get("scale", 1e6), p.get("downsample_to"))
    found = waves.negative_peak_waves(filtered) if p.get("detection_method", "yasa") == "yasa" else waves.zero_crossing_waves(filtered, p.get("amp_ptp_initial", 15))
    bounds = (p.get("freq_threshold", 7), p.get("max_ptp_amplitude", 150), p.get("artifact_threshold", 75), p.get("slope_uv_per_s_range"))
    if p.get("proximity_amplitude") is not None:
        # Waves near artifacts go before the percentile is taken.
        found = waves.far_from_artifacts(found, filtered, float(p["proximity_amplitude"]), float(p.get("proximity_window", 1.0)), ["element"])
    kept = waves.cascade(found, *bounds, p.get("ptp_threshold_mode", "adaptive"), p.get("ptp_percentile", 90), _thresholds(df, p), keys=["element"])
    return _waves(kept, df, p, ("Duration", "PTP", "Frequency", "Slope"))


@marker("SpindlesDetection", "spindlesdetection")
def _spindles(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    options = {k: p[k] for k in ("freq_sp", "freq_broad", "duration", "min_distance", "thresh_rms", "thresh_corr") if k in p}
    return _waves(spindles.spindles(df, p.get("scale", 1e6), ["element"], **options), df, p, ("Duration", "Amplitude", "Frequency"))


def _conditions(p: dict[str, Any]) -> tuple[list[str], list[str]]:
    return tuple([c] if isinstance(c, (str, int)) else list(c) for c in (p["condition_a"], p["condition_b"]))


@marker("WindowDecoding", "windowdecoding")
def _window(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return decoding.window_decoding(df, *_conditions(p), p.get("tmin"), p.get("tmax"), p.get("n_splits", 10), p.get("scoring", "roc_auc"), p.get("random_state"))


@marker("TimeDecoding", "timedecoding")
def _time(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return decoding.time_decoding(df, *_conditions(p), p.get("tmin"), p.get("tmax"), p.get("n_splits", 5), p.get("scoring", "roc_auc"), p.get("random_state", 42))


def run_marker(epochs: DataFrame, spec: Mapping[str, Any], channels: list[str] | None = None, share: Callable | None = None) -> DataFrame:
    """One marker's feature rows: regions, kernel, then the aggregations that its parameters ask for.

    share: where given, called with a key and a function, gives the table that markers of this key have in common.
    """
    p = _renamed(spec)
    if p["kind"] not in MARKERS:
        raise ValueError(f"unknown marker {p['kind']!r}; known are {', '.join(sorted(MARKERS))}")
    feature, kernel = MARKERS[p["kind"]]
    if share is not None:
        p["__shared"] = share
    df = epochs
    if p.get("rois"):
        names = channels or [r["channel"] for r in epochs.select("ch_idx", "channel").distinct().orderBy("ch_idx").collect()]
        df = select_channels(epochs, resolve_rois(p["rois"], names, p.get("equipment"))).drop("pos")
    out = kernel(df, p)
    axes = [c for c in ("element", "band", "tau", "epoch", "channel", "channel_i", "channel_j", "freq", "t_idx") if c in out.columns]
    if "channel_j" in axes:
        if any(p.get(k) for k in ("connectivity_method", "channel_method", "trial_method")):
            out = aggregate_pairs(out, axes, p.get("connectivity_method"), p.get("channel_method"), p.get("trial_method"))
    elif p.get("channel_method") or (p.get("trial_method") and "epoch" in axes):
        out = aggregate(out, axes, p.get("channel_method"), p.get("trial_method") if "epoch" in axes else None)
    return store.as_features(out, p.get("feature_name", feature), p["kind"], p.get("name"))


def _renamed(spec: Mapping[str, Any]) -> dict[str, Any]:
    return {RENAMED.get(k, k): v for k, v in spec.items()}


def _keys(p: Mapping[str, Any]) -> list[tuple]:
    """What a marker could share with others."""
    if p["kind"] in ("SpectralPowerBands", "PowerSpectralDensitySummary", "PowerSpectralDensityEstimator"):
        return [_spectral_key(p)]
    if p["kind"] == "PermutationEntropy":
        return [_ordinal_key(p, t, False) for t in _taus(p)]
    if p["kind"].startswith("SymbolicMutualInformation"):
        return [_ordinal_key(p, t, bool("positions" in p and p.get("csd", True))) for t in _taus(p)]
    return []


def compile_pipeline(spark: SparkSession, config: Mapping[str, Any] | str) -> DataFrame:
    """The union of all markers' feature rows.

    What several markers need is written once to the shared folder: the preprocessed signals, and the spectra and low-passed
    signals that markers with equal settings have in common. A preprocessing step with ``dump_path`` also
    writes its result there, under its stage's name.
    """
    if isinstance(config, str):
        import yaml

        config = yaml.safe_load(config)
    grabber = dict(config["datagrabber"])
    kind = grabber.pop("kind")
    df = SOURCES[kind](spark, grabber)
    steps, specs = [dict(x) for x in config.get("preprocess") or []], [_renamed(x) for x in config["markers"]]
    if unknown := [x["kind"] for x in steps if x["kind"] not in PREPROCESSORS]:
        raise ValueError(f"unknown preprocessing steps {unknown}")
    for step in steps:
        if step["kind"] == "EEGEpoching" and kind == "EEGDataGrabber":
            step["__annotations"] = recordings.annotations(spark, grabber["datadir"], _pattern(grabber), grabber.get("replacements", ["subject"])).withColumn("element", _element(grabber))
        df = PREPROCESSORS[step.pop("kind")](df, step)
        if step.get("dump_path"):
            df = store.dump(df, step["dump_path"])
    if len(specs) > 1:
        df = shared.keep(df, "signals")
    counts = Counter(k for p in specs for k in set(_keys(p)))
    made: dict[tuple, DataFrame] = {}

    def share(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if counts[key] < 2:
            return make()
        if key not in made:
            made[key] = shared.keep(make(), key[0])
        return made[key]

    out = None
    for p in specs:
        rows = run_marker(df, p, share=share)
        out = rows if out is None else out.unionByName(rows)
    if uri := (config.get("storage") or {}).get("uri"):
        store.write(out, uri)
    return out


def main(args: list[str] | None = None) -> int:
    """``python -m wavequill.plans.config run pipeline.yaml``: run a pipeline file and write its features to its storage."""
    import argparse

    import yaml

    parser = argparse.ArgumentParser(prog="wavequill", description=main.__doc__)
    parser.add_argument("command", choices=["run", "list"])
    parser.add_argument("file", nargs="?")
    parser.add_argument("--uri", help="where features go, in place of the file's storage uri")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(["grabbers: " + ", ".join(sorted(SOURCES)), "preprocessors: " + ", ".join(sorted(PREPROCESSORS)), "markers: " + ", ".join(sorted(MARKERS))]))
        return 0
    if not given.file:
        parser.error("run needs a file")
    with open(given.file) as f:
        config = yaml.safe_load(f)
    uri = given.uri or (config.get("storage") or {}).get("uri")
    if not uri:
        parser.error("no storage uri")
    spark = SparkSession.builder.appName("wavequill").getOrCreate()
    store.write(compile_pipeline(spark, {**config, "storage": None}), uri)
    print(f"{len(store.list_features(spark, uri))} features in {uri}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
