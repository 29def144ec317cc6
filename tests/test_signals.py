"""Operators against independent numpy, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequill.functions import aggregate as agg
from wavequill.functions import dsp, names
from wavequill.operators import complexity, decoding, filters, interpolate, ordinal, reference, reject, select, signals, spectral, spindles, timelocked, waves
from wavequill.sources import equipment, recordings, store


def rows(spark, data, sfreq=250.0, tmin=0.0, condition=None):
    """Signal rows of an array (epochs, channels, times)."""
    out = [("a", e, (condition or ["x"])[e % len(condition or ["x"])], c, f"E{c + 1}", sfreq, tmin, data[e, c].tolist()) for e in range(data.shape[0]) for c in range(data.shape[1])]
    return spark.createDataFrame(out, "element string, epoch int, condition string, ch_idx int, channel string, sfreq double, tmin double, data array<double>").repartition(4)


def tensor(df, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["epoch"], r["ch_idx"]] = r[column]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    t = np.arange(200) / 250
    return rng.normal(size=(10, 8, 200)) + 0.5 * np.sin(2 * np.pi * (5 + 2 * np.arange(8))[None, :, None] * t)


# ---- signal processing ---------------------------------------------------------------------------


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * np.asarray(f) / fs)
    h = np.ones_like(z)
    for b0, b1, b2, _, a1, a2 in sos:
        h = h * (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return 20 * np.log10(np.abs(h) + 1e-300)


def test_filters_meet_their_specifications():
    assert np.allclose(response(dsp.butter(4, (25.0,), "high", 250.0), [25.0], 250.0), -3.0103, atol=1e-3)
    assert np.allclose(response(dsp.butter(4, (8.0, 12.0), "band", 250.0), [8.0, 12.0], 250.0), -3.0103, atol=1e-3)
    c = response(dsp.cheby2_band((0.3, 1.5), (0.03, 6.5), 3.0, 25.0, 250.0), [0.03, 0.3, 0.7, 1.5, 6.5], 250.0)
    assert c[0] <= -25 and c[4] <= -25 and np.allclose(c[[1, 3]], -3, atol=1e-6) and abs(c[2]) < 0.1


def test_block_filter_equals_recursion():
    sos = dsp.butter(6, (30.0,), "low", 250.0)
    x = np.random.default_rng(0).normal(size=(3, 333))
    want = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        for row in want:
            z1 = z2 = 0.0
            for i, v in enumerate(row.copy()):
                row[i] = b0 * v + z1
                z1, z2 = b1 * v - a1 * row[i] + z2, b2 * v - a2 * row[i]
    assert np.allclose(dsp.sos_filter(sos, x), want, atol=1e-12)
    assert np.allclose(dsp.zero_phase(sos, np.full((2, 100), 3.0), 21), 3.0)


def test_welch_finds_a_tone_and_its_power():
    t = np.arange(1000) / 250
    f, p = dsp.welch(2 * np.sin(2 * np.pi * 20 * t), 250.0, 250, 250, 125)
    assert f[p.argmax()] == 20 and np.isclose(p.sum(), 2.0, rtol=1e-2)


def test_resampling_keeps_tones():
    t = np.arange(2000) / 250
    y = dsp.fft_resample(np.sin(2 * np.pi * 10 * t), 100, 250.0)
    assert np.allclose(y[50:-50], np.sin(2 * np.pi * 10 * np.arange(800) / 100)[50:-50], atol=1e-4)


# ---- kernels -------------------------------------------------------------------------------------


def pe(x, kernel, tau):
    n = len(x) - tau * (kernel - 1)
    pats = [tuple(np.argsort(x[i : i + tau * (kernel - 1) + 1 : tau], kind="stable")) for i in range(n)]
    _, c = np.unique(pats, axis=0, return_counts=True)
    p = c / n
    return -(p * np.log(p)).sum() / np.log({3: 6, 4: 24}[kernel])


@pytest.mark.parametrize(("kernel", "tau"), [(3, 1), (3, 8), (4, 2)])
def test_permutation_entropy(spark, data, kernel, tau):
    got = tensor(ordinal.permutation_entropy(rows(spark, data), (tau,), kernel), (10, 8))
    want = np.array([[pe(x, kernel, tau) for x in e] for e in data])
    assert np.allclose(got, want, atol=1e-12)


def test_permutation_entropy_of_ties_and_short_signals(spark):
    flat = np.zeros((1, 1, 20))
    assert tensor(ordinal.permutation_entropy(rows(spark, flat), (1,), 3), (1, 1))[0, 0] == 0
    assert np.isnan(tensor(ordinal.permutation_entropy(rows(spark, flat), (10,), 3), (1, 1))[0, 0])
    with pytest.raises(ValueError):
        ordinal.permutation_entropy(rows(spark, flat), (), 3)


def test_alphabet_mirrors():
    for k in (3, 4):
        a = ordinal.alphabet(k)
        assert all(a[i][::-1] == a[len(a) - 1 - i] for i in range(len(a)))


def wsmi(x, y, tau, weighted):
    a = ordinal.alphabet(3)
    sym = lambda v: [a.index(tuple(np.argsort(v[i : i + 2 * tau + 1 : tau], kind="stable"))) for i in range(len(v) - 2 * tau)]
    s, t = sym(x), sym(y)
    joint = np.zeros((6, 6))
    for i, j in zip(s, t, strict=True):
        joint[i, j] += 1 / len(s)
    px, py = np.bincount(s, minlength=6) / len(s), np.bincount(t, minlength=6) / len(s)
    out = 0.0
    for i in range(6):
        for j in range(6):
            if joint[i, j] > 1e-15 and not (weighted and (i == j or i + j == 5)):
                out += joint[i, j] * (np.log(joint[i, j]) - np.log(px[i] + 1e-15) - np.log(py[j] + 1e-15))
    return out / np.log(6)


@pytest.mark.parametrize("weighted", [True, False])
def test_mutual_information_both_ways(spark, data, weighted):
    part = data[:2, :4]
    full = {(r["epoch"], r["ch_i"], r["ch_j"]): r["value"] for r in ordinal.mutual_information(rows(spark, part), (2,), 3, weighted).collect()}
    sql = {(r["epoch"], r["channel_i"], r["channel_j"]): r["value"] for r in ordinal.mutual_information_sql(rows(spark, part), 2, 3, weighted).collect()}
    for e in range(2):
        for i in range(4):
            assert full[e, i, i] == 0
            for j in range(i + 1, 4):
                want = wsmi(part[e, i], part[e, j], 2, weighted)
                assert np.isclose(full[e, i, j], want) and full[e, i, j] == full[e, j, i]
                assert np.isclose(sql[e, f"E{i + 1}", f"E{j + 1}"], want)
    with pytest.raises(Exception, match="too few"):
        ordinal.mutual_information(rows(spark, part), (100,), 3).collect()


@pytest.mark.parametrize("full", [True, False])
def test_mutual_information_leaves_in_bounded_batches(spark, monkeypatch, full):
    x = np.random.default_rng(5).normal(size=(40, 48, 12))
    df, taken = rows(spark, x), []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.append((self, f)) or self, raising=True)
        ordinal.mutual_information(df, (1, 2), 3, keys=("epoch",), full=full)
    epochs, f = taken[0]
    made = list(f(iter(epochs.toArrow().combine_chunks().to_batches())))
    pairs = 48 * 48 if full else 48 * 47 // 2
    assert len(made) > 1 and max(b.num_rows for b in made) <= ordinal.PAIRS
    assert sum(b.num_rows for b in made) == 40 * 2 * pairs
    got = [tuple(r) for b in made for r in zip(*(b.column(c).to_pylist() for c in ("epoch", "tau", "channel_i", "channel_j")), strict=True)]
    assert len(set(got)) == len(got) and len({g[0] for g in got}) == 40


def test_kolmogorov(spark, data):
    import zlib

    def kc(x, bins):
        s = np.sort(x)
        first = len(x) // 10
        last = len(x) - first if first > 1 else len(x) - 1
        size = (s[last] - s[first]) / bins
        letters = bytes(65 + (0 if size <= 0 else max(0, min(bins - 1, int((v - s[first]) / size)))) for v in x)
        return len(zlib.compress(letters)) / len(letters)

    got = tensor(complexity.kolmogorov(rows(spark, data), 32), (10, 8))
    assert np.allclose(got, [[kc(x, 32) for x in e] for e in data])
    assert tensor(complexity.kolmogorov(rows(spark, np.zeros((1, 1, 50)))), (1, 1))[0, 0] == kc(np.zeros(50), 16)


def test_spectral_power(spark, data):
    s = spectral.psd(rows(spark, data), 1.0, 45.0, n_fft=None)
    f, p = dsp.welch(data, 250.0, 256, 64, 32)
    m = (f >= 1) & (f <= 45)
    bands = {r["band"]: r for r in spectral.band_power(s).where("epoch = 3 and ch_idx = 2").collect()}
    for name, (lo, hi) in spectral.BANDS.items():
        assert np.isclose(bands[name]["value"], p[3, 2, (f >= lo) & (f < hi) & m].sum())
    rel = tensor(spectral.band_power(spectral.normalise(s), {"alpha": (8.0, 12.0)}), (10, 8))
    assert np.allclose(rel, p[:, :, (f >= 8) & (f < 12)].sum(axis=-1) / p[:, :, m].sum(axis=-1))
    edge = tensor(spectral.spectral_edge(s, 0.95), (10, 8))
    cum = np.cumsum(p[:, :, m], axis=-1)
    assert np.allclose(edge, f[m][(cum >= 0.95 * cum[..., -1:]).argmax(axis=-1)])
    assert tensor(spectral.spectral_edge(spectral.psd(rows(spark, np.zeros((1, 1, 200))), 1.0, 45.0)), (1, 1))[0, 0] == f[m][0]
    with pytest.raises(Exception, match="no power"):
        spectral.decibels(spectral.band_power(spectral.psd(rows(spark, np.zeros((1, 1, 200))), 1.0, 45.0))).collect()


def test_drift(spark, data):
    got = timelocked.linear_drift(rows(spark, data, tmin=-0.2), 0.0, 0.3, 1e6)
    t = -0.2 + np.arange(200) / 250
    m = (t >= -1e-9) & (t <= 0.3 + 1e-9)
    for r in got.where("ch_idx = 1").collect():
        slope, level = np.polyfit(t[m], data[r["epoch"], 1, m] * 1e6, 1)
        assert np.isclose(r["slope"], slope) and np.isclose(r["intercept"], level)
    with pytest.raises(Exception, match="two samples"):
        timelocked.linear_drift(rows(spark, data), 0.0, 0.0).collect()


def test_topography_and_contrast(spark, data):
    df = rows(spark, data, tmin=-0.2, condition=["go/left", "go/right", "stop"])
    t = -0.2 + np.arange(200) / 250
    based = data - data[:, :, t <= 1e-9].mean(axis=-1, keepdims=True)
    want = based[:, :, (t >= 0.1 - 1e-9) & (t <= 0.3 + 1e-9)].mean(axis=-1)
    assert np.allclose(tensor(timelocked.topography(df, 0.1, 0.3, (None, 0.0)), (10, 8)), want)
    cond = np.array([["go/left", "go/right", "stop"][e % 3] for e in range(10)])
    got = {r["channel"]: r["value"] for r in timelocked.contrast(df, "go", ["stop"], 0.1, 0.3, (None, 0.0)).collect()}
    diff = want[np.char.startswith(cond, "go")].mean(axis=0) - want[cond == "stop"].mean(axis=0)
    assert np.allclose([got[f"E{i + 1}"] for i in range(8)], diff)
    with pytest.raises(ValueError):
        timelocked.contrast(df, "go", "stop", channel_method="std")
    with pytest.raises(ValueError):
        select.in_condition(F.col("condition"), "never", {"go/left": 1})


# ---- waves, spindles -----------------------------------------------------------------------------


def brute_waves(x, sf, least):
    cross = np.where(np.diff(np.signbit(x)))[0] + 1
    out = []
    for a, m, z in zip(cross, cross[1:], cross[2:], strict=False):
        lo, hi = x[a:m].min(), x[m:z].max()
        if lo < 0 < hi and hi - lo >= least:
            n, p = a + x[a:m].argmin(), m + x[m:z].argmax()
            out.append((a / sf, z / sf, m / sf, hi - lo, sf / (z - a), (hi - lo) / ((p - n) / sf), abs(lo) / max((n - a) / sf, np.finfo(float).eps), abs(lo) / max((m - n) / sf, np.finfo(float).eps)))
    return out


def test_slow_waves(spark):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(size=(3, 4, 600)), axis=-1)
    x = x - x.mean(axis=-1, keepdims=True)
    df = rows(spark, x)
    got = sorted((r["Epoch"], r["ChanIdx"], r["Start"], r["End"], r["MidCrossing"], r["PTP"], r["Frequency"], r["Slope"], r["DescendingSlope"], r["AscendingSlope"]) for r in waves.zero_crossing_waves(df, 1.0).collect())
    want = sorted((e, c, *w) for e in range(3) for c in range(4) for w in brute_waves(x[e, c], 250.0, 1.0))
    assert len(got) == len(want) > 0 and np.allclose(got, want)
    flat = rows(spark, np.zeros((3, 4, 100)))
    none = waves.zero_crossing_waves(flat)
    grid = flat.select(F.col("epoch").alias("Epoch"), F.col("channel").alias("Channel"))
    out = waves.features(none, grid).collect()
    assert len(out) == 12 and all(r["Density"] == 0 and np.isnan(r["PTP"]) for r in out)


def test_cascade_rules(spark):
    w = [(f"E{1 + i % 2}", 0, i % 2, 0.0, 1.0, 0.5, 1.0, -10.0, float(v), 10.0 + i, f, 1.0, 5.0, 5.0) for i, (v, f) in enumerate([(20, 1), (20, 8), (80, 1), (30, 2), (10, 1), (15, 1), (70, 3), (60, 1)])]
    df = spark.createDataFrame([tuple(float(x) if i == 10 else x for i, x in enumerate(r)) for r in w], waves.WAVE_SCHEMA)
    fixed = waves.cascade(df, mode="fixed")
    assert fixed.count() == 6
    kept = {(r["Channel"], r["PTP"]) for r in waves.cascade(df, ptp_percentile=50).collect()}
    by = {}
    for r in fixed.collect():
        by.setdefault(r["Channel"], []).append(r["PTP"])
    assert kept == {(c, p) for c, v in by.items() for p in v if p > np.percentile(v, 50)}
    given = spark.createDataFrame([("E1", 11.0)], "channel string, ptp_threshold double")
    assert {r["Channel"] for r in waves.cascade(df, thresholds=given).collect()} == {"E1"}
    table = spark.createDataFrame([("sub-03", "E1", 45.0), ("7", "E2", 40.0)], "subject string, channel string, ptp_threshold double")
    assert waves.subject_thresholds(table, "3").count() == 1
    with pytest.raises(ValueError):
        waves.subject_thresholds(table, "99")
    assert waves.subject_thresholds(table, "99", strict=False).count() == 0


def test_cascade_ignores_rounding(spark):
    # Differences of samples less a mean of 0.1, all 0.3 or 1 but for their last digit.
    made = lambda hi, lo: ("E1", hi - 0.1, (hi - 0.1) - (lo - 0.1), 1.0)
    df = spark.createDataFrame([made(0.3, 0.0), made(0.4, 0.1), made(0.7, 0.4), made(0.35, 0.05), made(0.2, -0.1), made(1.0, 0.0), made(1.1, 0.1), made(0.25, 0.2)], "Channel string, ValPosPeak double, PTP double, Frequency double")
    assert len({r["PTP"] for r in df.collect() if 0.2 < r["PTP"] < 0.4}) > 1
    assert sorted(round(r["PTP"], 9) for r in waves.cascade(df, ptp_percentile=50).collect()) == [1.0, 1.0]
    given = spark.createDataFrame([("E1", 0.3)], "channel string, ptp_threshold double")
    assert sorted(round(r["PTP"], 9) for r in waves.cascade(df, thresholds=given).collect()) == [1.0, 1.0]
    assert sorted(round(r["PTP"], 9) for r in waves.cascade(df, max_ptp=0.3, mode="fixed").collect()) == [0.05]


@pytest.mark.parametrize("seconds", [0.0, 0.02, 0.1])
def test_far_from_artifacts(spark, seconds):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((2, 3, 900)) < 0.02, 9.0, 0.0)
    x[0, 0] = 0
    df = rows(spark, x)
    n = max(1, round(seconds * 250))
    places = [(e, c, m) for e in range(2) for c in range(3) for m in range(900)]
    names = {(r["epoch"], r["ch_idx"]): r["channel"] for r in df.collect()}
    found = spark.createDataFrame([(names[e, c], e, c, m / 250) for e, c, m in places], "Channel string, Epoch int, ChanIdx int, MidCrossing double").withColumns({"Start": F.lit(0.0), "End": F.lit(0.0)})
    out = waves.far_from_artifacts(found, df, 5.0, seconds)
    assert out.columns == ["Epoch", "Channel", "ChanIdx", "MidCrossing", "Start", "End"]
    got = sorted((r["Epoch"], r["ChanIdx"], round(r["MidCrossing"] * 250)) for r in out.collect())
    assert got == [(e, c, m) for e, c, m in places if not (x[e, c, max(0, m - n) : m + n + 1] > 5).any()]
    # An array of all samples beyond the amplitude must not meet each wave.
    assert "exists(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_spindles_are_found_where_they_are():
    rng = np.random.default_rng(1)
    t = np.arange(250 * 20) / 250
    x = 10 * np.cumsum(rng.normal(size=len(t)))
    x = (x - np.convolve(x, np.ones(250) / 250, "same")) / 10
    burst = (t > 8) & (t < 9.2)
    x[burst] += 40 * np.sin(2 * np.pi * 13.5 * t[burst]) * np.hanning(burst.sum())
    found = spindles.detect(x, 250.0)
    assert any(s["Start"] < 8.8 < s["End"] and 12 < s["Frequency"] < 15 for s in found)
    assert spindles.detect(np.zeros(1000), 250.0) == []


# ---- rejection, references, splines --------------------------------------------------------------


def test_rejection(spark, data):
    x = data.copy()
    x[:7, 2] *= 40
    x[4, 3:7] *= 40
    df = rows(spark, x)
    assert [r["channel"] for r in reject.bad_channels_by_range(df, {"eeg": 30.0}, 0.5).collect()] == ["E3"]
    assert [r["epoch"] for r in reject.bad_epochs_by_range(df, {"eeg": 30.0}, 0.5).collect()] == [4]
    bad = {r["channel"] for r in reject.bad_channels_by_variance(df, 2.0, 2).where("is_bad").collect()}
    v = x.transpose(1, 0, 2).reshape(8, -1).var(axis=1)
    mask = np.zeros(8, bool)
    for _ in range(2):
        z = np.abs(v - v[~mask].mean()) / v[~mask].std()
        mask |= z > 2.0
    assert bad == {f"E{i + 1}" for i in np.flatnonzero(mask)}
    left, report = reject.reject_epochs(df, {"eeg": 30.0}, 0.5)
    assert left.count() == 72 and report.collect()[0]["bad_epochs"] == [4]
    with pytest.raises(ValueError, match="are left"):
        reject.reject_epochs(df, {"eeg": 0.1}, 0.1)
    with pytest.raises(ValueError):
        reject.bad_epochs_by_range(df, {})


def test_references(spark, data):
    s = signals.explode_samples(rows(spark, data[:2]))
    out = {(r["epoch"], r["channel"], r["t_idx"]): r["value"] for r in reference.reference(s, ["E1", "E2"]).collect()}
    assert np.isclose(out[1, "E5", 17], data[1, 4, 17] - data[1, :2, 17].mean())
    with pytest.raises(ValueError):
        reference.reference(s, ["nope"])
    same = reference.reference_if_any(s, ["nope"])
    assert same.exceptAll(s).count() == 0


def test_splines_reproduce_smooth_fields():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(60, 3))
    p[:, 2] = np.abs(p[:, 2])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    field = p @ [1.0, -0.5, 0.3] + 0.2
    w = interpolate.spline_weights(p[5:], p[:5])
    assert np.allclose(w.sum(axis=1), 1, atol=1e-6) and np.allclose(w @ field[5:], field[:5], atol=0.02)
    m = interpolate.csd_matrix(p)
    assert np.allclose(m @ np.ones(60), 0, atol=1e-6) and np.isfinite(m).all()


def test_per_channel_filter_crosses_epochs(spark, data):
    got = filters.over_epochs(rows(spark, data), 4, (25.0,), "high")
    want = dsp.zero_phase(dsp.butter(4, (25.0,), "high", 250.0), data.transpose(1, 0, 2).reshape(8, -1), 15).reshape(8, 10, 200)
    for r in got.where("ch_idx = 3").collect():
        assert np.allclose(r["data"], want[3, r["epoch"]])
    out = filters.clean(rows(spark, data), 1.0, 40.0, (50.0, 200.0), 125.0).where("ch_idx = 0 and epoch = 0").collect()[0]
    assert len(out["data"]) == 100 and out["sfreq"] == 125.0


# ---- decoding ------------------------------------------------------------------------------------


def test_decoding(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6, 20))
    x[20:, 2, 8:14] += 2.5
    df = rows(spark, x).withColumn("condition", F.when(F.col("epoch") < 20, "a").otherwise("b"))
    assert decoding.window_decoding(df, ["a"], ["b"], n_splits=5).collect()[0]["value"] > 0.9
    t = {r["t_idx"]: r["value"] for r in decoding.time_decoding(df, ["a"], ["b"]).collect()}
    assert len(t) == 20 and t[10] > 0.9 and t[2] < 0.8
    assert decoding.window_decoding(df, ["a"], ["nope"]).collect()[0]["value"] == 0.5
    chance = decoding.time_decoding(df, ["a"], ["nope"]).collect()
    assert len(chance) == 100 and {r["value"] for r in chance} == {0.5}
    assert decoding.window_decoding(df, ["a"], ["b"], scoring="accuracy", n_splits=5).collect()[0]["value"] > 0.5
    fold = decoding.stratified_folds(np.repeat([0, 1], [13, 17]), 5, 1)
    assert all(abs((fold[:13] == k).sum() - 13 / 5) < 1 and abs((fold[13:] == k).sum() - 17 / 5) < 1 for k in range(5))


# ---- aggregation, selection, names ---------------------------------------------------------------


def test_methods(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=37)
    df = spark.createDataFrame([(0, float(x)) for x in v], "g int, value double")
    cut = lambda p: np.sort(v)[int(p * 37) : 37 - int(p * 37)].mean()
    want = {"mean": v.mean(), "std": v.std(), "median": np.median(v), "min": v.min(), "max": v.max(), "sum": v.sum(), "trim_mean80": cut(0.1), "trim_mean90": cut(0.05)}
    got = df.groupBy("g").agg(*(agg.method(m, "value").alias(m) for m in agg.METHODS)).collect()[0]
    assert all(np.isclose(got[m], want[m]) for m in want) and set(want) == set(agg.METHODS)
    with pytest.raises(ValueError):
        agg.method("mode", "value")
    one = spark.createDataFrame([(0, 1.0), (0, 2.0)], "g int, value double").groupBy("g").agg(agg.method("trim_mean80", "value").alias("v")).collect()
    assert one[0]["v"] == 1.5
    nan = spark.createDataFrame([(0, 1.0), (0, float("nan"))], "g int, value double").groupBy("g").agg(agg.method("mean", "value").alias("v")).collect()
    assert np.isnan(nan[0]["v"])


def test_rois_and_equipment(spark):
    assert len(equipment.equipments()) == 14
    assert equipment.rois("egi256")["scalp"] == tuple(range(224)) and len(equipment.rois("egi/128")["nonscalp"]) == 3
    assert all(set(equipment.REQUIRED) <= set(equipment.rois(e)) for e in equipment.equipments())
    names_ = [f"E{i}" for i in range(1, 9)]
    assert select.resolve_rois(["Fz", 0, "E3"], names_, "egi/64") == [2, 5, 7, 0]
    assert select.resolve_rois([], names_) == [] and select.resolve_rois(["Cz"], list(equipment.channel_names("brainvision/32")), "brainvision/32")[0] == 7
    for bad, error in ((["nope"], ValueError), ([99], ValueError), ([1.5], TypeError)):
        with pytest.raises(error):
            select.resolve_rois(bad, names_, "egi/64")
    with pytest.raises(ValueError):
        equipment.define("x", {"Fz": []}, [])
    ch = spark.createDataFrame([(0, f"E{i}") for i in range(1, 60)] + [(1, "Fz")] + [(2, f"B{i}") for i in range(10, 20)], "element int, channel string")
    assert {r["element"]: r["equipment"] for r in equipment.detect(ch).collect()} == {0: "egi/64", 1: "brainvision/32", 2: "biosemi/128"}
    with pytest.raises(Exception, match="equipment"):
        equipment.detect(ch.where("element = 1").withColumn("channel", F.lit("Q"))).collect()
    assert equipment.roi_table(spark).where("equipment = 'egi/256' and roi = 'cnv'").count() == 7


def test_names(spark):
    df = spark.createDataFrame([("sub-007", "ses-1", None, "", "2"), ("AB", None, "task-lg", None, None)], "s string, e string, t string, a string, r string")
    got = [r["p"] for r in df.select(names.bids_path(*(F.col(c) for c in "seta"), F.col("r"), "markers", "eeg", ".h5").alias("p")).collect()]
    assert got == ["sub-007/ses-1/eeg/sub-007_ses-1_run-2_desc-markers_eeg.h5", "sub-AB/eeg/sub-AB_task-lg_desc-markers_eeg.h5"]
    assert [r[0] for r in df.select(names.normalise_subject(F.col("s"))).collect()] == ["7", "AB"]
    assert names.stage_name("/x/01_filtered_eeg.fif") == "filtered"
    assert spark.createDataFrame([("sub-1_ses-A_task-q.fif",)], "f string").select(names.entity_from_name(F.col("f"), "ses")).collect()[0][0] == "A"


def test_epochs_by_window_and_event(spark):
    samples = spark.createDataFrame([("a", c, i, float(i)) for c in ("x", "y") for i in range(23)], "element string, channel string, sample long, value double")
    by = {r["epoch"]: r["n"] for r in signals.fixed_epochs(samples, 10, 5).where("channel = 'x'").groupBy("epoch").agg(F.count("*").alias("n")).collect()}
    assert by == {0: 10, 1: 10, 2: 10}
    events = spark.createDataFrame([("a", 1, 1), ("a", 9, 1), ("a", 21, 2)], "element string, sample long, code int")
    got = {(r["epoch"], r["channel"]): r["v"] for r in signals.event_epochs(samples, events, 2, 3).groupBy("epoch", "channel").agg(F.avg("value").alias("v")).collect()}
    assert got == {(1, "x"): 9.5, (1, "y"): 9.5}
    stim = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 0, 3, 3, 0, 5, 2, 2])], "element string, sample long, value double")
    assert sorted((r["sample"], r["prev"], r["code"]) for r in signals.triggers(stim).collect()) == [(2, 0, 3), (5, 0, 5), (6, 5, 2)]


# ---- sources and store ---------------------------------------------------------------------------


def test_edf_round_trip_and_patterns(spark, tmp_path, data):
    x = data[0, :3].copy()
    x = np.tile(x, (1, 5))[:, :1000] * 20
    for sub in ("sub-01", "sub-02"):
        (tmp_path / sub / "ses-A").mkdir(parents=True)
        (tmp_path / sub / "ses-A" / f"{sub}_eeg.edf").write_bytes(recordings.encode_edf(["E1", "E2", "E3"], 250, x))
    df = recordings.grab(spark, str(tmp_path), "{subject}/ses-{session}/{subject}_eeg.edf", ["subject", "session"])
    out = df.collect()
    assert {(r["subject"], r["session"], r["channel"], r["sfreq"]) for r in out} == {(s, "A", c, 250.0) for s in ("01", "02") for c in ("E1", "E2", "E3")}
    assert np.allclose(next(r["data"] for r in out if r["channel"] == "E2"), x[1] * 1e-6, atol=1e-8)
    with pytest.raises(ValueError):
        recordings.grab(spark, str(tmp_path), "{subject}/x.edf", ["session"])
    with pytest.raises(ValueError):
        recordings.format_of("x.unknown")
    assert recordings.format_of("a/b_raw.fif.gz") == "FIF" and len(recordings.EXTENSIONS) == 16


def test_brainvision(spark, tmp_path):
    v = np.arange(24).reshape(2, 12).astype("<i2")
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "rec.vhdr").write_text("Brain Vision Data Exchange Header File\n[Common Infos]\nDataFile=rec.eeg\nNumberOfChannels=2\nSamplingInterval=4000\nDataOrientation=MULTIPLEXED\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fz,,0.5,µV\nCh2=Cz,,0.5,µV\n")
    (tmp_path / "s1" / "rec.eeg").write_bytes(np.ascontiguousarray(v.T).tobytes())
    out = {r["channel"]: r for r in recordings.grab(spark, str(tmp_path), "{subject}/rec.vhdr").collect()}
    assert out["Cz"]["sfreq"] == 250.0 and np.allclose(out["Cz"]["data"], v[1] * 0.5e-6)


def test_store_round_trip(spark, tmp_path, data):
    uri = str(tmp_path / "store")
    top = timelocked.topography(rows(spark, data)).select("element", "epoch", "ch_idx", "channel", "value")
    store.write(store.as_features(top, "timelockedtopo", "TimeLockedTopography"), uri)
    other = store.as_features(top.withColumn("element", F.lit("b")), "timelockedtopo", "TimeLockedTopography")
    store.write(other, uri)
    assert store.list_features(spark, uri) == ["timelockedtopo"]
    back = store.read(spark, uri, "timelockedtopo")
    assert back.count() == 160
    got, axes = store.to_tensor(back.where("subject = 'a'"))
    assert axes == ("epoch", "channel_i") and np.allclose(got, data.mean(axis=-1), atol=1e-6)
    paths = store.export_pickles(spark, uri, str(tmp_path / "pkl"))
    assert len(paths) == 1


def test_compiled_slow_wave_options(spark, tmp_path):
    """Thresholds of a table, artifacts nearby and reference channels reach the operators."""
    from wavequill.plans import config

    t = np.arange(2000) / 100
    wave = [float(x) for x in 30e-6 * np.sin(2 * np.pi * t)]
    rows = [("sub-03", 0, None, i, c, 100.0, 0.0, wave) for i, c in enumerate("AB")]
    df = spark.createDataFrame(rows, "element string, epoch int, condition string, ch_idx int, channel string, sfreq double, tmin double, data array<double>")
    path = str(tmp_path / "limits.csv")
    (tmp_path / "limits.csv").write_text("subject,channel,ptp_threshold\n3,A,1.0\n04,B,1.0\n")
    spec = {"kind": "SlowWavesDetection", "feature": "Density", "detection_method": "custom", "ptp_threshold_mode": "fixed"}

    def density(frame=df, **more):
        kernel = config.MARKERS["SlowWavesDetection"][1]
        return {r["channel"]: r["value"] for r in kernel(frame, {**spec, **more}).collect()}

    every = density()
    assert every["A"] == every["B"] > 10
    assert density(ptp_threshold_mode="adaptive", ptp_thresholds_path=path) == {"A": every["A"], "B": 0}
    assert density(proximity_amplitude=5.0) == {"A": 0, "B": 0} and density(proximity_amplitude=500.0) == every
    assert density(reference_channels=["A"]) == {"A": 0, "B": 0} and density(reference_channels=["A", "Z"]) == every
    other = df.withColumn("element", F.lit("05"))
    with pytest.raises(ValueError, match="no thresholds"):
        density(other, ptp_threshold_mode="adaptive", ptp_thresholds_path=path)
    assert density(other, ptp_threshold_mode="adaptive", ptp_thresholds_path=path, ptp_thresholds_strict=False) == {"A": 0, "B": 0}


def test_compiled_csd_needs_positions(spark):
    from wavequill.plans import config, workload

    rng = np.random.default_rng(3)
    places = workload._ring()
    rows = [(0, 0, None, i, c, 64.0, 0.0, [float(x) for x in rng.normal(size=64)]) for i, c in enumerate(places)]
    df = spark.createDataFrame(rows, "element int, epoch int, condition string, ch_idx int, channel string, sfreq double, tmin double, data array<double>")
    kernel = config.MARKERS["SymbolicMutualInformation"][1]
    spec = {"kind": "SymbolicMutualInformation", "taus": [1]}
    values = lambda **more: sorted((r["channel_i"], r["channel_j"], r["value"]) for r in kernel(df, {**spec, **more}).collect())
    with pytest.raises(ValueError, match="positions"):
        values(csd=True)
    with pytest.warns(UserWarning, match="no CSD"):
        plain = values()
    assert values(positions=places) == values(positions=places, csd=True) != plain == values(positions=places, csd=False)
