"""Decoders against files written here by the formats' descriptions, annotations, epochs by events, shared tables and the element store."""

import gzip
import pickle
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequill.functions import dsp, names
from wavequill.operators import decoding, reject, signals
from wavequill.plans import config
from wavequill.sources import formats, recordings, shared, store, tables

RATE, N, T = 100, 3, 500
X = np.random.default_rng(0).normal(size=(N, T)) * 1e-5
NAMES = ["E1", "E2", "STI"]


# ---- writers -------------------------------------------------------------------------------------


def tag(kind, form, body, following=0):
    return struct.pack(">iiii", kind, form, len(body), following) + body


def fif_bytes(data, gain=2.0, epochs=None, events=None, names=None, first=0):
    i4 = lambda *v: struct.pack(f">{len(v)}i", *v)
    out = [tag(100, 3, i4(1)), tag(104, 3, i4(101)), tag(200, 3, i4(N)), tag(201, 4, struct.pack(">f", RATE))]
    for k, name in enumerate(NAMES):
        out.append(tag(203, 30, struct.pack(">iiiffi12fii16s", k + 1, k + 1, 2, 1.0, gain, 1, *[0.0] * 12, 107, 0, name.encode())))
    out.append(tag(105, 3, i4(101)))
    if events is not None:
        out += [tag(104, 3, i4(115)), tag(3563, 3, np.asarray(events, ">i4").tobytes()), tag(206, 10, ";".join(f"{n}:{c}" for n, c in names.items()).encode()), tag(105, 3, i4(115))]
    if epochs is not None:
        body = (epochs / gain).astype(">f8").tobytes() + i4(*epochs.shape[::-1], 3)
        out += [tag(208, 3, i4(first)), tag(302, 5 | 0x40000000, body)]
    else:
        out += [tag(104, 3, i4(3813)), tag(304, 4, struct.pack(">2f", 0.5, 1.0)), tag(206, 10, b"tone:beep{COLON}2"), tag(105, 3, i4(3813))]
        for a in range(0, T, 100):
            if a == 200:
                out.append(tag(301, 3, i4(1)))
            else:
                out.append(tag(300, 4, (data[:, a : a + 100].T / gain).astype(">f4").tobytes()))
    return b"".join(out) + tag(108, 3, b"", -1)


def mff_files(data):
    first, second = data[:, :300], data[:, 300:]
    blocks = []
    for k, part in enumerate((first, second)):
        n = part.shape[1]
        head = struct.pack("<iiii", 1, 16 + 8 * N + 4, 4 * n * N, N) + struct.pack(f"<{N}i", *[4 * n * i for i in range(N)]) + struct.pack(f"<{N}I", *[RATE << 8 | 32] * N) + struct.pack("<i", 0)
        blocks.append(head + (part * 1e6).astype("<f4").tobytes())
    more = struct.pack("<i", 0) + (second * 1e6).astype("<f4")[:, :200].tobytes()
    sensors = "".join(f"<sensor><name>{n}</name><number>{k + 1}</number><type>{t}</type></sensor>" for k, (n, t) in enumerate([("", 0), ("", 0), ("VREF", 1)]))
    return {
        "signal1.bin": b"".join(blocks) + more,
        "sensorLayout.xml": f'<?xml version="1.0"?><sensorLayout xmlns="http://www.egi.com/x"><sensors>{sensors}</sensors></sensorLayout>'.encode(),
        "info.xml": b'<?xml version="1.0"?><fileInfo xmlns="http://www.egi.com/info"><recordTime>2020-01-01T10:00:00.000000000+01:00</recordTime></fileInfo>',
        "Events_DIN.xml": b'<eventTrack xmlns="http://www.egi.com/ev"><event><beginTime>2020-01-01T10:00:01.250000000+01:00</beginTime><code>DIN1</code></event></eventTrack>',
    }


def mat_element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def mat_matrix(value, name=""):
    def head(cls, shape):
        return mat_element(6, struct.pack("<II", cls, 0)) + mat_element(5, np.asarray(shape, "<i4").tobytes()) + mat_element(1, name.encode())

    if isinstance(value, str):
        body = head(4, (1, len(value))) + mat_element(16, value.encode())
    elif isinstance(value, dict) or isinstance(value, list) and value and isinstance(value[0], dict):
        rows = [value] if isinstance(value, dict) else value
        fields = list(rows[0])
        body = head(2, (1, len(rows))) + mat_element(5, struct.pack("<i", 32)) + mat_element(1, b"".join(f.encode().ljust(32, b"\0") for f in fields)) + b"".join(mat_matrix(r[f]) for r in rows for f in fields)
    elif isinstance(value, list):
        body = head(1, (1, len(value))) + b"".join(mat_matrix(v) for v in value)
    else:
        x = np.atleast_2d(np.asarray(value, float))
        body = head(6, x.shape) + mat_element(9, x.tobytes(order="F"))
    return mat_element(14, body)


def mat_bytes(packed=True, **variables):
    out = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack("<HH", 0x0100, 0x4D49)
    for name, v in variables.items():
        e = mat_matrix(v, name)
        if packed:
            z = zlib.compress(e)
            e = struct.pack("<II", 15, len(z)) + z
        out += e
    return out


def cnt_bytes(raw):
    head = bytearray(900 + 75 * N)
    struct.pack_into("<H", head, 370, N)
    struct.pack_into("<H", head, 376, RATE)
    struct.pack_into("<i", head, 864, raw.shape[1])
    struct.pack_into("<i", head, 886, len(head) + raw.size * 4)
    for k, name in enumerate(NAMES):
        at = 900 + 75 * k
        head[at : at + len(name)] = name.encode()
        struct.pack_into("<h", head, at + 47, 5)
        struct.pack_into("<f", head, at + 59, 2.0)
        struct.pack_into("<f", head, at + 71, 1.0)
    return bytes(head) + raw.T.astype("<i4").tobytes() + b"events"


def gdf_bytes(raw):
    head = bytearray(256 * (N + 1))
    head[:8] = b"GDF 2.20"
    struct.pack_into("<H", head, 184, N + 1)
    struct.pack_into("<qIIH", head, 236, 5, 1, 1, N)
    struct.pack_into("<q", head, 236, 5)
    struct.pack_into("<II", head, 244, 1, 1)
    struct.pack_into("<H", head, 252, N)
    for k, name in enumerate(NAMES):
        head[256 + 16 * k : 256 + 16 * k + len(name)] = name.encode()
        for at, form, v in ((102, "H", 4275), (104, "d", -100.0), (112, "d", 100.0), (120, "d", -1000.0), (128, "d", 1000.0), (216, "I", RATE), (220, "I", 3)):
            struct.pack_into("<" + form, head, 256 + at * N + struct.calcsize(form) * k, v)
    body = b"".join(raw[k, r * RATE : (r + 1) * RATE].astype("<i2").tobytes() for r in range(5) for k in range(N))
    table = bytes([1]) + (2).to_bytes(3, "little") + struct.pack("<f", RATE) + struct.pack("<2I", 101, 301) + struct.pack("<2H", 7, 9)
    return bytes(head) + body + table


# ---- decoders ------------------------------------------------------------------------------------


@pytest.mark.parametrize("packed", [False, True])
def test_fif(packed):
    data = fif_bytes(X)
    r = formats.fif({"": gzip.compress(data) if packed else data})
    want = X.copy()
    want[:, 200:300] = 0  # a skipped buffer
    assert r.labels == NAMES and r.rates == [RATE] * N and not r.is_epochs
    assert np.allclose(r.data, want, rtol=1e-6, atol=1e-12) and r.events == [(0.5, None, "tone"), (1.0, None, "beep:2")]
    epochs = X[:, :300].reshape(N, 3, 100).transpose(1, 0, 2)
    r = formats.fif({"": fif_bytes(X, epochs=epochs, events=[[0, 0, 1], [100, 0, 2], [200, 0, 1]], names={"std": 1, "dev/loud": 2}, first=-20)})
    assert r.is_epochs and np.allclose(r.data, epochs) and r.conditions == ["std", "dev/loud", "std"] and r.tmin == -0.2


def test_mff():
    r = formats.mff(mff_files(X))
    assert r.labels == ["E1", "E2", "VREF"] and r.rates == [RATE] * N and r.events == [(1.25, None, "DIN1")]
    assert np.allclose(np.array(r.data), np.hstack([X, X[:, 300:]]), rtol=1e-6)


def test_eeglab_and_fieldtrip():
    places = [{"labels": n} for n in NAMES]
    events = [{"type": "square", "latency": 101.0}, {"type": 7.0, "latency": 11.0}]
    common = {"nbchan": N, "srate": RATE, "xmin": -0.5, "chanlocs": places}
    held = {**common, "data": X * 1e6, "pnts": T, "trials": 1, "event": events}
    for packed in (True, False):
        r = formats.eeglab({".set": mat_bytes(packed, EEG=held)})
        assert r.labels == NAMES and np.allclose(r.data, X) and r.events == [(1.0, None, "square"), (0.1, 7, "7")]
    apart = {**common, "data": "x.fdt", "pnts": 100, "trials": 5, "event": [{"type": "a", "latency": 1.0, "epoch": 1.0}, {"type": "b", "latency": 210.0, "epoch": 3.0}]}
    r = formats.eeglab({".set": mat_bytes(**apart), ".fdt": (X * 1e6).astype("<f4").tobytes(order="F")})
    assert r.is_epochs and np.allclose(r.data, X.reshape(N, 5, 100).transpose(1, 0, 2), rtol=1e-6) and r.conditions == ["a", None, "b", None, None] and r.tmin == -0.5
    trials = [X[:, :200], X[:, 200:400]]
    time = [np.arange(200) / RATE - 0.1] * 2
    r = formats.fieldtrip({"": mat_bytes(data={"label": NAMES, "trial": trials, "time": time, "trialinfo": np.array([[3.0], [4.0]])})})
    assert r.labels == NAMES and np.allclose(r.data, np.stack(trials)) and r.tmin == -0.1 and np.isclose(r.rates[0], RATE) and r.conditions == ["3", "4"]
    for wrong in ({"x": np.zeros((2, 2))}, {"data": {"label": NAMES, "trial": [X, X[:, 1:]], "time": time}}):
        with pytest.raises(ValueError):
            formats.fieldtrip({"": mat_bytes(**wrong)})


def test_other_formats():
    raw = np.round(X * 1e7).astype(int)
    assert np.allclose(formats.cnt({"": cnt_bytes(raw)}).data, (raw - 5) * 2.0 / 204.8e6)
    r = formats.gdf({"": gdf_bytes(raw)})
    assert r.labels == NAMES and np.allclose(r.data, raw * 0.1 * 1e-6) and r.events == [(1.0, 7, None), (3.0, 9, None)]
    r = formats.nicolet({".data": raw.T.astype("<i2").tobytes(), ".head": b"num_samples=500\nsample_freq=100\nnum_channels=3\nelec_names=[E1,E2,STI]\nconversion_factor=0.25\n"})
    assert r.labels == NAMES and np.allclose(r.data, raw * 0.25e-6)
    head = b"NumSamples = 500\nNumChannels = 3\nSampleFreqHz = 100\nDataFormat = BINARY\n"
    r = formats.curry({".dat": (X.T * 1e6).astype("<f4").tobytes(), ".dap": head, ".rs3": b"LABELS START_LIST\t # x\nE1\nE2\nSTI\nLABELS END_LIST\n"})
    assert r.labels == NAMES and np.allclose(r.data, X, rtol=1e-6)
    with pytest.raises(ValueError, match="no decoder"):
        recordings.decode("KIT", {"": b""})


# ---- grabber, annotations, epochs ----------------------------------------------------------------


def test_grabbed_epochs_and_annotations(spark, tmp_path):
    epochs = X[:, :300].reshape(N, 3, 100).transpose(1, 0, 2)
    for s in ("sub-01", "sub-02"):
        (tmp_path / s / "eeg").mkdir(parents=True)
        (tmp_path / s / "eeg" / "x_epo.fif").write_bytes(fif_bytes(X, epochs=epochs, events=[[0, 0, 1], [1, 0, 2], [2, 0, 1]], names={"a": 1, "b": 2}))
        (tmp_path / s / "eeg" / "run.fif").write_bytes(fif_bytes(X))
        (tmp_path / s / "eeg" / "r.mff").mkdir()
        for name, data in {**mff_files(X), "other.bin": b"x"}.items():
            (tmp_path / s / "eeg" / "r.mff" / name).write_bytes(data)
        header = "[Common Infos]\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nSamplingInterval=10000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\n" + "".join(f"Ch{k + 1}={n},,0.1,µV\n" for k, n in enumerate(NAMES[:2]))
        (tmp_path / s / "eeg" / "b.vhdr").write_text(header)
        (tmp_path / s / "eeg" / "b.eeg").write_bytes(np.round(X[:2].T * 1e7).astype("<i2").tobytes())
        (tmp_path / s / "eeg" / "b.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\n" + "".join(f"Mk{k}=Stimulus,S  {1 + k % 2},{100 * k + 1},1,0\n" for k in range(1, 5)))
    got = recordings.grab(spark, str(tmp_path), "{subject}/eeg/*_epo.fif")
    assert got.count() == 2 * 3 * N and {r["condition"] for r in got.collect()} == {"a", "b"}
    assert np.allclose([r["data"] for r in got.where("subject = '01' and epoch = 1").orderBy("ch_idx").collect()], epochs[1])
    folder = recordings.grab(spark, str(tmp_path), "{subject}/eeg/*.mff")
    assert folder.count() == 2 * N and folder.where("channel = 'VREF'").count() == 2
    notes = recordings.annotations(spark, str(tmp_path), "{subject}/eeg/run.fif")
    assert sorted((r["subject"], r["sample"], r["code"], r["name"]) for r in notes.collect()) == [(s, n, c, t) for s in ("01", "02") for n, c, t in ((50, 2, "tone"), (100, 1, "beep:2"))]
    # Through a configuration: events of the markers, by name; the last reaches beyond the end.
    out = config.compile_pipeline(spark, {
        "datagrabber": {"kind": "EEGDataGrabber", "datadir": str(tmp_path), "patterns": {"EEG": {"pattern": "{subject}/eeg/*.vhdr"}}},
        "preprocess": [{"kind": "EEGEpoching", "tmin": -0.1, "tmax": 1.2, "event_id": {"Stimulus/S  1": 1, "Stimulus/S  2": 2}, "baseline": None}],
        "markers": [{"kind": "TimeLockedTopography", "tmin": -0.1, "tmax": 1.2}, {"kind": "TimeLockedContrast", "condition_a": "Stimulus/S  1", "condition_b": "Stimulus/S  2"}],
    })
    top = {(r["subject"], r["epoch"], r["channel_i"]): r["value"] for r in out.where("feature = 'timelockedtopo'").collect()}
    assert sorted({k[1] for k in top}) == [0, 1, 2]
    assert np.isclose(top["02", 1, "E2"], np.round(X[1, 190:321] * 1e7).mean() * 1e-7)
    with pytest.raises(Exception, match="no matching events"):
        config.compile_pipeline(spark, {"datagrabber": {"kind": "EEGDataGrabber", "datadir": str(tmp_path), "pattern": "{subject}/eeg/*.vhdr"}, "preprocess": [{"kind": "EEGEpoching", "event_id": {"none": 99}}], "markers": [{"kind": "TimeLockedTopography"}]}).collect()


def test_stimulus_epochs_of_the_events_table(spark, small):
    """Every event in the table whose view is over 80 starts an epoch, as by plain loops."""
    recording = tables.event_recording(spark, small)
    held = {(r["element"], r["channel"]): np.array(r["data"]) for r in recording.collect()}
    events = signals.stimulus_events(recording).withColumn("name", F.lit("loud"))
    got = {(r["element"], r["epoch"], r["channel"]): r["data"] for r in signals.cut_events(recording.where("channel <> 'STI'"), events, -0.2, 0.3).collect()}
    n = 0
    for (element, channel), x in held.items():
        stim = held[element, "STI"]
        at = [i for i in range(len(stim)) if stim[i] and (i == 0 or stim[i] != stim[i - 1])]
        for k, i in enumerate(at):
            if channel != "STI" and i >= 2 and i + 4 <= len(x):
                assert np.allclose(got[element, k, channel], x[i - 2 : i + 4])
                n += 1
    assert n == len(got) > 0
    places = {(r["element"], r["channel"], r["sample"]) for r in tables.event_samples(spark, small).collect()}
    assert len(places) == spark.read.parquet(f"{small}/events.parquet").count()


def test_markers_share_spectra(spark, small, monkeypatch):
    """Five one-band markers, an edge and relative powers over one table of spectra, with the values that each has alone."""
    bands = {"delta": [1.0, 4.0], "theta": [4.0, 8.0], "alpha": [8.0, 12.0]}
    common = {"n_fft": 64, "n_per_seg": 4, "n_overlap": 2}
    markers = [{"kind": "SpectralPowerBands", "name": f"m_{b}", "bands": {b: v}, "dB": False, **common} for b, v in bands.items()]
    markers += [{"kind": "PowerSpectralDensitySummary", "name": "edge", "percentile": 0.9, **common}, {"kind": "PermutationEntropy", "name": "pe", "taus": [1]}, {"kind": "SymbolicMutualInformation", "name": "smi", "taus": [1], "csd": False}]
    kept = []
    keep = shared.keep
    monkeypatch.setattr(shared, "keep", lambda df, name: kept.append(name) or keep(df, name))
    grab = {"kind": "EventRecording", "datadir": small}
    steps = [{"kind": "EEGEpoching", "tmin": -0.5, "tmax": 1.0, "baseline": [None, 0.0], "stim_channel": "STI"}]
    together = config.compile_pipeline(spark, {"datagrabber": grab, "preprocess": steps, "markers": markers})
    assert kept == ["signals", "psd", "low"]
    value = lambda df: {(r["marker"], r["subject"], r["epoch"], r["channel_i"], r["channel_j"], r["band"]): r["value"] for r in df.collect()}
    got = value(together)
    for m in (markers[1], markers[3], markers[5]):
        alone = value(config.compile_pipeline(spark, {"datagrabber": grab, "preprocess": steps, "markers": [m]}))
        mine = {k: v for k, v in got.items() if k[0] == m["name"]}
        assert mine.keys() == alone.keys() and np.allclose([mine[k] for k in alone], list(alone.values()))
    assert kept == ["signals", "psd", "low"]


def test_spectra_name_an_impossible_overlap():
    with pytest.raises(ValueError, match="overlap by 100"):
        dsp.welch(np.zeros((1, 40)), 10.0, 256, 128, 100)


def test_too_few_channels_fail_when_the_query_runs(spark):
    rows = [("a", e, f"E{c}", [0.0, 1.0 if c < 3 else 0.01]) for e in range(4) for c in range(4)] + [("b", 0, f"E{c}", [0.0, 0.01]) for c in range(4)]
    df = spark.createDataFrame(rows, "element string, epoch int, channel string, data array<double>")
    bad = reject.bad_channels_by_range(df, {"eeg": 0.5}, 0.5)
    assert reject.drop_channels(df, bad, min_channels=1).count() == 4 + 4
    with pytest.raises(Exception, match="1 of 4 channels are left, 2 are needed"):
        reject.drop_channels(df, bad, min_channels=0.7).count()


def test_element_store(spark, tmp_path, capsys):
    rows = [(f, f, "TimeLockedTopography", "timeseries", s, None, None, None, None, None, None, e, c, f"E{c + 1}", None, None, None, None, float(e + c)) for f in ("x", "y") for s in ("01", "02") for e in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, store.FEATURE_SCHEMA)
    for _ in range(2):  # a second time over the first
        made = store.write_elements(df, f"{tmp_path}/out", pickles=True).collect()
    path = tmp_path / "out/sub-01/eeg/sub-01_desc-markers.parquet"
    assert {r["rows"] for r in made} == {12} and sorted(p.name for p in path.parent.iterdir()) == ["sub-01_desc-markers.parquet", "sub-01_desc-markers.pkl"]
    files = sorted(p for p in (tmp_path / "out").rglob("*.parquet"))
    assert len(files) == 2 and spark.read.parquet(*map(str, files)).count() == 24
    held = pickle.loads(next((tmp_path / "out").rglob("*.pkl")).read_bytes())
    assert held["x"]["data"].shape == (2, 3) and held["x"]["dim_names"] == ("epoch", "channel_i")
    with pytest.raises(Exception, match="no subject"):
        store.write_elements(df.withColumn("subject", F.lit(None).cast("string")), f"{tmp_path}/none").collect()
    signal = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "element string, data array<double>")
    assert store.dump(signal, f"{tmp_path}/dumps/{{element}}/03_filtered_eeg.fif").count() == 2
    assert store.load(spark, f"{tmp_path}/dumps/filtered").where("element = 'b'").collect()[0]["data"] == [2.0]
    assert config.main(["list"]) == 0 and "EEGEpoching" in capsys.readouterr().out


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_data_types_and_subjects(spark):
    recordings.check_patterns({"EEG": {"pattern": "{subject}/*.fif", "space": "native", "mask": {"pattern": "m", "space": "native"}}})
    for wrong in ({"MEG": {"pattern": "x"}}, {"EEG": {"space": "native"}}, {"EEG": {"pattern": "x", "colour": 1}}, {"EEG": {"pattern": "x", "mask": {"pattern": "m"}}}):
        with pytest.raises(ValueError):
            recordings.check_patterns(wrong)
    df = spark.createDataFrame([("e", None, "s2", "s3"), ("e", "s1", None, None), ("e", None, None, None)], "element string, subject string, subject_id string, sub string")
    assert [r[0] for r in df.select(names.subject_of(df.columns)).collect()] == ["s2", "s1", "e"]
    assert [r[0] for r in df.select("element").select(names.subject_of(["element"])).collect()] == ["e"] * 3


def test_area_under_the_curve_by_pairs():
    rng = np.random.default_rng(6)
    y, score, weight = rng.integers(0, 2, 80), rng.integers(0, 9, 80) / 3, rng.uniform(0.1, 2, 80)
    for w in (None, weight):
        v = np.ones(80) if w is None else w
        pairs = [(v[i] * v[j], (score[i] > score[j]) + 0.5 * (score[i] == score[j])) for i in range(80) for j in range(80) if y[i] == 1 and y[j] == 0]
        assert np.isclose(decoding.auc(y, score, w), sum(a * b for a, b in pairs) / sum(a for a, _ in pairs))


def test_decoding_asks_for_exact_conditions_and_takes_tags(spark):
    """Element a has both conditions by name, and one more epoch by tag; b has only tags, so that it is at chance."""
    rng = np.random.default_rng(0)
    rows = [(e, k, c, 0, "E1", 10.0, 0.0, (rng.normal(size=4) * 0.1 + (3.0 if c.startswith("hi") else 0.0)).tolist()) for e, names_ in (("a", ["hi", "lo", "hi/loud"]), ("b", ["hi/loud", "lo/x"])) for k, c in enumerate(names_ * 6)]
    df = spark.createDataFrame(rows, "element string, epoch int, condition string, ch_idx int, channel string, sfreq double, tmin double, data array<double>")
    out = {r["element"]: r["value"] for r in decoding.window_decoding(df, ["hi"], ["lo"], n_splits=3).collect()}
    assert out == {"a": 1.0, "b": 0.5}
    assert decoding._labelled(df, ["hi"], ["lo"], None, None, ["element"]).count() == 18
