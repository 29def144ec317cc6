"""Decoders of recording files: bytes in, channels and events out. Written from the formats' public descriptions; values are volts."""

from __future__ import annotations

import gzip
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np


@dataclass
class Recording:
    """labels and rates by channel; data: an array for each channel, or, for epochs, one of epochs x channels x times.

    events: onset in seconds, code and name, of which either may be None; conditions: a name for each epoch.
    """

    labels: list[str]
    rates: list[float]
    data: list[np.ndarray] | np.ndarray
    tmin: float = 0.0
    conditions: list[str | None] = field(default_factory=list)
    events: list[tuple[float, int | None, str | None]] = field(default_factory=list)

    @property
    def is_epochs(self) -> bool:
        return isinstance(self.data, np.ndarray) and self.data.ndim == 3


_UNITS = {"v": 1.0, "mv": 1e-3, "uv": 1e-6, "µv": 1e-6, "μv": 1e-6, "nv": 1e-9}


def edf(files: Mapping[str, bytes]) -> Recording:
    """EDF and BDF, whose annotation channels become events."""
    data = files[""]
    wide = data[0] == 0xFF
    text = lambda a, b: data[a:b].decode("latin-1").strip()
    header, records, seconds, n = int(text(184, 192)), int(text(236, 244)), float(text(244, 252)), int(text(252, 256))
    at = 256
    fields = []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        fields.append([text(at + k * width, at + (k + 1) * width) for k in range(n)])
        at += n * width
    labels, counts = fields[0], [int(x) for x in fields[8]]
    low, high, dlow, dhigh = ([float(x) for x in fields[i]] for i in (3, 4, 5, 6))
    size = 3 if wide else 2
    body = np.frombuffer(data, np.uint8, offset=header)
    per = sum(counts)
    if records < 0:
        records = len(body) // (per * size)
    body = body[: records * per * size].reshape(records, per * size)
    out, events, start = {}, [], 0
    for k in range(n):
        raw = body[:, start : start + counts[k] * size]
        start += counts[k] * size
        if "annotation" in labels[k].lower():
            events += [e for record in raw for e in _time_stamped(record.tobytes())]
            continue
        raw = raw.reshape(-1, size)
        if wide:
            v = raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8 | raw[:, 2].astype(np.int8).astype(np.int32) << 16
        else:
            v = np.ascontiguousarray(raw).view("<i2").ravel().astype(np.int32)
        gain = (high[k] - low[k]) / (dhigh[k] - dlow[k])
        out[k] = ((v - dlow[k]) * gain + low[k]) * _UNITS.get(fields[2][k].lower(), 1.0)
    return Recording([labels[k] for k in out], [counts[k] / seconds for k in out], list(out.values()), events=events)


def _time_stamped(record: bytes) -> list[tuple[float, None, str]]:
    """Time-stamped annotation lists: +onset, perhaps a duration, then texts; a record's own time stamp has an empty text."""
    out = []
    for entry in record.split(b"\x14\x00"):
        head, *texts = entry.strip(b"\x00").split(b"\x14")
        if m := re.match(rb"([+-][\d.]+)", head):
            out += [(float(m[1]), None, t.decode("utf-8", "replace")) for t in texts if t]
    return out


def brainvision(files: Mapping[str, bytes]) -> Recording:
    """A .vhdr header with its .eeg samples and .vmrk markers."""
    values: dict[str, str] = {}
    channels: list[tuple[str, float]] = []
    for section, line in _ini(files[".vhdr"].decode("utf-8", "replace")):
        key, _, value = line.partition("=")
        if section == "[Channel Infos]":
            name, _, resolution, unit = (value.split(",") + ["", "", ""])[:4]
            channels.append((name.replace("\\1", ","), float(resolution or 1) * _UNITS.get(unit.strip().lower(), 1e-6)))
        else:
            values[key] = value
    kind = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}[values.get("BinaryFormat", "INT_16")]
    n, data = len(channels), files[".eeg"]
    flat = np.frombuffer(data, kind, len(data) // np.dtype(kind).itemsize // n * n).astype(float)
    table = flat.reshape(-1, n).T if values.get("DataOrientation", "MULTIPLEXED") == "MULTIPLEXED" else flat.reshape(n, -1)
    rate = 1e6 / float(values["SamplingInterval"])
    events = []
    for section, line in _ini(files.get(".vmrk", b"").decode("utf-8", "replace")):
        if section == "[Marker Infos]":
            kind, name, position = line.partition("=")[2].split(",")[:3]
            if kind != "New Segment":
                code = re.search(r"(\d+)$", name)
                events.append(((int(position) - 1) / rate, int(code[1]) if code else None, f"{kind}/{name}"))
    return Recording([c for c, _ in channels], [rate] * n, [row * scale for row, (_, scale) in zip(table, channels, strict=True)], events=events)


def _ini(text: str):
    section = ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("["):
            section = line
        elif "=" in line and not line.startswith(";"):
            yield section, line


# Kinds and types of FIF tags.
_BLOCK, _BLOCK_END, _CHANNELS, _RATE, _CHANNEL, _FIRST, _TEXT, _BUFFER, _SKIP, _EPOCHS, _ONSETS = 104, 105, 200, 201, 203, 208, 206, 300, 301, 302, 304
_EVENTS_BLOCK, _DENSE = 115, 0x40000000
_FIF_TYPES = {2: ">i2", 3: ">i4", 4: ">f4", 5: ">f8", 16: ">i2"}


def fif(files: Mapping[str, bytes]) -> Recording:
    """FIF files, gzipped or not: continuous buffers, or a matrix of epochs with the events block's names."""
    data = files[""]
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    rate, first, skipped = 0.0, 0, 0
    names: list[str] = []
    gains: list[float] = []
    buffers: list[np.ndarray] = []
    epochs = listed = None
    codes: dict[int, str] = {}
    notes: dict[str, object] = {}
    events: list[tuple[float, int | None, str | None]] = []
    blocks: list[int] = []
    at = 0
    while 0 <= at <= len(data) - 16:
        kind, form, size, following = struct.unpack_from(">iiii", data, at)
        body = data[at + 16 : at + 16 + size]
        at = at + 16 + size if following == 0 else following
        number = np.frombuffer(body, _FIF_TYPES[form & 0xFFFF], (size - 16 * bool(form & _DENSE)) // np.dtype(_FIF_TYPES[form & 0xFFFF]).itemsize) if form & 0xFFFF in _FIF_TYPES and kind != _EPOCHS else None
        if kind == _BLOCK:
            blocks.append(int(number[0]))
            notes = {}
        elif kind == _BLOCK_END:
            if blocks:
                blocks.pop()
            if isinstance(notes.get("text"), str) and np.size(notes.get("onset")) == len(notes["text"].split(":")) and np.size(notes["onset"]):
                events += [(float(o), None, t.replace("{COLON}", ":")) for o, t in zip(np.atleast_1d(notes["onset"]), notes["text"].split(":"), strict=True)]
            notes = {}
        elif kind == _RATE:
            rate = float(number[0])
        elif kind == _CHANNEL:
            span, cal = struct.unpack_from(">ff", body, 12)
            names.append(body[80:96].split(b"\0")[0].decode("latin-1"))
            gains.append(span * cal)
        elif kind == _FIRST:
            first = int(number[0])
        elif kind == _SKIP:
            skipped += int(number[0])
        elif kind == _BUFFER:
            rows = number.reshape(-1, len(names)).astype(float)
            buffers += [np.zeros((skipped * len(rows), len(names)))] * bool(skipped) + [rows]
            skipped = 0
        elif kind == _EPOCHS:
            count = struct.unpack_from(">i", body, size - 4)[0]
            shape = struct.unpack_from(f">{count}i", body, size - 4 * (count + 1))[::-1]
            epochs = np.frombuffer(body, _FIF_TYPES[form & 0xFFFF], int(np.prod(shape))).reshape(shape).astype(float)
        elif blocks and blocks[-1] == _EVENTS_BLOCK and form & 0xFFFF == 3:
            listed = number.reshape(-1, 3)
        elif blocks and blocks[-1] == _EVENTS_BLOCK and kind == _TEXT:
            codes = {int(c): n for n, c in (x.rsplit(":", 1) for x in body.decode("latin-1").split(";") if ":" in x)}
        elif kind == _TEXT:
            notes["text"] = body.decode("latin-1")
        elif kind == _ONSETS:
            notes["onset"] = number
        if following < 0:
            break
    gain = np.array(gains)
    if epochs is not None:
        names_of = [codes.get(int(c), str(int(c))) for c in listed[:, 2]] if listed is not None else [None] * len(epochs)
        return Recording(names, [rate] * len(names), epochs * gain[None, :, None], first / rate, names_of)
    table = np.concatenate(buffers).T * gain[:, None] if buffers else np.zeros((len(names), 0))
    return Recording(names, [rate] * len(names), list(table), events=events)


def mff(files: Mapping[str, bytes]) -> Recording:
    """An EGI MFF folder: blocks of signal1.bin, names from the sensor layout, events from Events_*.xml."""
    data, at = files["signal1.bin"], 0
    parts: list[list[np.ndarray]] = []
    rate = 0.0
    while at + 4 <= len(data):
        if struct.unpack_from("<i", data, at)[0] == 0:
            start = at + 4
        else:
            _, length, block, n = struct.unpack_from("<iiii", data, at)
            offsets = struct.unpack_from(f"<{n}i", data, at + 16)
            rate = float(struct.unpack_from("<I", data, at + 16 + 4 * n)[0] >> 8)
            start = at + length
        ends = [*offsets[1:], block]
        parts.append([np.frombuffer(data, "<f4", (b - a) // 4, start + a) for a, b in zip(offsets, ends, strict=True)])
        at = start + block
    table = [np.concatenate(x).astype(float) * 1e-6 for x in zip(*parts, strict=True)]
    labels = [f"E{k + 1}" for k in range(len(table))]
    if "sensorLayout.xml" in files:
        for sensor in _tree(files["sensorLayout.xml"]).iter("sensor"):
            k, name = int(sensor.findtext("number")) - 1, sensor.findtext("name") or ""
            if k < len(labels) and sensor.findtext("type") != "0":
                labels[k] = name or labels[k]
    events = []
    if "info.xml" in files:
        began = _stamp(_tree(files["info.xml"]).findtext("recordTime"))
        for name in sorted(f for f in files if re.fullmatch(r"Events.*\.xml", f)):
            for e in _tree(files[name]).iter("event"):
                events.append(((_stamp(e.findtext("beginTime")) - began).total_seconds(), None, (e.findtext("code") or "").strip()))
    return Recording(labels, [rate] * len(table), table, events=sorted(events, key=lambda e: e[0]))


def _tree(data: bytes) -> ET.Element:
    """An XML tree without name spaces."""
    return ET.fromstring(re.sub(rb'\sxmlns(:\w+)?="[^"]*"', b"", data, count=4))


def _stamp(text: str) -> datetime:
    """ISO times, of which nanoseconds are cut down to microseconds."""
    return datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.strip()))


_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def matlab(data: bytes) -> dict[str, object]:
    """Variables of a MATLAB level 5 file: arrays, strings, lists of cells, and structs as lists of dictionaries (one: itself)."""
    order = "<" if data[126:128] == b"IM" else ">"

    def element(b: bytes, at: int) -> tuple[int, bytes, int]:
        kind, n = struct.unpack_from(order + "II", b, at)
        if kind >> 16:  # a small element holds its bytes in the tag
            return kind & 0xFFFF, b[at + 4 : at + 4 + (kind >> 16)], at + 8
        end = at + 8 + n
        return kind, b[at + 8 : end], end if kind == 15 else at + 8 + -(-n // 8) * 8

    def numbers(kind: int, b: bytes) -> np.ndarray:
        return np.frombuffer(b, order + _MAT_TYPES[kind])

    def text(kind: int, b: bytes) -> str:
        return b.decode("utf-8" if kind == 16 else "latin-1") if kind in (1, 2, 16) else "".join(map(chr, numbers(kind, b)))

    def matrix(b: bytes) -> tuple[str, object]:
        if not b:
            return "", np.zeros((0, 0))
        _, flags, at = element(b, 0)
        _, dims, at = element(b, at)
        _, name, at = element(b, at)
        shape, kind = tuple(np.frombuffer(dims, order + "i4")), struct.unpack(order + "I", flags[:4])[0] & 0xFF
        count = int(np.prod(shape))

        def several(n: int, at: int) -> list:
            out = []
            for _ in range(n):
                _, body, at = element(b, at)
                out.append(matrix(body)[1])
            return out

        if kind == 1:
            value: object = several(count, at)
        elif kind == 2:
            _, width, at = element(b, at)
            _, names, at = element(b, at)
            width = struct.unpack(order + "i", width)[0]
            fields = [names[i : i + width].split(b"\0")[0].decode() for i in range(0, len(names), width)]
            flat = several(count * len(fields), at)
            rows = [dict(zip(fields, flat[i * len(fields) : (i + 1) * len(fields)], strict=True)) for i in range(count)]
            value = rows[0] if count == 1 else rows
        elif kind == 4:
            value = text(*element(b, at)[:2])
        else:
            form, body, _ = element(b, at)
            value = numbers(form, body).reshape(shape, order="F")
        return name.decode(), value

    out, at = {}, 128
    while at + 8 <= len(data):
        kind, body, at = element(data, at)
        if kind == 15:
            kind, body, _ = element(zlib.decompress(body), 0)
        if kind == 14:
            name, value = matrix(body)
            out[name] = value
    return out


def _one(value: object) -> float:
    return float(np.asarray(value).ravel()[0])


def eeglab(files: Mapping[str, bytes]) -> Recording:
    """An EEGLAB .set file with its samples inside or in the .fdt file; several trials are epochs."""
    held = matlab(files[".set"])
    eeg = held.get("EEG", held)
    n, points, trials, rate = (int(_one(eeg["nbchan"])), int(_one(eeg["pnts"])), int(_one(eeg["trials"])), _one(eeg["srate"]))
    inside = isinstance(eeg["data"], np.ndarray)
    data = np.asarray(eeg["data"], float).reshape(n, points * trials, order="F") if inside else np.frombuffer(files[".fdt"], "<f4", n * points * trials).astype(float).reshape(n, -1, order="F")
    places = eeg.get("chanlocs", [])
    places = [places] if isinstance(places, dict) else places
    labels = [str(p["labels"]) for p in places] if isinstance(places, list) and len(places) == n else [f"E{k + 1}" for k in range(n)]
    listed = eeg.get("event", [])
    listed = [listed] if isinstance(listed, dict) else listed if isinstance(listed, list) else []
    name = lambda e: e["type"] if isinstance(e["type"], str) else f"{_one(e['type']):g}"
    data = data * 1e-6
    if trials > 1:
        first: dict[int, str] = {}
        for e in listed:
            first.setdefault(int(_one(e["epoch"])) - 1 if np.size(e.get("epoch", ())) else int((_one(e["latency"]) - 1) // points), name(e))
        return Recording(labels, [rate] * n, data.reshape(n, trials, points).transpose(1, 0, 2), _one(eeg["xmin"]), [first.get(k) for k in range(trials)])
    code = lambda t: int(t) if re.fullmatch(r"-?\d+", t) else None
    return Recording(labels, [rate] * n, list(data), events=[((_one(e["latency"]) - 1) / rate, code(name(e)), name(e)) for e in listed])


def fieldtrip(files: Mapping[str, bytes]) -> Recording:
    """Epochs of the FieldTrip structure in a .mat file; trials of different lengths can't be epochs."""
    for value in matlab(files[""]).values():
        if isinstance(value, dict) and {"label", "trial", "time"} <= set(value):
            trials = [np.asarray(x, float) for x in value["trial"]]
            time = np.asarray(value["time"][0], float).ravel()
            if len({x.shape for x in trials}) != 1:
                raise ValueError("trials have different lengths")
            rate = _one(value["fsample"]) if "fsample" in value else 1 / (time[1] - time[0])
            info = np.asarray(value.get("trialinfo", np.zeros((0, 0))))
            return Recording([str(x) for x in value["label"]], [rate] * len(trials[0]), np.stack(trials), float(time[0]), [f"{x:g}" for x in info[:, 0]] if len(info) == len(trials) else [None] * len(trials))
    raise ValueError("no FieldTrip epochs in the file")


def cnt(files: Mapping[str, bytes]) -> Recording:
    """Neuroscan continuous files of 16 or 32 bits."""
    data = files[""]
    n, rate = struct.unpack_from("<H", data, 370)[0], struct.unpack_from("<H", data, 376)[0]
    samples, table = struct.unpack_from("<i", data, 864)[0], struct.unpack_from("<i", data, 886)[0]
    start = 900 + 75 * n
    labels, base, gain = [], [], []
    for k in range(n):
        at = 900 + 75 * k
        labels.append(data[at : at + 10].split(b"\0")[0].decode("latin-1"))
        base.append(struct.unpack_from("<h", data, at + 47)[0])
        gain.append(struct.unpack_from("<f", data, at + 59)[0] * struct.unpack_from("<f", data, at + 71)[0] / 204.8e6)
    end = table if start < table <= len(data) else len(data)
    size = 4 if samples > 0 and (end - start) // (n * samples) >= 4 else 2
    raw = np.frombuffer(data, f"<i{size}", (end - start) // size // n * n, start).reshape(-1, n).T
    return Recording(labels, [float(rate)] * n, [(row - b) * g for row, b, g in zip(raw.astype(float), base, gain, strict=True)])


def nicolet(files: Mapping[str, bytes]) -> Recording:
    """A .data file of 16-bit samples with its .head text."""
    head = dict(line.split("=", 1) for line in files[".head"].decode("latin-1").splitlines() if "=" in line)
    labels = head["elec_names"].strip().strip("[]").split(",")
    gain, rate, n = float(head.get("conversion_factor", 1)) * 1e-6, float(head["sample_freq"]), int(head["num_channels"])
    raw = np.frombuffer(files[".data"], "<i2", len(files[".data"]) // 2 // n * n).reshape(-1, n).T
    return Recording(labels, [rate] * n, list(raw * gain))


def curry(files: Mapping[str, bytes]) -> Recording:
    """Curry 7 .dat samples with the parameters of .dap and the labels of .rs3."""
    head = {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in files[".dap"].decode("latin-1").splitlines()) if v}
    n, rate = int(head["NumChannels"]), float(head["SampleFreqHz"])
    labels = re.search(r"LABELS\w* START_LIST[^\n]*\n(.*?)\n\s*LABELS\w* END_LIST", files.get(".rs3", b"").decode("latin-1"), re.S)
    names = labels[1].split() if labels else []
    raw = np.frombuffer(files[".dat"], "<f4", len(files[".dat"]) // 4 // n * n).reshape(-1, n).T if head.get("DataFormat", "BINARY") != "ASCII" else np.array(files[".dat"].split(), float).reshape(-1, n).T
    return Recording(names if len(names) == n else [f"E{k + 1}" for k in range(n)], [rate] * n, list(raw.astype(float) * 1e-6))


def gdf(files: Mapping[str, bytes]) -> Recording:
    """GDF 2 files: physical values from digital ones by each channel's limits, events from the table behind the data."""
    data = files[""]
    version = float(data[4:8])
    n = struct.unpack_from("<H", data, 252)[0]
    records = struct.unpack_from("<q", data, 236)[0]
    seconds = np.divide(*struct.unpack_from("<II", data, 244)) if version < 2.21 else struct.unpack_from("<d", data, 244)[0]
    head = 256 * struct.unpack_from("<H", data, 184)[0]
    field = lambda at, kind: np.frombuffer(data, f"<{kind}", n, 256 + at * n)
    labels = [data[256 + 16 * k : 272 + 16 * k].split(b"\0")[0].decode("latin-1").strip() for k in range(n)]
    units, low, high, dlow, dhigh = field(102, "u2"), field(104, "f8"), field(112, "f8"), field(120, "f8"), field(128, "f8")
    per, kinds = field(216, "u4"), field(220, "u4")
    forms = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "i8", 16: "f4", 17: "f8"}
    widths = [int(p) * np.dtype(forms[int(k)]).itemsize for p, k in zip(per, kinds, strict=True)]
    size = sum(widths)
    if records < 0:
        records = (len(data) - head) // size
    body = np.frombuffer(data, np.uint8, records * size, head).reshape(records, size)
    out, at = [], 0
    for k in range(n):
        raw = np.ascontiguousarray(body[:, at : at + widths[k]]).view("<" + forms[int(kinds[k])]).ravel().astype(float)
        at += widths[k]
        scale = {4256: 1.0, 4274: 1e-3, 4275: 1e-6, 4276: 1e-9}.get(int(units[k]), 1.0)
        out.append(((raw - dlow[k]) * (high[k] - low[k]) / (dhigh[k] - dlow[k]) + low[k]) * scale)
    events, at = [], head + records * size
    if at + 8 <= len(data):
        count = int.from_bytes(data[at + 1 : at + 4], "little")
        rate = struct.unpack_from("<f", data, at + 4)[0] or float(per[0] / seconds)
        places = np.frombuffer(data, "<u4", count, at + 8)
        types = np.frombuffer(data, "<u2", count, at + 8 + 4 * count)
        events = [((int(p) - 1) / rate, int(t), None) for p, t in zip(places, types, strict=True)]
    return Recording(labels, [float(p / seconds) for p in per], out, events=events)


#: Decoder of each format, and the files that belong to a recording beside the main one (endings, or names within a folder).
DECODERS = {
    "EDF": (edf, ()), "BDF": (edf, ()), "BrainVision": (brainvision, (".vhdr", ".eeg", ".vmrk")), "FIF": (fif, ()), "RawFIF": (fif, ()), "EGI": (mff, ("/",)), "EEGLAB": (eeglab, (".set", ".fdt")),
    "CNT": (cnt, ()), "GDF": (gdf, ()), "Nicolet": (nicolet, (".data", ".head")), "Curry": (curry, (".dat", ".dap", ".rs3")), "FieldTrip": (fieldtrip, ()),
}
