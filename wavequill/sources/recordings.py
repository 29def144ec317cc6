"""Recordings from files: patterns with placeholders, formats by extension, signals and annotations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ENTITIES
from ..operators.signals import SIGNAL_SCHEMA
from . import formats

#: Format of each extension. Formats without a decoder are known, and refused when read.
EXTENSIONS = {
    ".edf": "EDF", ".bdf": "BDF", ".vhdr": "BrainVision", ".fif": "FIF", ".fif.gz": "FIF", ".mff": "EGI", ".set": "EEGLAB", ".cnt": "CNT", ".gdf": "GDF", ".eeg": "NihonKohden",
    ".raw": "RawFIF", ".sqd": "KIT", ".con": "KIT", ".dat": "Curry", ".data": "Nicolet", ".mat": "FieldTrip",
}


#: What a pattern of a data type has to tell, and may tell; a mask's pattern likewise. The space is "native" where nothing is said.
DATA_TYPES = {"EEG": {"mandatory": ("pattern",), "optional": {"space": None, "mask": ("pattern", "space")}}}


def check_patterns(patterns: Mapping[str, Mapping]) -> None:
    """Refuse data types and keys that aren't known, and lacking ones."""
    for kind, given in patterns.items():
        if kind not in DATA_TYPES:
            raise ValueError(f"unknown data type {kind!r}; known are {', '.join(DATA_TYPES)}")
        known = DATA_TYPES[kind]
        if missing := [k for k in known["mandatory"] if not given.get(k)]:
            raise ValueError(f"{kind}: the pattern lacks {missing}")
        if strange := [k for k in given if k not in known["mandatory"] and k not in known["optional"]]:
            raise ValueError(f"{kind}: unknown keys {strange}")
        if given.get("mask") and (missing := [k for k in known["optional"]["mask"] if k not in given["mask"]]):
            raise ValueError(f"{kind}: the mask lacks {missing}")


def format_of(path: str) -> str:
    for ext in sorted(EXTENSIONS, key=len, reverse=True):
        if path.lower().endswith(ext):
            return EXTENSIONS[ext]
    raise ValueError(f"no known format has the extension of {path}")


def pattern_regex(pattern: str) -> str:
    """A regular expression for a {placeholder} pattern with * wildcards; each placeholder becomes a named group."""
    out, seen = "", set()
    for part in re.split(r"(\{\w+\}|\*)", pattern):
        if part == "*":
            out += "[^/]*"
        elif m := re.fullmatch(r"\{(\w+)\}", part):
            out += f"(?P={m[1]})" if m[1] in seen else f"(?P<{m[1]}>[^/]+?)"
            seen.add(m[1])
        else:
            out += re.escape(part)
    return out + "$"


def decode(kind: str, files: Mapping[str, bytes], decoders: Mapping[str, Callable] | None = None) -> formats.Recording:
    """A recording from the bytes of its files, by ending (or by name within a folder). Own decoders get the main file and may give labels, rates and arrays."""
    if decoders and kind in decoders:
        main = next(iter(files.values()))
        got = decoders[kind](main)
        return got if isinstance(got, formats.Recording) else formats.Recording(*got)
    if kind not in formats.DECODERS:
        raise ValueError(f"no decoder for {kind} files")
    return formats.DECODERS[kind][0](files)


def _files(spark: SparkSession, folder: str, pattern: str, replacements: Sequence[str], own: Mapping[str, Callable]) -> tuple[DataFrame, str, str]:
    """path and files (name, content) of every recording, the format, and the pattern's expression.

    Only formats of several files are grouped, by stem or folder; others are read where they lie.
    """
    missing = [r for r in replacements if "{" + r + "}" not in pattern]
    if missing:
        raise ValueError(f"the pattern has no placeholders {missing}")
    kind = format_of(pattern)
    beside = () if kind in own else formats.DECODERS.get(kind, (None, ()))[1]
    glob = f"{folder.rstrip('/')}/{re.sub(r'\{\w+\}', '*', pattern)}"
    load = lambda g: spark.read.format("binaryFile").load(g).select("path", "content")
    if not beside:
        return load(glob).select("path", F.array(F.struct(F.lit("").alias("name"), "content")).alias("files")), kind, pattern_regex(pattern)
    if beside == ("/",):
        # Large files of a folder that a decoder doesn't know stay unread.
        every = load(f"{glob}/*").where(F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"^(signal1\.bin|.*\.xml)$"))
        rows = every.select(F.regexp_replace("path", r"/[^/]+$", "").alias("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    else:
        main = beside[0]
        stem = glob[: -len(re.search(r"\.\w+$", glob)[0])]
        every = load(f"{stem}.*").where(F.lower(F.regexp_extract("path", r"(\.\w+)$", 1)).isin(list(beside)))
        rows = every.select(F.concat(F.regexp_replace("path", r"\.\w+$", ""), F.lit(main)).alias("path"), F.lower(F.regexp_extract("path", r"(\.\w+)$", 1)).alias("name"), "content")
    files = rows.groupBy("path").agg(F.collect_list(F.struct("name", "content")).alias("files"))
    if beside != ("/",):
        files = files.where(F.exists("files", lambda x: x["name"] == beside[0]))
    return files, kind, pattern_regex(pattern)


def _keys(path: str, regex: str) -> dict[str, str | None]:
    found = re.search(regex, path, re.I)
    keys = found.groupdict() if found else {}
    return {f: re.sub(rf"^{e}-", "", keys[f]) if f in keys else None for e, f in zip(ENTITIES, ("subject", "session", "task", "acq", "run"), strict=True)}


def grab(spark: SparkSession, folder: str, pattern: str = "{subject}/*.edf", replacements: Sequence[str] = ("subject",), decoders: Mapping[str, Callable] | None = None) -> DataFrame:
    """Signal rows of all recordings below ``folder`` that a pattern matches, read by Spark's own file source.

    Placeholders become key columns, values given without their BIDS prefix. A recording is the unit of
    distribution. Continuous ones have a row a channel with null epoch; files of epochs have a row an epoch and channel, with
    the epoch's condition.
    """
    own = decoders or {}
    files, kind, regex = _files(spark, folder, pattern, replacements, own)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, held in zip(pdf["path"], pdf["files"], strict=True):
                r = decode(kind, {f["name"]: f["content"] for f in held}, own)
                keys = _keys(path, regex)
                if r.is_epochs:
                    conditions = r.conditions or [None] * len(r.data)
                    for k, (epoch, condition) in enumerate(zip(r.data, conditions, strict=True)):
                        yield pd.DataFrame([{**keys, "epoch": k, "condition": condition, "ch_idx": i, "channel": c, "sfreq": fs, "tmin": r.tmin, "data": x.tolist()} for i, (c, fs, x) in enumerate(zip(r.labels, r.rates, epoch, strict=True))])
                else:
                    yield pd.DataFrame([{**keys, "epoch": None, "condition": None, "ch_idx": i, "channel": c, "sfreq": fs, "tmin": 0.0, "data": np.asarray(x).tolist()} for i, (c, fs, x) in enumerate(zip(r.labels, r.rates, r.data, strict=True))])

    return files.mapInPandas(run, SIGNAL_SCHEMA)


def annotations(spark: SparkSession, folder: str, pattern: str, replacements: Sequence[str] = ("subject",), decoders: Mapping[str, Callable] | None = None) -> DataFrame:
    """Events that the recordings' files tell: keys, sample, code, name. Names without a code are numbered in each recording, in order of names."""
    own = decoders or {}
    files, kind, regex = _files(spark, folder, pattern, replacements, own)
    schema = "subject string, session string, task string, acq string, run string, sample long, code int, name string"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, held in zip(pdf["path"], pdf["files"], strict=True):
                r = decode(kind, {f["name"]: f["content"] for f in held}, own)
                number = {n: i + 1 for i, n in enumerate(sorted({n for _, c, n in r.events if c is None and n is not None}))}
                rows = [{**_keys(path, regex), "sample": round(t * r.rates[0]), "code": number.get(n, 0) if c is None else c, "name": n} for t, c, n in r.events]
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, schema)


def encode_edf(labels: Sequence[str], rate: int, data: np.ndarray, seconds: int = 1) -> bytes:
    """A minimal EDF file of microvolt samples, for tests and exports."""
    n = len(labels)
    peak = float(np.abs(data).max()) or 1.0
    pad = lambda v, w: str(v)[:w].ljust(w).encode("latin-1")
    per = rate * seconds
    records = data.shape[1] // per
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(seconds, 8) + pad(n, 4)
    top = f"{peak:.6g}"
    for values, width in ((labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([f"-{top}"[:8]] * n, 8), ([top[:8]] * n, 8), (["-32768"] * n, 8), (["32767"] * n, 8), ([""] * n, 80), ([per] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(v, width) for v in values)
    peak = float(top[:8])
    digital = np.clip(np.round((data + peak) / (2 * peak) * 65535 - 32768), -32768, 32767).astype("<i2")
    body = b"".join(digital[k, r * per : (r + 1) * per].tobytes() for r in range(records) for k in range(n))
    return head + body
