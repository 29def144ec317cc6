"""The feature store: long tables as partitioned Parquet, written per element and read by feature."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import bids_path, stage_name

#: Axes of each marker class's output, outermost first; an axis that was aggregated is null in the table.
DIMENSIONS = {
    "SpectralPowerBands": ("band", "epoch", "channel_i"), "PermutationEntropy": ("tau", "epoch", "channel_i"), "KolmogorovComplexity": ("epoch", "channel_i"),
    "TimeLockedTopography": ("epoch", "channel_i"), "TimeLockedContrast": ("channel_i",), "ContingentNegativeVariation": ("epoch", "channel_i"),
    "PowerSpectralDensitySummary": ("epoch", "channel_i"), "SlowWavesDetection": ("epoch", "channel_i"), "SpindlesDetection": ("epoch", "channel_i"),
    "SymbolicMutualInformation": ("tau", "epoch", "channel_i", "channel_j"), "SymbolicMutualInformationROIs": ("tau", "epoch", "channel_i", "channel_j"),
    "PowerSpectralDensityEstimator": ("channel_i", "freq"), "WindowDecoding": (), "TimeDecoding": ("t_idx",),
}

KEYS = ("subject", "session", "task", "acq", "run")
FEATURE_SCHEMA = "feature string, marker string, marker_class string, kind string, subject string, session string, task string, acq string, run string, band string, tau int, epoch int, ch_i int, channel_i string, ch_j int, channel_j string, freq double, t_idx int, value double"
_AXES = ("band", "tau", "epoch", "ch_i", "channel_i", "ch_j", "channel_j", "freq", "t_idx")


def as_features(df: DataFrame, feature: str, marker_class: str, marker: str | None = None) -> DataFrame:
    """Any marker's result in the feature schema; columns that it lacks are null, ``channel`` is channel_i, an only ``element`` the subject.

    kind says what is left of the axes: matrix for channel pairs, timeseries for epochs by channels, vector for one axis, else scalar_table.
    """
    rename = {"channel": "channel_i", "ch_idx": "ch_i", "element": "subject"}
    have = {rename.get(c, c): c for c in df.columns}
    axes = [a for a in ("epoch", "channel_i", "channel_j", "freq", "t_idx") if a in have]
    kind = "matrix" if "channel_j" in axes else "timeseries" if {"epoch", "channel_i"} <= set(axes) else "vector" if axes else "scalar_table"
    fixed = {"feature": F.lit(feature), "marker": F.lit(marker or feature), "marker_class": F.lit(marker_class), "kind": F.lit(kind)}
    out = []
    for f in T._parse_datatype_string(FEATURE_SCHEMA).fields:
        c = fixed.get(f.name, F.col(have[f.name]) if f.name in have else F.lit(None))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def write(features: DataFrame, uri: str, mode: str = "update", force_float32: bool = True) -> None:
    """Write by feature and subject; update replaces only the partitions that come anew, overwrite all."""
    if mode not in ("update", "overwrite", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    out = features.withColumn("value", F.col("value").cast("float")) if force_float32 else features
    # Rebalanced, so that a feature with very many rows goes to several tasks and files, and small ones share a task.
    out = out.withColumn("subject", F.coalesce("subject", F.lit("none"))).hint("rebalance", "feature", "subject")
    writer = out.write.partitionBy("feature", "subject").option("compression", "gzip")
    if mode == "update":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(uri)
    else:
        writer.mode("overwrite" if mode == "overwrite" else "error").option("partitionOverwriteMode", "static").parquet(uri)


def element_uri(uri: str, suffix: str | None = "markers") -> Column:
    """The file of an element below ``uri``, by BIDS; the description is the uri's stem if the uri names a file, else "markers"."""
    base, stem, extension = uri.rstrip("/"), "markers", "parquet"
    if m := re.search(r"(?:^|/)([^/]+)\.(\w+)$", base):
        base, stem, extension = base[: -len(m[0])] or ".", m[1], "parquet"
        suffix = None if suffix == "markers" else suffix
    else:
        suffix = None if suffix == stem else suffix
    none = F.raise_error(F.lit("a row has no subject: its file can't be told")).cast("string")
    return F.concat(F.lit(base + "/"), bids_path(F.coalesce("subject", none), *(F.col(k) for k in KEYS[1:]), stem, suffix, extension))


def write_elements(features: DataFrame, uri: str, suffix: str | None = "markers", force_float32: bool = True, pickles: bool = False) -> DataFrame:
    """One file for each element, at its BIDS path; returns path, rows and features of each. Rows without a subject fail the query.

    An element's features are a bounded group and are written by one task: to a name of its attempt first, which is then renamed, so that a
    repeated task leaves one whole file. ``pickles`` puts a pickle of every feature's array beside it.
    """
    where = features.withColumn("__path", element_uri(uri, suffix))
    if force_float32:
        where = where.withColumn("value", F.col("value").cast("float"))

    def run(pdf):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        path = pdf["__path"].iloc[0]
        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
        system.create_dir(at.rpartition("/")[0], recursive=True)

        def put(name: str, data: bytes) -> None:
            own = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own, compression=None) as stream:
                stream.write(data)
            system.move(own, name)

        rows = pdf.drop(columns="__path")
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pandas(rows, preserve_index=False), sink, compression="gzip", compression_level=7)
        put(at, sink.getvalue().to_pybytes())
        if pickles:
            import pickle

            arrays = {str(n): dict(zip(("data", "dim_names"), tensor(g), strict=True)) for n, g in rows.groupby("marker")}
            put(re.sub(r"\.\w+$", ".pkl", at), pickle.dumps(arrays))
        return pd.DataFrame([{"path": path, "rows": len(rows), "features": rows["feature"].nunique()}])

    return where.groupBy("__path").applyInPandas(run, "path string, rows long, features long")


def dump(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's signals below ``path`` under the stage's name, by element where the path has ``{element}``, and go on from the files."""
    stage = stage_name(path)
    at = f"{path.split('{element}')[0].rstrip('/')}/{stage}" if "{element}" in path else path
    writer = df.write.mode("overwrite")
    (writer.partitionBy("element") if "{element}" in path else writer).parquet(at)
    return load(df.sparkSession, at, df.schema)


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Signals that ``dump`` wrote."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read(spark: SparkSession, uri: str, feature: str | None = None) -> DataFrame:
    """A store's rows; a feature's partition alone is read where it is named."""
    df = spark.read.parquet(uri)
    return df if feature is None else df.where(F.col("feature") == feature)


def list_features(spark: SparkSession, uri: str) -> list[str]:
    return [r["feature"] for r in read(spark, uri).select("feature").distinct().orderBy("feature").collect()]


def to_tensor(rows: DataFrame, marker_class: str | None = None) -> tuple[np.ndarray, tuple[str, ...]]:
    """A marker's rows as an array in the order of its class's axes, aggregated axes of size 1; for results of one element."""
    return tensor(rows.toPandas(), marker_class)


def tensor(pdf, marker_class: str | None = None) -> tuple[np.ndarray, tuple[str, ...]]:
    name = marker_class or (pdf["marker_class"].iloc[0] if len(pdf) else "")
    axes = DIMENSIONS.get(name, tuple(a for a in _AXES if a in pdf and pdf[a].notna().any()))
    codes, shape = [], []
    for a in axes:
        by = {"channel_i": "ch_i", "channel_j": "ch_j"}.get(a, a)
        column = pdf[by] if by in pdf and pdf[by].notna().any() else pdf[a]
        levels = sorted(column.dropna().unique())
        codes.append(column.map({v: i for i, v in enumerate(levels)}).fillna(0).astype(int).to_numpy())
        shape.append(max(len(levels), 1))
    out = np.full(shape, np.nan)
    out[tuple(codes)] = pdf["value"].to_numpy(float)
    return out, axes


def export_pickles(spark: SparkSession, uri: str, folder: str, features: Sequence[str] | None = None) -> list[str]:
    """One pickle for each feature: data, axis names and channel names. The driver holds one feature at a time."""
    import pickle
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for f in features or list_features(spark, uri):
        rows = read(spark, uri, f)
        data, axes = to_tensor(rows)
        names = [r["channel_i"] for r in rows.select("ch_i", "channel_i").distinct().orderBy("ch_i").collect() if r["channel_i"] is not None]
        path = Path(folder) / f"{f}.pkl"
        path.write_bytes(pickle.dumps({"name": f, "data": data, "dim_names": axes, "col_names": names}))
        out.append(str(path))
    return out
