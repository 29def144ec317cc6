"""Spherical splines: interpolation of bad channels and current source density."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _legendre_sum(cosine: np.ndarray, terms: int, stiffness: int, power: int) -> np.ndarray:
    """Sum over n of (2n + 1) / (n (n + 1))^(stiffness - power) P_n(cosine) / 4 pi."""
    n = np.arange(1, terms + 1)
    factor = np.concatenate([[0.0], (2 * n + 1) / ((n * (n + 1.0)) ** (stiffness - power) * 4 * np.pi)])
    return np.polynomial.legendre.legval(cosine, factor)


def _unit(positions: np.ndarray, origin: Sequence[float] | None) -> np.ndarray:
    p = np.asarray(positions, float) - (sphere_centre(positions) if origin is None else np.asarray(origin, float))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def sphere_centre(positions: np.ndarray) -> np.ndarray:
    """Centre of the sphere that fits the positions best, by linear least squares."""
    p = np.asarray(positions, float)
    if len(p) < 4:
        return np.zeros(3)
    a = np.hstack([2 * p, np.ones((len(p), 1))])
    return np.linalg.lstsq(a, (p**2).sum(axis=1), rcond=None)[0][:3]


def spline_weights(good: np.ndarray, bad: np.ndarray, origin: Sequence[float] | None = (0.0, 0.0, 0.0), regularisation: float = 1e-5, stiffness: int = 4, terms: int = 50) -> np.ndarray:
    """Weights (bad x good) by which values at good positions give those at bad ones; each row sums to one."""
    every = _unit(np.vstack([good, bad]), origin)
    g, b = every[: len(good)], every[len(good) :]
    inner = _legendre_sum(np.clip(g @ g.T, -1, 1), terms, stiffness, 0) + regularisation * np.eye(len(g))
    outer = _legendre_sum(np.clip(b @ g.T, -1, 1), terms, stiffness, 0)
    full = np.block([[inner, np.ones((len(g), 1))], [np.ones((1, len(g))), np.zeros((1, 1))]])
    solved = np.linalg.pinv(full)
    return np.hstack([outer, np.ones((len(b), 1))]) @ solved[:, : len(g)]


def csd_matrix(positions: np.ndarray, lambda2: float = 1e-5, stiffness: int = 4, terms: int = 50, radius: float | None = None) -> np.ndarray:
    """Surface Laplacian (channels x channels) of average-referenced values."""
    p = np.asarray(positions, float)
    centre = sphere_centre(p)
    radius = float(np.linalg.norm(p - centre, axis=1).mean()) if radius is None else radius
    u = _unit(p, centre)
    cosine = np.clip(u @ u.T, -1, 1)
    g = _legendre_sum(cosine, terms, stiffness, 0) + lambda2 * np.eye(len(u))
    h = _legendre_sum(cosine, terms, stiffness, 1)
    inverse = np.linalg.inv(g)
    column = inverse.sum(axis=0)
    spread = inverse - np.outer(column, column) / column.sum()
    centred = np.eye(len(u)) - 1 / len(u)
    return h @ spread @ centred / radius**2


def mix_channels(signals: DataFrame, matrix: np.ndarray, keys: Sequence[str] = ("element", "epoch")) -> DataFrame:
    """Replace the channels of each epoch, in order of ch_idx, by products with a matrix (channels x channels)."""
    import pandas as pd

    m = np.asarray(matrix, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ch_idx")
        if len(pdf) != m.shape[1]:
            raise ValueError(f"{len(pdf)} channels meet a matrix of {m.shape[1]}")
        return pdf.assign(data=list(m @ np.stack(pdf["data"].to_numpy())))

    return signals.groupBy(*keys).applyInPandas(run, signals.schema)


def apply_weights(samples: DataFrame, weights: DataFrame, keys: Sequence[str] = ("element", "epoch")) -> DataFrame:
    """Rows of bad channels become weighted sums of good ones: weights has bad, good and w, a row for each pair of channels."""
    at = [*keys, "t_idx"]
    made = samples.join(F.broadcast(weights), samples["channel"] == weights["good"]).groupBy(*at, F.col("bad").alias("channel")).agg(F.sum(F.col("w") * F.col("value")).alias("__new"))
    bad = weights.select(F.col("bad").alias("channel")).distinct()
    flagged = samples.join(F.broadcast(bad.withColumn("__bad", F.lit(True))), "channel", "left")
    out = flagged.join(made, [*at, "channel"], "left")
    return out.withColumn("value", F.when(F.col("__bad"), F.col("__new")).otherwise(F.col("value"))).drop("__bad", "__new").select(*samples.columns)


def interpolate(samples: DataFrame, positions: dict[str, Sequence[float]], bads: Sequence[str], keys: Sequence[str] = ("element", "epoch")) -> DataFrame:
    """Interpolate bad channels from the good ones whose positions are known; bad ones without a position stay as they are."""
    placed = {c: np.asarray(p, float) for c, p in positions.items() if np.all(np.isfinite(p)) and np.any(np.asarray(p) != 0)}
    good, bad = [c for c in placed if c not in bads], [c for c in placed if c in bads]
    if not bad:
        return samples
    w = spline_weights(np.stack([placed[c] for c in good]), np.stack([placed[c] for c in bad]), origin=None)
    rows = [(b, g, float(w[i, j])) for i, b in enumerate(bad) for j, g in enumerate(good)]
    return apply_weights(samples, samples.sparkSession.createDataFrame(rows, "bad string, good string, w double"), keys)
