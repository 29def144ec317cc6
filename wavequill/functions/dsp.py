"""Signal processing on numpy arrays whose last axis is time; used inside grouped-map functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


# ---- filter design -------------------------------------------------------------------------------


def _butter_prototype(order: int) -> tuple[np.ndarray, np.ndarray, float]:
    k = np.arange(1, order + 1)
    return np.zeros(0, complex), np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)), 1.0


def _cheby2_prototype(order: int, stop_db: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Inverse Chebyshev with unit stop-band edge: zeros on the imaginary axis, poles from the reciprocal of type I's."""
    e = 1 / np.sqrt(10 ** (stop_db / 10) - 1)
    mu = np.arcsinh(1 / e) / order
    m = np.arange(-order + 1, order, 2)
    zeros = 1j / np.sin(m[m != 0] * np.pi / (2 * order))
    circle = -np.exp(1j * np.pi * m / (2 * order))
    poles = 1 / (np.sinh(mu) * circle.real + 1j * np.cosh(mu) * circle.imag)
    gain = float(np.real(np.prod(-poles) / np.prod(-zeros)))
    return zeros, poles, gain


def _transform(z: np.ndarray, p: np.ndarray, k: float, kind: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Analog frequency transformation of a low-pass prototype with edge 1."""
    extra = len(p) - len(z)
    if kind == "low":
        return z * edges[0], p * edges[0], k * edges[0] ** extra
    if kind == "high":
        gain = k * float(np.real(np.prod(-z) / np.prod(-p)))
        return np.concatenate([edges[0] / z, np.zeros(extra)]), edges[0] / p, gain
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])

    def split(r: np.ndarray) -> np.ndarray:
        half = r * width / 2
        root = np.sqrt(half.astype(complex) ** 2 - centre**2)
        return np.concatenate([half + root, half - root])

    return np.concatenate([split(z), np.zeros(extra)]), split(p), k * width**extra


def _digital(z: np.ndarray, p: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Bilinear transform at a sampling rate of 2 (edges are pre-warped to it)."""
    fs2 = 4.0
    gain = k * float(np.real(np.prod(fs2 - z) / np.prod(fs2 - p)))
    zeros = np.concatenate([(fs2 + z) / (fs2 - z), -np.ones(len(p) - len(z))])
    return zeros, (fs2 + p) / (fs2 - p), gain


def _sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Second-order sections: each pole pair nearest the unit circle takes its nearest zeros."""
    n = -(-len(p) // 2)
    z, p = list(np.concatenate([z, np.zeros(2 * n - len(z))])), list(np.concatenate([p, np.zeros(2 * n - len(p))]))

    def pair(pool: list, near: complex) -> list:
        first = pool.pop(int(np.argmin(np.abs(np.array(pool) - near))))
        if abs(first.imag) > 1e-10:
            other = int(np.argmin(np.abs(np.array(pool) - np.conj(first))))
        else:
            real = [i for i, r in enumerate(pool) if abs(r.imag) <= 1e-10]
            other = min(real, key=lambda i: abs(pool[i] - near))
        return [first, pool.pop(other)]

    out = []
    for _ in range(n):
        worst = p[int(np.argmin(np.abs(1 - np.abs(np.array(p)))))]
        a = np.real(np.poly(pair(p, worst)))
        b = np.real(np.poly(pair(z, worst)))
        out.append(np.concatenate([b, a]))
    sos = np.array(out[::-1])
    sos[0, :3] *= k
    return sos


def _warp(edges: np.ndarray, fs: float) -> np.ndarray:
    return 4 * np.tan(np.pi * edges / fs)


@lru_cache(256)
def butter(order: int, edges: tuple[float, ...], kind: str, fs: float) -> np.ndarray:
    """Digital Butterworth filter as second-order sections; kind is low, high or band."""
    e = _warp(np.array(edges, float), fs)
    return _sections(*_digital(*_transform(*_butter_prototype(order), kind, e)))


@lru_cache(64)
def cheby2_band(pass_edges: tuple[float, float], stop_edges: tuple[float, float], pass_db: float, stop_db: float, fs: float) -> np.ndarray:
    """Chebyshev II band-pass of the smallest order for pass and stop edges in Hz, as second-order sections.

    The order follows from the narrower transition of the two; the pass-band loss at the pass
    edges is met exactly there, as the stop edges are moved inwards to it.
    """
    nyquist = fs / 2
    wp = np.tan(np.pi * np.array(pass_edges) / nyquist / 2)
    ws = np.tan(np.pi * np.array(stop_edges) / nyquist / 2)
    ratio = float(np.min(np.abs((ws**2 - wp[0] * wp[1]) / (ws * (wp[0] - wp[1])))))
    e_stop, e_pass = 10 ** (stop_db / 10) - 1, 10 ** (pass_db / 10) - 1
    order = int(np.ceil(np.arccosh(np.sqrt(e_stop / e_pass)) / np.arccosh(ratio)))
    # The prototype frequency at which the loss is pass_db, relative to the stop edge.
    edge = 1 / np.cosh(np.arccosh(np.sqrt(e_stop / e_pass)) / order)
    half = (wp[0] - wp[1]) / (2 * edge)
    low = half + np.sqrt(half**2 + wp[0] * wp[1])
    stops = 4 * np.array([low, wp[0] * wp[1] / low])
    return _sections(*_digital(*_transform(*_cheby2_prototype(order, stop_db), "band", np.sort(stops))))


# ---- filtering -----------------------------------------------------------------------------------


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Run sections over the last axis, in blocks: a block is one product with the section's impulse matrix and one with its state.

    state: where given, each section starts from it times the first sample of the input.
    """
    y = np.array(x, float)
    shape = y.shape
    y = y.reshape(-1, shape[-1])
    first = y[:, :1].copy()
    block = 64
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        move = np.array([[-a1, 1.0], [-a2, 0.0]])
        feed = np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(block):
            powers.append(powers[-1] @ move)
        see = np.array([m[0] for m in powers[:-1]])  # output of a state after k steps
        pulse = np.array([b0, *[(powers[k] @ feed)[0] for k in range(block - 1)]])
        lag = np.arange(block)[:, None] - np.arange(block)[None, :]
        impulse = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
        gather = np.array([powers[block - 1 - k] @ feed for k in range(block)])
        z = np.zeros((len(y), 2)) if state is None else state[s] * first
        for a in range(0, shape[-1], block):
            part = y[:, a : a + block].copy()
            n = part.shape[1]
            y[:, a : a + n] = part @ impulse[:n, :n].T + z @ see[:n].T
            z = z @ powers[n].T + part @ gather[block - n :]
    return y.reshape(shape)


def steady_state(sos: np.ndarray) -> np.ndarray:
    """States of the sections after an endless unit step."""
    out, gain = np.zeros((len(sos), 2)), 1.0
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        level = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * level
        out[s] = np.array([b1 - a1 * level + z2, z2]) * gain
        gain *= level
    return out


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Forwards and backwards, with an odd extension of ``pad`` samples (fewer for short signals) and steady starts."""
    x = np.asarray(x, float)
    pad = min(pad, x.shape[-1] - 1)
    if pad > 0:
        left = 2 * x[..., :1] - x[..., pad:0:-1]
        right = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
        x = np.concatenate([left, x, right], axis=-1)
    z = steady_state(sos)
    y = sos_filter(sos, x, z)
    y = sos_filter(sos, y[..., ::-1], z)[..., ::-1]
    return y[..., pad : y.shape[-1] - pad] if pad > 0 else y


def filtfilt_pad(order: int, band: bool = False) -> int:
    """Extension of forward-backward filtering by a polynomial pair of this order."""
    return 3 * ((2 * order if band else order) + 1)


# ---- transforms ----------------------------------------------------------------------------------


def hamming(n: int) -> np.ndarray:
    """Periodic Hamming window."""
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, fs: float, n_fft: int, n_per_seg: int, n_overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided spectral density: Hamming segments without their means, zero-padded to n_fft, averaged."""
    n = x.shape[-1]
    n_per_seg = min(n_per_seg, n_fft, n)
    step = n_per_seg - n_overlap
    if step <= 0:
        raise ValueError(f"segments of {n_per_seg} samples can't overlap by {n_overlap}")
    starts = np.arange(0, n - n_per_seg + 1, step)
    segments = np.stack([x[..., s : s + n_per_seg] for s in starts], axis=-2)
    segments = segments - segments.mean(axis=-1, keepdims=True)
    window = hamming(n_per_seg)
    power = np.abs(np.fft.rfft(segments * window, n_fft, axis=-1)) ** 2 / (fs * (window**2).sum())
    last = -1 if n_fft % 2 == 0 else None
    power[..., 1:last] *= 2
    return np.fft.rfftfreq(n_fft, 1 / fs), power.mean(axis=-2)


def fft_resample(x: np.ndarray, up_fs: float, fs: float) -> np.ndarray:
    """Resample by cutting or padding the spectrum; ends are mirrored before, so that they do not wrap round."""
    n = x.shape[-1]
    new = int(round(n * up_fs / fs))
    pad = min(n - 1, max(1, int(fs)))
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    m = ext.shape[-1]
    size = int(round(m * up_fs / fs))
    spectrum = np.fft.rfft(ext, axis=-1)
    keep = min(m, size) // 2 + 1
    out = np.zeros((*ext.shape[:-1], size // 2 + 1), complex)
    out[..., :keep] = spectrum[..., :keep]
    y = np.fft.irfft(out, size, axis=-1) * (size / m)
    first = int(round(pad * up_fs / fs))
    return y[..., first : first + new]


def fft_notch(x: np.ndarray, fs: float, freqs: list[float], width: float = 1.0) -> np.ndarray:
    """Zero-phase notches: spectral gain with raised-cosine edges around each frequency; those from Nyquist on are left out."""
    n = x.shape[-1]
    pad = min(n - 1, int(fs))
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1) if pad > 0 else x
    f = np.fft.rfftfreq(ext.shape[-1], 1 / fs)
    gain = np.ones(len(f))
    for f0 in freqs:
        if f0 < fs / 2:
            d = np.abs(f - f0)
            gain *= np.where(d <= width / 2, 0.0, np.where(d >= width, 1.0, 0.5 - 0.5 * np.cos(np.pi * (d - width / 2) / (width / 2))))
    y = np.fft.irfft(np.fft.rfft(ext, axis=-1) * gain, ext.shape[-1], axis=-1)
    return y[..., pad : pad + n] if pad > 0 else y


def fir_band(x: np.ndarray, fs: float, lo: float, hi: float) -> np.ndarray:
    """Zero-phase Hamming-window FIR band-pass with transitions of a quarter of each edge (at least 2 Hz, at most the edge)."""
    l_trans, h_trans = min(max(lo * 0.25, 2.0), lo), min(max(hi * 0.25, 2.0), fs / 2 - hi)
    n = int(np.ceil(3.3 / min(l_trans, h_trans) * fs))
    n += 1 - n % 2
    t = np.arange(n) - n // 2
    low = lambda f: 2 * f / fs * np.sinc(2 * f / fs * t)
    taps = (low(hi + h_trans / 2) - low(lo - l_trans / 2)) * np.hamming(n)
    pad = min(n // 2, x.shape[-1] - 1)
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    size = ext.shape[-1] + n - 1
    y = np.fft.irfft(np.fft.rfft(ext, size, axis=-1) * np.fft.rfft(taps, size), size, axis=-1)
    return y[..., n // 2 + pad : n // 2 + pad + x.shape[-1]]


def envelope(x: np.ndarray) -> np.ndarray:
    """Amplitude of the analytic signal."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1))
