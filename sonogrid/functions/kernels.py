"""Numeric kernels on (rows, samples) NumPy arrays; no Spark in here.

Filters are designed once a plan; all rows of a batch advance together.
"""

from __future__ import annotations

import numpy as np


def rfft_magnitude(x):
    return np.abs(np.fft.rfft(x, axis=1))


def irfft(z, n: int):
    """Rows of n real samples from their half spectra."""
    return np.fft.irfft(z, n, axis=1)


def fft_spec(x, d: float):
    """(magnitudes, frequencies) of one signal with sample spacing ``d``."""
    x = np.asarray(x, float)
    return np.abs(np.fft.rfft(x)), np.arange(len(x) // 2 + 1) / (d * len(x))


def time_index(tzero: float, delta_t: float, num: int):
    """``num`` times from ``tzero`` in steps of ``delta_t``."""
    return tzero + delta_t * np.arange(num)


def analytic(x):
    """Signal plus i times its Hilbert transform: positive frequencies doubled, DC and an even Nyquist kept."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1)


def envelope(x):
    return np.abs(analytic(x))


def phase_stats(x):
    """Circular mean and variance of the instantaneous phase; (0, 1) if undefined."""
    phase = np.angle(analytic(x))
    s, c = np.sin(phase).mean(axis=1), np.cos(phase).mean(axis=1)
    r = np.hypot(s, c)
    flat = r < 1e-12
    return np.where(flat, 0.0, np.arctan2(s, c)), np.where(flat, 1.0, 1 - np.minimum(1, r))


def peak_position(x, start: int, end: int, sub_sample: bool = True):
    """Place of the envelope's first maximum in [start, end), refined by a parabola; -1 for a silent gate."""
    env = envelope(x)
    gate = env[:, start:end]
    at = gate.argmax(axis=1) + start
    rows = np.arange(len(x))
    found = env[rows, at] > 0
    pos = at.astype(float)
    if sub_sample:
        inner = found & (at > start) & (at < end - 1)
        i, a = rows[inner], at[inner]
        y0, y1, y2 = env[i, a - 1], env[i, a], env[i, a + 1]
        bend = y0 - 2 * y1 + y2
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(bend != 0, 0.5 * (y0 - y2) / bend, 0.0)
        pos[inner] += np.clip(step, -0.5, 0.5)
    return np.where(found, pos, -1.0)


def round_half_away(v):
    """Nearest whole number, halves away from zero."""
    return np.sign(v) * np.floor(np.abs(v) + 0.5)


def hann(n: int):
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def band(nperseg: int, fs: float, f_min: float = 0.0, f_max: float = 0.0):
    """(frequencies, bins) within [f_min, f_max]; f_max 0 is the Nyquist frequency."""
    freqs = np.arange(nperseg // 2 + 1) * fs / nperseg
    top = f_max or fs / 2
    if f_min < 0 or top > fs / 2 * (1 + 1e-9) or f_min > top:
        raise ValueError("invalid frequency band")
    bins = np.flatnonzero((freqs >= f_min) & (freqs <= top * (1 + 1e-9)))
    if not len(bins):
        raise ValueError("empty frequency band")
    return freqs[bins], bins


def frames(n: int, nperseg: int, noverlap: int):
    if not 0 < nperseg <= n or not 0 <= noverlap < nperseg:
        raise ValueError("invalid segment length or overlap")
    step = nperseg - noverlap
    return np.arange((n - nperseg) // step + 1) * step


def frame_times(n: int, nperseg: int, noverlap: int, fs: float, origin: float = 0.0):
    return (nperseg / 2 + frames(n, nperseg, noverlap)) / fs + origin


def stft(x, nperseg: int, noverlap: int, bins):
    """(rows, bins, frames), windowed and scaled by one over the window's sum."""
    window = hann(nperseg)
    at = frames(x.shape[1], nperseg, noverlap)
    segments = x[:, at[:, None] + np.arange(nperseg)]
    return np.fft.rfft(segments * window, axis=2)[:, :, bins].transpose(0, 2, 1) / window.sum()


def power_spectrogram(x, nperseg: int, noverlap: int, bins, fs: float):
    """Density of each frame: one-sided, so all but DC and an even Nyquist bin are doubled."""
    window = hann(nperseg)
    z = stft(x, nperseg, noverlap, bins) * window.sum()
    p = (z.real**2 + z.imag**2) / (fs * (window**2).sum())
    twice = (bins > 0) & ((nperseg % 2 == 1) | (bins < nperseg // 2))
    return p * np.where(twice, 2.0, 1.0)[None, :, None]


def psd(x, nperseg: int, noverlap: int, bins, fs: float):
    return power_spectrogram(x, nperseg, noverlap, bins, fs).mean(axis=2)


def stft_peaks(x, nperseg: int, noverlap: int, bins):
    """(bin, frame) of the largest magnitude; the first of equals."""
    m = np.abs(stft(x, nperseg, noverlap, bins))
    return m.max(axis=2).argmax(axis=1), m.max(axis=1).argmax(axis=1)


def _digital(zeros, poles, fs: float):
    """Bilinear map of analogue roots; zeros at infinity go to -1."""
    c = 2 * fs
    z = (np.asarray(zeros) + c) / (c - np.asarray(zeros)) if len(zeros) else np.zeros(0)
    p = (np.asarray(poles) + c) / (c - np.asarray(poles))
    return np.concatenate([z, -np.ones(len(p) - len(z))]), p


def _warped(f: float, fs: float) -> float:
    if not 0 < f < fs / 2:
        raise ValueError("cutoff must lie between 0 and half the sample rate")
    return 2 * fs * np.tan(np.pi * f / fs)


def _butter_poles(order: int):
    k = np.arange(order)
    return np.exp(1j * (np.pi / 2 + (2 * k + 1) * np.pi / (2 * order)))


def butter_lowpass(cutoff: float, fs: float, order: int = 3):
    """(b, a), gain one at DC."""
    z, p = _digital([], _butter_poles(order) * _warped(cutoff, fs), fs)
    b, a = np.poly(z).real, np.poly(p).real
    return b * a.sum() / b.sum(), a


def butter_bandpass(low: float, high: float, fs: float, order: int = 3):
    """(b, a), gain one at the centre."""
    if not low < high:
        raise ValueError("the band is empty")
    lo, hi = _warped(low, fs), _warped(high, fs)
    width, centre2 = hi - lo, hi * lo
    half = _butter_poles(order) * width / 2
    root = np.sqrt(half**2 - centre2 + 0j)
    z, p = _digital(np.zeros(order), np.concatenate([half + root, half - root]), fs)
    b, a = np.poly(z).real, np.poly(p).real
    at = np.exp(2j * np.arctan2(np.sqrt(centre2), 2 * fs))
    return b / abs(np.polyval(b, at) / np.polyval(a, at)), a


def lfilter(b, a, x, state=None):
    """Causal recursive filter of each row (transposed direct form)."""
    n = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, n + 1 - len(b))) / a[0], np.pad(a, (0, n + 1 - len(a))) / a[0]
    s = np.zeros((len(x), n + 1)) if state is None else np.pad(state, ((0, 0), (0, 1)))
    out = np.empty_like(x, dtype=float)
    for i in range(x.shape[1]):
        v = x[:, i]
        y = b[0] * v + s[:, 0]
        out[:, i] = y
        s[:, :n] = s[:, 1:] + v[:, None] * b[1:] - y[:, None] * a[1:]
    return out


def filtfilt(b, a, x):
    """Zero-phase filter: forth and back over the rows, extended at both ends by odd reflection."""
    width = max(len(a), len(b))
    b, a = np.pad(b, (0, width - len(b))) / a[0], np.pad(a, (0, width - len(a))) / a[0]
    edge, n = 3 * width, x.shape[1]
    if n <= edge:
        raise ValueError(f"the filter needs more than {edge} samples")
    wide = np.hstack([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]])
    state = _steady(b, a)
    there = lfilter(b, a, wide, wide[:, :1] * state)[:, ::-1]
    return lfilter(b, a, there, there[:, :1] * state)[:, ::-1][:, edge : edge + n]


#: values of all windows that a running median holds at once
MEDIAN_CELLS = 1 << 22


def medfilt(x, kernel: int = 3):
    """Running median with whole-sample reflection at both ends."""
    n = x.shape[1]
    if kernel % 2 == 0 or kernel < 1 or kernel > 2 * n - 1:
        raise ValueError("the kernel must be odd and at most 2n - 1")
    half = kernel // 2
    wide = np.pad(x, ((0, 0), (half, half)), mode="reflect") if half else x
    out = np.empty(x.shape)
    step = max(1, MEDIAN_CELLS // (n * kernel))
    for a in range(0, len(x), step):
        windows = np.lib.stride_tricks.sliding_window_view(wide[a : a + step], kernel, axis=1)
        out[a : a + step] = np.partition(windows, half, axis=2)[..., half]
    return out


def _steady(b, a):
    """State of a filter that has seen ones forever."""
    n = len(a) - 1
    gain = b.sum() / a.sum()
    tail = b - a * gain
    return np.cumsum(tail[::-1])[::-1][1:][:n]


def cheby1_sections(q: int, order: int = 8, ripple: float = 0.05):
    """Second-order sections [(b, a)] of the anti-alias filter for decimation by q."""
    fs, cutoff = 2.0, 0.8 / q
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    phi = np.arcsinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(order) + 1) / (2 * order)
    poles = (-np.sinh(phi) * np.sin(theta) + 1j * np.cosh(phi) * np.cos(theta)) * _warped(cutoff, fs)
    _, p = _digital([], poles, fs)
    upper = sorted((v for v in p if v.imag > 0), key=lambda v: abs(v.imag))
    sections = [(np.array([1.0, 2.0, 1.0]), np.array([1.0, -2 * v.real, abs(v) ** 2])) for v in upper]
    gain = np.prod([b.sum() / a.sum() for b, a in sections])
    first_b, first_a = sections[0]
    return [(first_b * 10 ** (-ripple / 20) / gain, first_a), *sections[1:]]


def _cascade(sections, x):
    scale = x[:, :1].copy()
    for b, a in sections:
        x = lfilter(b, a, x, scale * _steady(b, a))
        scale = scale * (b.sum() / a.sum())
    return x


def decimate(x, q: int):
    """Zero-phase low-pass and every q-th sample; rows are cut to a multiple of q."""
    if q == 1:
        return x.copy()
    n = x.shape[1] // q * q
    sections = cheby1_sections(q)
    edge = 3 * (2 * len(sections) + 1)
    if n <= edge:
        raise ValueError(f"decimation needs more than {edge} samples")
    x = x[:, :n].astype(float)
    wide = np.hstack([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]])
    there = _cascade(sections, wide)
    back = _cascade(sections, there[:, ::-1])[:, ::-1]
    return back[:, edge : edge + n : q]


def savgol_matrix(n: int, window: int = 5, order: int = 2):
    """(n, n) smoothing matrix: local fits, the ends from the first and last whole window.

    An even window reaches one sample further back than forward; its weights are
    those of the fit's value at its middle, in reverse.
    """
    if window > n or not 0 <= order < window:
        raise ValueError("the window must be at most n and above the order")
    half = window // 2
    powers = np.vander(np.arange(window) - half, order + 1, increasing=True).astype(float)
    fit = powers @ np.linalg.pinv(powers)
    out = np.zeros((n, n))
    for i in range(half, n - half):
        out[i, i - half : i - half + window] = fit[::-1, half]
    for i in range(half):
        out[i, :window] = fit[i]
        out[n - half + i, n - window :] = fit[window - half + i]
    return out


def savgol(x, window: int = 5, order: int = 2):
    return x @ savgol_matrix(x.shape[1], window, order).T


def xcorr_lag(x, ref, max_shift: int = 0):
    """Delay of each row against ``ref``; ties go to 0, 1, -1, 2, -2 ..."""
    n = x.shape[1]
    limit = max_shift or n // 4
    if not 0 <= limit < n:
        raise ValueError("max_shift out of range")
    a = np.fft.rfft(x - x.mean(axis=1, keepdims=True), 2 * n, axis=1)
    b = np.fft.rfft(ref - ref.mean(), 2 * n)
    c = np.fft.irfft(a * np.conj(b), 2 * n, axis=1)
    order = [0, *(s * k for k in range(1, limit + 1) for s in (1, -1))]
    return np.array(order)[c[:, order].argmax(axis=1)]
