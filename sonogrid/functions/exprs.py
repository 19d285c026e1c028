"""Column builders over sample arrays: everything that SQL's own functions can say.

All are narrow and stay in the JVM.  Arrays of samples are widened before
arithmetic, as ANSI mode raises on overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonogrid.model import FULL_SCALE


def _total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v.cast("double")))


def let(value: Column, body) -> Column:
    """``body`` of a value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def image(signal: Column, mode: str) -> Column:
    if mode == "max":
        return F.array_max(signal).cast("tinyint")
    if mode == "absmax":
        return F.least(F.lit(127), F.greatest(F.abs(F.array_max(signal).cast("int")), F.abs(F.array_min(signal).cast("int")))).cast("tinyint")
    if mode == "power":
        return _total(signal, lambda v: v * v).cast("float")
    raise ValueError(f"unknown image mode {mode!r}")


def normalized(signal: Column) -> Column:
    return F.transform(signal, lambda v: (v.cast("double") / 128).cast("float"))


def gate(x: Column, n: int, start: int = 0, end: int = 0) -> Column:
    end = n if end == 0 else end
    if not 0 <= start < end <= n:
        raise ValueError("invalid gate")
    return F.slice(x, start + 1, end - start)


def downsample(signal: Column, n: int, factor: int, mode: str) -> Column:
    """'sample', 'mean' or 'median' of blocks, truncated to whole numbers."""
    if not 1 <= factor <= n:
        raise ValueError("factor out of range")
    at = F.sequence(F.lit(0), F.lit(n // factor - 1))
    if mode == "sample":
        return F.transform(at, lambda i: F.get(signal, i * factor))
    block = lambda i: F.slice(signal, i * factor + 1, factor)
    if mode == "mean":
        return F.transform(at, lambda i: (_total(block(i)) / factor).cast("tinyint"))
    if mode == "median":
        half = factor // 2

        def middle(s: Column) -> Column:
            if factor % 2:
                return F.get(s, F.lit(half))
            return ((F.get(s, F.lit(half - 1)).cast("double") + F.get(s, F.lit(half))) / 2).cast("tinyint")

        return F.transform(at, lambda i: let(F.array_sort(block(i)), middle))
    raise ValueError(f"unknown downsample mode {mode!r}")


def normalize(x: Column, mode: str = "minmax") -> Column:
    """By the largest magnitude, population z-score or range; a zero divisor counts as one."""
    safe = lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d)
    wide = F.transform(x, lambda v: v.cast("double"))
    if mode == "max":
        return let(wide, lambda w: let(safe(F.array_max(F.transform(w, F.abs))), lambda d: F.transform(w, lambda v: v / d)))
    if mode == "minmax":
        return let(wide, lambda w: let(F.array_min(w), lambda lo: let(safe(F.array_max(w) - lo), lambda d: F.transform(w, lambda v: (v - lo) / d))))
    if mode == "zscore":

        def scaled(w: Column, mean: Column) -> Column:
            return let(safe(F.sqrt(_total(w, lambda v: (v - mean) * (v - mean)) / F.size(w))), lambda d: F.transform(w, lambda v: (v - mean) / d))

        return let(wide, lambda w: let(_total(w) / F.size(w), lambda mean: scaled(w, mean)))
    raise ValueError(f"unknown normalisation {mode!r}")


def detrend(x: Column) -> Column:
    """Less the least-squares line; a single sample is kept."""

    def flat(w: Column) -> Column:
        n = F.size(w).cast("double")
        centre = (n - 1) / 2
        ss = n * (n * n - 1) / 12
        slope = F.aggregate(F.transform(w, lambda v, i: v * (i - centre)), F.lit(0.0), lambda a, v: a + v) / F.when(ss == 0, F.lit(1.0)).otherwise(ss)
        line = lambda b, mean: F.transform(w, lambda v, i: v - mean - b * (i - centre))
        return F.when(n <= 1, w).otherwise(let(slope, lambda b: let(_total(w) / n, lambda mean: line(b, mean))))

    return let(F.transform(x, lambda v: v.cast("double")), flat)


def moving_average(x: Column, n: int, window: int = 5) -> Column:
    """Zero-padded boxcar with taps i - (w - 1) / 2 .. i + w / 2; shorter arrays stay as they are."""
    if window < 1:
        raise ValueError("window must be positive")
    if n < window:
        return F.transform(x, lambda v: v.cast("double"))
    low, high = (window - 1) // 2, window // 2

    def mean(i: Column) -> Column:
        a = F.greatest(i - low, F.lit(0))
        return _total(F.slice(x, a + 1, F.least(i + high, F.lit(n - 1)) - a + 1)) / window

    return F.transform(x, lambda _, i: mean(i))


def kurtosis(x: Column) -> Column:
    """Pearson's, of the population; 0 for a constant."""

    def of(w: Column, mean: Column) -> Column:
        m2 = _total(w, lambda v: (v - mean) * (v - mean)) / F.size(w)
        m4 = _total(w, lambda v: (v - mean) * (v - mean) * (v - mean) * (v - mean)) / F.size(w)
        return let(m2, lambda s: F.when(s == 0, F.lit(0.0)).otherwise(m4 / (s * s)))

    return let(x, lambda w: let(_total(w) / F.size(w), lambda mean: of(w, mean)))


def spectral_entropy(psd: Column, base: float = 2.0) -> Column:
    total = _total(psd)
    inner = lambda t: _total(psd, lambda v: F.when(v > 0, -(v / t) * F.log(v / t)).otherwise(F.lit(0.0))) / math.log(base)
    return let(total, lambda t: F.when(t == 0, F.lit(0.0)).otherwise(inner(t)))


def spectral_flatness(psd: Column) -> Column:
    mean = _total(psd) / F.size(psd)
    return let(mean, lambda m: F.when(m == 0, F.lit(0.0)).otherwise(F.exp(_total(psd, lambda v: F.log(v + 1e-10)) / F.size(psd)) / m))


def spectral_centroid(freqs: list[float], psd: Column) -> Column:
    f = F.array(*[F.lit(float(v)) for v in freqs])
    top = F.aggregate(F.zip_with(f, psd, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return let(_total(psd), lambda t: F.when(t == 0, F.lit(0.0)).otherwise(top / t))


def spectral_energy_ratio(freqs: list[float], psd: Column, critical: float) -> Column:
    cut = sum(f < critical for f in freqs)
    below = _total(F.slice(psd, 1, cut)) if cut else F.lit(0.0)
    above = _total(F.slice(psd, cut + 1, len(freqs) - cut)) if cut < len(freqs) else F.lit(0.0)
    return let(below, lambda b: F.when(b == 0, F.lit(0.0)).otherwise(above / b))


def first_above(signal: Column, threshold: float) -> Column:
    """Index of the first sample over threshold * full scale (signed), -1 if none."""
    return (F.array_position(F.transform(signal, lambda v: v > F.lit(threshold * FULL_SCALE)), F.lit(True)) - 1).cast("int")


def first_magnitude(signal: Column, threshold: float) -> Column:
    """Index of the first sample of magnitude >= threshold * full scale, -1 if none; -128 never crosses."""
    wide = lambda v: v.cast("int")
    crosses = F.transform(signal, lambda v: (F.abs(wide(v)) >= F.lit(threshold * FULL_SCALE)) & (wide(v) != -128))
    return (F.array_position(crosses, F.lit(True)) - 1).cast("int")


def xgates(signal: Column, start: Column, n: int, samples: int, n_gates: int, mode: str) -> Column:
    """Reductions of consecutive gates from ``start``; gates beyond the signal are 0."""
    if mode not in ("max", "absmax", "power"):
        raise ValueError(f"unknown gate mode {mode!r}")

    def reduce(part: Column) -> Column:
        if mode == "power":
            return _total(part, lambda v: v * v)
        if mode == "max":
            return F.array_max(part).cast("double")
        return F.greatest(F.abs(F.array_max(part).cast("int")), F.abs(F.array_min(part).cast("int"))).cast("double")

    actual = F.least(F.lit(n_gates), F.floor((F.lit(n) - start) / samples).cast("int"))
    one = lambda g: F.when((start >= 0) & (g < actual), reduce(F.slice(signal, F.greatest(start, F.lit(0)) + g * samples + 1, samples))).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(n_gates - 1)), lambda g: one(g).cast("float"))


def one_hot(label: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(max(1, width) - 1)), lambda i: (label == i).cast("float"))


def padded(x: Column, length: int, value: float = 0.0) -> Column:
    wide = F.transform(x, lambda v: v.cast("float"))
    return F.concat(wide, F.array_repeat(F.lit(value).cast("float"), F.lit(length) - F.size(x)))


def time_axis(start: Column, header) -> Column:
    """Times of an A-scan's samples; an own origin counts only where it is positive."""
    origin = F.when(start > 0, start).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(header.scanlen - 1)), lambda i: F.lit(float(header.tzero)) + (origin + i) / F.lit(float(header.samplerate)) * 1e3)


def sample_index(t: Column, header) -> Column:
    """Number of the sample nearest to a time of the shared axis, halves to even."""
    return F.rint((t - F.lit(float(header.tzero))) / F.lit(header.spacing)).cast("int")


def sample_time(i: Column, header) -> Column:
    """Time of a sample of the shared axis."""
    return F.lit(float(header.tzero)) + i * F.lit(header.spacing)
