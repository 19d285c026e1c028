"""Images, gates, time of flight, spectra and filters of a scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonogrid.functions import exprs, kernels
from sonogrid.functions.arrow import with_kernel
from sonogrid.model import NO_TOF, Scan

PLACE = ["scan_idx", "line", "col"]


def image(scan: Scan, mode: str = "absmax") -> DataFrame:
    """C-scan (scan_idx, line, col, value): 'max', 'absmax' or 'power'."""
    return scan.df.select(*PLACE, exprs.image(F.col("signal"), mode).alias("value"))


def normalized_data(scan: Scan) -> DataFrame:
    return scan.df.select(*PLACE, exprs.normalized(F.col("signal")).alias("signal"))


def _gate(scan: Scan, start: int, end: int) -> tuple[int, int]:
    end = end or scan.header.scanlen
    if not 0 <= start < end <= scan.header.scanlen:
        raise ValueError("invalid gate")
    return start, end


def peak_positions(scan: Scan, start: int = 0, end: int = 0, sub_sample: bool = True) -> DataFrame:
    """The scan's rows with ``pos``, the envelope's peak in samples (-1: none)."""
    start, end = _gate(scan, start, end)
    return with_kernel(scan.df, scan.header.scanlen, lambda x: kernels.peak_position(x, start, end, sub_sample), {"pos": ("double", 0)}, drop=False)


def _tof(scan: Scan) -> Column:
    """ns of ``pos``; NO_TOF without a peak."""
    return F.when(F.col("pos") < 0, F.lit(NO_TOF)).otherwise(F.lit(float(scan.header.tzero)) + F.col("pos") * scan.header.spacing)


def tof(scan: Scan, start: int = 0, end: int = 0, sub_sample: bool = True) -> DataFrame:
    """Time of flight in ns of the strongest echo in the gate."""
    start, end = _gate(scan, start, end)
    found = with_kernel(scan.df.select(*PLACE, "signal"), scan.header.scanlen, lambda x: kernels.peak_position(x, start, end, sub_sample), {"pos": ("double", 0)})
    return found.select(*PLACE, _tof(scan).cast("float").alias("tof"))


def thickness(scan: Scan, sound_speed: float, start: int = 0, end: int = 0, sub_sample: bool = True) -> DataFrame:
    """Metres: time of flight times half the speed; NO_TOF is kept."""
    if sound_speed <= 0:
        raise ValueError("the sound speed must be positive")
    metres = F.when(F.col("tof") == NO_TOF, F.col("tof")).otherwise((F.col("tof") * F.lit(sound_speed * 1e-9 / 2).cast("float")).cast("float"))
    return tof(scan, start, end, sub_sample).select(*PLACE, metres.alias("thickness"))


def xgate(scan: Scan, gate_ns: float, n_gates: int = 50, pick: str = "tof", threshold: float | None = None, mode: str = "max") -> DataFrame:
    """(gates, gate_start): reductions of consecutive gates from each A-scan's pick; a failed pick is -1 and all zero."""
    if gate_ns <= 0 or n_gates <= 0:
        raise ValueError("gates must have a length and a number")
    if pick == "threshold" and threshold is None:
        pick = "none"
    h = scan.header
    samples = max(1, int(kernels.round_half_away(gate_ns / h.spacing)))
    df = scan.df.select(*PLACE, "signal")
    if pick == "none":
        df = df.withColumn("gate_start", F.lit(0))
    elif pick == "threshold":
        if not 0 <= threshold <= 1:
            raise ValueError("the threshold must lie between 0 and 1")
        df = df.withColumn("gate_start", exprs.first_above(F.col("signal"), threshold))
    elif pick == "tof":
        df = with_kernel(df, h.scanlen, lambda x: kernels.peak_position(x, 0, h.scanlen), {"pos": ("double", 0)}, drop=False)
        at = (_tof(scan).cast("float").cast("double") - float(h.tzero)) / h.spacing
        df = df.withColumn("gate_start", F.when(F.col("pos") < 0, F.lit(-1)).otherwise(F.round(at).cast("int")))
    else:
        raise ValueError(f"unknown pick {pick!r}")
    return df.select(*PLACE, "gate_start", exprs.xgates(F.col("signal"), F.col("gate_start"), h.scanlen, samples, n_gates, mode).alias("gates"))


def spectrum(scan: Scan, kind: str = "float") -> tuple[list[float], DataFrame]:
    """Frequencies in Hz and the magnitudes of each A-scan."""
    n = scan.header.scanlen
    freqs = [k * scan.header.samplerate * 1e6 / n for k in range(n // 2 + 1)]
    return freqs, with_kernel(scan.df.select(*PLACE, "signal"), n, kernels.rfft_magnitude, {"spectrum": (kind, 1)})


def _spectral(scan: Scan, nperseg: int, noverlap: int, f_min: float, f_max: float):
    fs = scan.header.samplerate * 1e6
    kernels.frames(scan.header.scanlen, nperseg, noverlap)
    freqs, bins = kernels.band(nperseg, fs, f_min, f_max)
    return fs, freqs.tolist(), bins


def frame_times(scan: Scan, nperseg: int, noverlap: int, absolute: bool = True) -> list[float]:
    origin = scan.header.tzero * 1e-9 if absolute else 0.0
    return kernels.frame_times(scan.header.scanlen, nperseg, noverlap, scan.header.samplerate * 1e6, origin).tolist()


def compute_stft(scan: Scan, nperseg: int = 256, noverlap: int = 128, f_min: float = 0.0, f_max: float = 0.0, absolute: bool = True, kind: str = "float"):
    """(frequencies, times, rows with re and im as [bin][frame])."""
    _, freqs, bins = _spectral(scan, nperseg, noverlap, f_min, f_max)

    def run(x):
        z = kernels.stft(x, nperseg, noverlap, bins)
        return z.real, z.imag

    return freqs, frame_times(scan, nperseg, noverlap, absolute), with_kernel(scan.df.select(*PLACE, "signal"), scan.header.scanlen, run, {"re": (kind, 2), "im": (kind, 2)})


def psd(scan: Scan, nperseg: int = 256, noverlap: int = 128, f_min: float = 0.0, f_max: float = 0.0, kind: str = "float"):
    """(frequencies, rows with the Welch density)."""
    fs, freqs, bins = _spectral(scan, nperseg, noverlap, f_min, f_max)
    return freqs, with_kernel(scan.df.select(*PLACE, "signal"), scan.header.scanlen, lambda x: kernels.psd(x, nperseg, noverlap, bins, fs), {"psd": (kind, 1)})


def power_spectrogram(scan: Scan, nperseg: int = 256, noverlap: int = 128, f_min: float = 0.0, f_max: float = 0.0, absolute: bool = True, kind: str = "float"):
    """(frequencies, times, rows with the density as [bin][frame])."""
    fs, freqs, bins = _spectral(scan, nperseg, noverlap, f_min, f_max)
    run = lambda x: kernels.power_spectrogram(x, nperseg, noverlap, bins, fs)
    return freqs, frame_times(scan, nperseg, noverlap, absolute), with_kernel(scan.df.select(*PLACE, "signal"), scan.header.scanlen, run, {"power": (kind, 2)})


def stft_peaks(scan: Scan, nperseg: int = 256, noverlap: int = 128, f_min: float = 0.0, f_max: float = 0.0, absolute: bool = True) -> DataFrame:
    """peak_bin, peak_frame and their frequency and time: the first of the largest magnitudes."""
    _, freqs, bins = _spectral(scan, nperseg, noverlap, f_min, f_max)
    times = frame_times(scan, nperseg, noverlap, absolute)
    found = with_kernel(scan.df.select(*PLACE, "signal"), scan.header.scanlen, lambda x: kernels.stft_peaks(x, nperseg, noverlap, bins), {"peak_bin": ("int", 0), "peak_frame": ("int", 0)})
    pick = lambda values, at: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(at))
    return found.withColumns({"peak_frequency": pick(freqs, "peak_bin"), "peak_time": pick(times, "peak_frame")})


def phase_stats(scan: Scan) -> DataFrame:
    out = {"phase_mean": ("double", 0), "phase_variance": ("double", 0)}
    return with_kernel(scan.df.select(*PLACE, "signal"), scan.header.scanlen, kernels.phase_stats, out)


def analytic(scan: Scan) -> DataFrame:
    def run(x):
        z = kernels.analytic(x)
        return z.real, z.imag

    return with_kernel(scan.df.select(*PLACE, "signal"), scan.header.scanlen, run, {"re": ("double", 1), "im": ("double", 1)})


#: strategies that a plan of built-in expressions says, and those that need a kernel
def preprocess_column(x: Column, n: int, strategy: str, **options) -> Column | None:
    """A built-in expression for the strategy, or None."""
    if strategy == "normalize":
        return exprs.normalize(x, options.get("mode", "minmax"))
    if strategy == "detrend":
        return exprs.detrend(x)
    if strategy == "moving_average":
        return exprs.moving_average(x, n, options.get("window", 5))
    if strategy == "gate":
        return exprs.gate(x, n, options.get("start", 0), options.get("end", 0))
    return None


def preprocess_kernel(strategy: str, n: int, **options):
    """A kernel for the strategy, designed once."""
    if strategy == "lp":
        b, a = kernels.butter_lowpass(options["cutoff"], options["fs"])
        return lambda x: kernels.lfilter(b, a, x)
    if strategy == "bp":
        b, a = kernels.butter_bandpass(options["lo"], options["hi"], options["fs"])
        return lambda x: kernels.lfilter(b, a, x)
    if strategy == "savgol":
        m = kernels.savgol_matrix(n, options.get("window_length", 5), options.get("polyorder", 2))
        return lambda x: x @ m.T
    if strategy == "medfilt":
        size = options.get("kernel_size", 3)
        kernels.medfilt(np.zeros((1, n)), size)  # an invalid size is an error of the plan
        return lambda x: kernels.medfilt(x, size)
    if strategy == "envelope":
        return kernels.envelope
    raise ValueError(f"unknown strategy {strategy!r}")


def preprocess(df: DataFrame, n: int, steps: list[tuple[str, dict]], column: str = "x", kind: str = "float") -> tuple[DataFrame, int]:
    """A chain of strategies on an array column; consecutive kernels share one Python pass.

    Returns the DataFrame and the arrays' new length.
    """
    pending: list = []

    def flush(df, n):
        if not pending:
            return df
        chain = list(pending)
        pending.clear()

        def run(x):
            for f in chain:
                x = f(x)
            return x

        return with_kernel(df, n, run, {column: ("double", 1)}, column)

    for strategy, options in steps:
        built_in = preprocess_column(F.col(column), n, strategy, **options)
        if built_in is None:
            pending.append(preprocess_kernel(strategy, n, **options))
            continue
        df = flush(df, n).withColumn(column, built_in)
        if strategy == "gate":
            n = (options.get("end", 0) or n) - options.get("start", 0)
    return flush(df, n).withColumn(column, F.col(column).cast(f"array<{kind}>")), n
