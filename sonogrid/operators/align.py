"""Registration in time: an aggregate over all A-scans, then a narrow pass.

The new header depends on the data (spread of the offsets, common origin), so
these calls run one aggregate at once.  It holds all that the header needs; the
result is a lazy narrow pass, so a kernel runs once for the header and once for the
result, and no signal is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.functions import exprs, kernels
from sonogrid.functions.arrow import with_kernel
from sonogrid.model import Scan
from sonogrid.operators.imaging import peak_positions


def collapse_starts(scan: Scan) -> Scan:
    """If all A-scans have one origin, it moves into the header."""
    seen = scan.df.agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.count("start").alias("n"), F.count("*").alias("rows")).first()
    if not seen.n or seen.n < seen.rows or seen.lo != seen.hi or seen.lo < 0:
        return scan
    h = scan.header
    return scan.with_df(scan.df.withColumn("start", F.lit(None).cast("int")), tzero=h.tzero + round(seen.lo / h.samplerate * 1e3))


def _cropped(scan: Scan, df: DataFrame, length: int, origins=None) -> Scan:
    """Cut each A-scan at its ``offset``; -1 (new or old) silences it.

    ``origins``: (least, greatest) new origin, if known; a common one moves into the header.
    """
    gone = (F.col("offset") == -1) | (F.coalesce(F.col("start"), F.lit(0)) == -1)
    start = F.when(gone, F.lit(-1)).otherwise(F.coalesce(F.col("start"), F.lit(0)) + F.col("offset")).cast("int")
    if origins is None:
        seen = df.select(start.alias("start")).agg(F.min("start").alias("lo"), F.max("start").alias("hi")).first()
        origins = (seen.lo, seen.hi)
    silent = F.array_repeat(F.lit(0).cast("tinyint"), length)
    cut = df.withColumn("signal", F.when(gone, silent).otherwise(F.slice("signal", F.greatest(F.col("offset"), F.lit(0)) + 1, F.lit(length))))
    lo, hi = origins
    if lo is None or lo != hi or lo < 0:
        return scan.with_df(cut.withColumn("start", start).select(*scan.df.columns), scanlen=length)
    cut = cut.withColumn("start", F.lit(None).cast("int"))
    return scan.with_df(cut.select(*scan.df.columns), scanlen=length, tzero=scan.header.tzero + round(lo / scan.header.samplerate * 1e3))


def align_manual(scan: Scan, offsets: DataFrame, length: int) -> Scan:
    """Cut each A-scan at its own offset (scan_idx, offset), relative to the present window; -1: no alignment."""
    old = scan.header.scanlen
    if not 0 < length <= old:
        raise ValueError("the new length must be positive and at most the old")
    bad = offsets.where((F.col("offset") != -1) & ((F.col("offset") < 0) | (F.col("offset") > old - length)))
    if bad.limit(1).count():
        raise ValueError("an offset leaves the A-scan")
    return _cropped(scan, scan.df.join(offsets.select("scan_idx", "offset"), "scan_idx"), length)


def align_zgate(scan: Scan, threshold: float = 0.2, length: int = 2000) -> Scan:
    """Cut from the first sample of at least threshold * full scale."""
    if not 0 <= threshold <= 1 or not 0 < length <= scan.header.scanlen:
        raise ValueError("invalid threshold or length")
    first = exprs.first_magnitude(F.col("signal"), threshold)
    at = F.when(F.col("first") < 0, F.lit(-1)).otherwise(F.least(F.col("first"), F.lit(scan.header.scanlen - length)))
    return _cropped(scan, scan.df.withColumn("first", first).withColumn("offset", at), length)


def _common(scan: Scan, df: DataFrame, max_gate_loss: float) -> Scan:
    """Crop to the common overlap of A-scans shifted by ``lag`` (NULL: none)."""
    n = scan.header.scanlen
    start = F.coalesce(F.col("start"), F.lit(0))
    kept = F.col("lag").isNotNull() & (start != -1)
    seen = df.agg(
        F.min("lag").alias("lo"),
        F.max("lag").alias("hi"),
        F.min(F.when(kept, start + F.col("lag"))).alias("first"),
        F.max(F.when(kept, start + F.col("lag"))).alias("last"),
        F.count(F.when(~kept, 1)).alias("gone"),
    ).first()
    spread = seen.hi - seen.lo
    if spread >= n or (max_gate_loss < 1 and spread > max_gate_loss * n):
        raise ValueError("the shifts lose too much of the gate")
    df = df.withColumn("offset", F.coalesce(F.col("lag") - F.lit(seen.lo), F.lit(-1)).cast("int"))
    origins = (-1, -1) if seen.gone or seen["first"] is None else (seen["first"] - seen.lo, seen["last"] - seen.lo)
    return _cropped(scan, df, n - spread, origins)


def align_xcorr(scan: Scan, reference: int = 0, max_shift: int | None = None, max_gate_loss: float = 1.0) -> Scan:
    """Register by cross-correlation with one A-scan."""
    n = scan.header.scanlen
    row = scan.df.where(F.col("scan_idx") == reference).select("signal").first()
    if row is None:
        raise IndexError("reference out of range")
    ref = np.array(row.signal, float)
    lagged = with_kernel(scan.df, n, lambda x: kernels.xcorr_lag(x, ref, max_shift or 0), {"lag": ("int", 0)}, drop=False)
    return _common(scan, lagged, max_gate_loss)


def align_tof(scan: Scan, gate_ns: float, reference: int = 0, start_ns: float = 0.0, max_gate_loss: float = 1.0) -> Scan:
    """Register by the strongest echo in a window; A-scans without one lose their alignment."""
    h = scan.header
    a = min(max(0, int(kernels.round_half_away(start_ns / h.spacing))), h.scanlen - 1)
    b = min(h.scanlen, a + max(1, int(kernels.round_half_away(gate_ns / h.spacing))))
    placed = peak_positions(scan, a, b)
    own = placed.where(F.col("scan_idx") == reference).select("pos").first()
    if own is None or own.pos < 0:
        raise ValueError("the reference has no peak")
    lag = F.when(F.col("pos") >= 0, F.round(F.col("pos") - F.lit(float(own.pos))).cast("int"))
    return _common(scan, placed.withColumn("lag", lag), max_gate_loss)
