"""Selections, rotations, mirrors and downsampling: key arithmetic and slices, no data movement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sonogrid.functions import exprs, kernels
from sonogrid.functions.arrow import with_kernel
from sonogrid.model import Scan


def _moved(scan: Scan, line, col, nlines: int, cols: int, df=None) -> Scan:
    df = (scan.df if df is None else df).withColumns({"line": line.cast("int"), "col": col.cast("int")})
    df = df.withColumn("scan_idx", (F.col("line") * cols + F.col("col")).cast("int"))
    return scan.with_df(df, nlines=nlines, scanspline=cols)


def rotate(scan: Scan, degrees: int) -> Scan:
    """Clockwise by a multiple of 90 degrees."""
    turn = degrees % 360
    nl, nc = scan.header.nlines, scan.header.scanspline
    line, col = F.col("line"), F.col("col")
    if turn == 0:
        return scan
    if turn == 90:
        return _moved(scan, col, nl - 1 - line, nc, nl)
    if turn == 180:
        return _moved(scan, nl - 1 - line, nc - 1 - col, nl, nc)
    if turn == 270:
        return _moved(scan, nc - 1 - col, line, nc, nl)
    raise ValueError("only multiples of 90 degrees")


def mirror(scan: Scan, axis: str) -> Scan:
    """'x' reverses columns, 'y' lines."""
    nl, nc = scan.header.nlines, scan.header.scanspline
    if axis.lower() == "x":
        return _moved(scan, F.col("line"), nc - 1 - F.col("col"), nl, nc)
    if axis.lower() == "y":
        return _moved(scan, nl - 1 - F.col("line"), F.col("col"), nl, nc)
    raise ValueError(f"unknown axis {axis!r}")


def rectangle_select(scan: Scan, line_start: int, line_end: int, col_start: int, col_end: int) -> Scan:
    h = scan.header
    if not (0 <= line_start < line_end <= h.nlines and 0 <= col_start < col_end <= h.scanspline):
        raise ValueError("invalid rectangle")
    inside = scan.df.where((F.col("line") >= line_start) & (F.col("line") < line_end) & (F.col("col") >= col_start) & (F.col("col") < col_end))
    cut = _moved(scan, F.col("line") - line_start, F.col("col") - col_start, line_end - line_start, col_end - col_start, inside)
    return cut.with_df(cut.df, rest=0)


def has_starts(scan: Scan) -> bool:
    return scan.df.where("start is not null").limit(1).count() > 0


def index_range_select(scan: Scan, start: int, end: int, aligned: bool | None = None) -> Scan:
    """Samples [start, end); own origins move along, else the shared one does.

    ``aligned`` says whether the scan has own origins; None looks (one small job).
    """
    from sonogrid.operators.align import collapse_starts

    h = scan.header
    start, end = max(0, start), min(h.scanlen, end)
    if start >= end:
        raise ValueError("empty range")
    cut = scan.df.withColumn("signal", F.slice("signal", start + 1, end - start))
    if has_starts(scan) if aligned is None else aligned:
        cut = cut.withColumn("start", F.when(F.col("start") == -1, F.col("start")).otherwise(F.col("start") + start))
        return collapse_starts(scan.with_df(cut, scanlen=end - start))
    return scan.with_df(cut, scanlen=end - start, tzero=round(h.tzero + start * h.spacing))


def time_range_select(scan: Scan, t0: float, t1: float, aligned: bool | None = None) -> Scan:
    """Samples between two times of the shared axis, in ns."""
    return index_range_select(scan, scan.header.sample_index(t0), scan.header.sample_index(t1), aligned)


def downsample(scan: Scan, factor: int, mode: str = "decimate") -> Scan:
    """'decimate' (zero-phase low-pass), 'mean', 'median' or 'sample'; results are cut to whole numbers."""
    h = scan.header
    if not 1 <= factor <= h.scanlen:
        raise ValueError("factor out of range")
    if mode == "decimate":
        run = lambda x: np.trunc(np.clip(kernels.decimate(x, factor), -128, 127)).astype(np.int8)
        df = with_kernel(scan.df, h.scanlen, run, {"signal": ("tinyint", 1)}).select(*scan.df.columns)
    else:
        df = scan.df.withColumn("signal", exprs.downsample(F.col("signal"), h.scanlen, factor, mode))
    df = df.withColumn("start", F.when(F.col("start") < 0, F.lit(-1)).otherwise(F.expr(f"start div {factor}")).cast("int"))
    return scan.with_df(df, scanlen=h.scanlen // factor, samplerate=h.samplerate / factor, downsample_factor=h.downsample_factor * factor)


def read_rows(scan: Scan, index) -> Scan | object:
    """A-scans by number, slice or (line, col); filters reach the Parquet scan."""
    n = scan.num_scans
    if isinstance(index, tuple):
        line, col = index
        if not (0 <= line and 0 <= col < scan.header.scanspline and line * scan.header.scanspline + col < n):
            raise IndexError("place out of range")
        return scan.df.where((F.col("line") == line) & (F.col("col") == col))
    if isinstance(index, slice):
        a, b, step = index.indices(n)
        if step < 0:
            taken = range(a, b, step)
            a, b, step = (taken[-1], taken[0] + 1, -step) if len(taken) else (0, 0, 1)
        return scan.df.where((F.col("scan_idx") >= a) & (F.col("scan_idx") < b) & ((F.col("scan_idx") - a) % step == 0))
    if isinstance(index, int):
        index = index + n if index < 0 else index
        if not 0 <= index < n:
            raise IndexError("A-scan out of range")
        return scan.df.where(F.col("scan_idx") == index)
    raise TypeError("an int, a slice or (line, col)")
