"""A cube to work on: a scan that changes in place, or gives a changed copy.

The operators take scans and return new ones.  This holder keeps the present one:
``in_place`` operations replace it and return the holder, others return a new one.
Turning, mirroring and downsampling are in place unless told otherwise, selections
and alignments are not.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid.model import Header, Scan
from sonogrid.operators import align, imaging, spatial
from sonogrid.operators import labels as L
from sonogrid.sources import store


class Cube:
    def __init__(self, scan: Scan):
        self.scan = scan

    @classmethod
    def from_data(cls, spark: SparkSession, signals, header: Header, labels=None, starts=None, names=("healthy",)) -> Cube:
        return cls(store.from_rows(spark, signals, header, labels, starts, names))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Cube:
        """A stored cube: a folder, or an HDF5 file where h5py is there."""
        if path.lower().endswith(".h5sam"):
            from sonogrid.sources import hdf5

            return cls(hdf5.read_scan_file(spark, path))
        return cls(store.read_scan(spark, path))

    def save(self, path: str) -> None:
        if path.lower().endswith(".h5sam"):
            from sonogrid.sources import hdf5

            return hdf5.write_scan_file(self.scan, path)
        store.write_scan(self.scan, path)

    def __getattr__(self, name: str):
        return getattr(self.scan, name)

    @property
    def header(self) -> Header:
        return self.scan.header

    @header.setter
    def header(self, header: Header) -> None:
        """Not checked against the rows; ``validate`` does that."""
        self.scan = replace(self.scan, header=header)

    @property
    def path(self) -> str:
        return self.scan.path

    @path.setter
    def path(self, path: str) -> None:
        self.scan = replace(self.scan, path=path)

    @property
    def starts(self) -> DataFrame:
        return self.scan.starts

    @starts.setter
    def starts(self, starts: DataFrame | None) -> None:
        """Own origins (scan_idx, start), or None for none; not checked."""
        kept = self.scan.df.drop("start")
        if starts is None:
            kept = kept.withColumn("start", F.lit(None).cast("int"))
        else:
            kept = kept.join(starts.select("scan_idx", F.col("start").cast("int").alias("start")), "scan_idx", "left")
        self.scan = replace(self.scan, df=kept.select(*self.scan.df.columns))

    def __len__(self) -> int:
        return len(self.scan)

    def __iter__(self):
        return iter(self.scan)

    def __array__(self, dtype=None, copy=None):
        return self.scan.__array__(dtype, copy)

    def __getitem__(self, index) -> DataFrame:
        return spatial.read_rows(self.scan, index)

    def copy(self) -> Cube:
        return Cube(self.scan)

    def _now(self, scan: Scan, in_place: bool) -> Cube:
        if not in_place:
            return Cube(scan)
        self.scan = scan
        return self

    def rotate(self, degrees: int, in_place: bool = True) -> Cube:
        return self._now(spatial.rotate(self.scan, degrees), in_place)

    def mirror(self, axis: str, in_place: bool = True) -> Cube:
        return self._now(spatial.mirror(self.scan, axis), in_place)

    def downsample(self, factor: int, mode: str = "decimate", in_place: bool = True) -> Cube:
        return self._now(spatial.downsample(self.scan, factor, mode), in_place)

    def rectangle_select(self, line_start: int, line_end: int, col_start: int, col_end: int, in_place: bool = False) -> Cube:
        return self._now(spatial.rectangle_select(self.scan, line_start, line_end, col_start, col_end), in_place)

    def index_range_select(self, start: int, end: int, in_place: bool = False) -> Cube:
        return self._now(spatial.index_range_select(self.scan, start, end), in_place)

    def time_range_select(self, t0: float, t1: float, in_place: bool = False) -> Cube:
        return self._now(spatial.time_range_select(self.scan, t0, t1), in_place)

    def align_manual(self, offsets: DataFrame, length: int, in_place: bool = False) -> Cube:
        return self._now(align.align_manual(self.scan, offsets, length), in_place)

    def align_zgate(self, threshold: float = 0.2, length: int = 2000, in_place: bool = False) -> Cube:
        return self._now(align.align_zgate(self.scan, threshold, length), in_place)

    def align_xcorr(self, reference: int = 0, max_shift: int | None = None, max_gate_loss: float = 1.0, in_place: bool = False) -> Cube:
        return self._now(align.align_xcorr(self.scan, reference, max_shift, max_gate_loss), in_place)

    def align_tof(self, gate_ns: float, reference: int = 0, start_ns: float = 0.0, max_gate_loss: float = 1.0, in_place: bool = False) -> Cube:
        return self._now(align.align_tof(self.scan, gate_ns, reference, start_ns, max_gate_loss), in_place)

    def set_labels(self, labels: DataFrame, names=("healthy",)) -> Cube:
        return self._now(L.set_labels(self.scan, labels, names), True)

    @property
    def label_set(self) -> L.Labels:
        return L.Labels.of(self.scan)

    def image(self, mode: str = "absmax") -> DataFrame:
        return imaging.image(self.scan, mode)

    def normalized_data(self) -> DataFrame:
        return imaging.normalized_data(self.scan)

    def tof(self, start: int = 0, end: int = 0, sub_sample: bool = True) -> DataFrame:
        return imaging.tof(self.scan, start, end, sub_sample)

    def thickness(self, sound_speed: float, start: int = 0, end: int = 0, sub_sample: bool = True) -> DataFrame:
        return imaging.thickness(self.scan, sound_speed, start, end, sub_sample)
