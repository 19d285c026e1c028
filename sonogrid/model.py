"""Header, constants and the Scan: a DataFrame of A-scans with its plan-time header.

One row is one A-scan: scan_idx, line, col, start (NULL without alignment, -1
unaligned), label (-1 unlabelled, 0 healthy), signal (array of tinyint).  The
header is small, fixes the arrays' length, and lives beside the DataFrame.
Operations return new scans; nothing is changed in place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

FULL_SCALE = 127
NO_TOF = -1.0
LABEL_UNLABELED = -1
LABEL_HEALTHY = 0
MAX_LABELS = 128
#: header entries of old files, without meaning now
OLD_ATTRIBUTES = ("headerlen", "bytes_p_sample", "version")


@dataclass(frozen=True)
class Header:
    """Acquisition parameters: MHz, ns, micrometres."""

    scanspline: int
    nlines: int
    scanlen: int
    samplerate: float = 100.0
    tzero: int = 0
    resolution: float = 1.0
    interpolated: bool = False
    quality: bool = False
    mode: str = ""
    transducer_in: str = ""
    transducer_through: str = ""
    cellid: str = ""
    downsample_factor: int = 1
    #: A-scans of a last line that is not whole, beyond ``nlines``
    rest: int = 0
    extra: dict = field(default_factory=dict, hash=False)

    @property
    def num_scans(self) -> int:
        return self.nlines * self.scanspline + self.rest

    @property
    def spacing(self) -> float:
        """Nanoseconds between samples."""
        return 1e3 / self.samplerate

    def time(self, start: int = 0, end: int = -1) -> list[float]:
        end = self.scanlen if end < start else end
        return [self.tzero + (start + i) / self.samplerate * 1e3 for i in range(end - start)]

    def sample_index(self, t: float) -> int:
        return round((t - self.tzero) / self.spacing)

    def sample_time(self, i: int) -> float:
        return self.tzero + i * self.spacing

    def relative_time(self) -> list[float]:
        """Times of the shared axis."""
        return self.time()

    def copy(self) -> Header:
        return replace(self, extra=dict(self.extra))

    def set_extra(self, key: str, value) -> Header:
        """A header with one more entry, which must be a number, a truth value or text."""
        if not isinstance(value, (bool, int, float, str)):
            raise TypeError("an extra entry is a number, a truth value or text")
        return replace(self, extra={**self.extra, key: value})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Header:
        return cls.from_attributes(json.loads(text))

    @classmethod
    def from_attributes(cls, given: dict) -> Header:
        """Known names are made their kind; fields of old files are dropped, unknown names go to ``extra``."""
        kinds = {f.name: type(f.default) for f in fields(cls) if f.name not in ("extra", "scanspline", "nlines", "scanlen")}
        kinds |= dict.fromkeys(("scanspline", "nlines", "scanlen"), int)
        known = {k: kinds[k](v) for k, v in given.items() if k in kinds}
        more = {k: v for k, v in given.items() if k not in kinds and k not in ("extra", *OLD_ATTRIBUTES)}
        return cls(**known, extra={**given.get("extra", {}), **more})


@dataclass(frozen=True)
class Scan:
    """A cube of A-scans."""

    df: DataFrame
    header: Header
    label_names: tuple[str, ...] = ("healthy",)
    path: str = ""

    def __len__(self) -> int:
        return self.num_scans

    def __iter__(self) -> Iterator:
        """The A-scans' rows in order; partitions arrive on the driver one at a time."""
        return self.df.orderBy("scan_idx").toLocalIterator()

    def __hash__(self) -> int:
        return hash((id(self.df), self.header_hash, self.label_names, self.path))

    def __array__(self, dtype=None, copy=None):
        """All samples as a matrix on the driver, in order."""
        import numpy as np

        if copy is False:
            raise ValueError("samples are gathered from the cluster: a copy cannot be avoided")
        return np.array([r.signal for r in self], np.int8 if dtype is None else dtype).reshape(len(self), -1)

    @property
    def num_scans(self) -> int:
        return self.header.num_scans

    @property
    def header_hash(self) -> int:
        return hash(self.header.to_json())

    @property
    def rows(self) -> int:
        return self.header.nlines

    @property
    def cols(self) -> int:
        return self.header.scanspline

    @property
    def scanlen(self) -> int:
        return self.header.scanlen

    @property
    def samplerate(self) -> float:
        return self.header.samplerate

    @property
    def downsample_factor(self) -> int:
        return self.header.downsample_factor

    @property
    def labels(self) -> DataFrame:
        return self.df.select("scan_idx", "label")

    @property
    def starts(self) -> DataFrame:
        """(scan_idx, start): own origins in samples, NULL without alignment."""
        return self.df.select("scan_idx", "start")

    def start_of(self, index: int) -> int | None:
        if not 0 <= index < self.num_scans:
            raise IndexError("A-scan out of range")
        row = self.df.where(f"scan_idx = {int(index)}").select("start").first()
        return None if row is None else row.start

    def time(self, index: int | None = None) -> list[float]:
        """Times of one A-scan's samples; an own origin counts only where it is positive."""
        start = None if index is None else self.start_of(index)
        return self.header.time(start, start + self.scanlen) if start and start > 0 else self.header.time()

    def relative_time(self) -> list[float]:
        return self.header.time()

    def absolute_time(self, index: int) -> list[float]:
        return self.time(index)

    @property
    def loaded(self) -> bool:
        """Whether the rows are held in the cluster's memory or disks."""
        return self.df.storageLevel.useMemory or self.df.storageLevel.useDisk

    def load(self) -> Scan:
        """Hold the rows in the cluster's memory and disks; as lazily or not, results are the same."""
        self.df.persist().count()
        return self

    def materialize(self) -> Scan:
        return self.load()

    @property
    def materialized(self) -> bool:
        return self.loaded

    @property
    def backing(self) -> list[str]:
        """Files the rows are read from."""
        return self.df.inputFiles()

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.header.nlines, self.header.scanspline, self.header.scanlen

    def with_df(self, df: DataFrame, **header) -> Scan:
        return replace(self, df=df, header=replace(self.header, **header))

    def validate(self) -> Scan:
        """Raise unless every place has one A-scan of the header's length."""
        from pyspark.sql import functions as F

        h = self.header
        seen = self.df.agg(F.count("*").alias("n"), F.min(F.size("signal")).alias("lo"), F.max(F.size("signal")).alias("hi")).first()
        if seen.n != h.num_scans or (seen.n and (seen.lo != h.scanlen or seen.hi != h.scanlen)):
            raise ValueError("data mismatch with header")
        return self
