"""Parquet stores of scans and datasets, and a synthetic generator.

A scan is a folder with ``ascans`` (Parquet) and ``header`` (one JSON row); a
dataset has ``samples`` and ``cubes``.  Reading is lazy, and filters on lines or
numbers reach the Parquet scan.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid.functions.exprs import let
from sonogrid.model import Header, Scan
from sonogrid.operators.dataset import Dataset

FORMAT_VERSION = 1
CODEC = "zstd"
BLOCK_BYTES = 16 << 20
#: 2**31 - 1: squares below it fit a long
NOISE_PRIME = 2147483647
ASCANS = "scan_idx int, line int, col int, start int, label tinyint, signal array<tinyint>"


def from_rows(spark: SparkSession, signals, header: Header, labels=None, starts=None, names=("healthy",)) -> Scan:
    """A scan from a few rows of samples on the driver."""
    cols = header.scanspline
    rows = [
        (i, i // cols, i % cols, None if starts is None else int(starts[i]), -1 if labels is None else int(labels[i]), [int(v) for v in s])
        for i, s in enumerate(signals)
    ]
    return Scan(spark.createDataFrame(rows, ASCANS), header, tuple(names)).validate()


def _writer(df: DataFrame, codec: str, block_bytes: int):
    """Parquet with a codec and a size of row groups, the unit that readers skip or load."""
    return df.write.mode("overwrite").option("compression", codec).option("parquet.block.size", block_bytes)


def write_scan(scan: Scan, path: str, codec: str = CODEC, block_bytes: int = BLOCK_BYTES) -> None:
    _writer(scan.df.select("scan_idx", "line", "col", "start", "label", "signal"), codec, block_bytes).parquet(f"{path}/ascans")
    meta = {"version": FORMAT_VERSION, "header": scan.header.to_json(), "label_names": json.dumps(list(scan.label_names))}
    scan.spark.createDataFrame([meta], "version int, header string, label_names string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def _version(found: int) -> None:
    if found > FORMAT_VERSION:
        warnings.warn(f"format version {found} is newer than {FORMAT_VERSION}", stacklevel=3)


def read_scan(spark: SparkSession, path: str, first: int | None = None, count: int | None = None) -> Scan:
    """A scan, or its A-scans first .. first + count - 1."""
    meta = spark.read.parquet(f"{path}/header").first()
    _version(meta.version)
    header = Header.from_json(meta.header)
    df = spark.read.schema(ASCANS).parquet(f"{path}/ascans")
    if first is not None:
        if first < 0 or count < 0 or first + count > header.num_scans:
            raise ValueError("rows out of range")
        df = df.where((F.col("scan_idx") >= first) & (F.col("scan_idx") < first + count))
    return Scan(df, header, tuple(json.loads(meta.label_names)), path)


def write_dataset(ds: Dataset, path: str, codec: str = CODEC, block_bytes: int = BLOCK_BYTES) -> None:
    """Samples with features and extra vectors if there are any; splits are not stored."""
    _writer(ds.df.drop("split"), codec, block_bytes).parquet(f"{path}/samples")
    rows = [(FORMAT_VERSION, c, h.to_json(), json.dumps(list(ds.label_names)), ds.maxlen, ds.unsupervised, ds.num_features) for c, h in enumerate(ds.headers)]
    cubes = ds.df.sparkSession.createDataFrame(rows, "version int, cube_id int, header string, label_names string, maxlen int, unsupervised boolean, num_features int")
    cubes.coalesce(1).write.mode("overwrite").parquet(f"{path}/cubes")


def read_dataset(spark: SparkSession, path: str) -> Dataset:
    """A dataset; its padding value is 0 again.  Stored labels of an unsupervised one are not read."""
    cubes = spark.read.parquet(f"{path}/cubes").orderBy("cube_id").collect()
    _version(cubes[0].version)
    headers = tuple(Header.from_json(c.header) for c in cubes)
    df, names = spark.read.parquet(f"{path}/samples"), tuple(json.loads(cubes[0].label_names))
    if cubes[0].unsupervised:
        df, names = df.withColumn("label", F.lit(None).cast("tinyint")), ("healthy",)
    return Dataset(df, headers, names, cubes[0].maxlen, cubes[0].unsupervised, num_features=cubes[0].num_features)


def convert(spark: SparkSession, paths: list[str], out: str, pad_value: float = 0.0, unsupervised: bool | None = None) -> Dataset:
    """Pool stored scans into a stored dataset; labels are stored, merged by name, even if it is unsupervised."""
    from sonogrid.operators import labels as L
    from sonogrid.operators.dataset import pool

    scans = [read_scan(spark, p) for p in paths]
    ds = pool(scans, pad_value, unsupervised)
    if ds.unsupervised and any(L.is_labeled(s.df) for s in scans):
        kept = pool(scans, pad_value, unsupervised, keep_labels=True)
        ds = replace(ds, df=kept.df, label_names=kept.label_names)
    write_dataset(ds, out)
    return read_dataset(spark, out)


def synthetic(spark: SparkSession, header: Header, seed: int = 42, noise: float = 2.0, offset: float = 19.0) -> Scan:
    """Sine bursts in noise, made by the cluster from a seeded integer recursion on (A-scan, sample)."""
    n = header.num_scans

    def u(i, k: int):
        """A number in (0, 1): squares and products modulo NOISE_PRIME."""
        first = (F.col("id") * 1000003 + i.cast("bigint") * 7919 + k * 104729 + seed * 611953) % NOISE_PRIME
        last = lambda x: let((((x * x + 12820163) % NOISE_PRIME) * 48271 + x) % NOISE_PRIME, lambda y: (y * y + 362437) % NOISE_PRIME)
        return (let(first, last) + 1) / F.lit(float(NOISE_PRIME + 1))

    gauss = lambda i: F.sqrt(-2 * F.log(u(i, 1))) * F.cos(u(i, 2) * 6.283185307179586)
    centre = header.scanlen / 2
    burst = lambda i: 90 * F.exp(-F.pow((i - centre) / (header.scanlen / 50 + 1), 2.0)) * F.sin((i - centre) * 0.4)
    value = lambda i: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(offset + noise * gauss(i) + burst(i)))).cast("tinyint")
    df = spark.range(n).select(
        F.col("id").cast("int").alias("scan_idx"),
        F.expr(f"cast(id div {header.scanspline} as int)").alias("line"),
        (F.col("id") % header.scanspline).cast("int").alias("col"),
        F.lit(None).cast("int").alias("start"),
        F.lit(-1).cast("tinyint").alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(header.scanlen - 1)), value).alias("signal"),
    )
    return Scan(df, header)


def to_numpy(df: DataFrame, column: str, order: str):
    """An array column as a matrix on the driver, in the given order."""
    import numpy as np

    return np.array([r[0] for r in df.orderBy(order).select(column).toLocalIterator()])
