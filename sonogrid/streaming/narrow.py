"""Row-wise operations on streams of A-scans.

Every narrow operation works unchanged on a streaming DataFrame; operations that
aggregate over a whole cube do not, and belong into ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonogrid.model import Header, Scan
from sonogrid.sources.store import ASCANS


def stream_scan(spark: SparkSession, path: str, header: Header, label_names=("healthy",)) -> Scan:
    """A scan whose A-scans arrive as Parquet files in a folder."""
    return Scan(spark.readStream.schema(ASCANS).parquet(path), header, tuple(label_names))


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to a Parquet folder, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
