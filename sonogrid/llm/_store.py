"""Shared scratch space: written tables that cut lineage, and files that tasks exchange.

Everything goes below ``spark.checkpoint.dir``, the folder that driver and
executors share, in a folder of the application that ``clear_scratch`` deletes.
Where that is unset (tests, a laptop) a temporary folder of this machine is set,
since there executors are threads of the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder (a URI or path)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sonogrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sonogrid/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in this application's folder."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that operators have written in this application; results not yet read or stored elsewhere go with it."""
    delete(spark, _root(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (there to ``path``, if given) and read it back: later plans start there.

    Survives lost executors and is never recomputed, unlike a cache.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(file system, path) of a URI; runs on executors, for side files that are no table rows."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file; folders are made as needed."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def get_file(uri: str) -> bytes:
    system, path = open_fs(uri)
    with system.open_input_stream(path, compression=None) as got:
        return got.read()
