"""The canonical cube of the test tables, and its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid.model import Header, Scan

COLS, SCANLEN, FS, TZERO, RESOLUTION = 20, 64, 100.0, 1000, 400.0
NAMES = ("healthy", "Defect_1", "Defect_2", "Defect_3", "Defect_4", "Defect_5", "Defect_6", "Defect_7", "Defect_8")

#: silent, constant, with -128, one spike
EDGE = [[0] * 64, [7] * 64, [(-128 if i == 9 else 60 if i == 20 else i % 5) for i in range(64)], [(100 if i == 31 else 0) for i in range(64)]]

SQL_CUBE = f"""cube AS (SELECT vec_id::INT AS scan_idx, (vec_id // {COLS})::INT AS line, (vec_id % {COLS})::INT AS col, (label - 1)::INT AS label,
  list_transform(embedding, lambda v: greatest(-128, least(127, round_even(v::DOUBLE * 200, 0)))::INT) AS s FROM embeddings)"""
SQL_LONG = SQL_CUBE + ", long AS (SELECT scan_idx, unnest(range(64))::INT AS i, unnest(s)::DOUBLE AS v FROM cube)"
SQL_EDGE = "edge AS (SELECT scan_idx, s FROM (VALUES " + ", ".join(f"({k}, {s})" for k, s in enumerate(EDGE)) + ") t(scan_idx, s))"


def canonical(spark: SparkSession, sf_dir: str, scanlen: int = SCANLEN) -> Scan:
    """``embeddings`` as a cube: 20 columns, whole samples in -128..127, label - 1."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    wide = F.transform(F.slice("embedding", 1, scanlen), lambda v: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(v.cast("double") * 200))).cast("tinyint"))
    df = table.select(
        F.col("vec_id").cast("int").alias("scan_idx"),
        F.expr(f"cast(vec_id div {COLS} as int)").alias("line"),
        (F.col("vec_id") % COLS).cast("int").alias("col"),
        F.lit(None).cast("int").alias("start"),
        (F.col("label") - 1).cast("tinyint").alias("label"),
        wide.alias("signal"),
    )
    return Scan(df, Header(COLS, 0, scanlen, FS, TZERO, RESOLUTION), NAMES)


def sized(spark: SparkSession, sf_dir: str, scanlen: int = SCANLEN) -> Scan:
    """The canonical cube with its number of lines (one count over Parquet footers)."""
    scan = canonical(spark, sf_dir, scanlen)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return scan.with_df(scan.df, nlines=n // COLS, rest=n % COLS)


def edge(spark: SparkSession) -> Scan:
    """Four awkward A-scans."""
    from sonogrid.sources.store import from_rows

    return from_rows(spark, EDGE, Header(4, 1, 64, FS, TZERO, RESOLUTION))


def long(df: DataFrame, column: str, *keys: str, digits: int | None = 4) -> DataFrame:
    """One row a sample: keys, i, v."""
    value = F.col("v").cast("double")
    out = df.select(*(keys or ("scan_idx",)), F.posexplode(column).alias("i", "v"))
    return out.withColumn("v", F.round(value, digits) + F.lit(0.0) if digits is not None else value)
