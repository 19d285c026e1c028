"""Connected components of a link table by alternating large and small stars.

Each round is two aggregations and two joins over the links left; written
tables cut the lineage.  A component of any shape is a star around its least id
after a number of rounds logarithmic in its size.  Links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm._store import written


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """One step on links (u, v) with u > v: neighbours hook to the least of their neighbourhood."""
    if larger_only:
        near = links.union(links.select("v", "u")).toDF("u", "v")
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hooked = near.join(least, "u").where("v > m" if not larger_only else "v > u")
    out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger_only:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _ordered(links: DataFrame) -> DataFrame:
    """(u, v) with u > v of links (a, b)."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def contracted(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(u, v), written: one round of stars over new links (a, b) and what an earlier call gave.

    Connects what the links connect, mostly in stars around least ids, but not to the end.
    """
    now = _ordered(links)
    return written(_star(_star(now if before is None else now.union(before), True), False))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in the links (a, b); the component is the least id reachable."""
    now = written(_ordered(links))
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = written(_star(_star(now, True), False))
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
