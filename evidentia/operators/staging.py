"""Cutting lineage in driver loops: a table in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is named and all
    of Spark is this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the place of each row in a total order, from 0, without one task for all rows.

    Rows are dealt to ranges of the order and sorted in them; a row's number in its range plus
    the sizes of the ranges before (one row per partition) is its place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = staged(ranged.withColumn("_p", F.shiftright("_id", 33)).withColumn("_k", F.col("_id").bitwiseAND(2**33 - 1)).drop("_id"))
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    first = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return kept.join(F.broadcast(first), "_p").withColumn(out, F.col("_first") + F.col("_k")).drop("_p", "_k", "_first")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, in each group by the order, without one task for a group: rows
    are summed in ranges of (group, order), and the ranges before in a row for each range and group."""
    ranged = staged(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    here = W.partitionBy("_p", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_p", *group).agg(F.sum(value).alias("_s"))
    first = sums.withColumn("_s", F.sum("_s").over(W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
    both = ranged.join(first, ["_p", *group])
    return both.withColumn(out, F.coalesce(F.sum(value).over(here), F.lit(0)) + F.coalesce("_s", F.lit(0))).drop("_p", "_s")


MATRIX_BYTES = 256 << 20


def bounded(rows: DataFrame, limit: int = MATRIX_BYTES) -> pd.DataFrame:
    """``rows`` on the driver, once their size is counted and found within ``limit``."""
    from .joins import CheckFailed

    size = rows.agg(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(0)))).first()[0] or 0
    if size > limit:
        raise CheckFailed(f"a table of {size} bytes; the limit is {limit}")
    return rows.toPandas()
