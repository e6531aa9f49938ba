"""Evidence over batches that arrive: best match, counts and score histograms kept as tables.

A state is a Parquet table with one folder per version; a batch is reduced first, merged
with the state by the same grouped operation, and written as the next version.  Re-running a
batch gives the same version, so a retry after a failure is harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import first_per_key


def _version(spark: SparkSession, path: str, k: int) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={k}/_SUCCESS")
    return spark.read.parquet(f"{path}/v={k}") if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [int(x.getPath().getName()[2:]) for x in fs.listStatus(p) if x.getPath().getName().startswith("v=")]
    for k in sorted(done, reverse=True):
        if (df := _version(spark, path, k)) is not None:
            return df
    return None


def _merged(path: str, reduce):
    def write(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        before = next((df for i in range(k - 1, -1, -1) if (df := _version(spark, path, i)) is not None), None)
        new = reduce(batch)
        reduce_again = reduce(before.unionByName(new), True) if before is not None else new
        reduce_again.write.mode("overwrite").parquet(f"{path}/v={k}")

    return write


def best_match(stream: DataFrame, keys: list[str], score: str, ties: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the best row and the number of rows of each key."""

    def reduce(df: DataFrame, again: bool = False) -> DataFrame:
        n = df.groupBy(*keys).agg((F.sum("n_matches") if again else F.count("*")).alias("n_matches"))
        best = first_per_key(df.drop("n_matches") if again else df, keys, [F.col(score).desc(), *ties])
        return best.join(n, keys)

    return stream.writeStream.foreachBatch(_merged(path, reduce)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    def reduce(df: DataFrame, again: bool = False) -> DataFrame:
        return df.groupBy(*keys).agg((F.sum("n") if again else F.count("*")).alias("n"))

    return stream.writeStream.foreachBatch(_merged(path, reduce)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key, each window given out once when ``late`` has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
