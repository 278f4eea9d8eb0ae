"""Continuous checks: a new result whenever the state of a repository changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUT = "repo_id string, sequence bigint, observed_at timestamp, seq bigint, fingerprint string"
STATE = "repo_id string, fingerprint string, sequence bigint"


def fingerprint(*parts: Column | str) -> Column:
    """What a state is: status, diff and untracked content."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def changes(feed: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of ``feed(repo_id, observed_at, seq, fingerprint)`` that differ from the one before, numbered on from ``last``.

    ``last(repo_id, fingerprint, sequence)`` holds a row per repository seen before.  A
    repository's rows are sorted, which spills; none are held in memory together.
    """
    w = Window.partitionBy("repo_id").orderBy("observed_at", "seq")
    known = last.select("repo_id", F.col("fingerprint").alias("_last"), F.col("sequence").alias("_n"))
    first = F.row_number().over(w) == 1
    j = feed.join(known, "repo_id", "left").withColumn("_first", first).withColumn("_before", F.when(first, F.col("_last")).otherwise(F.lag("fingerprint").over(w)))
    new = j.where((F.col("_first") & F.col("_n").isNull()) | ~F.col("fingerprint").eqNullSafe(F.col("_before")))
    number = F.coalesce("_n", F.lit(0)) + F.row_number().over(w)
    return new.select("repo_id", number.cast("bigint").alias("sequence"), "observed_at", "seq", "fingerprint")


def _states(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose state stands complete in ``folder``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(p.getName()) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def run_available(feed: DataFrame, table: str, checkpoint: str, each=None) -> None:
    """Process what is there and stop; ``each(updates, id)`` takes every batch of updates, or they go to ``table``.

    A batch that runs again after a failure overwrites what it wrote, and starts from the
    state that the batch before it left, so updates neither repeat nor skip a number.
    """
    folder = f"{checkpoint.rstrip('/')}/last"

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        before = [i for i in _states(spark, folder) if i < k]
        last = spark.read.schema(STATE).parquet(f"{folder}/{before[-1]}") if before else spark.createDataFrame([], STATE)
        path = f"{table}/batch={k}"
        changes(batch, last).write.mode("overwrite").parquet(path)
        done = spark.read.schema(OUT).parquet(path)
        if each:
            each(done, k)
        now = done.groupBy("repo_id").agg(F.max_by("fingerprint", "sequence").alias("fingerprint"), F.max("sequence").alias("sequence"))
        last.join(now, "repo_id", "left_anti").unionByName(now).write.mode("overwrite").parquet(f"{folder}/{k}")

    feed.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint.rstrip('/')}/offsets").trigger(availableNow=True).start().awaitTermination()


def updates_of_batch(feed: DataFrame) -> DataFrame:
    """The same over a complete feed."""
    return changes(feed, feed.sparkSession.createDataFrame([], STATE))
