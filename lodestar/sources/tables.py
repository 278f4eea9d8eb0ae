"""Tables written once into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a local master gets a folder of its own; on a cluster that would be
    another disk on each machine, so there it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, kind: str = "relations") -> str:
    """A path of its own in the shared folder; ``drop_written`` removes what lies there."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table: read several times, computed once, and short to plan from.

    This cuts lineage, so that a lost executor costs no recomputation of what came
    before, and forgets the partitioning, so that a later join may split hot keys.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a table of few files or row groups would keep the rest idle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def drop_written(spark: SparkSession) -> int:
    """Remove every table that ``written`` and ``new_path`` made; for a caller that is done with all results."""
    for path in _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n
