"""Small pieces that several operators share: tables, free names, linked groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written as materialize

__all__ = ["col", "connected_components", "free_name", "materialize", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less any columns of these names (case aside): a result's column replaces one of its name."""
    gone = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in gone])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)``, component being the smallest node reachable.

    Alternating large-star and small-star steps; the driver only sees a count and a
    checksum per round.  Self-loops are allowed; nodes without an edge do not appear.
    The hub of a star is one key with many rows: what is joined to it is dealt out once
    more after its aggregation, so that Spark may split the hub's partition (a side that
    ends in an aggregate cannot be repeated for the parts of the other).
    """
    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = int(cur.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")).repartition(parts)
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u >= v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them; after a large star u has few
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, large.u == least.k)
        cur = materialize(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        )
        now = cur.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == seen:
            break
        seen = now
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
