"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

MAX_FILES = 30
PART = 500_000  # rows that a task sorts or counts


def placed(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows dealt out by ``keys`` over the session's number of partitions, or more: ``PART`` rows each or fewer."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART)), *keys)


def eligible(commit_files: DataFrame, keys: list[str], file: str = "path", known: DataFrame | None = None, most: int = MAX_FILES) -> DataFrame:
    """Rows of commits of at most ``most`` files; only then those of files that still exist."""
    small = commit_files.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(*keys)
    kept = commit_files.join(small, keys, "left_semi")
    return kept if known is None else kept.join(known, file, "left_semi")


def pairs(commit_files: DataFrame, seeds: DataFrame | None, keys: list[str], file: str = "path", least: int = 2) -> DataFrame:
    """``(seed, companion, occurrences, seed_changes, strength, points)`` for the seeds given, or for every file.

    Files are numbered, odd if they are seeds, so that a pair is two numbers; files of
    under ``least`` commits have no pair.  A commit is one row, bounded by ``eligible``.
    Two files are one pair, whichever of them is a seed, and only pairs that occur
    ``least`` times get their names and both directions.  Rows and pairs are dealt out over
    partitions that grow in number with them, so that no task holds more as they grow.
    """
    known = written(commit_files.select(*keys, F.col(file).alias("_file")).dropna())
    size = known.count()
    named = placed(known, size, "_file").groupBy("_file").agg(F.count("*").alias("_changes")).where(F.col("_changes") >= least)
    odd = F.lit(1)
    if seeds is not None:
        named = named.join(seeds.select(F.col("seed").alias("_file"), F.lit(1).alias("_asked")).distinct(), "_file", "left")
        odd = F.coalesce("_asked", F.lit(0))
    named = written(named.select("_file", "_changes", (2 * F.monotonically_increasing_id() + odd).alias("_id")))
    rows = placed(known, size, "_file").join(named.select("_file", "_id"), "_file").select(*keys, "_id")
    commits = written(placed(rows, size, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list("_id")).alias("ids")).where("size(ids) > 1").select("ids"))
    n = commits.agg(F.sum(F.expr("cast(size(ids) as bigint) * (size(ids) - 1) div 2"))).first()[0] or 0
    one = commits.select("ids", F.posexplode("ids").alias("i", "a")).select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    one = one.where("a < b" if seeds is None else "a < b and (a % 2 = 1 or b % 2 = 1)")
    counts = placed(one, n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)
    both = counts.select("occurrences", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("c")), F.struct(F.col("b").alias("s"), F.col("a").alias("c")))).alias("p")).select("occurrences", "p.s", "p.c").where("s % 2 = 1")
    both = both.join(named.select(F.col("_id").alias("s"), F.col("_file").alias("seed"), F.col("_changes").alias("seed_changes")), "s").join(named.select(F.col("_id").alias("c"), F.col("_file").alias("companion")), "c")
    strength = F.col("occurrences") / F.col("seed_changes")
    return both.select("seed", "companion", "occurrences", "seed_changes", F.round(strength, 6).alias("strength"), F.least(F.lit(8), 2 + F.floor(strength * 6 + 0.5)).cast("int").alias("points"))
