"""Retrieval quality: hit rates, intervals, paired tests, calibration and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

Z_SCRIPT, Z_CLI = 1.96, 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z_SCRIPT) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, null where there are no cases."""
    p = hits / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    width = 1 + z * z / n
    ok = lambda c: F.when(n > 0, F.round(c, 3))
    return ok(F.greatest(F.lit(0.0), (middle - half) / width)), ok(F.least(F.lit(1.0), (middle + half) / width))


def hits_at(ranked: DataFrame, expected: DataFrame, tasks: DataFrame, task: str = "task_id", key: str = "path", ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``(task, hit1, hit3, ...)`` of every task that expects something."""
    best = ranked.join(expected, [task, key]).groupBy(task).agg(F.min("rank").alias("first"))
    known = tasks.select(task).join(expected.select(task).distinct(), task, "left_semi")
    return known.join(best, task, "left").select(task, *[F.coalesce(F.col("first") <= k, F.lit(False)).alias(f"hit{k}") for k in ks])


def rates(cases: DataFrame, by: list[Column | str], ks: tuple[int, ...] = (1, 3, 5), z: float = Z_SCRIPT) -> DataFrame:
    """Cases, hits, rate and interval at each k: one row per group and k, from one aggregation."""
    sums = cases.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col(f"hit{k}").cast("int")).alias(f"h{k}") for k in ks])
    names = [c for c in sums.columns if c != "n" and c not in {f"h{k}" for k in ks}]
    rows = sums.select(*names, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("x")).select(*names, "n", "x.k", "x.hits")
    low, high = wilson(F.col("hits"), F.col("n"), z)
    return rows.select(*names, "k", "hits", "n", F.round(F.col("hits") / F.col("n"), 3).alias("rate"), low.alias("low"), high.alias("high"))


def cohorts(cases: DataFrame, flag: str = "mentioned") -> DataFrame:
    """Every case once in ``all`` and once in its own cohort."""
    own = F.when(F.col(flag), "mentioned").otherwise("unmentioned")
    return cases.withColumn("cohort", F.explode(F.array(F.lit("all"), own)))


def mcnemar(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Exact two-sided test on cases that only one of two arms hits.

    p = min(1, 2 * sum over i <= min(x, y) of C(n, i) / 2 ** n), n = x + y; 1 if n is 0.
    """
    x = pairs.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    # terms follow from one another, as logarithms: C(n, i + 1) = C(n, i) * (n - i) / (i + 1), and no n is too large
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), F.least("only_a", "only_b").cast("int")), start, lambda s, i: F.struct((s.log + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("log"), (s.sum + F.exp(s.log)).alias("sum")), lambda s: s.sum)
    return x.withColumn("p", F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 6)))


def calibration(cases: DataFrame, band: str = "confidence", hit: str = "hit1", z: float = Z_SCRIPT) -> DataFrame:
    sums = cases.groupBy(band).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("int")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"), z)
    return sums.select(band, "hits", "n", F.round(F.col("hits") / F.col("n"), 3).alias("rate"), low.alias("low"), high.alias("high"))


def misleading_top(cases: DataFrame, by: list[str]) -> DataFrame:
    """Share of cases with the answer in the first five but not first."""
    return cases.groupBy(*by).agg(F.round(F.avg((F.col("hit5") & ~F.col("hit1")).cast("double")), 3).alias("misleading_rate"), F.count("*").alias("n"))


def best_policy(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The policy with the greatest (top1, top3, top5); of equals the first by ``order``."""
    w = Window.partitionBy(*group).orderBy(F.desc("top1"), F.desc("top3"), F.desc("top5"), order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def false_confidence(cases: DataFrame) -> DataFrame:
    """Share of adversarial cases whose confidence exceeds what they allow."""
    level = lambda c: F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col(c))
    return cases.agg(F.round(F.avg((level("confidence") > level("max_confidence")).cast("double")), 3).alias("false_confidence_rate"), F.count_if(level("confidence") <= level("max_confidence")).alias("passed"), F.count("*").alias("n"))


def secondary_recall(cases: DataFrame, by: list[str]) -> DataFrame:
    """Found of expected secondary files; null where none is expected."""
    s = cases.groupBy(*by).agg(F.sum("found").alias("found"), F.sum("expected").alias("expected"))
    return s.withColumn("recall", F.when(F.col("expected") > 0, F.round(F.col("found") / F.col("expected"), 3)))


def study_arms(runs: DataFrame) -> DataFrame:
    """Per arm: rates over all runs, exact medians over finite values."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return runs.groupBy("arm").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("success").cast("double")), 3).alias("success_rate"), F.median(finite("seconds")).alias("median_seconds"), F.median(finite("tokens")).alias("median_tokens"))


def incomplete(runs: DataFrame, tasks: DataFrame, arms: DataFrame) -> DataFrame:
    """Pairs of task and arm that do not occur exactly once."""
    seen = runs.groupBy("task_id", "arm").agg(F.count("*").alias("n"))
    return tasks.crossJoin(F.broadcast(arms)).join(seen, ["task_id", "arm"], "left").where(F.coalesce("n", F.lit(0)) != 1).select("task_id", "arm", F.coalesce("n", F.lit(0)).alias("n"))


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of a sorted frame with their place from 1: partitions of the sort are counted first, then rows within each."""
    rows = written(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return rows.join(F.broadcast(before.select("_part", "_first", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_part", "_id", "_first", "_before")
