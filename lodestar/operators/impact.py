"""What to inspect around the files of a plan: imports, history, routed tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from . import cochange

LIMIT, SEEDS = 12, 3
KEYS = ["plan_id"]


def seed_rows(requested: DataFrame, files: DataFrame, most: int = SEEDS) -> DataFrame:
    """``requested(plan_id, repo_id, path, ord)`` -> the first ``most`` that exist, numbered."""
    once = requested.groupBy("plan_id", "repo_id", "path").agg(F.min("ord").alias("ord"))
    known = once.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    w = Window.partitionBy("plan_id").orderBy("ord", "path")
    return known.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most).select("plan_id", "repo_id", F.col("path").alias("seed"), "ord")


def nearest_seed(paths: DataFrame, seeds: DataFrame) -> DataFrame:
    """``paths(plan_id, path, ...)`` with the seed that shares the longest run of leading folders; ties by seed."""
    a, b = F.split("path", "/"), F.split("seed", "/")
    common = F.aggregate(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, i: F.struct((s.on & (F.get(a, i) == F.get(b, i))).alias("on"), F.when(s.on & (F.get(a, i) == F.get(b, i)), s.n + 1).otherwise(s.n).alias("n")), lambda s: s.n)
    best = paths.join(seeds.select("plan_id", "seed"), "plan_id").withColumn("common", common)
    return best.groupBy(*paths.columns).agg(F.min_by("seed", F.struct(-F.col("common"), "seed")).alias("seed"))


def evidence(seeds: DataFrame, edges: DataFrame, routes: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``(plan_id, repo_id, path, kind, seed, points, occurrences, seed_changes)``, one per kind and seed.

    ``routes(plan_id, path)`` are routed tests; ``commit_files(repo_id, hash, path)``
    hold eligible commits only.
    """
    none = F.lit(None).cast("bigint")
    s = seeds.select("plan_id", "repo_id", "seed")
    cols = ("plan_id", "repo_id", "path", "kind", "seed", "points", "occurrences", "seed_changes")
    out = s.join(edges.withColumnRenamed("src", "seed"), ["repo_id", "seed"]).select("plan_id", "repo_id", F.col("dst").alias("path"), F.lit("imports").alias("kind"), "seed", F.lit(4).alias("points"), none.alias("occurrences"), none.alias("seed_changes"))
    into = s.join(edges.withColumnRenamed("dst", "seed"), ["repo_id", "seed"]).select("plan_id", "repo_id", F.col("src").alias("path"), F.lit("imported-by").alias("kind"), "seed", F.lit(6).alias("points"), none.alias("occurrences"), none.alias("seed_changes"))
    tests = nearest_seed(routes.select("plan_id", "path").distinct(), seeds).join(s, ["plan_id", "seed"]).select("plan_id", "repo_id", "path", F.lit("test-route").alias("kind"), "seed", F.lit(7).alias("points"), none.alias("occurrences"), none.alias("seed_changes"))
    changed = cochange.pairs(commit_files.withColumn("file", F.struct("repo_id", "path")), s.select(F.struct("repo_id", F.col("seed").alias("path")).alias("seed")).distinct(), ["repo_id", "hash"], "file")
    history = s.join(changed.select(F.col("seed.repo_id").alias("repo_id"), F.col("seed.path").alias("seed"), F.col("companion.path").alias("path"), "occurrences", "seed_changes", "points"), ["repo_id", "seed"]).select("plan_id", "repo_id", "path", F.lit("co-change").alias("kind"), "seed", "points", "occurrences", "seed_changes")
    every = out.select(*cols).union(into.select(*cols)).union(tests.select(*cols)).union(history.select(*cols))
    return every.groupBy("plan_id", "repo_id", "path", "kind", "seed").agg(F.max("points").alias("points"), F.max("occurrences").alias("occurrences"), F.max("seed_changes").alias("seed_changes"))


def impact_map(rows: DataFrame, seeds: DataFrame, files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(plan_id, rank, path, score, confidence, evidence)``; seeds, generated and retired files take no part."""
    kept = rows.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi").join(seeds.select("plan_id", F.col("seed").alias("path")), ["plan_id", "path"], "left_anti")
    kept = kept.where(~P.is_generated(F.col("path")) & ~P.is_backup(F.col("path")))
    why = (
        F.when(F.col("kind") == "imports", F.concat("seed", F.lit(" imports this file")))
        .when(F.col("kind") == "imported-by", F.concat(F.lit("this file imports "), "seed"))
        .when(F.col("kind") == "test-route", F.concat(F.lit("routed test for "), "seed"))
        .otherwise(F.concat(F.lit("changed with "), "seed", F.lit(" in "), F.col("occurrences").cast("string"), F.lit(" of its "), F.col("seed_changes").cast("string"), F.lit(" changes"))))
    strength = F.max(F.coalesce(F.col("occurrences") / F.greatest(F.col("seed_changes"), F.lit(1)), F.lit(0.0)))
    g = kept.withColumn("reason", why).groupBy("plan_id", "path").agg(
        F.sum("points").cast("int").alias("score"), F.count_distinct("kind").alias("kinds"), strength.alias("strength"),
        F.bool_or(F.col("kind") == "test-route").alias("tested"), F.bool_or(F.col("kind").isin("imports", "imported-by")).alias("linked"),
        F.array_sort(F.collect_list(F.struct("kind", "seed", "points", "reason", "occurrences", "seed_changes"))).alias("evidence"))
    level = F.when(F.col("tested") | (F.col("kinds") >= 2) | (F.col("strength") >= 0.6), "high").when(F.col("linked") | (F.col("strength") >= 0.3), "medium").otherwise("low")
    w = Window.partitionBy("plan_id").orderBy(F.desc("score"), *T.in_order("path"))
    return g.withColumn("confidence", level).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("plan_id", "rank", "path", "score", "confidence", "evidence")


def graph_nodes(primary: DataFrame, impact: DataFrame) -> DataFrame:
    """``(plan_id, id, path, role, confidence)``: ranked files, then what surrounds them."""
    both = primary.select("plan_id", "path", F.lit("primary").alias("role"), "confidence", F.lit(0).alias("p"), "rank").union(impact.select("plan_id", "path", F.lit("impact").alias("role"), "confidence", F.lit(1).alias("p"), "rank"))
    first = both.withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "path").orderBy("p", "rank"))).where("k = 1")
    w = Window.partitionBy("plan_id").orderBy("p", "rank", "path")
    return first.withColumn("n", F.row_number().over(w)).select("plan_id", "n", F.concat(F.lit("n"), F.col("n").cast("string")).alias("id"), "path", "role", "confidence")


def graph_edges(nodes: DataFrame, impact: DataFrame) -> DataFrame:
    """``(plan_id, src, dst, kind, label)`` between node ids; an importer points at what it imports."""
    e = impact.select("plan_id", "path", "rank", F.posexplode("evidence").alias("pos", "e"))
    a = nodes.select("plan_id", F.col("path").alias("seed"), F.col("id").alias("seed_id"))
    b = nodes.select("plan_id", "path", F.col("id").alias("file_id"))
    j = e.withColumn("seed", F.col("e.seed")).join(b, ["plan_id", "path"]).join(a, ["plan_id", "seed"])
    back = F.col("e.kind") == "imported-by"
    label = F.when(F.col("e.kind").isin("imports", "imported-by"), "imports").when(F.col("e.kind") == "test-route", "routed test").otherwise(F.concat(F.lit("co-change"), F.coalesce(F.concat(F.lit(" ×"), F.col("e.occurrences").cast("string")), F.lit(""))))
    return j.select("plan_id", "rank", "pos", F.when(back, F.col("file_id")).otherwise(F.col("seed_id")).alias("src"), F.when(back, F.col("seed_id")).otherwise(F.col("file_id")).alias("dst"), F.col("e.kind").alias("kind"), label.alias("label"))
