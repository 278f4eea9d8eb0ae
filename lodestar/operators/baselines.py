"""Plain searches as yardsticks, each under several policies of what is searched, in one pass.

A file carries the set of the policies that admit it.  It is tokenised once; statistics
are grouped over the set, so overlapping corpora cost rows of counts and no further texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written
from . import evaluation, retrieval

POLICIES = ("raw", "source", "code")
TOP = 5
PATH = r"[A-Za-z0-9_.$-]+(?:/[A-Za-z0-9_.$-]+)+\.[A-Za-z0-9]+"


def policies() -> Column:
    """Of a file record: all files, sources that are no tests, and of these the code."""
    source = F.col("is_source") & ~F.col("is_test")
    named = [F.lit("raw"), F.when(source, F.lit("source")), F.when(source & (F.col("kind") == "code"), F.lit("code"))]
    return F.filter(F.array(*named), lambda p: p.isNotNull())


def _top(scored: DataFrame, order: list, limit: int) -> DataFrame:
    w = Window.partitionBy("policy", "task_id").orderBy(*order, *T.in_order("path"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("policy", "task_id", "rank", "path")


def by_bm25(files: DataFrame, tasks: DataFrame, limit: int = TOP) -> DataFrame:
    """``files(path, text, policies)``, ``tasks(task_id, issue_text)`` -> ``(policy, task_id, rank, path)``."""
    counted, terms = retrieval.counted_tokens(files, tasks, ["path", "policies"])
    counted = written(counted)
    whole = counted.where(F.col("token") == retrieval.WHOLE).select("length", F.explode("policies").alias("policy"))
    corpora = whole.groupBy("policy").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = counted.where(F.col("token") != retrieval.WHOLE)
    df = tf.groupBy("policies", "token").agg(F.count("*").alias("df")).select("token", "df", F.explode("policies").alias("policy")).groupBy("policy", "token").agg(F.sum("df").alias("df"))
    # what a term weighs under each policy is a small table; a score for each policy is a column until a file is done
    stat = F.struct("n", "mean", "df")
    weights = df.join(F.broadcast(corpora), "policy").groupBy("token").agg(*[F.max(F.when(F.col("policy") == p, stat)).alias(p) for p in POLICIES])  # a row for each policy
    weights = written(terms.join(weights, "token"))
    of = lambda p: F.when(F.array_contains("policies", p), retrieval.part(f"{p}.n", f"{p}.mean", f"{p}.df"))
    sums = tf.repartition("path").join(weights, "token").groupBy("task_id", "path").agg(*[F.round(F.sum(of(p)), 6).alias(p) for p in POLICIES])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("score")) for p in POLICIES])).alias("x")
    return _top(sums.select("task_id", "path", each).select("x.policy", "task_id", "path", "x.score").where("score > 0"), [F.desc("score")], limit)


def by_literal(files: DataFrame, tasks: DataFrame, limit: int = TOP) -> DataFrame:
    """By distinct terms that stand in a file, then by how often; what a file holds is found once for all policies."""
    scored = retrieval.literal_counts(files, tasks, "path", more=["policies"]).select("*", F.explode("policies").alias("policy"))
    return _top(scored, [F.desc("terms"), F.desc("occurrences")], limit)


def by_path(files: DataFrame, tasks: DataFrame, limit: int = TOP) -> DataFrame:
    """By the paths that a task itself names, in order: of each, the longest tail that is a file, or the tail of one file only."""
    named = tasks.select("task_id", F.posexplode(T.find_all(F.translate("issue_text", "\\", "/"), PATH)).alias("pos", "mention"))
    tails = lambda c: F.transform(F.split(c, "/"), lambda _, i: F.array_join(F.slice(F.split(c, "/"), i + 1, F.size(F.split(c, "/"))), "/"))
    asked = named.select("task_id", "pos", F.posexplode(tails(F.col("mention"))).alias("start", "tail"))
    held = files.select("path", "policies", F.posexplode(tails(F.col("path"))).alias("_at", "tail")).withColumn("whole", F.col("_at") == 0)
    found = asked.join(held, "tail").select("task_id", "pos", "start", "path", "whole", F.explode("policies").alias("policy"))
    exact = F.max(F.when(F.col("whole"), F.col("path")))
    lone = F.when(F.count_if(~F.col("whole")) == 1, F.max(F.when(~F.col("whole"), F.col("path"))))
    found = found.groupBy("policy", "task_id", "pos", "start").agg(F.coalesce(exact, lone).alias("path")).where("path is not null")
    first = found.groupBy("policy", "task_id", "pos").agg(F.min_by("path", "start").alias("path")).groupBy("policy", "task_id", "path").agg(F.min("pos").alias("pos"))
    return _top(first, ["pos"], limit)


ARMS = {"path-extraction": by_path, "lexical-literal": by_literal, "bm25": by_bm25}


def arms(files: DataFrame, tasks: DataFrame, limit: int = TOP) -> DataFrame:
    """``(arm, policy, task_id, rank, path)`` of every arm under every policy; ``files`` are file records of one repository."""
    listed = written(files.select("path", F.concat_ws("\n", "path", "text").alias("text"), policies().alias("policies")))
    out = None
    for name, search in ARMS.items():
        one = search(listed, tasks, limit).select(F.lit(name).alias("arm"), "*")
        out = one if out is None else out.union(one)
    return out


def rates(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``(arm, policy, k, hits, n, rate, low, high)`` over all tasks that ``expected(task_id, path)`` something; an arm that finds nothing has its zeros."""
    tasks = expected.select("task_id").distinct()
    kinds = tasks.sparkSession.createDataFrame([(a, p) for a in ARMS for p in POLICIES], "arm string, policy string")
    first = found.join(expected, ["task_id", "path"]).groupBy("arm", "policy", "task_id").agg(F.min("rank").alias("first"))
    cases = tasks.crossJoin(F.broadcast(kinds)).join(first, ["arm", "policy", "task_id"], "left")
    cases = cases.select("arm", "policy", *[F.coalesce(F.col("first") <= k, F.lit(False)).alias(f"hit{k}") for k in (1, 3, 5)])
    return evaluation.rates(cases, ["arm", "policy"])


def headline(rated: DataFrame) -> DataFrame:
    """``(arm, policy, top1, top3, top5)``: each arm under the policy that serves it best; of equals the first of POLICIES."""
    wide = rated.groupBy("arm", "policy").agg(*[F.max(F.when(F.col("k") == k, F.col("rate"))).alias(f"top{k}") for k in (1, 3, 5)])
    order = F.array_position(F.array(*map(F.lit, POLICIES)), F.col("policy"))
    return evaluation.best_policy(wide.withColumn("_o", order), ["arm"], "_o").drop("_o")
