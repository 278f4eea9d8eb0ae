"""The whole plan of each task: ranked files, test commands, what lies around, risks, notes, next step."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import scan
from ..sources.tables import written
from . import diagnostics as D
from . import graph, impact, ranking, routes

BY = ["repo_id", "task_id"]
# What stands behind a note, in the order in which notes are given.
SCAN, GATES, GAPS, TASK, EMPTY, EXCLUSION = range(6)


def plan_id():
    return F.concat_ws("\0", *BY)


def commands(files: DataFrame, context: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test commands with the tests they reach, and each repository's language.

    ``(plan_id, ord, command, reason, package_dir, relatedFiles)`` and ``(repo_id,
    language, evidence)``.  The toolchain's own command serves where no script does; a
    plan without code has none.
    """
    languages = written(routes.primary_language(files))
    scripted = routes.test_routes(scan.package_scripts(files), routes.package_manager(files), context, files)
    own = routes.manifest_routes(files, context, languages).join(scripted.select("plan_id").distinct(), "plan_id", "left_anti")
    both = scripted.unionByName(own)
    return written(routes.with_related(both, routes.related_tests(files, context, changed))), languages


def gap_notes(files: DataFrame, code_plans: DataFrame, found: DataFrame, languages: DataFrame) -> DataFrame:
    """Plans with code, but without a command or a test that it reaches."""
    runner = routes.suggested_runner(files, languages).join(routes.js_runner(files).withColumnRenamed("runner", "js"), "repo_id", "full").select("repo_id", F.coalesce("runner", "js").alias("runner"))
    gaps = D.route_gaps(code_plans, found, found.where(F.size("relatedFiles") > 0)).join(code_plans, "plan_id").join(languages, "repo_id").join(runner, "repo_id", "left")
    first = found.where("ord = 1").select("plan_id", "command")
    g = gaps.join(first, "plan_id", "left")
    bare = F.col("code") == "no-test-route"
    says = F.when(~bare, F.concat(F.lit("no test covers the ranked files; the command is "), "command")).when(
        F.col("runner").isNotNull(), F.concat(F.lit("no test script found; for "), "language", F.lit(" ("), "evidence", F.lit(") the runner that fits is "), "runner")).otherwise("no test script found")
    return D.note(g, ["plan_id"], 1, F.col("code"), F.when(bare, "warning").otherwise("info"), says)


def gate_notes(files: DataFrame, routed: DataFrame) -> DataFrame:
    """Routed tests that skip themselves."""
    g = routes.gated_tests(files, routed).join(routed, ["repo_id", "path"]).join(files.select("repo_id", "path", "seq"), ["repo_id", "path"])
    n = F.size("env_names")
    why = F.when(F.col("gate") == "unconditional", " holds tests that are skipped").when(n == 0, " may skip tests").otherwise(F.concat(F.lit(" is skipped unless set: "), F.array_join("env_names", ", ")))
    rows = D.note(g.withColumn("_path", F.col("path")), ["plan_id", "seq"], 0, "gated-test-skipped", "warning", F.concat("path", why), F.array("path"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("plan_id").orderBy("seq"))).drop("seq")


def empty_notes(files: DataFrame, tasks: DataFrame, changed: DataFrame, ranked: DataFrame, signals: DataFrame, excluded: DataFrame | None, limit: int) -> DataFrame:
    """Why a task has no files; tasks without any are ranked again without exclusions."""
    removed = ranked.select(*BY, "path").limit(0)
    if excluded is not None:
        bare = written(tasks.join(ranked.select(*BY).distinct(), BY, "left_anti"))
        removed = ranking.rank(files, bare, changed, limit=limit).select(*BY, "path").join(excluded.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    removed = written(removed)
    cause = D.empty_result(signals, ranked, removed).join(files.groupBy("repo_id").agg(F.count("*").alias("files")), "repo_id")
    listed = D.first_paths(removed, BY)
    c = cause.join(listed, BY, "left").join(signals.select(*BY, F.array_sort("tokens").alias("tokens")), BY)
    words = F.array_join(F.transform(F.slice("tokens", 1, 8), lambda w: F.when(F.length(w) > 40, F.concat(w.substr(1, 39), F.lit("…"))).otherwise(w)), ", ")
    says = F.when(F.col("cause") == "excluded", F.concat(D.counted(F.col("n"), "file that matches is", "files that match are"), F.lit(" excluded"))).when(
        F.col("cause") == "no-terms", "the task has no word to search for").otherwise(F.concat(F.lit("none of "), F.col("files").cast("string"), F.lit(" files matches: "), words))
    code = F.when(F.col("cause") == "no-terms", "no-task-terms").otherwise("no-context-match")
    return D.note(c, BY, 1, code, "warning", says, F.col("paths"))


def exclusion_notes(tasks: DataFrame, ranked: DataFrame, excluded: DataFrame) -> DataFrame:
    """How many files exclusions took; a warning where none is left."""
    took = D.first_paths(excluded, ["repo_id"])
    full = ranked.select(*BY).distinct().withColumn("_full", F.lit(True))
    t = tasks.select(*BY).join(took, "repo_id").join(full, BY, "left")
    return D.note(t, BY, 1, "paths-excluded", F.when(F.col("_full"), "info").otherwise("warning"), F.concat(D.counted(F.col("n"), "path is", "paths are"), F.lit(" excluded from ranking")), F.col("paths"))


def plan(files: DataFrame, tasks: DataFrame, changed: DataFrame, commit_files: DataFrame | None = None, excluded: DataFrame | None = None, scanned: DataFrame | None = None, limit: int = ranking.LIMIT) -> dict[str, DataFrame]:
    """Relations of the plans of all tasks, keyed by ``plan_id``.

    ``plans(plan_id, repo_id, task_id, summary, action, specificity, top_score, runner_up,
    top_gap, clustered)``, ``ranked``, ``routes``, ``impact``, ``risks``, ``notes(plan_id,
    ord, code, severity, message, paths)``, ``changed``.  ``commit_files(repo_id, hash,
    path)`` is a history, ``excluded(repo_id, path)`` what is not to be ranked,
    ``scanned`` the notes of a scan (``diagnostics.scan_notes``).  A task with nothing
    to rank has a plan of notes alone.
    """
    spark = files.sparkSession
    files = written(files)  # read by nearly every step
    signals, grounding = grounded = ranking.ground(files, tasks, scanned)
    ranked = written(ranking.rank(files, tasks, changed, excluded, limit, diagnostics=scanned, grounded=grounded).withColumn("plan_id", plan_id()))
    plans = tasks.select(*BY, plan_id().alias("plan_id")).distinct()
    context = ranked.select("plan_id", "repo_id", "path", "rank")
    touched = changed.select("repo_id", "path").distinct().join(plans, "repo_id").select("plan_id", "path")
    code_plans = written(context.join(files.where("kind = 'code'").select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("plan_id", "repo_id").distinct())

    found, languages = commands(files, context, changed)
    routed = found.select("plan_id", F.explode("relatedFiles").alias("path")).distinct().join(plans.select("plan_id", "repo_id"), "plan_id")
    seeds = written(impact.seed_rows(context.withColumnRenamed("rank", "ord"), files))
    history = commit_files if commit_files is not None else spark.createDataFrame([], "repo_id string, hash string, path string")
    around = written(impact.impact_map(impact.evidence(seeds, graph.import_edges(files)[0], routed.select("plan_id", "path"), history), seeds, files))
    risks = routes.risk_notes(context.select("plan_id", "path"), touched)

    shape = ranked.select(*BY, "top_score", "runner_up", "top_gap", "clustered").distinct()
    keyed = lambda df: df.withColumn("plan_id", plan_id()).drop(*BY)
    parts = [
        (GATES, gate_notes(files, routed)), (GAPS, gap_notes(files, code_plans, found, languages)), (TASK, keyed(D.task_notes(signals, grounding, shape))),
        (EMPTY, keyed(empty_notes(files, tasks, changed, ranked, signals, excluded, limit))),
    ]
    if scanned is not None:
        parts.append((SCAN, scanned.join(plans.select("repo_id", "plan_id"), "repo_id").drop("repo_id")))
    if excluded is not None:
        parts.append((EXCLUSION, keyed(exclusion_notes(tasks, ranked, excluded))))
    rows = functools.reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(i)) for i, df in parts])
    notes = rows.withColumn("ord", F.row_number().over(Window.partitionBy("plan_id").orderBy("part", "ord", "code", "message"))).select("plan_id", "ord", "code", "severity", "message", "paths")

    # a generated file is never what to open first, unless there is nothing else
    lead = ranked.groupBy(*BY, "plan_id").agg(F.min_by("path", F.struct((F.col("f3") < 0), "rank")).alias("path"))
    lead = lead.join(routed.select("plan_id").distinct().withColumn("has_tests", F.lit(True)), "plan_id", "left").select(*BY, "path", F.coalesce("has_tests", F.lit(False)).alias("has_tests"))
    count = lambda df, name: df.groupBy("plan_id").agg(F.count("*").alias(name))
    head = plans.join(D.next_action(grounding, shape, lead), BY).join(grounding.select(*BY, "specificity"), BY).join(shape, BY, "left")
    for df, name in ((ranked, "n_files"), (around, "n_around"), (found, "n_routes")):
        head = head.join(count(df, name), "plan_id", "left")
    head = head.na.fill(0, ["n_files", "n_around", "n_routes"]).withColumn("clustered", F.coalesce("clustered", F.lit(False)))
    summary = F.concat(D.counted(F.col("n_files"), "file", "files"), F.lit(" to read, "), D.counted(F.col("n_around"), "file", "files"), F.lit(" around them, "), D.counted(F.col("n_routes"), "test command", "test commands"))
    head = head.select("plan_id", *BY, summary.alias("summary"), "action", "specificity", "top_score", "runner_up", "top_gap", "clustered")
    return {"plans": written(head), "ranked": ranked, "routes": found, "impact": around, "risks": written(risks), "notes": written(notes), "changed": touched}


def clarify_missing(explained: DataFrame, listing: DataFrame, ignored: DataFrame, limited: DataFrame) -> DataFrame:
    """``explained(repo_id, path, status)`` with ``cause`` where a path was not scanned.

    ``listing(repo_id, path)`` is what was scanned, ``ignored(repo_id, path)`` files on disk
    that were not, ``limited(repo_id)`` the repositories whose scan met its limit.
    """
    keys = ["repo_id", "path"]
    e = explained.join(listing.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left").join(ignored.select(*keys).distinct().withColumn("_disk", F.lit(True)), keys, "left").join(limited.select("repo_id").distinct().withColumn("_cut", F.lit(True)), "repo_id", "left")
    cause = F.when(~P.is_safe_relative(F.col("path")), "outside").when(F.col("_disk") & F.col("_cut"), "beyond-limit").when(F.col("_disk"), "ignored").otherwise("no-such-path")
    return e.withColumn("cause", F.when((F.col("status") == "not-scanned") & F.col("_in").isNull(), cause)).drop("_in", "_disk", "_cut")
