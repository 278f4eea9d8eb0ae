"""What a scan or a plan should tell its reader."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.scan import MAX_SAMPLE
from .routes import package_manager

MAX_FILES = 25_000


def busiest_scopes(paths: DataFrame, most: int = 3) -> DataFrame:
    """``(repo_id, ord, scope, n)``: the top folders with most files."""
    scope = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("(root)")
    n = paths.groupBy("repo_id", scope.alias("scope")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "scope")
    return n.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most).select("repo_id", "ord", "scope", "n")


def scan_limit(paths: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """``(repo_id, skipped)`` of repositories with more files than a scan takes."""
    return paths.groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("repo_id", (F.col("n") - most).alias("skipped"))


def unread(files: DataFrame) -> DataFrame:
    """``(repo_id, skip_reason, n, largest)``: unread sources by reason, with the three largest."""
    u = files.where(F.col("is_source") & F.col("skip_reason").isNotNull())
    w = u.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "skip_reason").orderBy(F.desc("size_bytes"), "path")))
    return w.groupBy("repo_id", "skip_reason").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "path")))), lambda x: x.path).alias("largest"))


def absent_tracked(tracked: DataFrame, files: DataFrame) -> DataFrame:
    """``(repo_id, n)`` of tracked paths that the scan did not find."""
    return tracked.join(files, ["repo_id", "path"], "left_anti").groupBy("repo_id").agg(F.count("*").alias("n"))


def generated_dominance(files: DataFrame, least: int = 500, share: float = 0.4) -> DataFrame:
    """Repositories of at least ``least`` files with at least that share generated."""
    g = files.groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if(P.is_generated(F.col("path"))).alias("generated"))
    return g.where((F.col("n") >= least) & (F.col("generated") >= F.col("n") * share))


def linked_duplicates(listing: DataFrame) -> DataFrame:
    """One row per real path: the spelling that is no alias, then the first. ``listing(repo_id, seq, path, real_path, is_alias)``."""
    w = Window.partitionBy("repo_id", "real_path").orderBy("is_alias", "seq")
    return listing.withColumn("k", F.row_number().over(w)).where("k = 1").select("repo_id", "seq", "path", "real_path")


def next_action(grounding: DataFrame, shape: DataFrame, lead: DataFrame) -> DataFrame:
    """``(repo_id, task_id, action)``: the first of nine advices that applies.

    ``lead(repo_id, task_id, path, has_tests)``: the leading file that is no artifact.
    """
    by = ["repo_id", "task_id"]
    j = grounding.join(shape, by, "left").join(lead, by, "left")
    return j.select(
        *by,
        F.when(F.size("unresolved") > 0, "correct-identifiers").when(F.size("unverified") > 0, "read-skipped-sources").when(F.size("partially_resolved") > 0, "check-partial-name")
        .when(~F.col("scan_complete"), "narrow-scope").when(F.col("specificity") == "vague", "add-anchor").when(F.coalesce("clustered", F.lit(False)), "verify-neighbourhood")
        .when(F.col("path").isNotNull() & F.col("has_tests"), F.concat(F.lit("inspect-with-tests:"), "path")).when(F.col("path").isNotNull(), F.concat(F.lit("inspect:"), "path")).otherwise("add-repository-anchor").alias("action"))


def empty_result(tasks: DataFrame, ranked: DataFrame, removed: DataFrame) -> DataFrame:
    """Why a task has no files: exclusions took what matches, it has no terms, or nothing matches.

    ``tasks(repo_id, task_id, tokens, identifiers, file_mentions)``; ``ranked`` and
    ``removed`` (what would rank, were it not excluded) are ``(repo_id, task_id, path)``.
    """
    by = ["repo_id", "task_id"]
    none = tasks.join(ranked.select(*by).distinct(), by, "left_anti")
    taken = removed.select(*by).distinct().withColumn("taken", F.lit(True))
    silent = (F.size("tokens") == 0) & (F.size("identifiers") == 0) & (F.size("file_mentions") == 0)
    return none.join(taken, by, "left").select(*by, F.when(F.col("taken"), "excluded").when(silent, "no-terms").otherwise("no-match").alias("cause"))


def route_gaps(plans: DataFrame, routes: DataFrame, related: DataFrame) -> DataFrame:
    """``(plan_id, code)`` of plans without a test command, or with commands that reach no related test."""
    routed = routes.select("plan_id").distinct()
    a = plans.join(routed, "plan_id", "left_anti").select("plan_id", F.lit("no-test-route").alias("code"))
    b = plans.join(routed, "plan_id", "left_semi").join(related.select("plan_id").distinct(), "plan_id", "left_anti").select("plan_id", F.lit("no-related-tests").alias("code"))
    return a.union(b)


def note(df: DataFrame, key: list[str], order: int, code: str | Column, severity: str | Column, message: Column, paths: Column | None = None) -> DataFrame:
    """A row ``(key..., ord, code, severity, message, paths)`` for each row of ``df``."""
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    none = F.array().cast("array<string>")
    return df.select(*key, F.lit(order).alias("ord"), col(code).alias("code"), col(severity).alias("severity"), message.alias("message"), (none if paths is None else F.coalesce(paths, none)).alias("paths"))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def first_paths(df: DataFrame, by: list[str], most: int = 8, order: str = "path") -> DataFrame:
    """``(by..., n, paths)``: how many, and the first ``most``; no more than these are gathered."""
    w = Window.partitionBy(*by).orderBy(order, "path")
    k = df.withColumn("k", F.row_number().over(w))
    return k.groupBy(*by).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "path")))), lambda x: x.path).alias("paths"))


def scan_notes(files: DataFrame, tracked: DataFrame | None = None, submodules: DataFrame | None = None, listing: DataFrame | None = None, most: int = MAX_FILES) -> DataFrame:
    """``(repo_id, ord, code, severity, message, paths)`` of what a scan left out or found odd.

    ``tracked(repo_id, path)`` are the paths git knows, ``submodules(repo_id, path)`` its
    links, ``listing(repo_id, seq, path, real_path, is_alias)`` what was found before
    aliases were dropped.
    """
    repo, said = ["repo_id"], lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    kinds = {"not-text": "content-not-utf8", "unreadable": "content-unreadable", "too-large": "content-too-large"}
    u = files.where(F.col("is_source") & ~F.coalesce("text_complete", F.lit(True)) & F.col("skip_reason").isin(*kinds))
    u = first_paths(u, ["repo_id", "skip_reason"], order="seq").join(unread(files).select("repo_id", "skip_reason", "largest"), ["repo_id", "skip_reason"])
    code = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("skip_reason")]
    why = F.when(F.col("skip_reason") == "too-large", said(f"over {MAX_SAMPLE} bytes, largest: ", F.array_join("largest", ", "))).otherwise(said(F.col("skip_reason"), ": ", F.array_join(F.slice("paths", 1, 3), ", ")))
    rows = [
        note(u, repo, 3, code, "warning", said(counted(F.col("n"), "source file was", "source files were"), " not read and rank by path alone; ", why), F.col("paths")),
        note(generated_dominance(files), repo, 5, "generated-paths-dominant", "info", said(F.floor(100 * F.col("generated") / F.col("n") + 0.5).cast("string"), " % of the files are build output")),
        note(package_conflicts(files), repo, 7, "package-manager-conflict", "warning", F.lit("lock files of several package managers disagree")),
    ]
    if tracked is not None:
        scopes = busiest_scopes(tracked.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_anti")).groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "scope"))), lambda x: x.scope).alias("scopes"))
        gone = absent_tracked(tracked, files).join(scopes, "repo_id")
        rows.append(note(gone, repo, 2, "tracked-paths-absent", "warning", said(counted(F.col("n"), "tracked path is", "tracked paths are"), " not on disk, mostly under ", F.array_join("scopes", ", "))))
        rows.append(note(scan_limit(tracked, most), repo, 1, "scan-limit-reached", "warning", said(counted(F.col("skipped"), "path was", "paths were"), " beyond the limit of a scan")))
    if submodules is not None:
        rows.append(note(first_paths(submodules, repo), repo, 4, "submodules-skipped", "info", said(counted(F.col("n"), "submodule was", "submodules were"), " not scanned: ", F.array_join(F.slice("paths", 1, 3), ", ")), F.col("paths")))
    if listing is not None:
        twice = listing.join(linked_duplicates(listing).select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        rows.append(note(first_paths(twice, repo, 3), repo, 6, "duplicate-real-path", "info", said(counted(F.col("n"), "path leads", "paths lead"), " to a file scanned under another name: ", F.array_join("paths", ", "))))
    return functools.reduce(DataFrame.union, rows)


def package_conflicts(files: DataFrame) -> DataFrame:
    return package_manager(files.select("repo_id", "path")).where("conflict")


def task_notes(signals: DataFrame, grounding: DataFrame, shape: DataFrame) -> DataFrame:
    """``(repo_id, task_id, ord, code, severity, message, paths)`` of what a task says, or fails to say."""
    by = ["repo_id", "task_id"]
    j = grounding.join(shape.select(*by, "clustered"), by, "left")
    names = lambda c: F.array_join(c, ", ")
    some = lambda c: j.where(F.size(c) > 0)
    listed = signals.where((F.col("checklist_preserved") > 0) | (F.col("checklist_removed") > 0))
    kept = F.col("checklist_preserved") > 0
    lines = counted(F.when(kept, F.col("checklist_preserved")).otherwise(F.col("checklist_removed")), "unchecked line", "unchecked lines")
    rows = [
        note(some("unresolved"), by, 1, "unresolved-identifier", "warning", F.concat(F.lit("not found: "), names("unresolved"))),
        note(some("partially_resolved"), by, 2, "partially-resolved-identifier", "info", F.concat(F.lit("part of a longer name: "), names("partially_resolved"))),
        note(some("unverified"), by, 3, "identifier-unverified", "warning", F.concat(F.lit("sources were not read, so not verified: "), names("unverified"))),
        note(j.where("specificity = 'vague'"), by, 4, "vague-task", "warning", F.lit("the task names no symbol, file or behaviour")),
        note(j.where("clustered and specificity <> 'anchored'"), by, 5, "flat-ranking", "warning", F.lit("the leading files score alike")),
        note(listed, by, 6, "task-checklist-filtered", "info", F.concat(lines, F.when(kept, " of a checklist kept, as nothing else is said").otherwise(" of a checklist left out"))),
    ]
    return functools.reduce(DataFrame.union, rows)
