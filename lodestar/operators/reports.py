"""Reports against each other and against what was done: compare, verify, explain, validate."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .routes import risk_notes, risk_rules, risk_tokens


def compare(previous: DataFrame, current: DataFrame, key: str = "pair_id") -> DataFrame:
    """Two rankings ``(pair_id, path, rank, score, confidence)`` joined on the path; a path twice in one is an error."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        once = df.groupBy(key, "path").agg(F.count("*").alias("_n"), *[F.first(c).alias(f"{mark}_{c}") for c in ("rank", "score", "confidence")])
        return once.withColumn("path", F.when(F.col("_n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("duplicate path: "), "path")).cast("string"))).drop("_n")

    j = side(previous, "prev").join(side(current, "cur"), [key, "path"], "full")
    status = (
        F.when(F.col("prev_rank").isNull(), "entered").when(F.col("cur_rank").isNull(), "left")
        .when((F.col("prev_rank") != F.col("cur_rank")) | (F.col("prev_score") != F.col("cur_score")), "moved")
        .when(F.col("prev_confidence") != F.col("cur_confidence"), "confidence-changed").otherwise("unchanged"))
    return j.select(key, "path", status.alias("status"), "prev_rank", "cur_rank", "prev_score", "cur_score", "prev_confidence", "cur_confidence")


def compare_summary(deltas: DataFrame, key: str = "pair_id") -> DataFrame:
    """Counts by status, and the leaders before and after."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.replace("-", "_"))
    return deltas.groupBy(key).agg(*map(n, ("entered", "left", "moved", "confidence-changed", "unchanged")), F.max(F.when(F.col("prev_rank") == 1, F.col("path"))).alias("prev_leader"), F.max(F.when(F.col("cur_rank") == 1, F.col("path"))).alias("cur_leader"))


CODES = ("plan-repository-mismatch", "plan-partially-stale", "planned-file-deleted", "edit-in-generated-location", "tracked-generated-edit", "unmapped-change", "leading-file-untouched", "no-test-changed", "impact-file-unreviewed", "new-risk-area")


def verify(plans: DataFrame, planned: DataFrame, changed: DataFrame, files: DataFrame, tracked: DataFrame, routes: DataFrame, impact: DataFrame, plan_risks: DataFrame) -> DataFrame:
    """Findings ``(plan_id, ord, code, severity, paths, area)`` of what changed against each plan.

    ``plans(plan_id, repo_id)``, ``planned(plan_id, path, rank, confidence)``,
    ``changed(plan_id, path)``, ``files(repo_id, path, is_test, is_source, kind)``,
    ``tracked(repo_id, path)``, ``routes(plan_id, path)`` of routed tests,
    ``impact(plan_id, rank, path, confidence)``, ``plan_risks(plan_id, area)``.
    A plan none of whose files exists has that one finding; one with nothing changed has
    no findings beyond missing files.
    """
    f = plans.join(files, "repo_id").select("plan_id", "path", "is_test", "is_source", "kind")
    here = F.col("is_test").isNotNull()
    p = planned.join(f, ["plan_id", "path"], "left").join(changed.withColumn("edited", F.lit(True)), ["plan_id", "path"], "left").withColumn("edited", F.coalesce("edited", F.lit(False)))
    lost = ~here & ~F.col("edited")
    state = p.groupBy("plan_id").agg(F.count("*").alias("n"), F.count_if(lost).alias("lost"))
    edits = changed.groupBy("plan_id").agg(F.count("*").alias("edits"))
    state = plans.join(state, "plan_id", "left").join(edits, "plan_id", "left").na.fill(0, ["n", "lost", "edits"])
    mismatch = state.where("n > 0 and lost = n").select("plan_id")
    live = state.where("not (n > 0 and lost = n) and edits > 0").select("plan_id")

    stems = plans.join(files.where(F.col("is_source") & ~P.is_generated(F.col("path")) & ~P.is_backup(F.col("path"))).select("repo_id", P.module_stem(F.col("path")).alias("stem")).distinct(), "repo_id").select("plan_id", "stem", F.lit(True).alias("maintained"))
    kept = plans.join(tracked.select("repo_id", "path").distinct(), "repo_id").select("plan_id", "path", F.lit(True).alias("tracked"))
    c = changed.join(live, "plan_id", "left_semi").withColumn("stem", P.module_stem(F.col("path")))
    c = c.join(f, ["plan_id", "path"], "left").join(stems, ["plan_id", "stem"], "left").join(kept, ["plan_id", "path"], "left").join(planned.select("plan_id", "path", F.lit(True).alias("in_plan")).distinct(), ["plan_id", "path"], "left")
    c = c.na.fill(False, ["is_test", "maintained", "tracked", "in_plan"])
    twin = P.is_generated(F.col("path")) & F.col("maintained")
    c = c.withColumn("discarded", P.is_backup(F.col("path")) | (twin & ~F.col("tracked"))).withColumn("artifact", twin & F.col("tracked"))
    plain = ~F.col("is_test") & ~F.col("discarded") & ~F.col("artifact")

    def row(df: DataFrame, k: int, severity: Column | str, order: list | None = None, most: int | None = None, area: Column | None = None, by: list[str] = ["plan_id"]) -> DataFrame:  # noqa: B006
        sev = F.lit(severity) if isinstance(severity, str) else severity
        listed = F.transform(F.array_sort(F.collect_list(F.struct(*(order or ["path"]), F.col("path").alias("_p")))), lambda x: x["_p"])
        g = df.withColumn("_s", sev).groupBy(*by).agg(F.first("_s").alias("severity"), (F.slice(listed, 1, most) if most else listed).alias("paths"))
        return g.select("plan_id", F.lit(k + 1).alias("ord"), F.lit(CODES[k]).alias("code"), "severity", "paths", (area if area is not None else F.lit(None).cast("string")).alias("area"))

    missing = p.join(mismatch, "plan_id", "left_anti")
    tests = f.where("is_test").select("plan_id", "path")
    code = c.where(plain & (F.col("kind") == "code"))
    untested = code.select("plan_id").distinct().join(c.where("is_test").select("plan_id").distinct(), "plan_id", "left_anti")
    suggested = routes.select("plan_id", "path").distinct().join(tests, ["plan_id", "path"], "left_semi").join(untested, "plan_id", "left_semi")
    anchors = suggested.union(code.select("plan_id", "path").join(untested, "plan_id", "left_semi").join(suggested.select("plan_id").distinct(), "plan_id", "left_anti"))
    lead = planned.where("rank = 1").join(live, "plan_id", "left_semi").join(changed, ["plan_id", "path"], "left_anti")
    outside = impact.where("confidence = 'high'").join(live, "plan_id", "left_semi").join(planned, ["plan_id", "path"], "left_anti").join(changed, ["plan_id", "path"], "left_anti").join(tests, ["plan_id", "path"], "left_anti")
    mine = c.select("plan_id", "path")
    fresh = risk_notes(mine, mine).join(plan_risks, ["plan_id", "area"], "left_anti").select("plan_id", "area", F.col("ord").alias("rule"), "severity")
    touched = mine.select("plan_id", "path", F.explode(risk_tokens(F.col("path"))).alias("token")).join(F.broadcast(risk_rules(plans.sparkSession)).select("area", "token"), "token").select("plan_id", "area", "path").distinct().join(fresh.select("plan_id", "area", "rule"), ["plan_id", "area"])
    rows = [
        row(p.join(mismatch, "plan_id", "left_semi"), 0, "error", ["rank"], 8),
        row(missing.where(lost), 1, "warning", ["rank"], 8),
        row(missing.where(~here & F.col("edited")), 2, "info", ["rank"], 8),
        row(c.where("discarded"), 3, "error"),
        row(c.where("artifact"), 4, "warning"),
        row(c.where(plain & ~F.col("in_plan") & F.coalesce("is_source", F.lit(True))), 5, "warning"),
        row(lead, 6, F.when(F.col("confidence") == "high", "warning").otherwise("info")),
        row(anchors, 7, "warning"),
        row(outside, 8, "info", ["rank"], 8),
        row(touched, 9, "warning", None, None, F.col("area"), ["plan_id", "area"]),
    ]
    return functools.reduce(DataFrame.unionByName, rows)


def verify_summary(plans: DataFrame, findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """Errors, warnings and notes per plan, and whether the check fails: at a finding of ``fail_on`` or worse."""
    worse = {"error": ["errors"], "warning": ["errors", "warnings"], "info": ["errors", "warnings", "notes"]}[fail_on]
    n = lambda s: F.count_if(F.col("severity") == s)
    s = findings.groupBy("plan_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("notes"))
    return plans.select("plan_id").join(s, "plan_id", "left").na.fill(0, ["errors", "warnings", "notes"]).withColumn("failed", functools.reduce(Column.__or__, [F.col(c) > 0 for c in worse]))


def explain(every: DataFrame, targets: DataFrame, files: DataFrame, excluded: DataFrame, limit: int = 8, cutoff: int = 4) -> DataFrame:
    """Why a path is, or is not, among the files of a task.

    ``every`` ranks all candidates without limit or cutoff; ``targets(repo_id, task_id,
    path)``; ``excluded(repo_id, path, pattern)``.  Paths compare without case.
    """
    by = ["repo_id", "task_id"]
    f = files.select("repo_id", F.lower("path").alias("low"), F.col("path").alias("known"), "is_test", "is_source")
    t = targets.withColumn("low", F.lower("path")).join(f, ["repo_id", "low"], "left").withColumn("path", F.coalesce("known", "path"))
    t = t.join(excluded.groupBy("repo_id", "path").agg(F.min("pattern").alias("pattern")), ["repo_id", "path"], "left")
    shown = every.where(F.col("score") >= cutoff).groupBy(*by).agg(F.count("*").alias("n"), F.min(F.when(F.col("rank") <= limit, F.col("score"))).alias("lowest"))
    t = t.join(every.select(*by, "path", "rank", "score", "confidence", "reasons"), [*by, "path"], "left").join(shown, by, "left")
    full = F.coalesce(F.col("n") >= limit, F.lit(False))
    status = (
        F.when(F.col("pattern").isNotNull(), "excluded")
        .when((F.col("rank") <= limit) & (F.col("score") >= cutoff), "ranked")
        .when(F.col("known").isNull(), "not-scanned")
        .when(F.col("score").isNull() & F.col("is_test"), "excluded").when(F.col("score").isNull() & ~F.col("is_source"), "not-scanned").when(F.col("score").isNull(), "excluded")
        .when(full & (F.col("score") >= F.col("lowest")), "outside-limit").otherwise("below-cutoff"))
    cut = F.when(full, F.col("lowest")).otherwise(cutoff)
    t = t.withColumn("status", status)
    on = F.col("status").isin("ranked", "outside-limit", "below-cutoff")
    return t.select(*by, "path", "status", F.when(F.col("status") == "ranked", F.col("rank")).alias("rank"), F.when(on, F.col("score")).alias("score"), F.when(F.col("status") == "ranked", F.col("confidence")).alias("confidence"), F.when(F.col("status").isin("outside-limit", "below-cutoff"), cut).alias("cutoff"), "pattern", F.when(on, F.col("reasons")).otherwise(F.array().cast("array<string>")).alias("reasons"))


def saved(spark: SparkSession, path: str) -> DataFrame:
    """``(label, report)`` of saved report files, a row each; a byte order mark at the start is no part of the text."""
    files = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(F.substring_index("path", "/", -1).alias("label"), F.regexp_replace(text, "^\ufeff", "").alias("report"))


def validate(reports: DataFrame) -> DataFrame:
    """``reports(label, report)`` -> ``(label, valid, problem, entry)``: the first rule that fails, and the first bad entry."""
    v = F.try_parse_json("report")
    typ = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    is_array = lambda p: F.coalesce(typ(p).startswith("ARRAY"), F.lit(False))
    items = lambda p: F.coalesce(F.try_variant_get(v, p, "array<variant>"), F.array().cast("array<variant>"))
    text = lambda x, p: F.when(F.schema_of_variant(F.try_variant_get(x, p, "variant")) == "STRING", F.try_variant_get(x, p, "string"))
    safe = lambda s: F.coalesce((F.length(F.trim(s)) > 0) & ~s.contains("\0") & ~s.rlike(r"^(?:[\\/]|[A-Za-z]:)") & ~F.exists(F.split(F.translate(s, "\\", "/"), "/"), lambda g: g.isin("", ".", "..")), F.lit(False))
    versioned = F.coalesce(F.try_variant_get(v, "$.reportVersion", "double") == 1, F.lit(False))
    has = lambda x, p: F.try_variant_get(x, p, "variant").isNotNull()

    def whole(x: Column, p: str, least: int) -> Column:
        n = F.try_variant_get(x, p, "double")
        return F.coalesce((n == F.floor(n)) & (n >= least) & ~F.schema_of_variant(F.try_variant_get(x, p, "variant")).isin("STRING", "BOOLEAN"), F.lit(False))

    number = lambda x, p: F.try_variant_get(x, p, "double").isNotNull() & ~F.schema_of_variant(F.try_variant_get(x, p, "variant")).isin("STRING", "BOOLEAN")
    one_of = lambda x, p, values: F.coalesce(text(x, p).isin(*values), F.lit(False))
    need = lambda x, p, ok: ~(versioned | has(x, p)) | ok
    paths_ok = lambda x, p: F.coalesce(F.schema_of_variant(F.try_variant_get(x, p, "variant")).startswith("ARRAY"), F.lit(False)) & F.forall(F.coalesce(F.try_variant_get(x, p, "array<variant>"), F.array().cast("array<variant>")), lambda s: safe(text(s, "$")))
    file_ok = lambda x: safe(text(x, "$.path")) & need(x, "$.rank", whole(x, "$.rank", 1)) & need(x, "$.score", number(x, "$.score")) & need(x, "$.confidence", one_of(x, "$.confidence", ("high", "medium", "low")))
    filled = lambda s: F.coalesce(F.length(F.trim(s)) > 0, F.lit(False))
    route_ok = lambda x: filled(text(x, "$.command")) & paths_ok(x, "$.relatedFiles") & need(x, "$.kind", one_of(x, "$.kind", ("test", "validation"))) & need(x, "$.reason", text(x, "$.reason").isNotNull())
    risk_ok = lambda x: filled(text(x, "$.area")) & need(x, "$.severity", one_of(x, "$.severity", ("low", "medium", "high")))
    diag_ok = lambda x: filled(text(x, "$.code")) & text(x, "$.message").isNotNull() & one_of(x, "$.severity", ("info", "warning", "error"))
    first_bad = lambda p, ok: F.array_position(F.transform(items(p), ok), False) - 1
    files = items("$.contextFiles")
    names = F.transform(files, lambda x: text(x, "$.path"))
    twice = F.array_position(F.transform(names, lambda n, i: F.array_position(names, n) - 1 == i), False) - 1
    order = F.array_position(F.transform(files, lambda x, i: F.coalesce(F.try_variant_get(x, "$.rank", "double") == i + 1, F.lit(False))), False) - 1
    bad = lambda name, cond, at=None: F.when(cond, F.struct(F.lit(name).alias("problem"), (F.lit(None).cast("int") if at is None else at.cast("int")).alias("at")))
    at = {p: first_bad(f"$.{p}", ok) for p, ok in (("contextFiles", file_ok), ("testRoutes", route_ok), ("risks", risk_ok), ("diagnostics", diag_ok))}
    envelope = (F.schema_of_variant(F.try_variant_get(v, "$.summary", "variant")) == "STRING") & is_array("$.testRoutes") & is_array("$.risks") & is_array("$.changedFiles") & is_array("$.diagnostics")
    result = F.coalesce(
        bad("not a report", ~F.coalesce(v.isNotNull() & is_array("$.contextFiles"), F.lit(False))),
        bad("unsupported version", has(v, "$.reportVersion") & ~versioned),
        bad("incomplete envelope", ~F.coalesce(envelope, F.lit(False))),
        bad("invalid contextFiles", at["contextFiles"] >= 0, at["contextFiles"]),
        bad("duplicate path", twice >= 0, twice),
        bad("rank out of order", versioned & (order >= 0), order),
        bad("invalid testRoutes", at["testRoutes"] >= 0, at["testRoutes"]),
        bad("invalid risks", at["risks"] >= 0, at["risks"]),
        bad("unsafe changedFiles", ~paths_ok(v, "$.changedFiles")),
        bad("invalid diagnostics", at["diagnostics"] >= 0, at["diagnostics"]),
    )
    return reports.withColumn("_r", result).select("label", F.col("_r").isNull().alias("valid"), F.col("_r.problem").alias("problem"), F.col("_r.at").alias("entry"))
