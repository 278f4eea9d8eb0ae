"""Do the names in a task exist in the repository?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..sources.tables import written

MATCHED = 5
# Openings and words of tasks that name nothing.
VAGUE = r"(?i)^\s*(?:please\s+)?(?:improve|make|clean(?:\s+(?:this|it|things?))?\s+up|cleanup|refactor)(?![A-Za-z0-9_])"
BROKEN = r"(?i)^\s*(?:please\s+)?(?:refactor|cleanup|clean\s+up)\s+(?:broke|breaks?|caused|causes|deleted?|deletes?|fails?|failed)(?![A-Za-z0-9_])"
VAGUE_TERMS = r"(?i)(?<![A-Za-z0-9_])(?:please|improve|better|clean(?:\s+(?:this|it|things?))?\s+up|cleanup|refactor|developer\s+experience|dx|general|overall|codebase|quality|make|things?)(?![A-Za-z0-9_])"


def is_vague(issue: Column) -> Column:
    left = F.size(T.tokenize(T.rx(issue, VAGUE_TERMS, " ")))
    return issue.rlike(VAGUE) & ~issue.rlike(BROKEN) & (left <= 3)


def is_anchor(name: Column, issue: Column) -> Column:
    capitals = F.length(name) - F.length(T.rx(name, "[A-Z]"))
    return issue.contains(F.concat(F.lit("`"), name, F.lit("`"))) | name.rlike("[_$0-9]") | name.rlike(r"[^\x00-\x7F]") | name.rlike("^[a-z][A-Za-z0-9_$]*[A-Z]") | (capitals >= 3)


def _follows(text: Column, name: Column, before: str) -> Column:
    """The whole name stands in the text after what ``before`` allows; the search goes by the name, which is quickly found."""
    quoted = T.quote_regex(name)
    return text.contains(name) & F.rlike(text, F.concat(quoted, F.lit(before), quoted, F.lit(")" + T.AFTER_NAME)))


def defines(text: Column, name: Column) -> Column:
    # the first rule is wider than the second: a definition ends in white space, a star or "function"
    return _follows(text, name, r"(?<=[\s*n]") & F.rlike(text, F.concat(F.lit(T.DEFINES), T.quote_regex(name), F.lit(T.AFTER_NAME)))


def mentions(text: Column, name: Column) -> Column:
    return _follows(text, name, r"(?<![\p{L}\p{N}_$]")


def definitions(text: Column) -> Column:
    """Names that a text defines."""
    return F.array_distinct(T.find_all(text, T.DEFINES + "(" + T.NAME + ")" + T.AFTER_NAME, 1))


def paths_named(named: DataFrame, files: DataFrame) -> DataFrame:
    """``named(repo_id, mention, ...)`` with each ``path`` of its repository that the mention names.

    Both end in the same path element, or the mention is that without its extension:
    this is joined by equality, and the whole rule asked of what meets.
    """
    last = lambda c: F.substring_index(F.lower(F.translate(c, "\\", "/")), "/", -1)
    ends = F.array_distinct(F.array(last("path"), T.rx(last("path"), r"\.[^.]+$")))
    f = files.select("repo_id", "path", F.explode(ends).alias("_last"))
    return named.withColumn("_last", last("mention")).join(f, ["repo_id", "_last"]).where(P.matches_mention(F.col("path"), F.col("mention"))).drop("_last")


def may_hold(sought: DataFrame, files: DataFrame) -> DataFrame:
    """``sought(repo_id, needle, ...)`` with each ``path`` of its repository whose text may hold the needle; none that does is left out.

    The longest run of name characters in a needle lies within a run of any text that
    holds it, so it meets the distinct runs of its repository by its first trigram.
    Needles without a run of three characters meet every path of their repository.
    """
    runs_of = lambda c: T.find_all(F.coalesce(c, F.lit("")), r"[\p{L}\p{N}_$]{3,}")
    longest = F.array_max(F.transform(runs_of(F.col("needle")), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    needles = written(sought.withColumn("_key", longest))
    keys = needles.where("_key is not null").select("repo_id", "_key").distinct().withColumn("gram", F.substring("_key", 1, 3))
    runs = files.join(keys.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", "path", F.explode(F.array_distinct(runs_of(F.col("text")))).alias("run"))
    grams = runs.select("repo_id", "run").distinct().select("repo_id", "run", F.explode(F.array_distinct(F.regexp_extract_all("run", F.lit("(?=(...))"), F.lit(1)))).alias("gram"))
    within = grams.join(keys, ["repo_id", "gram"]).where(F.col("run").contains(F.col("_key"))).select("repo_id", "run", "_key")
    near = runs.join(within, ["repo_id", "run"]).select("repo_id", "path", "_key").distinct().join(needles, ["repo_id", "_key"])
    every = needles.where("_key is null").join(files.select("repo_id", "path"), "repo_id")
    return near.select(*sought.columns, "path").union(every.select(*sought.columns, "path"))


def ground_identifiers(signals: DataFrame, files: DataFrame, exact: DataFrame | None = None, defined: DataFrame | None = None) -> DataFrame:
    """``(repo_id, task_id, ord, identifier, status, matched_files)``.

    Names meet the texts of their own repository that may hold them, all files counting,
    and definitions by the parts that names share; ``files`` is best a table.  A caller
    may have found them: ``exact(repo_id, identifier, path, seq, level)``, where 3 defines
    a name and 2 mentions it, and ``defined(repo_id, path, seq, at, name)``.
    """
    names = signals.select("repo_id", "task_id", "issue_text", F.posexplode("identifiers").alias("ord", "identifier")).where(is_anchor(F.col("identifier"), F.coalesce("issue_text", F.lit(""))))
    names = names.select("repo_id", "task_id", "ord", "identifier")
    sought = written(names.select("repo_id", "identifier").distinct())
    by = ["repo_id", "identifier"]
    text = F.coalesce("text", F.lit(""))
    if exact is None:
        near = may_hold(sought.withColumn("needle", F.col("identifier")), files).select(*by, "path").join(files.select("repo_id", "path", "seq", text.alias("text")), ["repo_id", "path"])
        exact = near.select(*by, "path", "seq", F.when(defines(F.col("text"), F.col("identifier")), 3).when(mentions(F.col("text"), F.col("identifier")), 2).otherwise(0).alias("level")).where("level > 0")
    exact = exact.join(sought, by, "left_semi").select(*by, "path", "seq", "level")
    # a definition whose parts hold all parts of the name
    parts = sought.select(*by, T.tokenize_identifier(F.col("identifier")).alias("parts")).where("size(parts) >= 2").select(*by, F.array_distinct("parts").alias("parts"))
    if defined is None:
        defined = files.join(parts.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", "path", "seq", F.posexplode(definitions(text)).alias("at", "name"))
    # a name is met by the rarest of its parts, and the others are looked up there
    whole = defined.select("repo_id", "path", "seq", F.array_distinct(T.tokenize_identifier(F.col("name"))).alias("held"))
    tokens, each = whole.select("*", F.explode("held").alias("part")), parts.select("*", F.explode("parts").alias("part"))
    spread = tokens.join(each.select("repo_id", "part").distinct(), ["repo_id", "part"], "left_semi").groupBy("repo_id", "part").agg(F.count("*").alias("k"))
    rarest = each.join(spread, ["repo_id", "part"], "left").groupBy(*by).agg(F.min_by("part", F.struct(F.coalesce("k", F.lit(0)), "part")).alias("part"), F.first("parts").alias("parts"))
    partial = tokens.join(written(rarest), ["repo_id", "part"]).where(F.size(F.array_except("parts", "held")) == 0).select(*by, "path", "seq").distinct().withColumn("level", F.lit(1))
    # the first files of the best level are taken before any list is made: a common name stands in many
    order = Window.partitionBy(*by).orderBy(F.desc("level"), "seq", "path")
    top = exact.union(partial.select(*exact.columns)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= MATCHED)
    g = top.groupBy(*by).agg(F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("k", "level", "path"))).alias("top"))
    g = g.select(*by, "level", F.transform(F.filter("top", lambda x: x["level"] == F.col("level")), lambda x: x["path"]).alias("matched"))
    unread = files.groupBy("repo_id").agg(F.bool_or(F.col("is_source") & ~F.coalesce("text_complete", F.lit(True))).alias("unread"))
    none = F.array().cast("array<string>")
    return names.join(g, by, "left").join(unread, "repo_id", "left").select(
        "repo_id", "task_id", "ord", "identifier",
        F.when(F.col("level") == 3, "exact-definition").when(F.col("level") == 2, "exact-text").when(F.col("level") == 1, "partial-definition").when(F.col("unread"), "unverified").otherwise("not-found").alias("status"),
        F.coalesce("matched", none).alias("matched_files"),
    )


def task_grounding(signals: DataFrame, files: DataFrame, grounded: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row per task: specificity, names by status, and whether the scan was complete."""
    names = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("ord", "identifier")))), lambda x: x.identifier)
    by = grounded.groupBy("repo_id", "task_id").agg(
        names("not-found").alias("unresolved"), names("partial-definition").alias("partially_resolved"), names("unverified").alias("unverified"),
        F.count_if(F.col("status").isin("exact-definition", "exact-text")).alias("resolved"))
    anchored = paths_named(signals.select("repo_id", "task_id", F.explode("file_mentions").alias("mention")), files).select("repo_id", "task_id").distinct().withColumn("mention_found", F.lit(True))
    single = signals.select("repo_id", "task_id", T.tokenize(F.coalesce("issue_text", F.lit(""))).alias("t")).where("size(t) = 1").select("repo_id", "task_id", F.col("t")[0].alias("token"))
    held = files.join(single.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", F.explode(F.array_union(T.tokenize(F.col("path")), T.tokenize(F.coalesce("text", F.lit(""))))).alias("token")).distinct()
    known = single.join(held.withColumn("_held", F.lit(True)), ["repo_id", "token"], "left").select("repo_id", "task_id", F.col("_held").isNotNull().alias("token_known"))
    scans = files.groupBy("repo_id").agg((~F.coalesce(F.bool_or(F.col("is_source") & ~F.coalesce("text_complete", F.lit(True))), F.lit(False))).alias("scan_complete"))
    if diagnostics is not None:
        cut = diagnostics.where(F.col("code").isin("scan-limit-reached", "tracked-paths-absent")).select("repo_id").distinct().withColumn("cut", F.lit(True))
        scans = scans.join(cut, "repo_id", "left").select("repo_id", (F.col("scan_complete") & F.col("cut").isNull()).alias("scan_complete"))
    g = signals.select("repo_id", "task_id", "issue_text")
    for other in (by, anchored, known):
        g = g.join(other, ["repo_id", "task_id"], "left")
    g = g.join(scans, "repo_id", "left")
    none = F.array().cast("array<string>")
    for c in ("unresolved", "partially_resolved", "unverified"):
        g = g.withColumn(c, F.coalesce(c, none))
    direct = F.coalesce("mention_found", F.lit(False)) | (F.coalesce("resolved", F.lit(0)) > 0) | (F.size("partially_resolved") > 0)
    vague = is_vague(F.coalesce("issue_text", F.lit(""))) | (F.col("token_known") == F.lit(False))
    return g.select(
        "repo_id", "task_id", F.when(direct, "anchored").when(F.coalesce(vague, F.lit(False)), "vague").otherwise("descriptive").alias("specificity"),
        "unresolved", "partially_resolved", "unverified",
        (F.coalesce("resolved", F.lit(0)) + F.size("partially_resolved")).alias("supported"),
        F.coalesce("scan_complete", F.lit(True)).alias("scan_complete"), is_vague(F.coalesce("issue_text", F.lit(""))).alias("issue_vague"))


def grounded_tokens(signals: DataFrame, grounding: DataFrame, extract) -> DataFrame:
    """Tokens of each task once the names that resolve to nothing are taken out of its text."""
    without = lambda c: F.aggregate("unresolved", F.coalesce(c, F.lit("")), lambda a, x: F.replace(a, x, F.lit(" ")))
    s = signals.join(grounding.select("repo_id", "task_id", "unresolved"), ["repo_id", "task_id"])
    cleaned = s.select("repo_id", "task_id", without("issue_text").alias("issue_text"), without("diff_text").alias("diff_text"))
    return extract(cleaned).select("repo_id", "task_id", F.col("tokens").alias("grounded_tokens"))
