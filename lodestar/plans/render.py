"""Reports as text: JSON, Markdown and Mermaid, one value per plan, assembled in one late select.

Lists are bounded by their operators' limits (files, routes, findings), so a plan's text
is small however many plans there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

VERSION = 1


def lines(df: DataFrame, key: str, order: list[str], line: Column, name: str) -> DataFrame:
    """``(key, name)``: the lines of each key in order, joined."""
    rows = df.select(key, F.struct(*order, line.alias("_line")).alias("r"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["_line"]), "\n").alias(name))


def _section(title: str, body: str) -> Column:
    return F.concat(F.lit(f"\n## {title}\n\n"), F.coalesce(F.col(body), F.lit("- none")), F.lit("\n"))


def _gather(plans: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    for df in parts.values():
        plans = plans.join(df, key, "left")
    return plans


def report_json(plans: DataFrame, ranked: DataFrame, routes: DataFrame, risks: DataFrame, changed: DataFrame, key: str = "plan_id", impact: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """``(key, report)``: version, files, routes, risks, impact, changes, notes; two spaces deep and with a last line break.

    Plans that carry ``action`` and ``specificity`` say so under ``analysis``.
    """
    def listed(df: DataFrame, order: list[str], cols: list, name: str) -> DataFrame:
        g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("v")))).alias("x"))
        return g.select(key, F.transform("x", lambda x: x["v"]).alias(name))

    parts = {
        "contextFiles": (listed(ranked, ["rank", "path"], ["path", "rank", "score", "confidence", "reasons"], "contextFiles"), "array<struct<path:string,rank:int,score:int,confidence:string,reasons:array<string>>>"),
        "testRoutes": (listed(routes, ["ord"], ["command", F.lit("test").alias("kind"), "reason", "relatedFiles"], "testRoutes"), "array<struct<command:string,kind:string,reason:string,relatedFiles:array<string>>>"),
        "risks": (listed(risks, ["ord"], ["area", "severity"], "risks"), "array<struct<area:string,severity:string>>"),
        "changedFiles": (changed.groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("changedFiles")), "array<string>"),
    }
    if impact is not None:
        parts["impact"] = (listed(impact, ["rank"], ["path", "rank", "score", "confidence", F.transform("evidence", lambda e: F.struct(e["kind"].alias("kind"), e["seed"].alias("seed"), e["reason"].alias("reason"))).alias("evidence")], "impact"), "array<struct<path:string,rank:int,score:int,confidence:string,evidence:array<struct<kind:string,seed:string,reason:string>>>>")
    if notes is not None:
        parts["diagnostics"] = (listed(notes, ["ord"], ["code", "severity", "message", "paths"], "diagnostics"), "array<struct<code:string,severity:string,message:string,paths:array<string>>>")
    said = [c for c in ("action", "specificity", "top_score", "runner_up", "top_gap", "clustered") if c in plans.columns]
    j = _gather(plans.select(key, "summary", *said), key, {name: df for name, (df, _) in parts.items()})
    cols = [F.coalesce(name, F.array().cast(kind)).alias(name) for name, (_, kind) in parts.items()]
    if notes is None:
        cols.append(F.array().cast("array<string>").alias("diagnostics"))
    if said:
        cols.append(F.struct(*said).alias("analysis"))
    body = F.struct(F.lit(VERSION).alias("reportVersion"), "summary", *cols)
    return j.select(key, F.concat(F.to_json(body, {"pretty": "true"}), F.lit("\n")).alias("report"))


def report_markdown(plans: DataFrame, ranked: DataFrame, routes: DataFrame, risks: DataFrame, key: str = "plan_id") -> DataFrame:
    file = F.concat(F.col("rank").cast("string"), F.lit(". "), T.code_span(F.col("path")), F.lit(" ("), "confidence", F.lit(" confidence, score "), F.col("score").cast("string"), F.lit("): "), F.array_join("reasons", "; "))
    route = F.concat(F.lit("- "), T.code_span(F.col("command")), F.lit(": "), "reason")
    risk = F.concat(F.lit("- "), "severity", F.lit(": "), "area")
    j = _gather(plans.select(key, "summary"), key, {"f": lines(ranked, key, ["rank"], file, "f"), "r": lines(routes, key, ["ord"], route, "r"), "k": lines(risks, key, ["ord"], risk, "k")})
    return j.select(key, F.concat(F.lit("# Plan\n\n"), "summary", F.lit("\n"), _section("Files", "f"), _section("Tests", "r"), _section("Risks", "k")).alias("text"))


def report_compact(plans: DataFrame, ranked: DataFrame, impact: DataFrame, routes: DataFrame, notes: DataFrame, key: str = "plan_id") -> DataFrame:
    """For agents: the file to edit, three to read, five around it, the test command, three uncertainties."""
    span = T.code_span(F.col("path"))
    dash = F.concat(F.lit("- "), span)
    parts = {
        "edit": lines(ranked.where("rank = 1"), key, ["rank"], dash, "edit"),
        "read": lines(ranked.where("rank between 2 and 4"), key, ["rank"], dash, "read"),
        "around": lines(impact.where("rank <= 5"), key, ["rank"], dash, "around"),
        "test": lines(routes.where("ord = 1"), key, ["ord"], F.concat(F.lit("- "), T.code_span(F.col("command"))), "test"),
        "unsure": lines(notes.where("ord <= 3"), key, ["ord"], F.concat(F.lit("- "), "message"), "unsure"),
    }
    j = _gather(plans.select(key, "summary"), key, parts)
    titles = (("Edit first", "edit"), ("Read", "read"), ("Impact", "around"), ("Verify", "test"), ("Uncertain", "unsure"))
    return j.select(key, F.concat(F.lit("## Task\n\n"), "summary", F.lit("\n"), *[_section(a, b) for a, b in titles]).alias("text"))


def _mermaid(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), ("\n", "&#10;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mermaid(nodes: DataFrame, edges: DataFrame, key: str = "plan_id") -> DataFrame:
    """A flow chart; history is dashed."""
    n = lines(nodes, key, ["n"], F.concat(F.lit("  "), "id", F.lit('["'), _mermaid(F.col("path")), F.lit('"]:::'), "role"), "n")
    arrow = F.when(F.col("kind") == "co-change", " -.-").otherwise(" -->")
    e = lines(edges, key, ["rank", "pos"], F.concat(F.lit("  "), "src", arrow, F.lit('|"'), _mermaid(F.col("label")), F.lit('"| '), "dst"), "e")
    style = "  classDef primary stroke-width:2px\n  classDef impact stroke-width:1px\n"
    return n.join(e, key, "left").select(key, F.concat_ws("\n", F.lit("flowchart TD"), "n", "e", F.lit(style)).alias("text"))


def context_markdown(snippets: DataFrame, key: str = "plan_id") -> DataFrame:
    """Snippets in fences longer than any run of back-ticks within; omitted files by reason."""
    fence = T.safe_fence(F.col("content"))
    shown = F.concat(F.lit("### "), T.code_span(F.col("path")), F.lit(" lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n\n"), fence, P.fence_language(F.col("path")), F.lit("\n"), "content", F.lit("\n"), fence)
    left = F.concat(F.lit("- "), T.code_span(F.col("path")), F.lit(": "), "omitted")
    return lines(snippets, key, ["ord"], F.coalesce(shown, left), "text")


def comparison_markdown(deltas: DataFrame, key: str = "pair_id") -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("entered", "left", "moved", "confidence-changed", "unchanged"))), F.col("status"))
    from_to = lambda a, b: F.concat(F.coalesce(F.col(a).cast("string"), F.lit("-")), F.lit(" to "), F.coalesce(F.col(b).cast("string"), F.lit("-")))
    line = F.concat(F.lit("- "), "status", F.lit(" "), T.code_span(F.col("path")), F.lit(": rank "), from_to("prev_rank", "cur_rank"), F.lit(", score "), from_to("prev_score", "cur_score"))
    return lines(deltas.withColumn("o", order).withColumn("r", F.coalesce("cur_rank", "prev_rank")), key, ["o", "r", "path"], line, "text")


def verification_markdown(findings: DataFrame, key: str = "plan_id") -> DataFrame:
    listed = F.array_join(F.transform(F.slice("paths", 1, 8), T.code_span), ", ")
    return lines(findings, key, ["ord", "area"], F.concat(F.lit("- **"), "severity", F.lit("** "), "code", F.coalesce(F.concat(F.lit(" ("), "area", F.lit(")")), F.lit("")), F.lit(": "), listed), "text")


def backtest_markdown(rates: DataFrame) -> DataFrame:
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "cohort", "arm", F.col("k").cast("string"), F.concat(F.col("hits").cast("string"), F.lit("/"), F.col("n").cast("string")), F.concat(pct("rate"), F.lit(" ("), pct("low"), F.lit("-"), pct("high"), F.lit(")"))), F.lit(" |"))
    head = F.lit("| cohort | arm | k | hits | rate (95% interval) |\n|---|---|---|---|---|\n")
    one = lines(rates.withColumn("_k", F.lit(1)), "_k", ["cohort", "arm", "k"], row, "text")
    return one.select(F.concat(head, "text").alias("text"))


def fit(text: Column, most: int, note: str = "\n\n(cut to fit)\n") -> Column:
    """``text`` within so many bytes; an open fence is closed."""
    head = T.truncate_utf8(text, most - len(note) - 4)
    fences = F.size(T.find_all(head, r"(?m)^```"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(head, F.when(fences % 2 == 1, F.lit("\n```")).otherwise(F.lit("")), F.lit(note)))


def explanation_markdown(explained: DataFrame, by: list[str] = ["repo_id", "task_id"]) -> DataFrame:  # noqa: B006
    """``(by..., path, text)`` of what ``reports.explain`` found: why a file is, or is not, among those of a task."""
    n = lambda c: F.col(c).cast("string")
    says = (
        F.when(F.col("status") == "ranked", F.concat(F.lit("Rank "), n("rank"), F.lit(" with a score of "), n("score"), F.lit(" and "), "confidence", F.lit(" confidence.")))
        .when(F.col("status") == "outside-limit", F.concat(F.lit("A score of "), n("score"), F.lit(" reaches the lowest that is shown, "), n("cutoff"), F.lit(", but others come first.")))
        .when(F.col("status") == "below-cutoff", F.concat(F.lit("A score of "), n("score"), F.lit(" is under "), n("cutoff"), F.lit(". A name, a quoted text or a path of this file in the task raises it.")))
        .when((F.col("status") == "excluded") & F.col("pattern").isNotNull(), F.concat(F.lit("Left out by the pattern "), T.code_span(F.col("pattern")), F.lit(".")))
        .when(F.col("status") == "excluded", "No candidate: tests, lock files and generated copies are not ranked.").otherwise("Not scanned: no such file was read."))
    signals = F.when(F.size("reasons") > 0, F.concat(F.lit("\n## Signals\n\n"), F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n"), F.lit("\n"))).otherwise("")
    return explained.select(*by, "path", F.concat(F.lit("# Why "), T.code_span(F.col("path")), F.lit("\n\n"), says, F.lit("\n"), F.coalesce(signals, F.lit(""))).alias("text"))
