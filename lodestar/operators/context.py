"""Context packs: bounded stretches of the files of a plan, and diffs cut to a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written

CANDIDATES, LEAST = 15, 48
SHARES = {"primary": 0.4, "supporting": 0.25}
DEFINES = r"(?<![A-Za-z0-9_])(?:class|function|interface|type|enum|def|fn|func|const|let|var)(?![A-Za-z0-9_])"


def candidates(ranked: DataFrame, impact: DataFrame) -> DataFrame:
    """``(plan_id, ord, path, role, confidence, reason)``: ranked files, then their surroundings; at most 15."""
    a = ranked.select("plan_id", "path", F.lit("primary").alias("role"), "confidence", F.array_join(F.slice("reasons", 1, 2), "; ").alias("reason"), F.lit(0).alias("p"), "rank")
    b = impact.select("plan_id", "path", F.lit("supporting").alias("role"), "confidence", F.array_join(F.slice(F.transform("evidence", lambda e: e.reason), 1, 2), "; ").alias("reason"), F.lit(1).alias("p"), "rank")
    once = a.union(b).withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "path").orderBy("p", "rank"))).where("k = 1")
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("plan_id").orderBy("p", "rank", "path"))).where(F.col("ord") <= CANDIDATES).drop("p", "k", "rank")


def tokens_of(size: Column) -> Column:
    """Tokens of so many bytes, about."""
    return F.ceil(size / 4).cast("int")


def let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def measured(rows: DataFrame) -> DataFrame:
    """``rows(plan_id, ord, text, tokens, names, ...)`` with ``lines``, ``best`` (the line that says most, from 0), ``ends`` and ``filled``: bytes and lines with a word before each line and after the last.

    A line counts 12 for a name in it, 7 for one but for case, 2 for each term and 1 for a
    definition; each later one gives up a little, so a long way down counts for less.
    """
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    r = rows.withColumn("lines", lines)
    has = lambda l, x: F.contains(F.lower(l), F.lower(x))
    named = lambda l: F.aggregate(F.transform("names", lambda n: F.when(F.contains(l, n), 12).when(has(l, n), 7).otherwise(0)), F.lit(0), lambda a, x: a + x)
    says = lambda l: named(l) + 2 * F.size(F.filter("tokens", lambda t: has(l, t))) + l.rlike(DEFINES).cast("int")
    marked = F.array_max(F.transform("lines", lambda l, i: F.struct((says(l) - i / 100_000).alias("v"), (-i).alias("i"))))
    r = r.withColumn("best", -marked["i"])
    keys = ["plan_id", "ord"]
    each = r.select(*keys, F.posexplode(F.transform("lines", lambda l: F.struct(F.octet_length(l).cast("bigint").alias("size"), l.rlike(r"\S").cast("bigint").alias("word")))).alias("at", "x"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = each.select(*keys, "at", F.sum("x.size").over(upto).alias("e"), F.sum("x.word").over(upto).alias("w"))
    sums = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "e", "w"))).alias("s"))  # the lines of one file
    before = lambda c: F.concat(F.array(F.lit(0).cast("bigint")), F.transform("s", lambda x: x[c]))
    return r.join(sums.select(*keys, before("e").alias("ends"), before("w").alias("filled")), keys)


def window_of(ends: Column, best: Column, allowance: Column, then) -> Column:
    """``then(first, last, tokens)`` of the lines, from 0, that an allowance of tokens takes.

    All of them if they fit; else the best, and lines to either side in turn for as long
    as they fit and the allowance is not reached; what does not fit once never does, so
    both searches ask prefix sums.
    """
    n = F.size(ends) - 1
    size = lambda x, y: F.get(ends, y + 1) - F.get(ends, x) + (y - x)
    grows = lambda x, y, x1, y1: (x1 >= 0) & (y1 < n) & (size(x, y) <= 4 * allowance - 4) & (size(F.greatest(x1, F.lit(0)), F.least(y1, n - 1)) <= 4 * allowance)
    x_of, y_of = (lambda k: best - F.floor((k + 1) / 2).cast("int")), (lambda k: best + F.floor(k / 2).cast("int"))
    how_many = lambda most, ok: F.size(F.filter(F.when(most > 0, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).otherwise(F.array().cast("array<int>")), ok))
    both = how_many(2 * F.least(best, n - 1 - best) + 1, lambda k: grows(x_of(k - 1), y_of(k - 1), x_of(k), y_of(k)))

    def one_side(k: Column) -> Column:
        down = k % 2 == 0  # the side whose turn it was went up, so the other is left
        most = F.when(down, n - 1 - y_of(k)).otherwise(x_of(k))
        x, y = (lambda j: F.when(down, x_of(k)).otherwise(x_of(k) - j)), (lambda j: F.when(down, y_of(k) + j).otherwise(y_of(k)))
        more = how_many(most, lambda j: grows(x(j - 1), y(j - 1), x(j), y(j)))
        return let(more, lambda j: let(F.struct(x(j).alias("a"), y(j).alias("b")), lambda w: then(w["a"], w["b"], F.least(allowance, tokens_of(size(w["a"], w["b"]))))))

    zero = F.lit(0)
    return F.when(tokens_of(size(zero, n - 1)) <= allowance, then(zero, n - 1, tokens_of(size(zero, n - 1)))).otherwise(let(both, one_side))


def pack(cands: DataFrame, files: DataFrame, signals: DataFrame, plans: DataFrame) -> DataFrame:
    """``(plan_id, ord, path, role, start_line, end_line, estimated_tokens, source_truncated, content, omitted)``.

    ``plans(plan_id, repo_id, budget)``, ``signals(plan_id, tokens, identifiers,
    member_mentions)``.  A plan has at most 15 candidates, so its budget is a fold over a
    short list of what was measured of each; texts stay outside of it.
    """
    said = signals.select("plan_id", "tokens", F.concat("identifiers", "member_mentions").alias("names"))
    rows = cands.select("plan_id", "ord", "path", "role").join(plans, "plan_id").join(files.select("repo_id", "path", "text", "text_complete"), ["repo_id", "path"], "left").join(said, "plan_id")
    m = written(measured(rows))
    share = F.floor(F.col("budget") * F.when(F.col("role") == "primary", SHARES["primary"]).otherwise(SHARES["supporting"])).cast("int")
    item = F.struct("ord", F.col("text").isNull().alias("gone"), (F.element_at("filled", -1) == 0).alias("blank"), F.greatest(F.lit(LEAST), share).alias("most"), "best", "ends", "filled")
    listed = m.groupBy("plan_id").agg(F.min("budget").cast("int").alias("budget"), F.array_sort(F.collect_list(item)).alias("items"))
    kind = "ord int, a int, b int, size int, allowance int, omitted string"
    empty = F.array().cast(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in kind.split(', '))}>>")
    no = F.lit(None).cast("int")

    def outcome(ord_: Column, a: Column, b: Column, size: Column, allowance: Column, omitted: Column) -> Column:
        return F.struct(ord_.cast("int").alias("ord"), a.cast("int").alias("a"), b.cast("int").alias("b"), size.cast("int").alias("size"), allowance.cast("int").alias("allowance"), omitted.cast("string").alias("omitted"))

    def choose(left: Column, c: Column) -> Column:
        out = lambda reason: outcome(c["ord"], no, no, no, no, F.lit(reason))

        def taken(allowance: Column) -> Column:
            def found(a: Column, b: Column, size: Column) -> Column:
                blank = F.get(c["filled"], b + 1) - F.get(c["filled"], a) == 0
                return F.when((size < LEAST) & (allowance >= LEAST) & blank, out("budget")).otherwise(outcome(c["ord"], a, b, size, allowance, F.lit(None)))

            return window_of(c["ends"], c["best"], allowance, found)

        return F.when(c["gone"], out("unavailable")).when(c["blank"], out("empty")).when(left < LEAST, out("budget")).otherwise(let(F.least(left, c["most"]), taken))

    step = lambda acc, c: let(choose(acc["left"], c), lambda o: F.struct((acc["left"] - F.coalesce(o["size"], F.lit(0))).alias("left"), F.concat(acc["done"], F.array(o)).alias("done")))
    start = F.struct(F.col("budget").alias("left"), empty.alias("done"))
    chosen = listed.select("plan_id", F.inline(F.aggregate("items", start, step, lambda acc: acc["done"])))
    j = m.select("plan_id", "ord", "path", "role", "lines", "text_complete").join(chosen, ["plan_id", "ord"])
    content = F.array_join(F.slice("lines", F.col("a") + 1, F.col("b") - F.col("a") + 1), "\n")
    content = F.when(F.octet_length(content) > 4 * F.col("allowance"), T.truncate_utf8(content, 4 * F.col("allowance"))).otherwise(content)
    there = F.col("omitted").isNull()
    return j.select(
        "plan_id", "ord", "path", "role", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), F.col("size").alias("estimated_tokens"),
        F.when(there, ~F.coalesce("text_complete", F.lit(True))).alias("source_truncated"), F.when(there, content).alias("content"), "omitted")


def added_lines(diffs: DataFrame) -> DataFrame:
    """``(repo_id, file, pos, line)`` of the added lines of ``diffs(repo_id, diff_text)``, by file section."""
    rows = diffs.select("repo_id", F.posexplode(F.split("diff_text", r"\r?\n")).alias("n", "line"))
    head = F.col("line").startswith("diff --git ")
    section = F.sum(F.when(head, 1).otherwise(0)).over(Window.partitionBy("repo_id").orderBy("n"))
    rows = rows.withColumn("file", section).where(~head & F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("repo_id", "file").orderBy("n"))).select("repo_id", "file", "pos", "line")


def sample_lines(lines: DataFrame, budget: int = 200_000) -> DataFrame:
    """``(repo_id, pos, file, line)`` of ``lines``, those that a budget of characters takes.

    Files take turns, a line each; lines are joined by a break, which counts; one that
    does not fit is passed over, and later ones may still fit.  Rows are dealt by
    repository, sorted by Spark, and passed over once: a task holds two numbers.
    """
    dealt = lines.select("repo_id", "pos", "file", "line", F.length("line").cast("bigint").alias("cost")).repartition("repo_id").sortWithinPartitions("repo_id", "pos", "file")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, used = object(), 0
        for b in batches:
            taken = []
            for r, cost in zip(b.column("repo_id").to_pylist(), b.column("cost").to_pylist()):
                if r != repo:
                    repo, used = r, 0
                cost += used > 0
                taken.append(used + cost <= budget)
                used += cost if taken[-1] else 0
            yield b.filter(pa.array(taken, pa.bool_())).drop_columns(["cost"])

    return dealt.mapInArrow(take, lines.select("repo_id", "pos", "file", "line").schema)


def sample_diff(diffs: DataFrame, budget: int = 200_000) -> DataFrame:
    """``(repo_id, text, lines, total_lines)``: a diff within the budget as it is, else complete added lines, as ``sample_lines`` takes them."""
    rows = added_lines(diffs.where(F.length("diff_text") > budget))
    total = rows.groupBy("repo_id").agg(F.count("*").cast("int").alias("total_lines"))
    kept = sample_lines(rows, budget).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("pos", "file", "line"))).alias("rows"))  # no longer than the budget
    done = total.join(kept, "repo_id", "left").select(
        "repo_id", F.coalesce(F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("")).alias("text"), F.coalesce(F.size("rows"), F.lit(0)).alias("lines"), "total_lines")
    short = diffs.where(F.length("diff_text") <= budget).select("repo_id", F.col("diff_text").alias("text"), F.lit(None).cast("int").alias("lines"), F.lit(None).cast("int").alias("total_lines"))
    return done.union(short)
