"""Ignore patterns: ordered globs, negation, the last match wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def clean(patterns: list[str]) -> list[str]:
    """Patterns in order of first use, forward slashes, no blanks or comments."""
    out = [p.strip().replace("\\", "/") for p in patterns]
    return list(dict.fromkeys(p for p in out if p and not p.startswith("#")))


def glob_regex(pattern: str) -> str | None:
    """A pattern (without its ``!``) as a regular expression over ``path``; null for one that matches nothing.

    ``*`` and ``?`` stay within a segment, ``**`` does not, a leading slash anchors, a
    trailing one asks for a folder.
    """
    body = re.sub("/$", "", re.sub("^/", "", pattern, count=1), count=1)
    if not body:
        return None
    parts = re.split(r"(\*\*/?|\*|\?)", body)
    known = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    inner = "".join(known.get(p) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in parts)
    return ("^" if pattern.startswith("/") else "(?:^|/)") + inner + ("/" if pattern.endswith("/") else "(?:/|$)")


def rules(spark, patterns: list[str]) -> DataFrame:
    """``(ord, pattern, negated, folder, regex)`` of what a user wrote: a bounded list."""
    rows = []
    for i, p in enumerate(clean(patterns)):
        r = glob_regex(p.removeprefix("!"))
        if r is not None:
            rows.append((i, p, p.startswith("!"), p.endswith("/"), r))
    return spark.createDataFrame(rows, "ord int, pattern string, negated boolean, folder boolean, regex string")


def matches(paths: DataFrame, rule: DataFrame) -> DataFrame:
    """Every (path, rule) that match; the rules are broadcast, the paths stay where they are."""
    subject = F.when(F.col("folder"), F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    return paths.join(F.broadcast(rule), F.rlike(subject, F.col("regex")))


def excluded(paths: DataFrame, rule: DataFrame, keys: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """``(keys..., pattern)`` of paths whose last matching pattern excludes."""
    last = matches(paths.select(*keys).distinct(), rule).groupBy(*keys).agg(F.max_by(F.struct("pattern", "negated"), "ord").alias("last"))
    return last.where(~F.col("last.negated")).select(*keys, F.col("last.pattern").alias("pattern"))


def unmatched(paths: DataFrame, rule: DataFrame) -> DataFrame:
    """Patterns that match no path; negations are exempt."""
    return rule.where("not negated").join(matches(paths, rule).select("ord").distinct(), "ord", "left_anti").select("ord", "pattern")


def parse_ignore_file(lines: DataFrame) -> DataFrame:
    """``lines(n, value)`` -> patterns in order, first use only."""
    c = F.translate(F.trim("value"), "\\", "/")
    kept = lines.select("n", c.alias("pattern")).where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    return kept.groupBy("pattern").agg(F.min("n").alias("n")).select("n", "pattern")


# ---------------------------------------------------------------- rules of many repositories at once

def ignore_lines(files: DataFrame, name: str) -> DataFrame:
    """``(repo_id, ord, pattern)``: the lines of each repository's ignore file ``name`` at its root."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("ord", "pattern")
    return files.where(F.col("path") == name).select("repo_id", lines)


def combined(*lists: DataFrame) -> DataFrame:
    """Several ``(repo_id, ord, pattern)`` as one, those of the earlier list first."""
    out = None
    for k, one in enumerate(lists):
        one = one.select("repo_id", F.struct(F.lit(k).alias("list"), F.col("ord").cast("bigint").alias("at")).alias("ord"), "pattern")
        out = one if out is None else out.union(one)
    return out


def rebased(pattern: Column, root: Column) -> Column:
    """A pattern that begins with the repository's own absolute path, anchored to its root instead; case counts unless the path has a drive."""
    body, top = F.translate(F.ltrim(F.rtrim(pattern)), "\\", "/"), F.regexp_replace(F.translate(root, "\\", "/"), "/$", "")
    negated = body.startswith("!")
    bare = F.when(negated, body.substr(F.lit(2), F.length(body))).otherwise(body)
    drive = top.rlike("^[A-Za-z]:/")
    inside = F.when(drive, F.lower(bare).startswith(F.concat(F.lower(top), F.lit("/")))).otherwise(bare.startswith(F.concat(top, F.lit("/"))))
    moved = F.concat(F.when(negated, "!").otherwise(""), F.lit("/"), bare.substr(F.length(top) + 2, F.length(bare)))
    return F.when(F.coalesce(inside & (F.length(top) > 0), F.lit(False)), moved).otherwise(pattern)


def compiled(patterns: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(repo_id, ord, pattern, negated, folder, regex, literals, keys)`` of ``patterns(repo_id, ord, pattern)``, all in the plan.

    Blanks and comments go, and so do repeats after a pattern's first use.  ``roots(repo_id,
    root)`` are absolute paths, for patterns that begin with one.  ``literals`` are the
    segments that every match holds as whole segments; ``keys`` are these as ``whole``, and
    each ``prefix`` or ``suffix`` that some segment of every match has.  ``regex`` is null
    for a pattern that matches nothing.
    """
    p = patterns
    if roots is not None:
        p = p.join(roots, "repo_id", "left").withColumn("pattern", rebased(F.col("pattern"), F.col("root"))).drop("root")
    p = p.select("repo_id", "ord", F.translate(F.trim("pattern"), "\\", "/").alias("pattern")).where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    p = p.groupBy("repo_id", "pattern").agg(F.min("ord").alias("ord")).withColumn("negated", F.col("pattern").startswith("!"))
    p = p.withColumn("glob", F.regexp_replace("pattern", "^!", ""))
    folder, anchored = F.col("glob").endswith("/"), F.col("glob").startswith("/")
    body = F.regexp_replace(F.regexp_replace("glob", "^/", ""), "/$", "")
    inner = body
    # marks that mean something to an expression first; a double star keeps a place until single ones are done
    for what, to in ((r"([.+^${}()|\[\]\\])", r"\\$1"), (r"\?", "[^/]"), (r"\*\*/?", "\x01"), (r"\*", "[^/]*"), ("\x01", ".*")):
        inner = F.regexp_replace(inner, what, to)
    regex = F.concat(F.when(anchored, "^").otherwise("(?:^|/)"), inner, F.when(folder, "/").otherwise("(?:/|$)"))
    parts = F.split(body, "/")
    # a double star takes the slash after it, so what follows one need not begin a segment, but ends one
    begins = lambda i: (i == 0) | ~F.get(parts, i - 1).endswith("**")
    whole = F.transform(parts, lambda s, i: F.when((s != "") & ~s.rlike(r"[*?]") & begins(i), s))
    literals = F.array_distinct(F.filter(whole, lambda s: s.isNotNull()))
    key = lambda how, c: F.struct(F.lit(how).alias("how"), c.alias("key"))
    start, end = (lambda s: F.regexp_extract(s, r"^[^*?]*", 0)), (lambda s: F.regexp_extract(s, r"[^*?]*$", 0))
    cut = F.flatten(F.transform(parts, lambda s, i: F.when(begins(i) & ~s.rlike(r"[*?]"), F.array(key("whole", s))).when(begins(i), F.array(key("prefix", start(s)), key("suffix", end(s)))).otherwise(F.array(key("suffix", end(s))))))
    keys = F.array_distinct(F.filter(cut, lambda k: k["key"] != ""))
    return p.select("repo_id", "ord", "pattern", "negated", folder.alias("folder"), F.when(body != "", regex).alias("regex"), F.when(body != "", literals).alias("literals"), F.when(body != "", keys).alias("keys"))


def matches_by_repository(paths: DataFrame, rule: DataFrame) -> DataFrame:
    """``(repo_id, path, ord, pattern, negated)`` of every match of ``paths(repo_id, path)`` with the rules of their repository.

    A rule meets only the paths that hold the rarest of its keys, a whole segment or how
    one begins or ends, by an equi-join; one of whose keys no path holds meets none.
    Each distinct segment is cut to the lengths that keys of its repository have.  Rules
    without a key, such as ``*`` or ``*x*``, meet the paths of their repository.
    """
    p = written(paths.select("repo_id", "path").distinct())
    held = p.select("repo_id", "path", F.explode(F.array_distinct(F.split("path", "/"))).alias("segment"))
    asked = rule.where("regex is not null").select("repo_id", "ord", "pattern", "negated", "folder", "regex", "keys")
    sought = asked.select("repo_id", "ord", F.inline("keys"))
    lengths = sought.groupBy("repo_id").agg(*[F.collect_set(F.when(F.col("how") == how, F.length("key"))).alias(f"_{how}") for how in ("prefix", "suffix")])  # no longer than a segment is of use
    size, segment = F.length("segment"), F.col("segment")
    part = lambda how, c: F.struct(F.lit(how).alias("how"), c.alias("key"))
    cuts = F.concat(
        F.array(part("whole", segment)),
        F.transform(F.filter("_prefix", lambda n: n <= size), lambda n: part("prefix", F.substring(segment, F.lit(1), n))),
        F.transform(F.filter("_suffix", lambda n: n <= size), lambda n: part("suffix", F.substring(segment, size - n + 1, n))))
    segments = held.groupBy("repo_id", "segment").agg(F.count("*").alias("n"))
    keyed = segments.join(lengths, "repo_id").select("repo_id", "segment", "n", F.inline(cuts))
    keyed = written(keyed.join(sought.select("repo_id", "how", "key").distinct(), ["repo_id", "how", "key"], "left_semi"))
    seen = keyed.groupBy("repo_id", "how", "key").agg(F.sum("n").alias("n"))
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "how", "key")).alias("s")
    rarest = sought.join(seen, ["repo_id", "how", "key"], "left").groupBy("repo_id", "ord").agg(least).where("s.n > 0").select("repo_id", "ord", "s.how", "s.key")
    near = asked.drop("keys").join(rarest, ["repo_id", "ord"]).join(keyed.drop("n"), ["repo_id", "how", "key"])
    subject = F.when(F.col("folder"), F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    hit = F.rlike(subject, F.col("regex"))
    # several segments of a path may have one beginning or end: the first of them counts
    has = lambda s: F.when(F.col("how") == "prefix", s.startswith(F.col("key"))).when(F.col("how") == "suffix", s.endswith(F.col("key"))).otherwise(s == F.col("key"))
    first = F.get(F.filter(F.split("path", "/"), has), 0) == F.col("segment")
    cols = ["repo_id", "path", "ord", "pattern", "negated"]
    by_key = held.join(near, ["repo_id", "segment"]).where(first & hit).select(*cols)
    return by_key.union(p.join(asked.where(F.size("keys") == 0).drop("keys"), "repo_id").where(hit).select(*cols))


def excluded_by_repository(paths: DataFrame, rule: DataFrame) -> DataFrame:
    """``(repo_id, path, pattern)`` of paths whose last matching pattern excludes."""
    last = matches_by_repository(paths, rule).groupBy("repo_id", "path").agg(F.max_by(F.struct("pattern", "negated"), "ord").alias("last"))
    return last.where(~F.col("last.negated")).select("repo_id", "path", F.col("last.pattern").alias("pattern"))


def unmatched_by_repository(paths: DataFrame, rule: DataFrame) -> DataFrame:
    """``(repo_id, ord, pattern)`` of patterns that match no path of their repository; negations are exempt."""
    used = matches_by_repository(paths, rule).select("repo_id", "ord").distinct()
    return rule.where("not negated").join(used, ["repo_id", "ord"], "left_anti").select("repo_id", "ord", "pattern")
