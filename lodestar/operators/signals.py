"""What a task says: tokens, mentioned files and members, quoted fragments, identifiers."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

MAX_FRAGMENTS, MAX_IDENTIFIERS = 8, 24
# Names that are files, and extensions that are no members.
CONVENTIONAL = (
    "AUTHORS|CHANGELOG|CODE_OF_CONDUCT|CONTRIBUTING|LICENSE|NOTICE|README|SECURITY|CODEOWNERS|Dockerfile|Gemfile|"
    "Jenkinsfile|Makefile|Procfile|Rakefile|Vagrantfile"
)
NO_MEMBERS = "c cc cjs cpp css go h hpp html java js json jsx kt less md mdx mjs py rb rs scss ts tsx yaml yml".split()
_EXTENSIONS = "|".join(sorted((e[1:] for e in P.SOURCE_EXTENSIONS), key=lambda e: (-len(e), e)))
FILE_MENTION = rf"(?:[A-Za-z]:[\\/]|[\\/])?[A-Za-z0-9_@$][A-Za-z0-9_.$/\\-]{{0,200}}\.(?:{_EXTENSIONS}|d\.ts)(?![A-Za-z0-9_])"
MEMBER = T.BEFORE_NAME + T.NAME + r"\.(" + T.NAME + ")" + T.AFTER_NAME
MAX_QUOTED = 512  # fragments of over 160 characters are none
CLOSES = {"“": "”", "„": "”", "‘": "’", "«": "»", '"': '"', "'": "'", "`": "`"}
_CLOSING = frozenset(CLOSES.values())


def _rest(line: str, at: int) -> str:
    """What is left of a line, or enough of it to tell that it is too long to count: blanks at its start do not."""
    begin = at
    while begin < len(line) and line[begin].isspace():
        begin += 1
    return line[at : begin + MAX_QUOTED]


def _closes(line: str) -> dict[str, list[int]]:
    """Places of each closing mark that no odd run of backslashes stands before, in order; one pass."""
    out: dict[str, list[int]] = {}
    run = 0
    for i, c in enumerate(line):
        if c in _CLOSING and run % 2 == 0:
            out.setdefault(c, []).append(i)
        run = run + 1 if c == "\\" else 0
    return out


def scan_quotes(text: str) -> list[dict]:
    """Quoted stretches, line by line: delimiter and value.

    An apostrophe after a letter or digit opens nothing, a backslash keeps a quote from
    closing, and an unclosed quote (but an apostrophe) takes the rest of the line; of
    such a rest the first MAX_QUOTED characters are kept, which no reader of it exceeds.
    A line is passed over once for its closing marks and once for its opening ones.
    """
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        places, at = _closes(line), 0
        while at < len(line):
            close = CLOSES.get(line[at])
            word_before = at > 0 and line[at - 1].isascii() and line[at - 1].isalnum()
            if close is None or line[at] == "'" and word_before:
                at += 1
                continue
            known = places.get(close, [])
            k = bisect.bisect_right(known, at)
            if k < len(known):
                out.append({"delimiter": line[at], "value": line[at + 1 : known[k]]})
                at = known[k] + 1
            else:
                if line[at] != "'":
                    out.append({"delimiter": line[at], "value": _rest(line, at + 1)})
                at += 1
    return out


def quotes(text: Column) -> Column:
    """``scan_quotes`` of each text, in Arrow batches: tasks are short and few beside files."""

    def scanned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scan_quotes(t or ""))

    return F.pandas_udf(scanned, "array<struct<delimiter:string,value:string>>")(text)


def _distinctive_fragment(c: Column) -> Column:
    n = F.length(c)
    marks = F.length(T.rx(c, r"[\p{L}\p{N}$]"))
    spaced = c.rlike(r"\s") & (F.size(F.split(F.trim(c), r"\s+")) >= 2)
    return (n >= 6) & (n <= 160) & c.rlike(r"[\p{L}\p{N}]") & (spaced | (~c.rlike(r"\s") & (marks >= 1)))


def _distinctive_name(c: Column) -> Column:
    return c.rlike("[0-9_$]") | c.rlike(r"\p{Ll}\p{Lu}") | c.rlike(r"[^\x00-\x7F]")


def exact_fragments(quoted: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(quoted, lambda q: F.trim(q.value)), _distinctive_fragment)), 1, MAX_FRAGMENTS)


def identifiers(text: Column, quoted: Column) -> Column:
    plain = F.filter(T.find_all(text, r"[\p{L}_$][\p{L}\p{N}_$]{4,}"), _distinctive_name)
    ticked = F.filter(F.transform(F.filter(quoted, lambda q: q.delimiter == "`"), lambda q: F.trim(q.value)), lambda v: v.rlike(f"^{T.NAME}$") & (_distinctive_name(v) | (F.length(v) >= 6)) & (F.length(v) >= 5))
    called = T.find_all(text, T.BEFORE_NAME + r"([\p{L}_$][\p{L}\p{N}_$]{2,})\(", 1)
    every = F.array_distinct(F.concat(plain, ticked, called))
    return F.slice(F.filter(every, lambda i: ~F.lower(i).isin(*T.STOP_WORDS)), 1, MAX_IDENTIFIERS)


def file_mentions(text: Column) -> Column:
    named = T.find_all(text, rf"(?i)(?<![A-Za-z0-9_])(?:{CONVENTIONAL})(?![A-Za-z0-9_])")
    linked = T.find_all(text, r"(?i)https?://github\.com/[^/\s]+/[^/\s]+/(?:blob|tree|blame)/[^/\s]+/([^\s#?]+)", 1)
    linked = F.transform(linked, lambda p: F.regexp_extract(F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p), FILE_MENTION, 0))
    plain = F.transform(T.find_all(T.rx(text, r"(?i)https?://\S+", " "), FILE_MENTION), lambda p: T.rx(F.translate(p, "\\", "/"), r"^\.\.?/"))
    long = lambda a: F.filter(a, lambda p: F.length(p) >= 4)
    return F.array_distinct(F.concat(named, long(F.transform(linked, lambda p: F.translate(p, "\\", "/"))), long(plain)))


def member_mentions(text: Column) -> Column:
    return F.array_distinct(F.filter(T.find_all(text, MEMBER, 1), lambda m: ~F.lower(m).isin(*NO_MEMBERS)))


def _read(tasks: DataFrame, issue: str, diff: str) -> DataFrame:
    t = tasks.withColumn("_issue", F.coalesce(issue, F.lit(""))).withColumn("_diff", F.coalesce(diff, F.lit("")))
    t = t.withColumn("_c", T.checklist(T.redact(F.col("_issue")))).withColumn("_seen", T.strip_comments(F.col("_c.text")))
    t = t.withColumn("_plain", T.strip_links(F.col("_seen")))
    return t.withColumn("_task", F.concat("_plain", F.lit("\n"), T.strip_links(T.redact(T.added_lines(F.col("_diff"))))))


def task_tokens(tasks: DataFrame, issue: str = "issue_text", diff: str = "diff_text") -> DataFrame:
    """``tasks`` with their ``tokens`` alone."""
    t = _read(tasks, issue, diff)
    return t.select(*[t[c] for c in tasks.columns], T.tokenize(F.col("_task")).alias("tokens"))


def task_signals(tasks: DataFrame, issue: str = "issue_text", diff: str = "diff_text") -> DataFrame:
    """``tasks`` with what each says, in columns; null texts count as empty."""
    t = _read(tasks, issue, diff).withColumn("_quoted", quotes(F.col("_task")))
    return t.select(
        *[t[c] for c in tasks.columns],
        F.concat("_issue", F.lit("\n"), "_diff").alias("task_text"),
        T.tokenize(F.col("_task")).alias("tokens"),
        file_mentions(F.col("_seen")).alias("file_mentions"),
        member_mentions(F.col("_plain")).alias("member_mentions"),
        exact_fragments(F.col("_quoted")).alias("exact_fragments"),
        identifiers(F.col("_task"), F.col("_quoted")).alias("identifiers"),
        F.col("_c.removed").alias("checklist_removed"),
        F.col("_c.preserved").alias("checklist_preserved"),
    )
