"""Text functions as Column expressions: tokens, stems, task clean-up, sizes.

Regular expressions name ASCII word characters explicitly, since the JVM's own word
boundary takes letters of any script.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOP_WORDS = (
    "add all also and any are async await been being both break but can cannot catch class const continue codebase "
    "could debugger did doe does down else enum extends false finally each even export for from function github got "
    "had has have her him his how implements import index instanceof instead interface into its just let main make "
    "may might more most must namespace new node not now null off only other our out over packages private quality "
    "protected readonly return same she should some src static still such super switch than that the their them then "
    "there these they this those thing throw true try typeof under undefined uses var very void was were what when "
    "where which while who why will with would yield you your"
).split()

# Words that BM25 queries leave out.
RETRIEVAL_STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both "
    "but by can cannot could did do does doing down during each few for from further had has have having he her here "
    "hers him his how i if in into is it its itself just me more most my no nor not of off on once only or other "
    "ought our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why with would you your bug "
    "issue issues error errors expected actual behavior behaviour reproduce reproduction steps version versions node "
    "npm report repo repository description example code please thanks title type severity confidence location line "
    "lines following above below see also would should could may might must will can also using used use uses"
).split()

MAX_TOKEN = 64
# Endings that take back a silent e.
SILENT_E = "at|bl|iz|ap|ud|ac|ut|ov|et|dl|rg|ng|ic|out|rs|ch|lv"
NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
BEFORE_NAME, AFTER_NAME = r"(?<![\p{L}\p{N}_$])", r"(?![\p{L}\p{N}_$])"
#: What stands before a defined name; the two letters that it begins with are asked for first, as most places in a text have others.
DEFINES = (
    "(?=[acdefilstv][aelnorstuxy])" + BEFORE_NAME + r"(?:export\s+)?(?:async\s+)?"
    r"(?:function\s*\*?\s*|(?:const|let|var|class|interface|type|enum|def|fn|func|fun|struct|trait)\s+)"
)


def rx(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def in_order(c: Column | str) -> tuple[Column, Column]:
    """Sort keys of a text as a reader expects them: letters first, then accents, then small before capital; equal ones by their bytes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.collate(c, "UNICODE"), c


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def cut(c: Column, n: int) -> Column:
    """All but the last ``n`` characters."""
    return c.substr(F.lit(1), F.length(c) - n)


def _vowels(c: Column) -> Column:
    """Each letter as V or C; y is a vowel after a consonant."""
    p = rx(rx(rx(c, "[aeiou]", "V"), "[^Vy]", "C"), "^y", "C")
    for _ in range(3):
        p = rx(rx(p, "Cy", "CV"), "Vy", "VC")
    return p


def verb_stem(c: Column) -> Column:
    p = _vowels(c)
    doubled = c.rlike(r"([a-z])\1$") & ~c.endswith("ss")
    short = p.rlike("^C*V+C+V*$") & p.rlike("CVC$") & ~c.rlike("[wxy]$")
    return F.when(doubled, cut(c, 1)).when(c.rlike(f"(?:{SILENT_E})$") | short, F.concat(c, F.lit("e"))).otherwise(c)


def _ends(c: Column, *endings: str) -> Column:
    return functools.reduce(Column.__or__, [c.endswith(e) for e in endings])


def stem(c: Column) -> Column:
    n = F.length(c)
    return (
        F.when(c == "kubernetes", c)
        .when(c.isin("scss", "sass", "less"), F.lit("css"))
        .when(c.isin("contributor", "contributors"), F.lit("contribute"))
        .when((n > 5) & c.endswith("ies"), F.concat(cut(c, 3), F.lit("y")))
        .when((n > 4) & c.endswith("ied"), F.concat(cut(c, 3), F.lit("y")))
        .when((n > 5) & c.endswith("ing"), verb_stem(cut(c, 3)))
        .when((n > 3) & c.endswith("ed"), verb_stem(cut(c, 2)))
        .when((n > 4) & _ends(c, "sses", "shes", "ches", "xes", "zes"), cut(c, 2))
        .when((n > 3) & c.endswith("s") & ~_ends(c, "ss", "us", "is"), cut(c, 1))
        .otherwise(c)
    )


def searchable(c: Column) -> Column:
    return (F.length(c) <= MAX_TOKEN) & ((F.length(c) >= 3) | c.isin("ci", "ui") | c.rlike("^[A-Za-z][0-9]$"))


def _stop(c: Column) -> Column:
    return c.isin(*STOP_WORDS)


def split_camel(c: Column) -> Column:
    return rx(c, "([a-z0-9])([A-Z])", "$1 $2")


def raw_words(c: Column) -> Column:
    """Lower-case words of a text, camel case split, links left out; repeats and order kept."""
    linked = rx(c, r"(?i)(?<![A-Za-z0-9_])http\s*/\s*([123])(?![A-Za-z0-9_])", "http h$1")
    linked = rx(linked, r"(?i)https?://[^\s<>()\[\]{}]+", " ")
    c = F.when(F.lower(c).contains("http"), linked).otherwise(c)
    return F.split(F.lower(split_camel(c)), r"[^\p{L}\p{N}]+")


def tokenize(c: Column) -> Column:
    """Distinct stems of the search terms in a text or path, in order of first occurrence."""
    keep = lambda t: searchable(t) & ~_stop(t)
    return F.array_distinct(F.filter(F.transform(F.filter(F.array_distinct(raw_words(c)), keep), stem), keep))


def forms(token: Column) -> Column:
    """All raw words whose stem is ``token`` and that are search terms themselves."""
    cut_, end = (lambda k: cut(token, k)), (lambda c, e: F.concat(c, F.lit(e)))
    doubled = F.concat(token, F.right(token, F.lit(1)))
    tries = [token, *(end(token, e) for e in ("s", "es", "ing", "ed")), *(end(doubled, e) for e in ("ing", "ed")), *(end(cut_(1), e) for e in ("ing", "ed", "ies", "ied")), *map(F.lit, ("scss", "sass", "less", "contributor", "contributors"))]
    return F.filter(F.array_distinct(F.array(*tries)), lambda w: searchable(w) & ~_stop(w) & (stem(w) == token))


def tokenize_identifier(c: Column) -> Column:
    """Distinct stems of the parts of a name; no word is a stop word here."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(split_camel(c)), r"[^\p{L}\p{N}]+"), stem), searchable))


def retrieval_tokens(c: Column) -> Column:
    """BM25 tokens: each word of three letters or more, and its parts where it has several; repeats kept."""
    parts = lambda w: F.filter(F.split(rx(w, "(?<=[a-z0-9])(?=[A-Z])", "_"), "_"), lambda p: F.length(p) >= 3)

    def of(w: Column) -> Column:
        p, whole = parts(w), F.array(F.lower(w))
        several = w.contains("_") | ((F.lower(w) != w) & w.rlike("[a-z0-9][A-Z]"))  # most words are of one part, and are told so without a pattern
        return F.when(several, F.concat(whole, F.when(F.size(p) > 1, F.transform(p, F.lower)).otherwise(F.array().cast("array<string>")))).otherwise(whole)

    # a shorter word has no part of three letters either
    return F.flatten(F.transform(find_all(c, "[A-Za-z0-9_$]{3,}"), of))


def query_terms(c: Column) -> Column:
    return F.filter(F.array_distinct(retrieval_tokens(c)), lambda t: ~t.isin(*RETRIEVAL_STOP_WORDS))


def redact(c: Column) -> Column:
    """Task text without credentials in links and without known key shapes."""
    c = rx(c, r"(?i)(https?://)[^/\s@]+@", "$1")
    for shape in (r"(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{8,}", r"AKIA[0-9A-Z]{16}"):
        c = rx(c, rf"(?<![A-Za-z0-9_]){shape}(?![A-Za-z0-9_])", "[redacted]")
    return rx(c, r"(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{15,}[A-Za-z0-9_](?![A-Za-z0-9_])", "[redacted]")


def strip_links(c: Column) -> Column:
    return rx(c, r"(?i)https?://[^\s<>()\[\]{}]+", " [url] ")


def strip_comments(c: Column) -> Column:
    return rx(c, r"(?s)<!--.*?-->", " ")


UNCHECKED = r"^\s*[-*]\s*\[\s\]\s+"


def checklist(c: Column) -> Column:
    """``(text, removed, preserved)``: unchecked items leave, unless headings and blanks are all else there is."""
    lines = F.split(c, r"\r?\n")
    unchecked = F.filter(lines, lambda x: x.rlike(UNCHECKED))
    kept = F.filter(lines, lambda x: ~x.rlike(UNCHECKED))
    solid = F.exists(kept, lambda x: (F.length(F.trim(x)) > 0) & ~F.trim(x).rlike(r"^#{1,6}\s+"))
    n = F.size(unchecked)
    return F.struct(
        F.when((n > 0) & solid, F.array_join(kept, "\n")).otherwise(c).alias("text"),
        F.when(solid, n).otherwise(0).alias("removed"),
        F.when(solid, F.lit(0)).otherwise(n).alias("preserved"),
    )


def added_lines(c: Column) -> Column:
    """Lines that a diff adds, with their plus signs."""
    return F.array_join(F.filter(F.split(c, r"\r?\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), "\n")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4).cast("bigint")


def truncate_utf8(c: Column, limit: Column | int) -> Column:
    """The longest prefix of whole characters within so many bytes."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    step = lambda a, x: F.when((a.n >= 0) & (a.n + F.octet_length(x) <= limit), F.struct(F.concat(a.s, x).alias("s"), (a.n + F.octet_length(x)).alias("n"))).otherwise(F.struct(a.s.alias("s"), F.lit(-1).alias("n")))
    return F.aggregate(F.split(c, ""), start, step, lambda a: a.s)


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(c.substr(1, n - 1), F.lit("…"))).otherwise(c)


def regex_tokens(c: Column) -> Column:
    """``x{m,n}`` in a text stands for runs of x of length max(3, m) to min(n, 8)."""
    pattern = r"(?<![A-Za-z0-9_])([A-Za-z])\{(\d{1,9}),(\d{1,9})\}"
    letters, low, high = (find_all(c, pattern, g) for g in (1, 2, 3))

    def runs(t: Column) -> Column:
        a, b = F.greatest(F.lit(3), t["1"].cast("int")), F.least(F.lit(8), t["2"].cast("int"))
        return F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda k: F.repeat(F.lower(t["0"]), k))).otherwise(F.array().cast("array<string>"))

    found = F.array_distinct(F.flatten(F.transform(F.arrays_zip(letters.alias("0"), low.alias("1"), high.alias("2")), runs)))
    return F.when(c.rlike(r"\{\d"), found).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))  # few texts have any


def occurrences(text: Column, needle: Column) -> Column:
    """Times that ``needle`` occurs without overlap."""
    return F.when(F.length(needle) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"))


def quote_regex(c: Column) -> Column:
    """``c`` as a pattern that matches it alone."""
    return rx(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def code_span(c: Column) -> Column:
    """Markdown code: more back-ticks around than the longest run within."""
    run = F.coalesce(F.array_max(F.transform(find_all(c, "`+"), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), run + 1)
    pad = F.when(c.rlike("^[` ]|[` ]$"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, c, pad, fence)


def safe_fence(c: Column) -> Column:
    """Three back-ticks, or one more than the longest run in ``c``."""
    run = F.coalesce(F.array_max(F.transform(find_all(c, "`+"), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), run + 1))


def shell_quote(c: Column, shell: str = "posix") -> Column:
    inner = F.replace(c, F.lit("'"), F.lit("''" if shell == "powershell" else "'\\''"))
    return F.when(c.rlike(r"^[\p{L}\p{N}._/\\:@+-]+$"), c).otherwise(F.concat(F.lit("'"), inner, F.lit("'")))
