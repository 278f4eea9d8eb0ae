"""Which files hold the words and strings that tasks ask for: one pass over the texts, and then only what may hold a string is looked at.

Texts never meet all words of their corpus: a task's word comes back as the forms that
share its stem, a string as a word that every text with the string has, and texts meet
these by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written
from .grounding import defines, may_hold, mentions

LINKED, RUN = "\0", "\1"  # mark words of a text with its links, and what its patterns stand for; no word holds either
ASSIGNS = r"""(?<![A-Za-z0-9_])(?:const|let|var)\s+[$A-Za-z_][$A-Za-z0-9_]*(?:\s*:[^=\r\n]+)?\s*=\s*[/("'`]?\s*$"""


def plain_words(c: Column) -> Column:
    """Lower-case words of a text, camel case split, with those of its links."""
    return F.split(F.lower(T.split_camel(c)), r"[^\p{L}\p{N}]+")


def terms_of(tokens: DataFrame) -> DataFrame:
    """``tokens(repo_id, token)`` with a number each: ``id``; written."""
    return written(tokens.select("repo_id", "token").distinct().withColumn("id", F.monotonically_increasing_id()))


def needles_of(signals: DataFrame) -> DataFrame:
    """``(repo_id, id, needle, is_name, is_text)``: members and names, which stand alone, and quoted texts, which may stand within words; written."""
    rows = [signals.select("repo_id", F.explode(c).alias("needle"), F.lit(c != "exact_fragments").alias("name")) for c in ("member_mentions", "identifiers", "exact_fragments")]
    every = rows[0].union(rows[1]).union(rows[2]).groupBy("repo_id", "needle").agg(F.bool_or("name").alias("is_name"), F.bool_or(~F.col("name")).alias("is_text"))
    return written(every.withColumn("id", F.monotonically_increasing_id()))


def term_keys(terms: DataFrame) -> DataFrame:
    """``(repo_id, word, kind, id)``: the words of a text that count as each term."""
    words = terms.select("repo_id", F.explode(T.forms(F.col("token"))).alias("word"), F.lit("term").alias("kind"), "id")
    runs = terms.where(F.col("token").rlike(r"^([a-z])\1{2,7}$"))  # all that a pattern can stand for
    return words.union(runs.select("repo_id", F.concat(F.lit(RUN), "token").alias("word"), F.lit("run").alias("kind"), "id"))


def needle_keys(needles: DataFrame) -> DataFrame:
    """``(repo_id, word, kind, id)``: of each string the longest word that is whole in every text that holds it; strings without such a word are left out.

    The ends of a quoted text may be parts of longer words.  A name is whole, unless
    ``function`` stands before it without a blank.  What a sigma becomes in lower case
    depends on what surrounds it.
    """
    words, n = F.col("words"), F.size("words")
    whole = lambda w: (w != "") & ~w.rlike("[σς]")
    longest = lambda a: F.array_max(F.transform(F.filter(a, whole), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    inner = longest(F.slice("words", F.lit(2), F.when(F.col("is_text"), F.greatest(n - 2, F.lit(0))).otherwise(n)))
    first = F.when(~F.col("is_text") & whole(words[0]), F.array(words[0], F.concat(F.lit("function"), words[0])))
    k = needles.withColumn("words", plain_words(F.col("needle"))).withColumn("inner", inner)
    k = k.select("repo_id", "id", F.explode(F.when(F.col("inner").isNotNull(), F.array("inner")).otherwise(first)).alias("word"))
    return k.select("repo_id", F.explode(F.array("word", F.concat(F.lit(LINKED), "word"))).alias("word"), F.lit("needle").alias("kind"), "id")


def met(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``(fid, terms, runs, needles)`` of each file that has a word of ``keys``: numbers without repeats; ``files(repo_id, fid, text)``; written."""
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    marked = lambda mark, a: F.transform(a, lambda w: F.concat(F.lit(mark), w))
    with_links = F.when(F.lower(text).contains("http"), marked(LINKED, F.array_distinct(plain_words(text)))).otherwise(none)
    words = F.concat(F.array_distinct(T.raw_words(text)), with_links, marked(RUN, T.regex_tokens(text)))
    rows = files.select("repo_id", "fid", F.explode(words).alias("word")).join(keys, ["repo_id", "word"])
    of = lambda *kinds: F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("id")))
    return written(rows.groupBy("fid").agg(of("term", "run").alias("terms"), of("run").alias("runs"), of("needle").alias("needles")))


def before(text: Column, f: Column, k: Column) -> Column:
    """What stands before the k-th occurrence of ``f``: 240 characters at most."""
    return F.call_function("right", F.call_function("substring_index", text, f, k), F.lit(240))


def held(files: DataFrame, words: DataFrame, needles: DataFrame, keys: DataFrame) -> DataFrame:
    """``(fid, id, mentions, defines, has, assigned)``: how each file that holds a string holds it; written.

    ``has`` and ``assigned`` are of quoted texts: it stands there, and right after an assignment.
    """
    loose = written(needles.join(keys.select("id").distinct(), "id", "left_anti").select("repo_id", "id", "needle"))
    far = may_hold(loose, files).select("repo_id", "path", "id").join(files.select("repo_id", "path", "fid"), ["repo_id", "path"]).select("fid", "id")
    pairs = words.select("fid", F.explode("needles").alias("id")).union(far)
    asked = pairs.join(needles.drop("repo_id"), "id").groupBy("fid").agg(F.collect_set(F.struct("id", "needle", "is_name", "is_text")).alias("x"))
    r = files.select("fid", F.coalesce("text", F.lit("")).alias("text")).join(asked, "fid").select("fid", "text", F.explode("x").alias("x")).select("fid", "text", "x.*")
    text, needle = F.col("text"), F.col("needle")
    r = r.select("fid", "id", "text", "needle", (F.col("is_name") & mentions(text, needle)).alias("mentions"), (F.col("is_name") & defines(text, needle)).alias("defines"), (F.col("is_text") & text.contains(needle)).alias("has"))
    times = F.greatest(T.occurrences(text, needle), F.lit(1))
    after = F.exists(F.sequence(F.lit(1), times), lambda k: before(text, needle, k).rlike(ASSIGNS))
    some = text.contains("const") | text.contains("let") | text.contains("var")
    return written(r.where("mentions or defines or has").select("fid", "id", "mentions", "defines", "has", F.when(F.col("has") & some, after).otherwise(False).alias("assigned")))
