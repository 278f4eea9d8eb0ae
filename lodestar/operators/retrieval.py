"""BM25, literal search and token statistics over many documents and tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written

K1, B = 1.2, 0.75
START = 5  # characters by which terms meet texts; shorter terms by all of theirs
PART = 8_000_000  # pairs of a document and a task's term, found or not, of one task of Spark
WHOLE = "\0"  # stands for a document as a whole among its tokens, none of which holds it


def term_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, token, tf)`` of BM25 tokens."""
    return docs.select(key, F.explode(T.retrieval_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, length)``, counted within the row: no exchange."""
    return docs.select(key, F.size(T.retrieval_tokens(F.col(text))).cast("bigint").alias("length"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """``(token, df)``: a row of ``tf`` is a (document, token) pair already."""
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def counted_tokens(docs: DataFrame, tasks: DataFrame, keys: list[str], text: str = "text", task: str = "task_id", issue: str = "issue_text", by: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """``(by..., keys..., token, length, tf)`` of the tokens that some task asks for, and ``(by..., task, token)``.

    Documents are tokenised once: each also counts WHOLE, which stands for all of it,
    whatever the tasks ask for.
    """
    terms = tasks.select(*by, task, F.explode(T.query_terms(F.col(issue))).alias("token"))
    wanted = terms.select(*by, "token").distinct()
    whole = (tasks.select(*by).distinct() if by else tasks.sparkSession.range(1)).select(*by, F.lit(WHOLE).alias("token"))
    listed = docs.select(*by, *keys, T.retrieval_tokens(F.col(text)).alias("listed")).select(*by, *keys, "listed", F.size("listed").cast("bigint").alias("length"))
    tokens = listed.select(*by, *keys, "length", F.explode(F.concat("listed", F.array(F.lit(WHOLE)))).alias("token"))
    return tokens.join(wanted.union(whole), [*by, "token"], "left_semi").groupBy(*by, *keys, "token", "length").agg(F.count("*").alias("tf")), terms


def part(n: str = "n", mean: str = "mean", df: str = "df") -> Column:
    """What a token adds to a score, by columns ``n``, ``mean``, ``df``, ``tf`` and ``length``."""
    n, mean, df = F.col(n), F.when(F.coalesce(mean, F.lit(0.0)) == 0, 1.0).otherwise(F.col(mean)), F.col(df)
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))


def _ties(docs: DataFrame, key: str) -> tuple[Column, ...]:
    return T.in_order(key) if docs.schema[key].dataType.simpleString() == "string" else (F.col(key),)


def bm25(docs: DataFrame, tasks: DataFrame, key: str = "path", text: str = "text", task: str = "task_id", issue: str = "issue_text", limit: int = 5, by: list[str] | None = None) -> DataFrame:
    """``(by..., task, rank, key, score)``: the ``limit`` best documents of every task.

    With ``by``, each of its values is a corpus of its own, searched by its own tasks.
    Documents are reduced to the tokens that some task asks for before anything is
    shuffled; what a term weighs for a task is a small table, and a document's tokens stay
    together from there on, so that no (task, document) row travels but the best of each
    partition.  Scores are rounded to six places, ties go to the smaller key.
    """
    by = list(by or [])
    counted, terms = counted_tokens(docs, tasks, [key], text, task, issue, by)
    counted = written(counted)
    corpus = counted.where(F.col("token") == WHOLE).groupBy(*by).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = counted.where(F.col("token") != WHOLE)
    df = tf.groupBy(*by, "token").agg(F.count("*").alias("df"))
    weights = terms.join(df, [*by, "token"])
    weights = written(weights.join(corpus, by) if by else weights.crossJoin(F.broadcast(corpus)))  # one row
    scored = tf.repartition(*by, key).join(weights, [*by, "token"]).select(*by, task, key, part().alias("part")).groupBy(*by, task, key).agg(F.round(F.sum("part"), 6).alias("score"))
    best = Window.partitionBy(*by, task).orderBy(F.desc("score"), *_ties(docs, key))
    return scored.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(*by, task, "rank", key, "score")


def _placed(docs: DataFrame, terms: int, key: str) -> DataFrame:
    """``docs`` dealt out by ``key``, so that a partition has about ``PART`` pairs of a document and a task's term at most; small tables as Spark sees fit."""
    n = -(-docs.count() * terms // PART)
    return docs.repartition(n, key) if n > docs.sparkSession.sparkContext.defaultParallelism else docs.repartition(key)


def literal_counts(docs: DataFrame, tasks: DataFrame, key: str = "path", text: str = "text", task: str = "task_id", issue: str = "issue_text", more: list[str] = []) -> DataFrame:  # noqa: B006
    """``(task, key, more..., terms, occurrences)``: how many of a task's terms stand in a document, and how often.

    Texts are dealt out by ``key`` once, and nothing else of them travels: the terms that
    tasks ask for go to where the texts are.  A run is held against the terms that begin as
    it does at some place; beginnings meet as numbers, and where the term first stands in
    the run decides.  ``more`` are columns that a key fixes.
    """
    terms = written(tasks.select(task, F.explode(T.query_terms(F.col(issue))).alias("term")))
    words = terms.select("term").distinct().withColumn("start", F.xxhash64(F.substring("term", 1, START)))
    runs = _placed(docs.select(key, *more, text), terms.count(), key).select(key, *more, F.explode(T.find_all(F.lower(text), "[a-z0-9_$]{3,}")).alias("run"))
    places = runs.select("*", F.posexplode(T.find_all(F.col("run"), f"(?=(.{{3,{START}}}))", 1)).alias("at", "piece"))
    starts = places.select("*", F.explode(F.sequence(F.lit(3), F.length("piece"))).alias("size")).withColumn("start", F.xxhash64(F.substring("piece", F.lit(1), F.col("size"))))
    hits = starts.join(words, "start").where(F.instr("run", F.col("term")) == F.col("at") + 1)
    times = F.when(F.length("run") < 2 * F.length("term"), 1).otherwise(T.occurrences(F.col("run"), F.col("term")))  # no room for a second
    counted = hits.groupBy(key, *more, "term").agg(F.sum(times).alias("n"))
    return counted.join(terms, "term").groupBy(task, key, *more).agg(F.count("*").alias("terms"), F.sum("n").alias("occurrences"))


def literal_search(docs: DataFrame, tasks: DataFrame, key: str = "path", text: str = "text", task: str = "task_id", issue: str = "issue_text", limit: int = 5) -> DataFrame:
    """Keyword search by substring: most distinct terms, then most occurrences, then key.

    A term is of three or more letters, digits, ``_`` and ``$``, so it stands within a
    run of these; a run is held against the terms that begin where it does or within it,
    once for all tasks, and no text against every term.
    """
    scored = literal_counts(docs, tasks, key, text, task, issue)
    best = Window.partitionBy(task).orderBy(F.desc("terms"), F.desc("occurrences"), *_ties(docs, key))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(task, "rank", key, "terms", "occurrences")


def holding(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", task: str = "task_id", issue: str = "issue_text") -> DataFrame:
    """``(task, key)`` of every passage and each document that holds it as it stands.

    A run of letters, digits, ``_`` and ``$`` within a passage, not at its ends, is a run
    of any text that holds the passage: of these the one in the fewest documents is joined
    by equality, and only what that finds is read for the passage.  Passages without one
    are few words long; these alone are held against every text.
    """
    runs = lambda c: T.find_all(c, "[A-Za-z0-9_$]+")
    inner = F.slice(runs(F.col(issue)), 2, F.greatest(F.size(runs(F.col(issue))) - 2, F.lit(0)))
    p = passages.select(task, F.col(issue).alias("_passage"), F.array_distinct(inner).alias("_runs"))
    asked = p.select(task, F.explode("_runs").alias("_run"))
    words = docs.select(key, F.explode(F.array_distinct(runs(F.col(text)))).alias("_run"))
    words = written(words.join(asked.select("_run").distinct(), "_run", "left_semi"))
    seen = words.groupBy("_run").agg(F.count("*").alias("_n"))
    # a passage with a run that no document has is in none
    rarest = asked.join(seen, "_run", "left").groupBy(task).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_r")).where("_r.n > 0").select(task, "_r._run")
    near = words.join(rarest, "_run").select(task, key)
    d = docs.select(key, F.col(text).alias("_text"))
    long = near.join(p.select(task, "_passage"), task).join(d, key).where(F.col("_text").contains(F.col("_passage")))
    short = d.join(p.where("size(_runs) = 0").select(task, "_passage"), F.col("_text").contains(F.col("_passage")))
    return long.select(task, key).union(short.select(task, key))


def widespread_tokens(tokens: DataFrame, groups: list[str], key: str, share: float = 0.85, least: int = 4) -> DataFrame:
    """Tokens in at least ``share`` of a group's documents; groups of under ``least`` have none.

    ``tokens(groups..., key, tokens array)``, the array distinct.
    """
    n = tokens.groupBy(*groups).agg(F.count("*").alias("n"))
    df = tokens.select(*groups, F.explode("tokens").alias("token")).groupBy(*groups, "token").agg(F.count("*").alias("df"))
    joined = df.join(n, groups) if groups else df.crossJoin(F.broadcast(n))  # one row
    return joined.where((F.col("n") >= least) & (F.col("df") >= F.ceil(F.col("n") * share))).select(*groups, "token", "df", "n")
