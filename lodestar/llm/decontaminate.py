"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of each window of ``WINDOW`` words the least hash of its runs of ``GRAM`` words is its
fingerprint.  It depends on the words of the window alone, so two texts that share a
window share its fingerprint: no shared span of ``WINDOW`` words is missed.  Neighbouring
windows mostly have the same one, so a text keeps two in seven of its words' number.
Only texts with a fingerprint of the benchmark are read once more, and their windows
with such a fingerprint are held against the benchmark's word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import col, materialize

WINDOW = 10  # words of a window: a shared span of so many is found
GRAM = 5  # words that a hash covers; a window has WINDOW - GRAM + 1 of them
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order: A-Z lower-cased, digits and what is not ASCII as it stands; null and empty texts have none."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(WORD), F.lit(0))


def _runs(n: Column, length: int, at) -> Column:
    """``at(i)`` for each start i of ``length`` consecutive ones of n."""
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), at)).otherwise(F.array().cast("array<bigint>"))


def _grams(ws: Column, length: int) -> Column:
    return _runs(F.size(ws), length, lambda i: F.xxhash64(F.lit(length), *[ws[i + j] for j in range(length)]))


def fingerprints(texts: DataFrame, lengths: tuple[int, ...], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``texts`` with ``words`` -> the same with ``p{length}``, an array with the fingerprint of each window, for each length.

    Windows of fewer words than ``window`` are those of short items; they are one hash each.
    """
    out = texts.withColumn("grams", _grams(F.col("words"), gram)) if window in lengths else texts
    for k in lengths:
        if k == window:
            span = window - gram + 1
            least = lambda i: F.least(*[F.col("grams")[i + j] for j in range(span)]) if span > 1 else F.col("grams")[i]
            out = out.withColumn(f"p{k}", _runs(F.size("grams"), span, least))
        else:
            out = out.withColumn(f"p{k}", _grams(F.col("words"), k))
    return out.drop("grams")


def _windows(lengths: tuple[int, ...]) -> Column:
    """All windows of a row with ``words`` and ``p{length}``: start, length, fingerprint and words."""
    kind = "array<struct<start:int,length:int,print:bigint,span:string>>"

    def of(k: int) -> Column:
        one = lambda p, i: F.struct(i.alias("start"), F.lit(k).alias("length"), p.alias("print"), F.array_join(F.slice("words", i + 1, k), " ").alias("span"))
        return F.transform(F.col(f"p{k}"), one).cast(kind)

    return F.concat(*map(of, lengths))


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, tuple[int, ...]]:
    """``(print, length, span, item_id)`` of every window of every item, and the lengths that occur.

    An item of fewer words than ``window``, but not none, is one window.
    """
    items = bench.select(col(id_col).alias("item_id"), words(col(text_col)).alias("words")).where(F.size("words") > 0)
    items = materialize(items.withColumn("long", F.size("words") >= window))
    short = [r.k for r in items.where("not long").select(F.size("words").alias("k")).distinct().collect()]  # under ``window`` values
    out = fingerprints(items.where("long"), (window,), window, gram).select("item_id", F.inline(_windows((window,))))
    for k in short:
        own = fingerprints(items.where(F.size("words") == k), (k,), window, gram)
        out = out.union(own.select("item_id", F.inline(_windows((k,)))))
    lengths = tuple(sorted(short)) + (window,)
    return materialize(out.select("print", "length", "span", "item_id").distinct()), lengths


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_hit, items array, contaminated)``, one row per row of ``docs``.

    A word is hit if it lies in an occurrence of a window of an item; ``items`` are the
    ids, as sorted strings, of the items with such windows.  Null and empty texts have no
    words and are clean; null and empty items have no windows; a null item_id counts in
    n_hit but has no place in ``items``, and repeated ids count once.  Repeated and null
    doc_ids keep a row each.  Empty tables give clean or no rows.  Other columns,
    whatever their names, are not read.

    Equal texts share a key, so that what is found of one is found of all.  Relations of
    the benchmark are written tables: Spark broadcasts them where they are small, and
    shuffles fingerprints, not texts, where they are not.
    """
    spans, lengths = benchmark_windows(bench, item_col, item_text, window, gram)
    text = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.md5(col(text_col)).alias("key"))
    read = spread(text).select("doc_id", "text", "key", words(F.col("text")).alias("words"))
    marks = fingerprints(read.select("doc_id", "key", "words"), lengths, window, gram)
    marks = marks.select("doc_id", "key", F.size("words").cast("bigint").alias("n_words"), F.array_distinct(F.concat(*[F.col(f"p{k}") for k in lengths])).alias("prints"))
    marks = materialize(marks)
    known = materialize(spans.select("print").distinct())
    suspects = materialize(marks.where(F.size("prints") > 0).select("key", F.explode("prints").alias("print")).join(known, "print", "left_semi").select("key").distinct())
    again = text.join(suspects, "key", "left_semi").select("key", words(F.col("text")).alias("words"))
    found = fingerprints(again, lengths, window, gram).select("key", F.inline(_windows(lengths)))
    whole = materialize(spans.select("print", "length", "span").distinct())
    found = materialize(found.join(known, "print", "left_semi").join(whole, ["print", "length", "span"], "left_semi").select("key", "start", "length", "span").distinct())
    # words covered: what each window adds beyond the farthest end before it
    before = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    added = found.select("key", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))).alias("n"))
    hit = added.groupBy("key").agg(F.sum("n").alias("n_hit"))
    owners = spans.where("item_id is not null").select("length", "span", F.col("item_id").cast("string").alias("item"))
    items = found.select("key", "length", "span").distinct().join(owners, ["length", "span"]).select("key", "item").distinct()
    items = items.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    facts = materialize(hit.join(items, "key", "left"))
    out = marks.select("doc_id", "key", "n_words").join(facts, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    sha = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), sha, "contaminated")


def oracle_sql() -> str:
    """The same over the ``documents`` and ``benchmark`` views, for DuckDB: every window of every document is compared."""
    ws = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH items AS (SELECT item_id, {ws('text')} AS ws FROM benchmark),
spans AS (SELECT item_id, unnest(CASE WHEN len(ws) >= {WINDOW} THEN [ws[i + 1:i + {WINDOW}] FOR i IN range(0, len(ws) - {WINDOW - 1})] WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS span FROM items),
lengths AS (SELECT DISTINCT len(span) AS k FROM spans),
docs AS (SELECT row_number() OVER () AS r, doc_id, {ws('text')} AS ws FROM documents),
windows AS (SELECT r, k, ws, unnest(range(0, len(ws) - k + 1)) AS s FROM docs, lengths WHERE len(ws) >= k),
found AS (SELECT DISTINCT w.r, w.s, w.k, item_id FROM (SELECT r, s, k, ws[s + 1:s + k] AS span FROM windows) w JOIN spans USING (span)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
