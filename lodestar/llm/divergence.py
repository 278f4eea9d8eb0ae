"""How the sources of a language differ in their words, exactly, with a sketch in front.

Documents are read once: each task counts the terms of its own, by columns, and writes what it has
counted.  A count-min sketch over these rows tells in how many documents each term may
stand: every partition fills one, and sketches add up.  No count in it is under the true
one, so a term whose least counter is under the bar is in too few documents, and its rows
are never shuffled.  What is left is summed exactly.  Sources are compared by joins of
the terms they hold; terms that a source lacks all have one probability there, so they
enter as a product and not as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import col, materialize

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOW = {i: i + 32 for i in range(65, 91)}
LEAST_DOCS = 30
ROWS, WIDTH_BITS = 4, 20  # of the sketch: 4 MB, whatever the input
BLOCKS = 16  # parts of a sketch that are merged apart
FAN_IN = 32  # sketches that one task adds up
CHUNK = 16 << 20  # bytes of text, or one text, whose terms a task counts at once
SMOOTH, UNIT = 5, 1_000_000_000
TOP_TERMS = 50


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(LOW) if not text.isascii() else text.lower())


def tallied(texts: pa.Table) -> pa.RecordBatch:
    """Terms of these (lang, source, text) by language and source: occurrences, and documents that hold them."""
    lang, source, text = (texts.column(k).combine_chunks() for k in range(3))
    lists = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)  # of A-Z alone; what is between terms is what TERM leaves out
    words = lists.flatten().dictionary_encode()
    size = max(1, len(words.dictionary))
    rows = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    in_row = rows * size + words.indices.to_numpy(zero_copy_only=False)
    in_row.sort()
    first = np.flatnonzero(np.r_[True, in_row[1:] != in_row[:-1]][: len(in_row)])
    times = np.diff(np.r_[first, len(in_row)])
    row, code = np.divmod(in_row[first], size)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
    of = group[row] * size + code
    order = np.argsort(of)
    of, times = of[order], times[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    group, code = np.divmod(of[first], size)
    n, docs = np.add.reduceat(times, first) if len(first) else times, np.diff(np.r_[first, len(of)])
    term = words.dictionary.take(pa.array(code))
    cols = [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"]).filter(pc.not_equal(term, ""))  # before the first and after the last


def counted(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, h, n, docs)`` of ``docs(lang, source, text)``, as each task has counted it: occurrences, and documents that hold the term.

    ``h`` names the language and the term; rows of one term are still many.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False))
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
                if len(part):
                    held.append(b.slice(part[0], len(part)))
                    size += ends[part[-1]] - (ends[part[0] - 1] if part[0] else 0)
                if size >= CHUNK:
                    yield tallied(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield tallied(pa.Table.from_batches(held))

    parts = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return parts.withColumn("h", F.xxhash64("lang", "term"))


def cells(h: np.ndarray, rows: int = ROWS, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """rows x terms: the counter of each row that each term falls on."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    r = np.arange(rows, dtype=np.uint64)[:, None]
    return ((r << np.uint64(width_bits)) | ((h + r * step) & np.uint64((1 << width_bits) - 1))).astype(np.int64)


def sketch(rows_of_terms: DataFrame, least: int = LEAST_DOCS, rows: int = ROWS, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """Merged counters of ``(h, docs)``, each at most ``least``, which is all that is asked of them: ``rows << width_bits`` bytes for least < 256, whatever the input."""
    size, kind = rows << width_bits, np.uint8 if least < 256 else np.uint32
    part = -(-size // BLOCKS)
    n = max(1, rows_of_terms.rdd.getNumPartitions())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for b in batches:
            seen = np.minimum(b.column(1).to_numpy(), least).astype(np.uint32)
            for row in cells(b.column(0).to_numpy(), rows, width_bits):  # a batch is short, so no sum overflows
                np.add.at(counts, row, seen)
            np.minimum(counts, least, out=counts)
        counts, salt = counts.astype(kind), TaskContext.get().partitionId()
        blobs = [counts[i : i + part].tobytes() for i in range(0, size, part)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blobs)), pa.int32()), "salt": pa.array([salt] * len(blobs), pa.int64()), "counts": pa.array(blobs, pa.binary())})

    def merge(rows_: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows_["counts"].iloc[0]) // np.dtype(kind).itemsize, np.uint32)
        for blob in rows_["counts"]:
            total = np.minimum(total + np.frombuffer(blob, kind), least)
        return pd.DataFrame({"block": [rows_["block"].iloc[0]], "salt": [rows_["salt"].iloc[0]], "counts": [total.astype(kind).tobytes()]})

    schema = "block int, salt bigint, counts binary"
    merged = rows_of_terms.select("h", "docs").mapInArrow(fill, schema)
    while True:  # each round adds up at most about FAN_IN sketches in a task
        n = -(-n // FAN_IN)
        merged = merged.withColumn("salt", F.pmod("salt", F.lit(n))).groupBy("block", "salt").applyInPandas(merge, schema)
        if n == 1:
            break
    blobs = {r.block: r.counts for r in merged.collect()}  # BLOCKS rows
    return np.concatenate([np.frombuffer(blobs[b], kind) for b in sorted(blobs)]) if blobs else np.zeros(size, kind)


def may_reach(rows_of_terms: DataFrame, counts: np.ndarray, least: int = LEAST_DOCS, rows: int = ROWS, width_bits: int = WIDTH_BITS) -> DataFrame:
    """The rows of terms that may stand in ``least`` documents; only ``h`` travels to Python."""
    shared = rows_of_terms.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def kept(h: pd.Series) -> pd.Series:
        return pd.Series((shared.value[cells(h.to_numpy(), rows, width_bits)] >= least).all(0))

    return rows_of_terms.where(F.pandas_udf(kept, "boolean")("h"))


def _p(n: str, total: str, terms_: str) -> str:
    """Smoothed share in units of 1 / UNIT; exact for any count, by decimals."""
    return f"1 + (cast({n} + {SMOOTH} as decimal(20, 0)) * {UNIT}) div ({total} + {SMOOTH} * {terms_})"


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", rows: int = ROWS, width_bits: int = WIDTH_BITS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    ``pair``: for each source of a language each other one, by the sum of the absolute
    differences of their probabilities over all terms that stand in at least ``least``
    documents of the language.  ``term``: the ``top`` terms by what a source's
    probability exceeds the language's.  Null texts, languages and sources count as ''.
    Greatest value first, then item in order of UTF-8.  A source without terms is there;
    an only source has no ``pair`` rows; a language without kept terms has pairs of value
    0.  Repeated rows are documents of their own, an empty table gives no rows, and other
    columns, whatever their names, are not read.
    """
    named = lambda c, n: F.coalesce(col(c).cast("string"), F.lit("")).alias(n)
    d = spread(docs.select(named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text")))
    raw = materialize(counted(d))
    some = may_reach(raw, sketch(raw, least, rows, width_bits), least, rows, width_bits)
    counts = materialize(some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs")
    kept = materialize(kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = d.select("lang", "source").distinct()
    held = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("total", zero).alias("total"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, F.expr(_p("0", "total", "v")))))
    held = held.join(groups, ["lang", "source"]).select("lang", "source", "term", F.expr(_p("n", "total", "v")).alias("p"), F.expr(_p("lang_n", "lang_total", "v")).alias("q"), "p0")
    held = materialize(held)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = held.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    listed = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # what each source's terms differ by from the other's p0, by the distinct values of p; then what both hold is put right
    values = held.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    one = values.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("other_p0"))).alias("alone"), F.sum("m").alias("size"))
    mine = held.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    theirs = held.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    shift = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb")) - F.abs(F.col("pb") - F.col("za"))
    both = mine.join(theirs, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(shift).alias("shift"), F.count("*").alias("shared"))
    g = groups.select("lang", F.col("source").alias("a"), "v", F.col("p0").alias("za"))
    pairs = g.join(groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("zb")), "lang").where("a < b")
    sides = one.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.col("alone").alias("alone_a"), F.col("size").alias("size_a"))
    pairs = pairs.join(sides, ["lang", "a", "b"], "left")
    sides = one.select("lang", F.col("other").alias("a"), F.col("source").alias("b"), F.col("alone").alias("alone_b"), F.col("size").alias("size_b"))
    pairs = pairs.join(sides, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left").fillna(0)
    value = F.col("alone_a") + F.col("alone_b") + F.col("shift") + (F.col("v") - F.col("size_a") - F.col("size_b") + F.col("shared")) * F.abs(F.col("za") - F.col("zb"))
    pairs = materialize(pairs.select("lang", "a", "b", F.when(F.col("v") > 0, value).otherwise(zero).alias("value")))
    either = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    either = either.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    cols = ["lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank"]
    return either.select(*cols).union(listed.select(*cols))


def oracle_sql() -> str:
    """The same over the ``documents`` view, for DuckDB: every term of every source, without a sketch."""
    p = lambda n, total: f"1 + (({n} + {SMOOTH})::HUGEINT * {UNIT}) // ({total} + {SMOOTH} * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM.pattern}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS own FROM dense GROUP BY ALL),
f AS (SELECT e.lang, e.source, e.term, n, {p('n', 'own')} AS p, {p('lang_n', 'total')} AS q FROM dense e JOIN sums USING (lang, source) JOIN langs USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f x ON x.lang = a.lang AND x.source = a.source LEFT JOIN f y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
