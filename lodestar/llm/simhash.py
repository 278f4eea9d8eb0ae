"""SimHash near-duplicates: 64-bit fingerprints over word shingles, linked through BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import col, connected_components, free_name, materialize

SEED = 42
SHINGLE = 3
RADIUS = 2
SHARD_ROWS = 4096  # members that one shard of trees holds, about
SALTS = 32  # keys that the rows of one component are dealt over
HOT_ROWS = 2048  # a bucket beyond this is cut into chunks, met pairwise


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 ``text``; 0 if it holds no word."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n < shingle:
        return h(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - shingle + 1].tolist()
    whole = b" ".join(words)
    hashes = np.array([h(whole[a:e], SEED) for a, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` of every row; a null text counts as empty, a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


class BKForest:
    """One BK-tree per bucket: a child hangs under its parent by its Hamming distance to it."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        self.fps = fps
        self.buckets, first, which = np.unique(bucket, return_index=True, return_inverse=True)
        self.roots = first
        self.child = np.full((len(fps), 65), -1, np.int32)
        flat, at = self.child.reshape(-1), first[which].astype(np.int64)
        todo = np.flatnonzero(at != np.arange(len(fps)))
        while len(todo):  # a level at a time: the first item of a (parent, distance) becomes the node
            edge = at[todo] * 65 + np.bitwise_count(fps[todo] ^ fps[at[todo]])
            keys, idx = np.unique(edge, return_index=True)
            flat[keys] = todo[idx]
            at[todo] = flat[edge]
            todo = todo[at[todo] != todo]

    def within(self, fps: np.ndarray, bucket: np.ndarray, radius: int, block: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node index) of all within ``radius``, in the query's own bucket."""
        if not len(self.buckets):
            return
        pos = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        known = np.flatnonzero(self.buckets[pos] == bucket)
        for i in range(0, len(known), block):
            q = known[i : i + block]
            node = self.roots[pos[q]]
            while len(q):
                d = np.bitwise_count(fps[q] ^ self.fps[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                nq, nn = [], []
                for step in range(-radius, radius + 1):  # only edges within the radius can lead to a match
                    k = d + step
                    ok = np.flatnonzero((k >= 0) & (k <= 64))
                    c = self.child[node[ok], k[ok]]
                    there = c >= 0
                    nq.append(q[ok[there]])
                    nn.append(c[there].astype(np.int64))
                q, node = np.concatenate(nq), np.concatenate(nn)


def _roots(n: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Smallest value reachable from each of n nodes along pairs (a, b)."""
    low = value.copy()
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        if (new == low).all():
            return low
        low = new


def _link_shard(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
    bucket = rows["bucket"].to_numpy(np.int64)
    role = rows["role"].to_numpy()
    tree, ask = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    forest = BKForest(fps[tree], bucket[tree])
    pairs = [(ask[q], tree[t]) for q, t in forest.within(fps[ask], bucket[ask], radius)]
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    keep = fps[a] != fps[b]
    a, b = a[keep], b[keep]
    value = fps.view(np.int64)
    low = _roots(len(fps), a, b, value)
    used = np.unique(np.concatenate((a, b)))
    return pd.DataFrame({"u": value[used], "v": low[used]})


def link(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct ``fps(fp)`` -> a spanning forest ``(u, v)`` of the pairs within ``radius`` bits.

    Fingerprints that differ in at most ``radius`` bits agree on at least one of
    ``radius + 1`` bit blocks, so each fingerprint joins the shard of each of its
    block values; a shard builds one BK-tree per block value and its members walk it.
    A block value with over ``hot_rows`` members is cut into chunks, and every pair of
    chunks is a shard of its own: the tree of one is sent to the queries of the other.
    """
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    blocks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.expr(f"shiftrightunsigned(shiftleft(fp, {64 - hi}), {64 - hi + lo})").alias("value"))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ])
    rows = fps.select("fp", F.explode(blocks).alias("b")).select("fp", F.xxhash64("b.i", "b.value").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("count")).withColumn("c", F.ceil(F.col("count") / hot_rows).cast("int"))
    hot = materialize(sizes.where("c > 1").select("bucket", "count", "c"))
    # shards are counted after the copies that hot buckets make
    copies = hot.agg(F.coalesce(F.sum(F.col("count") * (F.col("c") - 1)), F.lit(0))).first()[0]
    shards = max(1, math.ceil((fps.count() * (radius + 1) + copies) / shard_rows))
    rows = rows.join(hot.select("bucket", "c"), "bucket", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(7), "fp"), "c").cast("int"))
    meet = F.expr("transform(sequence(0, c - 1), o -> struct(least(h, o) as a, greatest(h, o) as b, cast(if(h = o, 0, if(h < o, 1, 2)) as tinyint) as role))")
    rows = rows.withColumn("m", F.explode(meet))
    rows = rows.select("fp", "bucket", F.col("m.role").alias("role"), F.pmod(F.xxhash64("bucket", "m.a", "m.b"), F.lit(shards)).alias("shard"), F.xxhash64("bucket", "m.a", "m.b").alias("cell"))
    return rows.drop("bucket").withColumnRenamed("cell", "bucket").groupBy("shard").applyInPandas(lambda pdf: _link_shard(pdf, radius), "u bigint, v bigint")


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """``marked(doc_id, fp)``, a table -> ``(fp, component_id)``, the smallest id that each fingerprint reaches."""
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = connected_components(link(first.select("fp"), radius))
    joined = materialize(first.join(comp, first.fp == comp.node, "left").select("fp", "first_id", F.col("component")))
    least = joined.where("component is not null").groupBy("component").agg(F.min("first_id").alias("low"))
    # a large group of near copies is one component: its rows go to SALTS keys
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = joined.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    of = salted.join(least, ["component", "salt"], "left")
    return materialize(of.select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("low")).alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row.

    Equal fingerprints link, and so do those within ``radius`` bits; ``component_id``
    is the smallest id reachable.  Null texts count as empty, texts without a word have
    fingerprint zero.  Rows with a null id take part, and get the smallest known id of
    their group, or null where it has none; repeated rows come back each.  Copies
    collapse before any pair is sought.  Other columns, whatever their names, are not
    read; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col))
    return marked.join(_components(marked, radius).select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` less all but one row of each group of near-duplicates, columns as they are.

    The row with the smallest id stays, one with an id before one without; of several
    rows with that id (or of none with any) the first as they are written here.  So a
    group keeps exactly one row, however its ids repeat or are null.
    """
    row, fp = free_name(docs, "_row"), free_name(docs, "_fp")
    marked = materialize(_with_fingerprints(docs, text_col, fp).withColumn(row, F.monotonically_increasing_id()))
    few = marked.select(col(id_col).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    group = _components(few.select("doc_id", "fp"), radius).select("fp", "component")
    # of a fingerprint first, so that a large group of copies is one row before groups meet
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    once = few.groupBy("fp").agg(best).join(group, "fp")
    kept = once.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("_kept"))
    return marked.join(kept, F.col(row) == F.col("_kept"), "left_semi").drop(row, fp)


def _with_fingerprints(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each text, in a column of a name that is free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            fps = np.array([simhash(t or b"") for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
