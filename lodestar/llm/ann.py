"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, and posted in the inverted file
of each of them.  A query reads the files of its own nearest pivots, which gives the
footrule distance to every vector posted there.  Permutations know directions only, and
what all vectors share tells none apart: so directions are those from the mean, and what
a footrule distance says of the angle is multiplied by a vector's distance from the mean.
The best by that are ranked anew by the true inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import lengths, sample, stacked, usable

PIVOTS = 512
PREFIX = 128  # nearest pivots that represent a vector
READ = 64  # of a query's pivots, those whose files are read
SHARD_ROWS = 8192
QUERY_BLOCK = 8192
RERANK_LEAST = 100
#: The share of a shard that is ranked anew is measured: ASKED sampled queries are searched through all rows, and
#: the share is what holds WANTED of their true neighbours, placed among SHOWN sampled rows.
ASKED, SHOWN, WANTED = 64, 8192, 0.96
BINS = 256  # of footrule closeness, for each of which the mean cosine is measured


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector stays zero."""
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1.0)[:, None], size


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first."""
    prefix = min(prefix, len(pivots))
    far = -(x @ pivots.T)
    near = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1) if len(x) else np.zeros((0, prefix), np.int64)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


class Postings:
    """Inverted files of one shard: a weight (prefix - place, 0 if not posted) for each pivot and row.

    A quarter of the weights are not zero, so a file of all of them is shorter than one
    of row numbers, and is read in order.
    """

    def __init__(self, perms: np.ndarray, pivots: int):
        n, self.prefix = perms.shape
        kind = np.uint8 if self.prefix < 256 else np.uint16
        self.weight = np.zeros((pivots, n), kind)
        self.weight[perms, np.arange(n)[:, None]] = np.arange(self.prefix, 0, -1, dtype=kind)
        self.own = np.zeros((0, n), kind)

    def closeness(self, perm: np.ndarray) -> np.ndarray:
        """What the footrule distance of cut permutations is less than for lists that share nothing, halved.

        A pivot that one of two lists lacks stands at the end there, so that lists share
        min(weight, weight) for each pivot in both, and nothing for any other.
        """
        if len(self.own) != len(perm):  # the weights of any query's pivots, as wide as the files
            own = np.arange(self.prefix, self.prefix - len(perm), -1, dtype=self.weight.dtype)
            self.own = np.repeat(own[:, None], self.weight.shape[1], axis=1)
        return np.minimum(self.weight[perm], self.own).sum(0, dtype=np.uint16 if self.prefix < 256 else np.uint32)


class Model:
    """What all tasks share: mean, pivots (directions from the mean), the cosine of each closeness, the share. Of bounded size."""

    def __init__(self, rows: np.ndarray, pivots: int, prefix: int, read: int):
        self.mean = rows.mean(0)
        self.pivots = directions(rows[:pivots] - self.mean)[0]
        self.prefix, self.read = min(prefix, len(self.pivots)), min(read, prefix, len(self.pivots))
        self.cosine, self.share = np.linspace(-1, 1, BINS + 1), 1.0

    def post(self, x: np.ndarray) -> tuple[Postings, np.ndarray]:
        u, size = directions(x - self.mean)
        return Postings(permutations(u, self.pivots, self.prefix), len(self.pivots)), size

    def asked(self, q: np.ndarray) -> np.ndarray:
        """A query's order of products is that of its products with what lies beyond the mean."""
        return permutations(directions(q)[0], self.pivots, self.read)

    def bins(self, closeness: np.ndarray) -> np.ndarray:
        most = self.prefix * (self.prefix + 1) // 2 - (self.prefix - self.read) * (self.prefix - self.read + 1) // 2
        return closeness.astype(np.int64) * BINS // max(1, most)

    def fit(self, queries: np.ndarray, shown: np.ndarray, near: list[np.ndarray], wanted: float) -> None:
        """``near``: the true neighbours' vectors of each query."""
        post, size = self.post(shown)
        u, perms = directions(shown - self.mean)[0], self.asked(queries)
        sums, n, seen = np.zeros(BINS + 1), np.zeros(BINS + 1), []
        for q, perm in zip(directions(queries)[0], perms):
            b = self.bins(post.closeness(perm))
            seen.append(b)
            np.add.at(sums, b, u @ q)
            np.add.at(n, b, 1)
        theirs = [self.post(v) for v in near]
        found = [self.bins(p.closeness(perm)) for (p, _), perm in zip(theirs, perms)]
        for q, v, b in zip(directions(queries)[0], near, found):  # the rare close ones as well
            np.add.at(sums, b, directions(v - self.mean)[0] @ q)
            np.add.at(n, b, 1)
        known = np.flatnonzero(n)
        # closer never tells of a wider angle
        self.cosine = np.maximum.accumulate(np.interp(np.arange(BINS + 1), known, sums[known] / n[known]))
        behind = []
        for b, mine, (_, long) in zip(seen, found, theirs):
            all_ = np.sort(self.cosine[b] * size)
            behind.append((len(all_) - np.searchsorted(all_, self.cosine[mine] * long, "left")) / len(all_))
        self.share = float(np.quantile(np.concatenate(behind), wanted)) if behind else 1.0


def search_shard(index: pd.DataFrame, queries: pd.DataFrame, model: Model, k: int, least: int) -> pd.DataFrame:
    index = index.sort_values("id", kind="stable")
    ids, dim = index["id"].to_numpy(), len(model.mean)
    x, asked = stacked(index["vec"], dim), stacked(queries["vec"], dim)
    post, size = model.post(x)
    perms = model.asked(asked)
    most = min(len(ids), max(least, k + 1, math.ceil(model.share * len(ids))))
    out_q, out_v, out_s = [], [], []
    place = np.arange(len(ids), dtype=np.int64)
    for q, vec, perm in zip(queries["id"].tolist(), asked, perms):
        near = place
        if most < len(ids):
            likely = model.cosine[model.bins(post.closeness(perm))] * size
            near = np.flatnonzero(likely >= np.partition(likely, len(ids) - most)[len(ids) - most])  # ties all stay
        near = near[ids[near] != q]
        s = (x[near] * vec).sum(1)  # each row in the same order of its own, so that equal vectors score alike
        if len(near) > k:
            some = s >= np.partition(s, len(s) - k)[len(s) - k]
            near, s = near[some], s[some]
        top = np.lexsort((ids[near], -s))[:k]
        out_q.append(np.full(len(top), q, np.int64))
        out_v.append(ids[near][top])
        out_s.append(s[top])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def nearest_of_all(v: DataFrame, ids: list[int], queries: np.ndarray, k: int) -> list[np.ndarray]:
    """Vectors of the k nearest of each of a few queries, found among all rows: each batch keeps its own best."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            mine = b["id"].to_numpy()
            s = stacked(b["vec"], queries.shape[1]) @ queries.T
            s[mine[:, None] == np.array(ids)] = -np.inf
            top = np.argsort(-s, axis=0)[:k]
            new = pd.DataFrame({"q": np.repeat(np.arange(len(ids)), len(top)), "s": np.take_along_axis(s, top, 0).T.ravel(), "id": mine[top.T.ravel()], "vec": b["vec"].to_numpy()[top.T.ravel()]})
            kept = new if kept is None else pd.concat([kept, new])
            kept = kept.sort_values(["q", "s"], ascending=[True, False]).groupby("q").head(k)
        if kept is not None:
            yield kept[np.isfinite(kept["s"])]

    kind = v.schema["vec"].dataType.simpleString()
    found = v.mapInPandas(best, f"q int, s double, id bigint, vec {kind}")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    rows = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "vec").collect()  # k of each of a few
    out = [[r.vec for r in rows if r.q == i] for i in range(len(ids))]
    return [np.array(o, dtype=np.float64).reshape(-1, queries.shape[1]) for o in out]


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, read: int = READ, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, least: int = RERANK_LEAST, wanted: float = WANTED) -> DataFrame:
    """The ``k`` nearest found of each query row, by largest inner product in double precision.

    ``(query_id, rank, vec_id, score)``, nearest first, ties to the smaller id; fewer
    rows if there are fewer candidates, none for an empty table.  ``is_query`` is a
    condition on ``id``.  Pivots are a fixed number of rows, chosen by hash of the id;
    every row is indexed.  Shards of the index meet blocks of queries, each pair in a
    task; nothing grows on the driver.  Vectors that take no part (see ``usable``) are
    neither asked for nor found; vectors of several lengths are searched among their own.
    Repeated rows of an id are one candidate each, but never their own query's; as a
    query, the least of an id's vectors is asked once.  Other columns, whatever their
    names, are not read.
    """
    v = usable(vectors, id_col, vec_col)
    out = None
    for dim in lengths(v):
        one = _search(v.where(F.size("vec") == dim), is_query, k, pivots, prefix, read, shard_rows, query_block, least, wanted)
        out = one if out is None else out.union(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # an id may have vectors of several lengths: it is one query still
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(v: DataFrame, is_query: Column, k: int, pivots: int, prefix: int, read: int, shard_rows: int, query_block: int, least: int, wanted: float) -> DataFrame:
    """``(query_id, vec_id, score)``: the best k of every shard, for vectors of one length."""
    n, asking = v.agg(F.count("*"), F.count_if(is_query)).first()
    shown = sample(v, max(pivots, SHOWN))
    model = Model(shown, pivots, prefix, read)
    few = v.where(is_query).orderBy(F.xxhash64("id", F.lit(2)), "id", "vec").limit(ASKED).select("id", "vec").collect() if n > least else []
    if few:
        queries = np.array([r.vec for r in few], dtype=np.float64)
        model.fit(queries, shown, nearest_of_all(v, [r.id for r in few], queries, k), wanted)
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asking / query_block))
    # rows are dealt evenly, whatever their ids are
    index = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = v.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return search_shard(index, queries, model, k, least)

    return index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(cell, "query_id bigint, vec_id bigint, score double")
