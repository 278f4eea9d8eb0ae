"""Hard negatives by bit-sliced integer products.

Components become whole numbers in two's complement, and a shard of vectors becomes bit
planes packed 64 components to a word.  The product of an anchor with a plane is a few
ANDs and counts of ones.  Planes are read from the sign down; what the planes to come can
still add lies between two bounds, so each candidate's score has an interval that halves
from plane to plane, and candidates that can no longer qualify are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize

SCALE = 256
SHARD_ROWS = 16_384  # candidates of a task, about
ANCHOR_BLOCK = 4096  # anchors of a task, about
POSITIVES, NEGATIVES = 5, 5
TOO_LARGE = "products of vectors with components so large may not fit a long"
LOW_PCT = 80  # of a positive's score, the least that a negative's may be


def whole_numbers(vectors: pd.Series, scale: int = SCALE) -> np.ndarray:
    x = np.floor(scale * np.stack(vectors.to_numpy()).astype(np.float64))
    if np.abs(x).max(initial=0) >= 1 << 61:
        raise OverflowError(TOO_LARGE)
    return x.astype(np.int64)


def bits_of(x: np.ndarray) -> int:
    """Bits below the sign that two's complement needs."""
    return int(max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 0)).bit_length()


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(bits + 1) x words x rows of uint64: plane b holds bit b of each component, the last plane the sign."""
    n, d = x.shape
    out = np.zeros((bits + 1, max(1, math.ceil(d / 64)), n), np.uint64)
    for b in range(bits + 1):
        packed = np.packbits(((x >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        full = np.zeros((n, out.shape[1] * 8), np.uint8)
        full[:, : packed.shape[1]] = packed
        out[b] = full.view("<u8").T
    return out


class Sliced:
    """A shard of vectors as bit planes."""

    def __init__(self, x: np.ndarray):
        self.bits = bits_of(x)
        self.planes = planes(x, self.bits)

    def dot(self, anchor: np.ndarray, b: int, rows: np.ndarray | slice) -> np.ndarray:
        """Product of an anchor (as ``planes`` of one row) with plane b of some rows."""
        mine = self.planes[b][:, rows]
        top = len(anchor) - 1
        total = np.zeros(mine.shape[1], np.int64)
        for j, words in enumerate(anchor):
            if words.any():
                ones = np.bitwise_count(mine & words).sum(0, dtype=np.int64)
                total += (ones << j) if j < top else -(ones << j)
        return total

    def refine(self, anchor: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``keep(lo, hi)`` leaves after the last plane, and their exact scores.

        ``keep`` is asked after each plane, with bounds of the scores of what is left.
        """
        sliced = planes(anchor[None], bits_of(anchor[None]))
        less, more = int(np.minimum(anchor, 0).sum()), int(np.maximum(anchor, 0).sum())
        score = np.zeros(len(rows), np.int64)
        for b in range(self.bits, -1, -1):
            part = self.dot(sliced, b, rows) << b
            score += -part if b == self.bits else part
            rest = (1 << b) - 1  # what all planes to come can weigh
            ok = keep(score + rest * less, score + rest * more)
            if not ok.all():
                rows, score = rows[ok], score[ok]
            if not len(rows):
                break
        return rows, score


def _largest(values: np.ndarray, k: int) -> int | None:
    """The k-th largest, if there are so many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def top_rows(shard: Sliced, anchor: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows that may be among the k of largest score: ties of the k-th stay."""

    def keep(lo, hi):
        bar = _largest(lo, k)
        return np.ones(len(lo), bool) if bar is None else hi >= bar

    return shard.refine(anchor, rows, keep)


def rows_below(shard: Sliced, anchor: np.ndarray, rows: np.ndarray, limits: list[int], k: int, low_pct: int = LOW_PCT) -> tuple[np.ndarray, np.ndarray]:
    """All rows that may be among the k of largest score between low_pct per cent of a limit and the limit, for any limit."""
    limits = [(p, -(-low_pct * p // 100)) for p in limits if p >= 0]  # a negative score leaves nothing between

    def keep(lo, hi):
        ok = np.zeros(len(lo), bool)
        for p, least in limits:
            sure = lo[(hi <= p) & (lo >= least)]
            bar = _largest(sure, k)
            ok |= (lo <= p) & (hi >= (least if bar is None else max(least, bar)))
        return ok

    return shard.refine(anchor, rows, keep) if limits else (rows[:0], np.zeros(0, np.int64))


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _checked(index: pd.DataFrame, anchors: pd.DataFrame, scale: int) -> tuple[np.ndarray, np.ndarray]:
    x, a = whole_numbers(index["vec"], scale), whole_numbers(anchors["vec"], scale)
    most = lambda z: max(int(z.max(initial=0)), -int(z.min(initial=0)))
    if 2 * most(x) * most(a) * max(1, x.shape[1]) >= 1 << 62:
        raise OverflowError(TOO_LARGE)
    return x, a


def _positives(index: pd.DataFrame, anchors: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    """The best k of a shard of one label for each anchor of that label."""
    out = []
    if len(index) and len(anchors):
        x, a = _checked(index, anchors, scale)
        ids, shard, every = index["id"].to_numpy(np.int64), Sliced(x), np.arange(len(index))
        for anchor, vec in zip(anchors["id"].tolist(), a):
            rows, score = top_rows(shard, vec, every[ids != anchor], k)
            for i in _first(ids[rows], score, k):
                out.append((anchor, int(ids[rows[i]]), int(score[i])))
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])


def _negatives(index: pd.DataFrame, anchors: pd.DataFrame, k: int, low_pct: int, scale: int) -> pd.DataFrame:
    """For each anchor of a block and each of its positives, the best k of a shard."""
    out = []
    if len(index) and len(anchors):
        x, a = _checked(index, anchors, scale)
        ids, labels, shard = index["id"].to_numpy(np.int64), index["label"].to_numpy(np.int64), Sliced(x)
        others = {lab: np.flatnonzero(labels != lab) for lab in set(anchors["label"].tolist())}
        for anchor, label, vec, positives in zip(anchors["id"].tolist(), anchors["label"].tolist(), a, anchors["positives"]):
            pairs = [(p["positive_score"], p["positive_id"]) for p in positives]
            rows, score = rows_below(shard, vec, others[label], [p for p, _ in pairs], k, low_pct)
            for p, positive in pairs:
                ok = np.flatnonzero((score * 100 >= low_pct * p) & (score <= p))
                for i in ok[_first(ids[rows[ok]], score[ok], k)]:
                    out.append((anchor, positive, int(ids[rows[i]]), p, int(score[i])))
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def usable_labelled(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, label, vec, dim)``: rows without null id, label or vector and with finite components only; one row of each id."""
    v = vectors.select(col(id_col).cast("bigint").alias("id"), col(label_col).cast("bigint").alias("label"), col(vec_col).alias("vec"))
    v = v.where("id is not null and label is not null and vec is not null")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    one = v.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return one.select("id", "r.label", "r.vec", F.size("r.vec").alias("dim"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW_PCT,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, shard_rows: int = SHARD_ROWS, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, exact.

    Scores are inner products of ``floor(scale * x)``.  An anchor's positives are the
    first ``positives`` other rows of its label, by score, then smaller id; for each, the
    first ``negatives`` rows of another label whose score is at least ``low_pct`` per cent
    of the positive's and at most the positive's.  ``is_anchor`` is a condition on ``id``,
    ``label`` an expression of ``id`` and ``label`` that replaces the label.

    Rows with a null id, label or vector or a component that is null or not finite take no
    part; zero vectors do.  Vectors meet those of their own length only.  Ids name rows:
    of several of one id the least (label, vector) counts.  A product that no long holds
    is an error.  An empty table gives no rows; other columns, whatever their names, are
    not read.

    Shards of at most about ``shard_rows`` candidates meet blocks of about
    ``anchor_block`` anchors, each pair in a task, so a frequent label is dealt over many;
    a task returns its best few, and what is kept of all shards is ranked once more.
    """
    v = usable_labelled(vectors, id_col, vec_col, label_col)
    v = materialize(v.withColumn("label", label.cast("bigint")) if label is not None else v).where("label is not null")
    dealt = lambda n, per, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.lit(1), F.ceil(n / per)).cast("bigint")).cast("int")
    each = lambda n, per: F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(n / per)) - 1).cast("int")))

    # positives: shards and blocks are counted by length and label
    sizes = materialize(v.groupBy("dim", "label").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).where("a > 0"))
    known = v.join(sizes, ["dim", "label"])
    index = known.withColumn("shard", dealt(F.col("n"), shard_rows, 1)).withColumn("block", each(F.col("a"), anchor_block))
    asked = known.where(is_anchor).withColumn("block", dealt(F.col("a"), anchor_block, 2)).withColumn("shard", each(F.col("n"), shard_rows))
    cell = ["dim", "label", "shard", "block"]
    best = index.select(*cell, "id", "vec").groupBy(*cell).cogroup(asked.select(*cell, "id", "vec").toDF(*cell, "id", "vec").groupBy(*cell))
    best = best.applyInPandas(lambda i, a: _positives(i, a, positives, scale), "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    near = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    anchors = materialize(v.where(is_anchor).join(near, "id"))

    # negatives: by length alone
    sizes = materialize(v.groupBy("dim").agg(F.count("*").alias("n")).join(anchors.groupBy("dim").agg(F.count("*").alias("a")), "dim"))
    index = v.join(sizes, "dim").withColumn("shard", dealt(F.col("n"), shard_rows, 3)).withColumn("block", each(F.col("a"), anchor_block))
    asked = anchors.join(sizes, "dim").withColumn("block", dealt(F.col("a"), anchor_block, 4)).withColumn("shard", each(F.col("n"), shard_rows))
    cell, carried = ["dim", "shard", "block"], ["id", "label", "vec", "positives"]
    found = index.select(*cell, "id", "label", "vec").groupBy(*cell).cogroup(asked.select(*cell, *carried).toDF(*cell, *carried).groupBy(*cell))
    found = found.applyInPandas(lambda i, a: _negatives(i, a, negatives, low_pct, scale), "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """The same over the ``embeddings`` view, for DuckDB: every product of every pair."""
    return f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW_PCT} * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
