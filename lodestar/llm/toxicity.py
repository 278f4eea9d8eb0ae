"""Toxicity: non-negative positive-unlabelled learning over words and their openings.

Confirmed toxic texts are the positives; unlabelled text, some of it toxic, is the rest.
The risk of the negative class is estimated from the unlabelled rows less the positives'
share (the class prior), and held at zero or more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import col
from .quality import with_column, with_field

#: Bounds of the samples of positives and of unlabelled documents.
POSITIVES, UNLABELLED = 1500, 3000
SAMPLE_CHARS = 100_000  # of a text that is learned from, at most
#: Texts of the positives that a feature must occur in (so many, and this share), and its rate there against unlabelled text.
MIN_TEXTS, MIN_LIFT = (3, 0.005), 5.0
#: Features of a smaller weight are left out of the second fit.
MIN_WEIGHT = 0.25
CACHE_WORDS = 400_000

WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself, and its first four and five letters."""
    parts = {word, f"<{word[:4]}", f"<{word[:5]}"} if len(word) >= 4 else {word}
    return tuple(zlib.crc32(p.encode()) for p in sorted(parts))


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def text_features(text: str) -> set[int]:
    return {f for w in words_of(text) for f in word_features(w)}


def unlike(texts: list[str]) -> list[str]:
    """Texts without near copies: of those that share one of four least word-trigram hashes, the first."""
    seen, out = set(), []
    for t in sorted(set(texts)):
        w = t.lower().split()
        h = [zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))]
        keys = {(k, min(x * m & 0xFFFFFFFF for x in h)) for k, m in enumerate((1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def nnpu_fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer from 0/1 rows of positives and of unlabelled text (Adam).

    risk = prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]), l the logistic
    loss; where the second part is negative, the step goes against it alone.
    """
    n = p.shape[1]
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = -2.0
    p1, u1 = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    for t in range(1, steps + 1):
        zp, zu = p1 @ w, u1 @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = prior * p1.T @ (sp - 1) / len(p1)
        g_neg = u1.T @ su / len(u1) - prior * p1.T @ sp / len(p1)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g[:n] += l2 * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


class PUModel:
    """Features with their weights, and a bias; features that tell nothing weigh nothing."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def logit(self, text: str) -> float:
        """Each feature counts once a text, so a text's length alone moves nothing."""
        found: set[int] = set()
        for w in words_of(text):
            f = self.known.get(w)
            if f is None:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                f = self.known[w] = tuple(x for x in word_features(w) if x in self.weights)
            if f:
                found.update(f)
        return self.bias + sum(self.weights[x] for x in sorted(found))

    def score(self, text: str) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.logit(text), -30, 30))))


def fit(positives: list[str], unlabelled: list[str], prior: float) -> PUModel:
    """Near copies count once.  Without positives or unlabelled text everything scores the prior."""
    ps, us = unlike(positives), unlike(unlabelled)
    bias = float(np.log(prior / (1 - prior)))
    if not ps or not us:
        return PUModel({}, bias)
    in_p = Counter(f for t in ps for f in text_features(t))
    least = max(MIN_TEXTS[0], round(MIN_TEXTS[1] * len(ps)))
    common = {f for f, c in in_p.items() if c >= least}
    # no more of a text is kept than what enough positives share
    ps, us = ([text_features(t) & common for t in x] for x in (ps, us))
    in_u = Counter(f for s in us for f in s)
    chosen = sorted(f for f in common if in_p[f] / len(ps) >= MIN_LIFT * (in_u[f] + 0.5) / len(us))
    if not chosen:
        return PUModel({}, bias)
    col = {f: k for k, f in enumerate(chosen)}

    def rows(x: list[set[int]]) -> np.ndarray:
        out = np.zeros((len(x), len(col)), np.float32)
        for i, s in enumerate(x):
            out[i, [col[f] for f in s if f in col]] = 1
        return out

    w, b = nnpu_fit(rows(ps), rows(us), prior)
    if strong := [f for f, x in zip(chosen, w) if x >= MIN_WEIGHT]:  # what is left tells on its own
        col = {f: k for k, f in enumerate(strong)}
        w, b = nnpu_fit(rows(ps), rows(us), prior)
        chosen = strong
    b = min(b, bias)  # without evidence no text is likelier toxic than the average one
    return PUModel({f: float(x) for f, x in zip(chosen, w)}, b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 4, left_out: int = 2, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, longest: int = SAMPLE_CHARS) -> PUModel:
    """Labels are read outside the fold left out only; the samples are bounded, by hash of the id.

    The prior is the share of toxic rows among those labels.  Labels other than 0 and 1,
    null ids and null texts count for nothing; without any positive everything scores the
    prior.  Rows that repeat an id count once, by the greatest text, and texts of over
    ``longest`` characters are not learned from, so rows and bytes are bounded.  Only the
    columns named are read of either table.
    """
    known = labels.select(col(id_col).alias("i"), col(label).alias("y")).where(F.col("y").isin(0, 1) & (F.pmod(F.crc32(F.col("i").cast("string")), F.lit(fold)) != left_out))
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    prior = min(max(share or 0.05, 0.005), 0.5)
    d = docs.select(col(id_col).alias("i"), col(text_col).alias("text"))
    toxic = known.where("y = 1").select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(positives)
    others = d.where("i is not null").select("i").distinct().orderBy(F.xxhash64("i", F.lit(1)), "i").limit(unlabelled)
    few = F.broadcast(toxic.withColumn("p", F.lit(1)).union(others.withColumn("p", F.lit(0))))  # a bounded number of ids
    # a row of each id, and no text too long to hold
    rows = d.where(F.length("text") <= longest).join(few, "i").groupBy("i", "p").agg(F.max("text").alias("text")).select("text", "p").collect()
    return fit([r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0], prior)


def score(docs: DataFrame, model: PUModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of each whole text in ``name``; a column of that name is replaced.

    Null texts count as empty and have a score as well; an empty table gives no rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)  # at most as many weights as the samples hold features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pu = box.value
        for b in batches:
            out = [pu.score(t or "") for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield with_column(b, name, pa.array(out, pa.float64()))

    return docs.mapInArrow(run, with_field(docs, name, DoubleType()))
