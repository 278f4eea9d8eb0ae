"""Quality classifier: a byte-level convolutional network, trained and applied with numpy.

Filters of WIDTH bytes slide over the whole text.  Their responses are max-pooled over
overlapping chunks; a chunk's pooled responses give its logit through a hidden layer,
and a document's mean, greatest and smallest chunk logit give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from .common import col

WIDTH = 6
FILTERS = 32
HIDDEN = 16
CELL = 64  # bytes pooled together; a chunk is CHUNK cells, and starts every STEP cells
CHUNK, STEP = 4, 2
#: Bounds of the labelled sample: documents a class, and chunks a document.
SAMPLE_DOCS = 1200
SAMPLE_CHARS = 100_000  # of a text that is learned from, at most
SAMPLE_CHUNKS = 12
EPOCHS = 8


class ByteCNN:
    """Weights: tables[j, byte] is what a byte at place j of a filter adds to each filter."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = np.float32
        self.tables = (r.normal(size=(WIDTH, 256, FILTERS)) * 0.4).astype(f)
        self.bias = np.zeros(FILTERS, f)
        self.w1 = (r.normal(size=(FILTERS, HIDDEN)) / FILTERS**0.5).astype(f)
        self.b1 = np.zeros(HIDDEN, f)
        self.w2 = (r.normal(size=HIDDEN) / HIDDEN**0.5).astype(f)
        self.b2 = f(0)
        self.top = np.array([1.0, 0.0, 0.0, 0.0])  # mean, max, min chunk logit, bias
        self.pairs = None

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = np.maximum(pooled + self.bias, 0)
        h = np.maximum(r @ self.w1 + self.b1, 0)
        return r, h, h @ self.w2 + self.b2

    def fit_chunks(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.003, seed: int = 5) -> None:
        """Adam on the cross entropy of chunks (rows of bytes), weighted so that both classes count alike."""
        rnd = np.random.default_rng(seed)
        names = ("tables", "bias", "w1", "b1", "w2", "b2")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        t, span = 0, x.shape[1] - WIDTH + 1
        for _ in range(epochs):
            order = rnd.permutation(len(x))
            for i in range(0, len(x), batch):
                b = order[i : i + batch]
                xb = x[b]
                act = self.tables[0][xb[:, :span]]
                for j in range(1, WIDTH):
                    act += self.tables[j][xb[:, j : j + span]]
                at = act.argmax(1)
                pooled = np.take_along_axis(act, at[:, None, :], 1)[:, 0]
                r, h, z = self._head(pooled)
                d = (weight[b] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)).astype(np.float32)
                dh = d[:, None] * self.w2 * (h > 0)
                dr = (dh @ self.w1.T) * (r > 0)
                g = {"w2": h.T @ d, "b2": d.sum(), "w1": r.T @ dh, "b1": dh.sum(0), "bias": dr.sum(0), "tables": np.zeros_like(self.tables)}
                cols = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(WIDTH):  # only the bytes under each filter's greatest response move it
                    np.add.at(g["tables"][j], (xb[np.arange(len(b))[:, None], at + j], cols), dr)
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))

    def _pairs(self) -> np.ndarray:
        """tables two by two, so that a pair of bytes is one look-up."""
        if self.pairs is None:
            t = self.tables
            self.pairs = np.stack([(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)])
        return self.pairs

    def chunk_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all chunks of all texts, and how many chunks each text has.

        A text is padded with zero bytes to a whole number of cells, and to one chunk at
        least; a text's last filters see zero bytes, never the next text.
        """
        cells = np.array([max(CHUNK, -(-len(t) // CELL)) for t in texts])
        cells += (cells - CHUNK) % STEP
        data = np.zeros(int(cells.sum() + len(texts)) * CELL, np.uint8)  # a cell of zeros after each text
        starts = np.concatenate(([0], np.cumsum(cells + 1)[:-1]))
        for s, t in zip(starts.tolist(), texts):
            data[s * CELL : s * CELL + len(t)] = np.frombuffer(t, np.uint8)
        pairs, pooled = self._pairs(), np.empty((len(data) // CELL, FILTERS), np.float32)
        block = 512 * CELL
        padded = np.concatenate((data, np.zeros(WIDTH, np.uint8))).astype(np.int32)
        for i in range(0, len(data), block):
            n = min(block, len(data) - i)
            two = padded[i : i + n + WIDTH - 2] * 256 + padded[i + 1 : i + n + WIDTH - 1]
            act = pairs[0][two[:n]]
            for j in range(1, WIDTH // 2):
                act += pairs[j][two[2 * j : 2 * j + n]]
            pooled[i // CELL : (i + n) // CELL] = act.reshape(-1, CELL, FILTERS).max(1)
        counts = (cells - CHUNK) // STEP + 1
        first = np.repeat(starts, counts) + STEP * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        best = pooled[first]
        for k in range(1, CHUNK):
            best = np.maximum(best, pooled[first + k])
        return self._head(best)[2], counts

    def features(self, texts: list[bytes]) -> np.ndarray:
        z, counts = self.chunk_logits(texts)
        at = np.cumsum(counts) - counts
        return np.stack([np.add.reduceat(z, at) / counts, np.maximum.reduceat(z, at), np.minimum.reduceat(z, at), np.ones(len(counts))], 1)

    def fit_top(self, texts: list[bytes], y: np.ndarray, steps: int = 400, rate: float = 0.5) -> None:
        x = np.clip(self.features(texts), -12, 12)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        scale = np.array([4.0, 4.0, 4.0, 1.0])
        w = self.top * scale
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x / scale) @ w))
            w -= rate * ((x / scale).T @ (weight * (p - y)) / len(y) + 1e-3 * w)
        self.top = w / scale

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One probability a text; one of no bytes is a chunk of padding."""
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.features(texts), -12, 12) @ self.top))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", seed: int = 3) -> ByteCNN:
    """Fit on ``labelled``, a bounded number of rows; whole texts for the top, random chunks below.

    Rows with a null text or label are left out, repeated ones count once.  Without a row
    of both classes the network stays as initialised.
    """
    rows = labelled.select(col(text_col), col(label_col)).dropna().collect()
    kept = sorted({(r[0].encode(), int(r[1])) for r in rows})
    model, rnd = ByteCNN(), np.random.default_rng(seed)
    if len({y for _, y in kept}) < 2:
        return model
    size, xs, ys = CELL * CHUNK, [], []
    for t, y in kept:
        t = t + b"\0" * max(0, size - len(t))
        most = len(t) - size
        for a in {0, most, *rnd.integers(0, most + 1, SAMPLE_CHUNKS - 2).tolist()}:
            xs.append(np.frombuffer(t[a : a + size], np.uint8))
            ys.append(y)
    model.fit_chunks(np.stack(xs), np.array(ys, np.float32))
    model.fit_top([t for t, _ in kept], np.array([y for _, y in kept], float))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, left_out: int, most: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", longest: int = SAMPLE_CHARS) -> DataFrame:
    """``(text, label)`` of at most ``most`` labelled documents of each class outside the fold left out, by hash of the id.

    Labels other than 0 and 1 and null ids count for nothing; an id with both labels
    stands in both classes.  Rows that repeat an id count once, by the greatest text, and
    texts of over ``longest`` characters are not learned from, so rows and bytes are
    bounded.  Only the columns named are read of either table.
    """
    known = labels.select(col(id_col).alias("i"), col(label).alias("label")).where(F.col("label").isin(0, 1) & (F.pmod(F.crc32(F.col("i").cast("string")), F.lit(fold)) != left_out)).distinct()
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("i"), "i").limit(most) for y in (0, 1)]
    few = F.broadcast(parts[0].union(parts[1]))  # at most 2 * most ids
    found = docs.select(col(id_col).alias("i"), col(text_col).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(few, "i")
    return found.groupBy("i", "label").agg(F.max("text").alias("text")).select("text", "label")


def score(docs: DataFrame, model: ByteCNN, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``name``, whole texts read; a column of that name is replaced.

    Null texts count as empty and have a score as well; an empty table gives no rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = box.value
        for b in batches:
            texts = [t or b"" for t in b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
            out = np.zeros(len(texts))
            i = 0
            while i < len(texts):  # about 4 MB at a time
                k, size = i, 0
                while k < len(texts) and (k == i or size + len(texts[k]) < 4 << 20):
                    size += len(texts[k])
                    k += 1
                out[i:k] = net.scores(texts[i:k])
                i = k
            yield with_column(b, name, pa.array(out))

    return docs.mapInArrow(run, with_field(docs, name, DoubleType()))


def with_field(docs: DataFrame, name: str, kind: DataType) -> StructType:
    """The schema of ``docs`` with a last column ``name``, in place of any of that name (case aside)."""
    return StructType([*[f for f in docs.schema.fields if f.name.lower() != name.lower()], StructField(name, kind)])


def with_column(b: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [k for k, n in enumerate(b.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], values], names=[*[b.schema.names[k] for k in kept], name])
