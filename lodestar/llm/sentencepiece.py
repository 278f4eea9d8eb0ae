"""SentencePiece encoding and decoding with numpy, many words of one length at a time.

Substring hashes of all words of a length are looked up in the sorted keys of the
pieces, which gives each (place, length) its score and id.  Two ways to choose pieces
from them share this table:

* ``viterbi`` (unigram models): places advance together in all words, and vectorised
  maxima store backpointers;
* ``merges`` (BPE models): the best-scoring neighbours of each word join, leftmost
  first, until none can.  The pieces of the greatest total score differ from these, so
  a BPE model's own ids need the merges.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

BASE = np.uint64(0x100000001B3)
SPACE = "▁"
LONG = 64  # words of more characters merge one by one, through a heap
CELLS = 4_000_000  # substrings looked up at a time
CACHE_WORDS = 300_000
BLOCK_BYTES = 4 << 20
_WORD = re.compile(rb" *[^ \n]+|\n| +")  # no piece joins over these borders


class Pieces:
    """The pieces of a model: sorted hashes, scores, ids; bytes stand for unknown characters."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int = 0):
        """``pieces`` in order of id, null for control symbols and bytes."""
        self.text = {i: p for i, p in enumerate(pieces) if p is not None}
        self.byte_ids, self.unknown = byte_ids, unknown
        self.id = {p: i for i, p in self.text.items()}
        self.score_of = {p: scores[i] for i, p in self.text.items()}
        known = sorted((self._hash(p), i) for i, p in self.text.items())
        self.keys = np.array([h for h, _ in known], np.uint64)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.ids = np.array([i for _, i in known], np.int32)
        self.scores = np.array([scores[i] for i in self.ids], np.float64)
        self.longest = max(map(len, self.id), default=1)
        crossing = [p for p in self.id if "\n" in p and len(p) > 1 or SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces join over a word's border: {crossing[:3]}")

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
        byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        return cls([m.id_to_piece(i) if plain[i] else None for i in range(n)], [m.get_score(i) for i in range(n)], byte_ids, m.unk_id())

    def table(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words (rows of code points): score and id of the substring at [word, place, length - 1]."""
        n, size = chars.shape
        most = min(self.longest, size)
        score = np.full((n, size, most), -np.inf)
        ids = np.full((n, size, most), -1, np.int32)
        h = np.zeros((n, size), np.uint64)
        for k in range(most):  # hashes of all substrings of k + 1 characters
            span = size - k
            h = h[:, :span] * BASE + chars[:, k:].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            score[:, :span, k] = np.where(hit, self.scores[at], -np.inf)
            ids[:, :span, k] = np.where(hit, self.ids[at], -1)
        return score, ids

    def char_ids(self, c: str) -> list[int]:
        """A character that no piece holds: its bytes, or the unknown id."""
        if self.byte_ids:
            return [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
        return [self.unknown]


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """For each word, marks of where a piece starts in the segmentation of greatest total score.

    A character that is no piece costs ``penalty``; of equal totals the shorter last piece wins.
    """
    n, size, most = score.shape
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int64)
    single = np.where(np.isfinite(score[:, :, 0]), score[:, :, 0], penalty)
    for end in range(1, size + 1):
        lens = np.arange(1, min(most, end) + 1)
        starts = end - lens
        step = np.where(lens == 1, single[:, starts], score[:, starts, lens - 1])
        total = best[:, starts] + step
        pick = total.argmax(1)
        best[:, end] = total[np.arange(n), pick]
        back[:, end] = starts[pick]
    marks = np.zeros((n, size), bool)
    at, rows = np.full(n, size), np.arange(n)
    while at.any():
        at = np.where(at > 0, back[rows, at], 0)
        marks[rows, at] = True
    return marks


def merges(score: np.ndarray) -> np.ndarray:
    """For each word, marks of where a piece starts once the best neighbours have joined, again and again."""
    n, size, most = score.shape
    marks = np.ones((n, size), bool)
    if size < 2 or most < 2:
        return marks
    place = np.arange(size)
    end, prev = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
    gain = np.full((n, size), -np.inf)  # of joining the piece that starts here with the next
    gain[:, : size - 1] = score[:, : size - 1, 1]
    rows = np.arange(n)

    def worth(r: np.ndarray, i: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return np.where(stop - i <= most, score[r, i, np.minimum(stop - i, most) - 1], -np.inf)

    while len(rows):
        pick = gain[rows].argmax(1)  # the leftmost of the best
        on = np.isfinite(gain[rows, pick])
        rows, i = rows[on], pick[on]
        j = end[rows, i]
        stop = end[rows, j]
        end[rows, i] = stop
        marks[rows, j] = False
        gain[rows, j] = -np.inf
        more = stop < size
        r, m = rows[more], stop[more]
        prev[r, m] = i[more]
        gain[rows, i] = -np.inf
        gain[r, i[more]] = worth(r, i[more], end[r, m])
        back = prev[rows, i]
        has = back >= 0
        gain[rows[has], back[has]] = worth(rows[has], back[has], stop[has])
    return marks


def _merge_long(p: Pieces, word: str) -> list[str]:
    """The same for one long word, through a heap of candidate joins."""
    nxt, prv, part = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), list(word)
    heap: list = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(word) and (s := p.score_of.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (-s, i, part[i], part[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if part[i] else len(word)
        if j >= len(word) or part[i] != a or part[j] != b:
            continue
        part[i], part[j] = a + b, ""
        nxt[i] = nxt[j]
        if nxt[i] < len(word):
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [x for x in part if x]


def encode_words(p: Pieces, words: list[str], method: str = "merges") -> list[bytes]:
    """Ids of each word as little-endian 32-bit numbers; the words of a length advance together."""
    out: list = [b""] * len(words)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    low = float(p.scores.min(initial=0)) - 10
    for size, group in by.items():
        if size > LONG and method == "merges":
            for i in group:
                out[i] = np.array([x for part in _merge_long(p, words[i]) for x in ([p.id[part]] if part in p.id else p.char_ids(part))], "<u4").tobytes()
            continue
        step = max(1, CELLS // max(1, size * min(size, p.longest)))
        for k in range(0, len(group) if size else 0, step):
            some = group[k : k + step]
            chars = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), size)
            score, ids = p.table(chars)
            marks = viterbi(score, low) if method == "viterbi" else merges(score)
            rows, at = np.nonzero(marks)
            last = np.concatenate((rows[1:] != rows[:-1], [True]))
            got = ids[rows, at, np.where(last, size, np.concatenate((at[1:], [size]))) - at - 1]
            raw = got.astype("<u4").tobytes()
            cut = (4 * np.searchsorted(rows, np.arange(len(some) + 1))).tolist()
            for r, i in enumerate(some):
                out[i] = raw[cut[r] : cut[r + 1]]
            for r in np.unique(rows[got < 0]).tolist():  # words with characters that no piece holds
                w, a, b = words[some[r]], cut[r] // 4, cut[r + 1] // 4
                out[some[r]] = np.array([y for x, c in zip(got[a:b].tolist(), at[a:b].tolist()) for y in ([x] if x >= 0 else p.char_ids(w[c]))], "<u4").tobytes()
    return out


class Codec:
    """Encodes and decodes whole texts; ids of known words come from a bounded cache."""

    def __init__(self, pieces: Pieces, method: str = "merges"):
        self.pieces, self.method, self.known = pieces, method, {}
        raw = {i: t.replace(SPACE, " ").encode() for i, t in pieces.text.items()} | {i: bytes([b]) for b, i in pieces.byte_ids.items()}
        self.raw = [raw.get(i, b"") for i in range(max(raw, default=0) + 1)]

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of UTF-8 ``text`` (little-endian 32-bit); a space stands before it, and no text has no ids."""
        if not text:
            return np.zeros(0, "<u4")
        words = _WORD.findall(b" " + text)
        self._learn(words)
        return np.frombuffer(b"".join([self.known[w] for w in words]), "<u4")

    def encode_all(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of many texts; their new words advance together, some megabytes at a time."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) < BLOCK_BYTES):
                size += len(texts[upto])
                upto += 1
            split = [_WORD.findall(b" " + t) if t else [] for t in texts[at:upto]]
            self._learn([w for words in split for w in words])
            for words in split:
                yield np.frombuffer(b"".join([self.known[w] for w in words]), "<u4")
            at = upto

    def _learn(self, words: list[bytes]) -> None:
        known = self.known
        new = list({w for w in words if w not in known})
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(set(words))
        if new:
            known.update(zip(new, encode_words(self.pieces, [w.decode("utf-8", "replace").replace(" ", SPACE) for w in new], self.method)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text, without the space that encoding put before it; broken bytes become U+FFFD."""
        whole = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace").encode()
        return whole[1:] if whole[:1] == b" " else whole


def encode(docs: DataFrame, model: str, method: str = "merges", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, ids array<int>, n_ids, ids_crc32, round_trip)`` of every row.

    ``ids`` is null unless ``with_ids``; ``round_trip`` says that the ids decode to the
    text (a text with U+2581 decodes to spaces).  Null texts count as empty: no ids.
    Null and repeated ids come back row by row; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces.load(model), method)
        for b in batches:
            ids, n, crc, back = [], [], [], []
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for t, got in zip(texts, codec.encode_all(texts)):
                ids.append(got.astype(np.int32) if with_ids else None)
                n.append(len(got))
                crc.append(zlib.crc32(got.tobytes()))
                back.append(codec.decode(got) == t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())], names=["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids bigint, ids_crc32 bigint, round_trip boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of every row; null ids give a null text, ids that the model lacks nothing."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces.load(model))
        most = len(codec.raw)
        for b in batches:
            texts = [None if x is None else codec.decode(np.array([i for i in x if i is not None and 0 <= i < most], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
