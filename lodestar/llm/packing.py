"""Bounded-space online packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

LENGTH = 4096
OPEN_WINDOWS = 32
MERGE_PARTITIONS = 64  # leftovers of so many partitions meet in one task
TOP_UP = 16  # a gap of at least this is filled with the head of the next piece
CACHE_WORDS = 500_000


class WordIds(dict):
    """Ids of whole texts, a white-space separated word at a time, known words from a bounded cache.

    Exact for tokenizers that drop white space, never join over it, ignore case, and
    take a full stop or comma after a letter as a token of its own.  Special strings are
    found in the raw text, so a word that may hold one keeps its case.  Words of letters
    alone go through the same merges in a quicker library, if that gives the tokenizer's
    ids for every word of letters in the vocabulary (see ``checked_merger``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder, self.merge = Tokenizer.from_file(path), checked_merger(path)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if word[-1] in b".," and b"a" <= word[-2:-1] <= b"z":
            got = self[word[:-1]] + self[word[-1:]]
        else:
            got = self._encode(word.decode("utf-8", "replace"))
        self[word] = got
        return got

    def _encode(self, word: str) -> bytes:
        if self.merge is not None and is_plain(word):
            return self._pack(self.merge(word))
        return self._pack(self.encoder.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: bytes, end_id: int) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        if b"<|" in text:
            words = [w if b"<|" in w else w.lower() for w in text.split()]
        else:
            words = text.lower().split()  # ASCII letters and white space; the tokenizer itself deals with any other
        return np.frombuffer(b"".join(map(self.__getitem__, words)) + self._pack([end_id]), "<u4")


def is_plain(word: str) -> bool:
    """Letters alone, as the tokenizer's normaliser leaves them."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


@functools.lru_cache(maxsize=4)
def checked_merger(path: str):
    """``merger(path)`` if it agrees with the tokenizer on all words of the vocabulary, else None: once per process."""
    from tokenizers import Tokenizer

    merge, encoder = merger(path), Tokenizer.from_file(path)
    if merge is None:
        return None
    words = sorted({w for t in encoder.get_vocab(with_added_tokens=False) if is_plain(w := t.removesuffix("</w>"))})
    same = all(e.ids == merge(w) for w, e in zip(words, encoder.encode_batch_fast(words, add_special_tokens=False)))
    return merge if same else None


def merger(path: str):
    """Ids of one lower-case word by the merges of a tokenizer file with word ends; None for another kind of file.

    The end of a word is the byte 255, which no text holds: a last byte takes it first,
    then merges go by their rank in the file.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}

    def raw(token: str) -> bytes:
        body, end = (token[:-4], b"\xff") if token.endswith("</w>") and len(token) > 4 else (token, b"")
        return bytes(letter[c] for c in body) + end

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
    for i, pair in enumerate(model["merges"]):
        ranks.setdefault(raw("".join(pair if isinstance(pair, list) else pair.split(" "))), 1000 + i)
    ids = {ranks[r]: i for t, i in model["vocab"].items() if all(c in letter for c in t.removesuffix("</w>")) and (r := raw(t)) in ranks and (b"\xff" in r) == (t.endswith("</w>") and len(t) > 4)}
    piece = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda word: [ids[r] for r in piece(word.encode() + b"\xff")]


class Windows:
    """A fixed number of open windows: best fit, and the fullest goes when none fits."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.made = length, most, [], 0

    def place(self, size: int) -> tuple[list, list | None]:
        """The window that takes a piece of ``size``, and the window emitted for it, if any."""
        fits = [w for w in self.open if self.length - w[0] >= size]
        gone = None
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            if len(self.open) >= self.most:
                gone = max(self.open, key=lambda w: w[0])
                self.open.remove(gone)
            best = self.start()
        return best, gone

    def start(self) -> list:
        self.open.append(w := [0, self.made, []])  # used, number, pieces
        self.made += 1
        return w

    def put(self, w: list, size: int, piece: tuple) -> list | None:
        """Append; the window itself if it is now full, and so leaves."""
        w[2].append((*piece, w[0]))
        w[0] += size
        if w[0] == self.length:
            self.open.remove(w)
            return w
        return None


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset", "part", "leftover")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: where its ids stand in the document and in the sequence.

    ``(doc_id, start, length, ids_crc32, doc_tokens, ids binary, sequence_id, offset)``;
    ``ids`` are little-endian unsigned 32-bit, null unless ``with_ids``.  A document is
    its ids and ``end_id``; null and empty texts are ``end_id`` alone.  Pieces of
    ``length`` fill a sequence, the rest is placed best-fit among ``windows`` open ones.
    When none fits, the fullest is topped up with the head of the piece (if its gap is
    worth a cut) and emitted.  What is open at a partition's end is merged with that of
    other partitions, a bounded number at a time; no ids are lost, added or reordered.
    Rows without an id and rows that repeat one are documents of their own; an empty table
    gives no pieces; other columns, whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = WordIds(tokenizer), TaskContext.get().partitionId()
        space, out = Windows(length, windows), {c: [] for c in COLUMNS}

        def emit(w: list, leftover: bool) -> None:
            for *piece, offset in w[2]:
                for c, v in zip(COLUMNS, (*piece, (part << 32) | w[1], offset, part, leftover)):
                    out[c].append(v)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(out[c], t) for c, t in zip(COLUMNS, (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            for c in COLUMNS:
                out[c].clear()
            return pa.RecordBatch.from_arrays(arrays, names=list(COLUMNS))

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids = encode(text or b"", end_id)
                n, at = len(ids), 0
                while at < n:
                    size = min(length, n - at)
                    w = None
                    if size < length and len(space.open) >= space.most and not any(length - x[0] >= size for x in space.open):
                        fullest = max(space.open, key=lambda x: x[0])
                        if length - fullest[0] >= TOP_UP:
                            w, size = fullest, length - fullest[0]
                    gone = None
                    if w is None:
                        w, gone = (space.start(), None) if size == length else space.place(size)
                    if gone is not None:
                        emit(gone, False)
                    raw = ids[at : at + size].tobytes()
                    if (full := space.put(w, size, (doc, at, size, zlib.crc32(raw), n, raw if with_ids else None))) is not None:
                        emit(full, False)
                    at += size
                if len(out["doc_id"]) >= 2000:
                    yield flush()
        for w in space.open:
            emit(w, True)
        if out["doc_id"]:
            yield flush()

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint, part bigint, leftover boolean"
    placed = materialize(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema))
    rest = placed.where("leftover").withColumn("bucket", F.expr(f"cast(part div {MERGE_PARTITIONS} as bigint)"))
    merged = rest.groupBy("bucket").applyInPandas(lambda pdf: _merge(pdf, length), placed.select(*COLUMNS).schema)
    return placed.where("not leftover").unionByName(merged).drop("part", "leftover")


def _merge(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Best-fit decreasing over the leftover pieces of a bounded number of partitions."""
    pdf = pdf.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    seq, off = [], []
    made, gaps = 0, []  # (gap, window), sorted
    for size in pdf["length"].tolist():
        k = bisect_left(gaps, (size, -1))
        if k == len(gaps):
            gap, w, made = length, made, made + 1
        else:
            gap, w = gaps.pop(k)
        seq.append(w)
        off.append(length - gap)
        if gap > size:
            insort(gaps, (gap - size, w))
    base = (1 << 62) | (int(pdf["bucket"].iloc[0]) << 32)
    return pdf.assign(sequence_id=[base | w for w in seq], offset=off, leftover=False).drop(columns="bucket")[list(COLUMNS)]
