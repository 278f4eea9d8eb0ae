"""Token counts by section: whole documents are encoded once, and token spans joined to sections."""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

#: White space as the tokenizer's own split pattern sees it. A piece of text that ends before white space is encoded alike alone.
_WS = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
CACHE_CHUNKS = 500_000
_PLAIN = re.compile(f" ?[^{_WS}]+")
#: Fixed value: how a byte-level tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "most")


def lines(text: str) -> list[int]:
    """Where the lines of ``text`` start; a line break belongs to the line that it ends."""
    return [0, *[m.end() for m in re.finditer("\n", text) if m.end() < len(text)]]


class Spans(dict):
    """Character spans of the tokens of whole texts, from a bounded cache of chunks.

    Chunks of at most one space and then no white space go through the same vocabulary
    in a quicker library, if that gives the tokenizer's spans for every token of the
    vocabulary (see ``checked_bytes``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True  # such strings in a document are ordinary text
        self.quick = checked_bytes(path)

    def __missing__(self, chunk: str) -> bytes:
        if self.quick is not None and _PLAIN.fullmatch(chunk) is not None:
            got = self._quick(chunk)
        else:
            got = [x for span in self.encoder.encode(chunk, add_special_tokens=False).offsets for x in span]
        self[chunk] = got = struct.pack(f"<{len(got)}i", *got)
        return got

    def _quick(self, chunk: str) -> list[int]:
        """Starts and ends in turn."""
        encode, sizes = self.quick
        out, at = [], 0
        if chunk.isascii():
            for x in encode(chunk):
                out += (at, at + sizes[x])
                at += sizes[x]
        else:
            of = [i for i, c in enumerate(chunk) for _ in range(len(c.encode("utf-8", "replace")))]
            for x in encode(chunk):
                out += (of[at], of[at + sizes[x] - 1] + 1)
                at += sizes[x]
        return out

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(first character, one past the last) of each token; a space before a word is part of its token."""
        chunks = _CHUNK.findall(text)
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self) > CACHE_CHUNKS:
            self.clear()
        got = list(map(self.__getitem__, chunks))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        tokens = np.fromiter(map(len, got), np.int64, len(got)) >> 3
        spans = np.frombuffer(b"".join(got), "<i4").reshape(-1, 2) + np.repeat(np.cumsum(sizes) - sizes, tokens)[:, None]
        return spans[:, 0], spans[:, 1]


@functools.lru_cache(maxsize=4)
def checked_bytes(path: str):
    """``byte_level(path)`` if it agrees with the tokenizer on all tokens of the vocabulary, else None: once per process."""
    from tokenizers import Tokenizer

    quick, encoder = byte_level(path), Tokenizer.from_file(path)
    if quick is None:
        return None
    encoder.encode_special_tokens = True
    texts = sorted({t for i in encoder.get_vocab(with_added_tokens=False).values() if _PLAIN.fullmatch(t := encoder.decode([i]))})
    same = all(e.ids == quick[0](t) for t, e in zip(texts, encoder.encode_batch_fast(texts, add_special_tokens=False)))
    return quick if same else None


def byte_level(path: str):
    """Ids of a text by the vocabulary of a byte-level tokenizer file, and the bytes of each; None for another kind."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    if model.get("type") != "BPE" or (whole.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or whole.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in whole.get("added_tokens", [])}
    ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in special and all(c in letter for c in t)}
    sizes = {i: len(r) for r, i in ranks.items()}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary.

    ``start``: a token belongs to the section of its first character; ``end``: to that of
    its last; ``most``: to the section that holds most of its characters, the earlier of
    equals.
    """
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, np.maximum(end - 1, first), "right") - 1
    own = b if rule == "end" else a
    if rule == "most":
        own = a.copy()
        edge = np.append(starts, np.iinfo(np.int64).max)
        for i in np.flatnonzero(a != b):
            held = [min(end[i], edge[s + 1]) - max(first[i], edge[s]) for s in range(a[i], b[i] + 1)]
            own[i] = a[i] + int(np.argmax(held))
    n = len(starts)
    return np.bincount(own, minlength=n), np.bincount(own[a != b], minlength=n)


def count_by_section(docs: DataFrame, tokenizer: str, rule: str = "start", sections: Callable[[str], list[int]] = lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, section, start, end, tokens, crossing)``: one row per section of every row.

    Sections are given by where they start (from 0, in order) and cover the text.  The
    tokens of a document's sections add up to those of the whole document.  Null and
    empty texts have one empty section; null and repeated ids have rows for each of their
    rows; an empty table gives none; other columns, whatever their names, are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(tokenizer)
        for b in batches:
            rows, parts, n = [], [], 0
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                starts = np.array(sections(t), np.int64)
                tokens, crossing = allocate(*spans(t), starts, rule)
                parts.append(np.stack([np.arange(len(starts)), starts, np.append(starts[1:], len(t)), tokens, crossing]))
                rows.append(np.full(len(starts), i))
                n += len(starts)
                if n >= 50_000:
                    yield batch(b, rows, parts)
                    rows, parts, n = [], [], 0
            if rows:
                yield batch(b, rows, parts)

    def batch(b: pa.RecordBatch, rows: list, parts: list) -> pa.RecordBatch:
        cols = np.hstack(parts)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(cols[0].astype(np.int32)), *[pa.array(c) for c in cols[1:].astype(np.int64)]], names=["doc_id", "section", "start", "end", "tokens", "crossing"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, section int, start bigint, end bigint, tokens bigint, crossing bigint")
