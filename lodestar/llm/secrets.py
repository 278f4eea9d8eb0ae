"""Secret scans: fixed shapes, and random-looking strings told by two character Markov models."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name

# The shapes that are always reported. (?a) keeps case folding to ASCII.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same runs as [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio a character, in nats, that a candidate must exceed, and the ratio in all.
PER_CHAR, IN_ALL = 0.7, 20.0
#: Share of ordinary strings of a kind, under a model that knows half of them, that stay under what its candidates must exceed.
QUIET = 0.985
#: Bounds of what ordinary strings are learned from: documents, read whole, and words in all.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 200_000
#: A word of training is a whole run of so many letters: a longer one is no ordinary word.
TRAINING_WORD = r"(?<![A-Za-z])[A-Za-z]{2,40}(?![A-Za-z])"

_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed shapes, by start, then in the order of KINDS."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]


def _bigrams(samples: list[str], smooth: float = 0.5) -> np.ndarray:
    """Log transition probabilities, the first character from a start state."""
    n = len(ALPHABET)
    counts = np.full((n + 1, n), smooth)
    for s in samples:
        c = _codes(s)
        if len(c):
            np.add.at(counts, (np.concatenate(([n], c[:-1])), c), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


#: Alphabets of key generators; each has a model of its own, so that a string of one case is held against such strings.
GENERATORS = {
    "hex": "0123456789abcdef", "lower": ALPHABET[26:52], "upper": ALPHABET[:26], "letters": ALPHABET[:52], "lower36": ALPHABET[26:62],
    "upper36": ALPHABET[:26] + ALPHABET[52:62], "base62": ALPHABET[:62], "base64": ALPHABET[:64], "url64": ALPHABET[:62] + "_-",
}


def random_samples(n: int = 9000, seed: int = 7) -> list[str]:
    """Labelled positives: strings as key generators make them, each generator in turn."""
    rnd = random.Random(seed)
    kinds = list(GENERATORS.values())
    return ["".join(rnd.choices(kinds[i % len(kinds)], k=rnd.randint(LEAST, 64))) for i in range(n)]


def ordinary_samples(texts: list[str], seed: int = 7) -> list[str]:
    """Labelled negatives: words of ordinary text, and identifiers, paths and numbers made of them."""
    rnd = random.Random(seed)
    words = [w for t in texts for w in re.findall(TRAINING_WORD, "".join(c if ord(c) < 128 else " " for c in t))][:SAMPLE_WORDS]
    words = words or ["the", "name", "value", "index"]
    out = list(words)
    for _ in range(6000):
        some = [rnd.choice(words) for _ in range(rnd.randint(2, 5))]
        out.append(rnd.choice(("_", "-", "/", "")).join(some))
        out.append(some[0].lower() + "".join(w.title() for w in some[1:]))
        out.append("_".join(some).upper())
        out.append("/".join(some) + str(rnd.randint(0, 99)))
    for _ in range(2000):  # names of versions, builds and times
        some, number = [rnd.choice(words) for _ in range(rnd.randint(1, 3))], lambda: str(rnd.randint(0, rnd.choice((9, 99, 2100))))
        out.append(rnd.choice("-_").join([*some, *(number() for _ in range(rnd.randint(1, 4))), rnd.choice(words)]))
        out.append("-".join([f"{rnd.randint(1990, 2030)}", *(f"{rnd.randint(0, 59):02d}" for _ in range(rnd.randint(1, 2)))]) + rnd.choice((f"T{rnd.randint(0, 23):02d}-{rnd.randint(0, 59):02d}-{rnd.randint(0, 59):02d}Z", "")) + "-" + "-".join(some))
    out += [rnd.choice("-_=+/") * rnd.randint(2, 80) for _ in range(300)] + [str(rnd.randint(0, 10**rnd.randint(1, 30))) for _ in range(1500)]
    return out


def _kind(s: str) -> tuple[bool, bool, int]:
    """Whether it has a digit and both cases, and its length in steps of eight up to 32: strings whose ratios are alike."""
    return any(c.isdigit() for c in s), any(c.isupper() for c in s) and any(c.islower() for c in s), min(len(s) // 8, 4)


class MarkovSecrets:
    """First-order models over characters: one of each generator of random strings, and one of ordinary strings.

    A candidate's ratio is that of the likeliest generator.  It must exceed PER_CHAR a
    character, IN_ALL in all, and what QUIET of the ordinary strings of its kind reach at
    most under a model that had not learned them.  Strings among the ordinary ones that
    the first fit calls random are left out of the second, so that secrets in the texts
    that words are taken from raise nothing.
    """

    def __init__(self, randoms: list[str], ordinary: list[str]):
        n = len(GENERATORS)
        self.random = np.stack([_bigrams(randoms[i::n]) for i in range(n)])
        self._fit(ordinary)
        left = [s for s in ordinary if not self.is_secret(s)]
        if len(left) < len(ordinary):
            self._fit(left)

    def _fit(self, ordinary: list[str]) -> None:
        self.ordinary, seen = _bigrams(ordinary), {}
        for k in (0, 1):
            half = _bigrams(ordinary[k::2])
            for s in ordinary[1 - k :: 2]:
                if len(s) >= LEAST and any(c.isalpha() for c in s):
                    seen.setdefault(_kind(s), []).append(self._ratio(s, half) / len(s))
        self.least = {kind: max(PER_CHAR, float(np.quantile(v, QUIET))) for kind, v in seen.items()}

    def _ratio(self, s: str, ordinary: np.ndarray) -> float:
        c = _codes(s)
        before = np.concatenate(([len(ALPHABET)], c[:-1]))
        return float(self.random[:, before, c].sum(1).max() - ordinary[before, c].sum())

    def score(self, s: str) -> float:
        return self._ratio(s, self.ordinary)

    def is_secret(self, s: str) -> bool:
        if len(s) < LEAST or not any(c.isalpha() for c in s):
            return False
        r = self.score(s)
        return r > IN_ALL and r > self.least.get(_kind(s), PER_CHAR) * len(s)

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """All spans: the base ones, and random strings in what lies outside of them.

        Candidates and base spans are walked together, both in order, so the work is in
        proportion to the text.
        """
        taken: list[list[int]] = []
        for x, y, _ in base:  # stretches that base spans cover, overlapping ones as one
            if taken and x <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], y)
            else:
                taken.append([x, y])
        more, k = [], 0
        for m in CANDIDATE.finditer(text):
            a, end = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            j = k
            while a < end:
                x, y = taken[j] if j < len(taken) and taken[j][0] < end else (end, end)
                part = text[a : max(a, x)]
                if a > m.start():
                    part = part.lstrip("+/_=-")
                    a = max(a, x) - len(part)
                if x < end:
                    part = part.rstrip("+/_=-")
                if len(part) >= LEAST and self.is_secret(part):
                    more.append((a, a + len(part), "markov"))
                a, j = max(a, y), j + 1
        return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> MarkovSecrets:
    """Fit on ``random_samples`` and on words of at most ``sample_docs`` documents, by hash of the id.

    Of all words of these documents SAMPLE_WORDS come to the driver, by hash of document,
    place and word; what is scanned is always the whole text.  Rows without an id are not
    learned from, repeated ids count once, and without any text a few fixed words stand in.
    """
    d = docs.select(col(id_col).alias("i"), col(text_col).alias("t"))
    ids = d.where("i is not null").select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(sample_docs)
    some = d.join(F.broadcast(ids), "i", "left_semi").groupBy("i").agg(F.max("t").alias("t"))
    words = some.select("i", F.posexplode(F.regexp_extract_all("t", F.lit(TRAINING_WORD), F.lit(0))).alias("at", "w"))
    rows = words.orderBy(F.xxhash64("i", "at", "w"), "i", "at").limit(SAMPLE_WORDS).select("w").collect()
    return MarkovSecrets(random_samples(), ordinary_samples([" ".join(r.w for r in rows)]))


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, model: MarkovSecrets, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (arrays of kind, start, end; code points, end exclusive).

    Null and empty texts have no spans, an empty table gives no rows.  The whole text is
    scanned, however long.  Columns of ``docs`` with these two names are replaced; all
    others stay.  Strings of digits alone are never random: nothing tells them from numbers.
    """
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    @F.pandas_udf(f"base {span}, spans {span}")
    def find(texts: pd.Series) -> pd.DataFrame:
        pack = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        rows = []
        for t in texts:
            base = base_spans(t or "")
            rows.append((pack(base), pack(model.spans(t or "", base))))
        return pd.DataFrame(rows, columns=["base", "spans"])

    found = free_name(docs, "_found")
    got = docs.withColumn(found, find(col(text_col)))
    kept = [col(c) for c in docs.columns if c.lower() not in ("base", "spans")]
    return got.select(*kept, F.col(f"{found}.base").alias("base"), F.col(f"{found}.spans").alias("spans"))


def redact(docs: DataFrame, model: MarkovSecrets, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mask`` (overlapping spans by one); null stays null."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for a, b, _ in model.spans(t, base_spans(t)):
                if b <= at:
                    continue
                if a >= at:
                    out += [t[at:a], mask]
                at = b
            return "".join([*out, t[at:]])

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, hide(col(text_col)))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("bigint").alias(f"n_{k}")
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
