"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations learned from a bounded sample give balanced binary codes.  A code is cut into
16-bit substrings, a table each for as many as are needed: a vector looks up its own
substring and those a few bits away, whole codes tell which of the finds may be near, and
vectors in a byte a component which of these are.  How many tables, bits away and bits in
all are measured on pairs at the threshold made from the sample, as it lies: where all
vectors share a direction, such pairs differ in far more bits than their angle tells.
What is left makes groups, and within a group the original vectors are compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, connected_components, materialize
from .simhash import _roots
from .vectors import lengths, sample, stacked, usable

BITS = 256
TABLE_BITS = 16
FOUND = 0.985  # of the pairs at the threshold that are made for it, the share that tables must find
MADE = 4096  # such pairs
MAX_FLIPS = 2
TIGHT = 12  # bits: codes so near to a leader stand behind it while candidates are sought
SLACK = 0.02  # of a cosine, for vectors in a byte a component
LEADERS = 4  # rounds of choosing leaders; what is left leads itself
SAMPLE = 4096
ROUNDS = 30
SHARD_ROWS = 262_144  # codes that one part of a table holds, about
GROUP_ROWS = 4096  # vectors that one task compares all with all; larger groups meet in chunks


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 1, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean (or zero), and a projection (dim x bits) of unit vectors: principal axes, each set turned by ITQ."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = u.mean(0) * centred
    c = u - mean
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    z, d, rnd, parts = c @ axes, x.shape[1], np.random.default_rng(seed), []
    for _ in range(math.ceil(bits / d)):
        r = np.linalg.qr(rnd.normal(size=(d, d)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
            r = (left @ right).T
        parts.append(axes @ r)
    return mean, np.hstack(parts)[:, :bits]


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.packbits((u - mean) @ turn >= 0, axis=1, bitorder="little").view("<u2")


def reduced(x: np.ndarray) -> np.ndarray:
    """Vectors in a byte a component, each as long as a byte allows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x / top * 127).astype(np.int8)


def made_pairs(x: np.ndarray, threshold: float, n: int = MADE, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a sample, and for each one at exactly the threshold: half away in any direction, half towards other vectors."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rnd = np.random.default_rng(seed)
    a = u[rnd.integers(0, len(u), n)]
    to = np.where((np.arange(n) % 2 == 0)[:, None], rnd.normal(size=a.shape), u[rnd.integers(0, len(u), n)] - u[rnd.integers(0, len(u), n)])
    w = to - (to * a).sum(1, keepdims=True) * a
    size = np.linalg.norm(w, axis=1, keepdims=True)
    ok = size[:, 0] > 1e-9
    a, w = a[ok], w[ok] / size[ok]
    return a, threshold * a + np.sqrt(max(0.0, 1 - threshold * threshold)) * w


def real_pairs(x: np.ndarray, threshold: float, n: int = MADE, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different vectors of a sample that reach the threshold, as far as there are so many."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(u), block):
        s = u[i : i + block] @ u.T
        q, h = np.nonzero((s >= threshold) & (s < 1 - 1e-9) & (np.arange(len(u)) > np.arange(i, min(i + block, len(u)))[:, None]))
        a.append(q[: n // 4] + i)
        b.append(h[: n // 4])
        if sum(map(len, a)) >= n:
            break
    return u[np.concatenate(a)[:n]], u[np.concatenate(b)[:n]]


def plan(x: np.ndarray, mean: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[bool, float, int, int, int]:
    """``(short, cost, tables, flips, within)``: the cheapest that finds FOUND of the made pairs of either kind and of real ones.

    ``within`` bits hold all but a few of them; ``short`` tells that none finds so many.
    Cost is rows read: tables by the share of unrelated rows that stand within so many
    flips.
    """
    a, b = made_pairs(x, threshold)
    far = lambda p, q: np.bitwise_count(encode(p, mean, turn) ^ encode(q, mean, turn)).astype(np.int64)
    made, real, rnd = far(a, b), far(*real_pairs(x, threshold)), np.random.default_rng(3)
    other = far(x[rnd.integers(0, len(x), MADE)], x[rnd.integers(0, len(x), MADE)])
    kinds = [k for k in (made[0::2], made[1::2], real) if len(k)]
    tables = other.shape[1]
    within = int(max((np.quantile(k.sum(1), 0.998) for k in kinds), default=tables * TABLE_BITS))
    best = (True, math.inf, tables, MAX_FLIPS)
    for flips in range(MAX_FLIPS + 1):
        shares = [(np.cumsum(k <= flips, axis=1) > 0).mean(0) for k in kinds]
        ok = np.flatnonzero(np.min(shares, axis=0) >= FOUND) if shares else np.zeros(0, int)
        if len(ok):
            t = int(ok[0]) + 1
            probes = sum(math.comb(TABLE_BITS, k) for k in range(flips + 1))
            cost = t * (60 + probes / 8) / 1e5 + (other[:, :t] <= flips).mean() * t  # a table's rows are sent and sorted; then what it finds
            best = min(best, (False, cost, t, flips))
    return (*best, within)


def flip_masks(flips: int) -> list[int]:
    """Every change of a substring in at most so many bits, none first."""
    return [sum(1 << i for i in which) for k in range(flips + 1) for which in itertools.combinations(range(TABLE_BITS), k)]


def _angles(small: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of pairs, about, from vectors in a byte a component."""
    dot = np.einsum("ij,ij->i", small[a], small[b], dtype=np.float32)
    return np.arccos(np.clip(dot / (size[a] * size[b]), -1, 1))


def candidates(ids: np.ndarray, codes: np.ndarray, small: np.ndarray, t: int, flips: int, within: int, threshold: float, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """A forest ``(id, root)`` of rows of which table ``t`` finds codes ``within`` so many bits and vectors about as near as the threshold.

    Rows of one substring gather behind a few leaders first, so that a large group of
    near copies is not met pair by pair; leaders then meet, with the distance of their
    farthest row added on either side.
    """
    n, words = len(ids), codes.view(np.uint64)
    small = small.astype(np.float32)
    size = np.sqrt(np.einsum("ij,ij->i", small, small))
    far = lambda a, b: np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64)
    order = np.argsort(codes[:, t], kind="stable")
    leader, spread, wide, loose, pairs = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.float32), order, []
    for _ in range(LEADERS):
        _, first, which = np.unique(codes[loose, t], return_index=True, return_inverse=True)
        head = loose[first][which]
        off = far(loose, head)
        near = off <= TIGHT
        leader[loose[near]] = head[near]
        np.maximum.at(spread, head[near], off[near])
        for i in range(0, int(near.sum()), block):
            a, b = loose[near][i : i + block], head[near][i : i + block]
            np.maximum.at(wide, b, _angles(small, size, a, b))
        loose = loose[~near]
        if not len(loose):
            break
    behind = np.flatnonzero(leader != np.arange(n))
    pairs.append((behind, leader[behind]))
    lead = order[leader[order] == order]
    sub = codes[lead, t]
    starts = np.searchsorted(sub, np.arange((1 << TABLE_BITS) + 1))
    theta = math.acos(max(-1.0, threshold - SLACK))
    for flip in flip_masks(flips):
        value = sub ^ np.uint16(flip)
        lo, many = starts[value], starts[value.astype(np.int64) + 1] - starts[value]
        asks = np.flatnonzero((many > 0) & (value >= sub))  # each pair of substrings once
        ends = np.cumsum(many[asks])
        at = 0
        while at < len(asks):  # so many pairs at a time
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            who, s = asks[at:upto], many[asks[at:upto]]
            q = np.repeat(who, s)
            h = np.repeat(lo[who], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            q, h = lead[q], lead[h]
            ok = np.flatnonzero((q != h) & (far(q, h) <= within + spread[q] + spread[h]))
            q, h = q[ok], h[ok]
            ok = _angles(small, size, q, h) <= theta + wide[q] + wide[h]
            if ok.any():
                pairs.append((q[ok], h[ok]))
            at = upto
            if len(pairs) > 64:  # only what connects is kept
                pairs[:] = [_forest(pairs, n)]
    a, b = (np.concatenate(p) for p in zip(*pairs))
    low = _roots(n, a, b, ids)
    used = np.unique(np.concatenate((a, b)))
    return ids[used], low[used]


def _forest(pairs: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(p) for p in zip(*pairs))
    low = _roots(n, a, b, np.arange(n))
    used = np.unique(np.concatenate((a, b)))
    return used, low[used]


def _compare(rows: pd.DataFrame, threshold: float, block: int = 512) -> pd.DataFrame:
    """Links of one cell: all of its groups, or two chunks ``side`` 0 and 1 of one large group.

    ``(id, links, root, whole)``; ``whole`` says that no other cell has rows of the group.
    """
    rows = rows.sort_values(["group", "side", "id"], kind="stable")
    ids, n = rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    group, side, whole = (rows[c].to_numpy() for c in ("group", "side", "whole"))
    x = stacked(rows["vec"], 0)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for a, e in zip(edges.tolist(), np.append(edges[1:], len(ids)).tolist()):
        m = a + int(np.count_nonzero(side[a:e] == 0))
        other = (a, e) if m == e else (m, e)  # a group with itself, or one chunk with the other
        pairs = [(np.zeros(0, np.int64),) * 2]
        for i in range(a, m, block):
            upto = min(i + block, m)
            near = x[i:upto] @ x[other[0] : other[1]].T >= threshold
            if m == e:
                near[np.arange(upto - i), np.arange(i, upto) - a] = False
            links[i:upto] += near @ n[other[0] : other[1]]
            if m < e:
                links[m:e] += n[i:upto] @ near
            q, h = np.nonzero(near)
            pairs.append((q + i, h + other[0]))
            if sum(len(p[0]) for p in pairs) > 1 << 20:
                pairs = [tuple(p + a for p in _forest([(q - a, h - a) for q, h in pairs], e - a))]
        q, h = (np.concatenate(p) for p in zip(*pairs))
        if len(q):
            root[a:e] = _roots(e - a, q - a, h - a, ids[a:e])
    some = (links > 0) | (root != ids)
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": root[some], "whole": whole[some]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors that take no part (see ``usable``) link with nothing, and so does a null id,
    whose component is null; vectors of several lengths link among their own, each length
    by codes of its own.  Equal vectors collapse first, by a hash of 128 bits; repeated
    rows of an id count as vectors of their own in n_links and come back once each, with
    the most links and the least component of them.  Other columns, whatever their names,
    are not read; an empty table gives no rows.

    The tables hold ids, codes and vectors in a byte a component.  One that exceeds
    ``shard_rows`` is cut by leading bits of pieces of its substring (two that differ in
    fewer bits than there are pieces agree in one), and a part that still does into chunks
    that meet pairwise.  Vectors travel once to their group, and in a group of over
    ``group_rows`` to chunks that meet pairwise; each pair there is compared once, so
    nothing is emitted by pair.  Groups connect by what is near but for SLACK, so one is
    hardly larger than what truly links.
    """
    v = usable(vectors, id_col, vec_col)
    all_ids = vectors.select(col(id_col).cast("bigint").alias("vec_id"))
    of = None
    for dim in lengths(v):
        one = _linked(v.where(F.size("vec") == dim), dim, threshold, bits, shard_rows, group_rows)
        of = one if of is None else of.union(one)
    if of is None:
        return all_ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    of = of.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = all_ids.join(of, all_ids.vec_id == of.id, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(v: DataFrame, dim: int, threshold: float, bits: int, shard_rows: int, group_rows: int) -> DataFrame:
    """``(id, n_links, component_id)`` of vectors of one length."""
    few = sample(v, SAMPLE)
    # codes from the mean tell more apart; where all vectors are so near that they are noise, codes from the origin find what those lose
    ways = [learn(few, bits, centred=c) for c in (True, False)]
    plans = [plan(few, *way, threshold) for way in ways]
    best = min(range(len(plans)), key=lambda i: plans[i][:2])
    (mean, turn), (_, _, tables, flips, within) = ways[best], plans[best]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = stacked(b["vec"], dim)
            yield b[["id", "h1", "h2"]].assign(code=[c.tobytes() for c in encode(x, mean, turn)], small=[r.tobytes() for r in reduced(x)])

    v = v.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))  # 128 bits name a vector
    hashed = materialize(v.mapInPandas(coded, "id bigint, h1 bigint, h2 bigint, code binary, small binary"))
    once = hashed.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.min("code").alias("code"), F.min("small").alias("small"))
    # an id may have several vectors, so each gets a number, in order of its first id
    reps = materialize(once.orderBy("first_id", "h1", "h2").withColumn("id", F.monotonically_increasing_id()))
    total = reps.count()
    pieces = flips + 1
    width = TABLE_BITS // pieces
    cut = min(width, max(0, math.ceil(math.log2(max(1, total) / shard_rows))))
    byte = lambda k: f"cast(conv(hex(substring(code, {k + 1}, 1)), 16, 10) as int)"
    sub = lambda t: f"({byte(2 * t)} + 256 * {byte(2 * t + 1)})"
    if cut:
        keys = [F.expr(f"{(t * 4 + p) * 65536} + (shiftright({sub(t)}, {(p + 1) * width - cut}) & {(1 << cut) - 1})") for t in range(tables) for p in range(pieces)]
    else:
        keys = [F.lit(t * 4 * 65536) for t in range(tables)]
    spread = reps.select("id", "code", "small", F.explode(F.array(*[k.cast("int") for k in keys])).alias("part"))
    large = {r.part: r.c for r in spread.groupBy("part").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("c")).where("c > 1").collect()}  # a bounded number of parts
    row = ["id", "code", "small", "part"]
    if large:
        chunks = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(large.items()) for x in kv])[F.col("part")], F.lit(1))
        spread = spread.withColumn("c", chunks).withColumn("own", F.pmod(F.xxhash64("id", "part"), "c").cast("int"))
        spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(*row, F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"))
    else:
        spread = spread.select(*row, F.lit(0).alias("a"), F.lit(0).alias("b"))

    def seek(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy(np.int64)
        codes = np.frombuffer(b"".join(rows["code"]), "<u2").reshape(len(ids), -1)
        small = np.frombuffer(b"".join(rows["small"]), np.int8).reshape(len(ids), -1)
        u, v = candidates(ids, codes, small, int(key[0]) // (4 * 65536), flips, within, threshold)
        return pd.DataFrame({"u": u, "v": v})

    found = spread.groupBy("part", "a", "b").applyInPandas(seek, "u bigint, v bigint")
    group = materialize(connected_components(found).withColumnRenamed("node", "id").withColumnRenamed("component", "group"))
    hot = materialize(group.groupBy("group").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("c")).where("c > 1"))
    # rows of large groups meet in cells of two chunks; all groups of a cell are compared in one task
    rows = group.join(hot, "group", "left").withColumn("c", F.coalesce("c", F.lit(1))).join(reps.select("id", "n", "first_id", "h1", "h2"), "id")
    # of a vector's copies, the rows of the first id hold it
    found_any = v.join(rows, (v.h1 == rows.h1) & (v.h2 == rows.h2) & (v.id == rows.first_id))
    found_any = found_any.groupBy(rows.id, "n", "group", "c").agg(F.first("vec").alias("vec"))
    own = F.pmod(F.xxhash64("id"), "c").cast("int")
    met = found_any.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    spots = max(1, math.ceil(total / group_rows))
    lone = F.col("c") == 1
    cell = F.when(lone, F.pmod(F.xxhash64("group"), F.lit(spots))).otherwise(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))
    met = met.select("id", "n", "group", "vec", (F.col("own") > F.col("other")).cast("int").alias("side"), lone.alias("whole"), cell.alias("cell"))
    met = materialize(met.groupBy("whole", "cell").applyInPandas(lambda pdf: _compare(pdf, threshold), "id bigint, links bigint, root bigint, whole boolean"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    comp = met.where("whole").select("id", F.col("root").alias("component"))
    across = met.where("not whole").select(F.col("id").alias("u"), F.col("root").alias("v"))
    if not across.isEmpty():
        comp = comp.union(connected_components(across).select("node", "component"))
    facts = reps.select("id", "h1", "h2", "n").join(links, "id", "left").join(comp, "id", "left")
    facts = facts.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    facts = facts.join(reps.select(F.col("id").alias("component"), F.col("first_id").alias("component_id")), "component").drop("component")
    return hashed.select("id", "h1", "h2").join(materialize(facts), ["h1", "h2"]).select("id", "n_links", "component_id")
