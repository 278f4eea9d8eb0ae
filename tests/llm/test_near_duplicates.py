"""SimHash and ITQ against brute force, and what they do with odd rows."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from lodestar.llm import itq, simhash


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    bits = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(parts))


def groups(n, linked):
    low = list(range(n))
    while True:
        new = [min([low[j] for j in range(n) if j == i or linked(i, j)]) for i in range(n)]
        if new == low:
            return low
        low = new


def texts():
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "É", "eps", "zeta\x0b", "eta", "x1"]
    out = [" ".join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(60)]
    out += [out[0], out[1] + " more", out[1] + " mores", out[2].upper(), "", " \t\n", "one", "one two", "\x1cnot white", "a b"]
    base = rnd.choices(words, k=900)
    for i in range(40):
        b = list(base)
        b[i * 20] = f"w{i}"
        out.append(" ".join(b))
    return out


def test_fingerprints():
    for t in texts():
        assert simhash.simhash(t.encode()) == plain_fingerprint(t)


def test_bk_forest_finds_all():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 200).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(5), base ^ np.uint64(7)]))
    bucket = (fps % np.uint64(3)).astype(np.int64)
    got = {(int(q), int(t)) for a, b in simhash.BKForest(fps, bucket).within(fps, bucket, 2, block=50) for q, t in zip(a, b)}
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero((far <= 2) & (bucket[:, None] == bucket[None, :])))))


@pytest.mark.parametrize("hot", [2048, 4])
def test_near_duplicates(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.link, "__defaults__", (2, 64, hot))
    every = texts()
    fps = [plain_fingerprint(t) for t in every]
    want = groups(len(every), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)], "doc_id bigint, text string, fp string")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [rows[i].component_id for i in range(len(every))] == want
    assert [rows[i].fp & (2**64 - 1) for i in range(len(every))] == fps
    assert len(set(want)) < len(every)


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "same words here"), (5, "same words here"), (5, "same words here"), (9, None), (2, ""), (None, "only nulls know this text")], "doc_id bigint, text string")
    rows = sorted((repr(r.doc_id), repr(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert rows == sorted([("None", "5"), ("5", "5"), ("5", "5"), ("9", "2"), ("2", "2"), ("None", "None")])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def vectors(n=300, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    x[50:60] = x[40:50] + r.normal(size=(10, 64)) * 0.1
    x[60:100] = x[60] + r.normal(size=(40, 64)) * 0.15
    x[100:105] = x[100]
    x[110] = x[111] * 3
    return x


@pytest.mark.parametrize("rows,group", [(262_144, 4096), (64, 16)])
def test_itq_equals_brute_force(spark, rows, group):
    x = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    link = (s >= 0.9) & ~np.eye(len(x), dtype=bool)
    want = groups(len(x), lambda i, j: link[i, j])
    df = spark.createDataFrame([(i, [float(v) for v in a], 0) for i, a in enumerate(x)], "vec_id bigint, embedding array<double>, n int")
    got = {r.vec_id: r for r in itq.near_duplicates(df, shard_rows=rows, group_rows=group).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.9 * link.sum() and all(got[i].n_links <= link[i].sum() for i in got)
    assert np.mean([got[i].component_id == want[i] for i in got]) >= 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and len(got) == len(x)
    assert got[110].n_links == 1 and got[100].n_links == 4


def test_itq_recall_at_the_threshold(spark):
    """20,000 vectors with 2,000 pairs of cosine 0.90 to 0.93, one large group of near copies, and copies."""
    r = np.random.default_rng(7)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(2000):
        c, other = r.uniform(0.9, 0.93), r.normal(size=64)
        other -= other @ x[i] * x[i]
        x[2000 + i] = c * x[i] + (1 - c * c) ** 0.5 * other / np.linalg.norm(other)
    x[5000:7000] = x[5000] + r.normal(size=(2000, 64)) * 0.01
    x[8000:8100] = x[8000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in itq.near_duplicates(df, group_rows=512).collect()}
    found = sum(got[i].component_id == got[2000 + i].component_id == i and got[i].n_links == 1 for i in range(2000))
    assert len(got) == len(x) and found >= 0.95 * 2000
    assert all(got[i].component_id == 5000 and got[i].n_links == 1999 for i in range(5000, 7000))
    assert all(got[i].component_id == 8000 and got[i].n_links == 99 for i in range(8000, 8100))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(10_000, 20_000))


def shaped(kind, n=20_000, pairs=1500, d=64, seed=11):
    """Vectors, of which i and pairs + i have a cosine of 0.90 to 0.93; ``kind`` is a mean cosine, or "flat": 12 effective dimensions."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    spread = np.eye(d)
    if kind == "flat":
        spread = np.diag(np.r_[np.ones(12), np.full(d - 12, 0.03)])
        x = x @ spread
    elif kind:
        x += np.sqrt(d * kind / (1 - kind)) * np.eye(d)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        c, w = r.uniform(0.9, 0.93), r.normal(size=d) @ spread
        w -= w @ x[i] * x[i]
        x[pairs + i] = c * x[i] + (1 - c * c) ** 0.5 * w / np.linalg.norm(w)
    return x * r.lognormal(0, 0.5, size=(n, 1))


@pytest.mark.parametrize("kind", [0.46, 0.57, 0.67, "flat"])
def test_itq_recall_whatever_the_shape(spark, tmp_path, kind):
    x = shaped(kind)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))}), f"{tmp_path}/x.parquet")
    df = spark.read.parquet(f"{tmp_path}/x.parquet").repartition(4)
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.array([np.count_nonzero(u @ u[i] >= 0.9) - 1 for i in range(3000)])
    mine = np.array([got[i].n_links for i in range(3000)])
    assert (mine <= links).all() and mine.sum() >= 0.95 * links.sum()
    assert sum(got[i].component_id == got[1500 + i].component_id for i in range(1500)) >= 0.95 * 1500


@pytest.mark.parametrize("kind", [0, 0.67, "flat"])
def test_itq_groups_are_hardly_larger_than_what_links(kind):
    x = shaped(kind, n=12_000)
    mean, turn = itq.learn(x[:4096])
    short, _, tables, flips, within = itq.plan(x[:4096], mean, turn, 0.9)
    assert not short
    codes, small, ids = itq.encode(x, mean, turn), itq.reduced(x), np.arange(len(x))
    edges = [itq.candidates(ids, codes, small, t, flips, within, 0.9) for t in range(tables)]
    a, b = (np.concatenate(e) for e in zip(*edges))
    low = itq._roots(len(x), a, b, ids)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, h = np.nonzero(np.triu(u @ u.T >= 0.88 - itq.SLACK, 1))
    true = itq._roots(len(x), q, h, ids)
    assert np.bincount(low).max() <= max(2, np.bincount(true).max())


def test_itq_candidates_are_those_of_the_table():
    """What a table finds connects as brute force over its substrings does, with leaders or without."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 64))
    x[100:160] = x[100] + r.normal(size=(60, 64)) * 0.05
    x[200:300] = x[300:400] + r.normal(size=(100, 64)) * 0.3
    mean, turn = itq.learn(x)
    codes, small, ids = itq.encode(x, mean, turn), itq.reduced(x), np.arange(400) * 10
    codes = codes.copy()
    codes[:, 2] = (codes[:, 2] & 7) | (codes[:, 2] & 0x8000)  # crowded substrings
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for flips in (0, 1, 2):
        a, b = itq.candidates(ids, codes, small, 2, flips, 90, 0.9)
        near = lambda i, j: (codes[i, 2] ^ codes[j, 2]).item().bit_count() <= flips and int(np.bitwise_count(codes[i] ^ codes[j]).sum()) <= 90 and u[i] @ u[j] >= 0.9  # noqa: B023, E731
        low = groups(400, near)
        root = {i * 10: i * 10 for i in range(400)} | dict(zip(a.tolist(), b.tolist()))
        for i in range(400):  # all that brute force connects is connected
            assert root[i * 10] == root[low[i] * 10]


def test_itq_vectors_of_several_lengths(spark):
    r = np.random.default_rng(9)
    rows = []
    for d, n in ((64, 50), (32, 3), (8, 40), (5, 1)):
        base = r.normal(size=(n, d))
        if d == 32:
            base = base[:1] + r.normal(size=(n, d)) * 0.01
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(base)]
    got = {x.vec_id: x for x in itq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i].n_links for i in (50, 51, 52)] == [2, 2, 2] and got[52].component_id == 50 and got[93].n_links == 0 and len(got) == 94


def test_itq_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] + [0.0] * 3
    rows = [(1, one), (2, one), (3, None), (4, [0.0] * 4), (5, [nan, 1.0, 0.0, 0.0]), (6, [inf, 1.0, 0.0, 0.0]), (7, [1.0, None, 0.0, 0.0]), (8, []), (9, [1.0, 0.0]), (10, [0.0, 1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0, 0.0]), (None, one)]
    df = spark.createDataFrame([(*r, "x", 0.5, 3) for r in rows], "vec_id bigint, embedding array<double>, id string, h1 double, n int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in itq.near_duplicates(df).collect())
    assert got == sorted([("1", 1, "1", True), ("2", 1, "1", False), ("None", 0, "None", True), *[(str(i), 1 if i == 10 else 0, str(i), True) for i in (*range(3, 11), 10)]])
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each(spark):
    """Null and repeated ids: a group keeps one row, of the smallest id, and all columns."""
    same_, other, nulls = "same words here and more", "quite another text of words", "only nulls know this text"
    rows = [(None, same_, 1), (5, same_, 2), (5, same_, 3), (None, nulls, 4), (None, nulls, 5), (9, None, 6), (2, "", 7), (7, other, 8), (7, "again another thing is said", 9)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id bigint, text string, _row int, _fp string, component_id int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(5, same_), (None, nulls), (2, ""), (7, other), (7, "again another thing is said")]))
    assert simhash.one_of_each(docs.limit(0)).count() == 0
