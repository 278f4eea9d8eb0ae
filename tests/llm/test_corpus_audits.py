"""Decontamination, divergence of sources and hard negatives against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, divergence, negatives, queries

SF = "/root/testdata/sf0.001"
NEW = ("op11_winnowed_contamination", "op12_source_divergence", "op13_hard_negatives")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.oracles()[name])


# ---------------------------------------------------------------- decontamination

def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(docs, bench):
    spans = collections.defaultdict(set)
    for item, text in bench:
        ws = words(text)
        for i in range(max(1, len(ws) - 9)) if ws else []:
            spans[tuple(ws[i : i + 10])].add(item)
    out = []
    for doc, text in docs:
        ws, hit, items = words(text), set(), set()
        for k in {len(s) for s in spans}:
            for i in range(len(ws) - k + 1):
                if tuple(ws[i : i + k]) in spans:
                    hit |= set(range(i, i + k))
                    items |= spans[tuple(ws[i : i + k])]
        named = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(ws), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_of_odd_rows(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "ZWÖLF", "x1y"]
    passage = rnd.choices(vocabulary, k=40)
    run = lambda a, b: " ".join(passage[a:b])
    bench = [(1, run(0, 25)), (2, run(20, 40)), (2, "repeat of an id " + run(0, 12)), (3, run(3, 12)), (4, "Only three words"), (5, ""), (6, None), (None, run(25, 36)), (7, "a a a a a a a a a a a a"), (11, "one")]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for i in range(40)]
    docs += [(100, run(0, 10)), (101, run(1, 10)), (102, "x " + run(2, 13) + ", " + run(2, 13)), (102, run(2, 13).upper()), (103, run(25, 35)), (104, None), (105, ""), (106, " -- "), (None, run(0, 40)), (107, "a " * 500), (108, "only... THREE -- words ONE"), (109, run(3, 12)), (110, run(0, 40) * 200)]
    kinds = "doc_id bigint, text string", "item_id bigint, text string"
    d = spark.createDataFrame(docs, kinds[0]).withColumns({"words": F.lit(1), "key": F.lit("k"), "print": F.lit(0)})
    b = spark.createDataFrame(bench, kinds[1]).withColumns({"span": F.lit(""), "doc_id": F.lit(0)})
    got = sorted((tuple(r) for r in decontaminate.digest(decontaminate.contamination(d, b)).collect()), key=repr)
    assert got == plain_contamination(docs, bench)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    clean = decontaminate.contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.items for r in clean)


def test_every_shared_span_is_found(spark):
    """Texts of few distinct words have equal hashes all over; planted spans of ten words are found in all places."""
    rnd = random.Random(4)
    item = [rnd.choice("ab") for _ in range(60)]
    docs = []
    for i in range(0, 51):
        docs.append((i, " ".join([*rnd.choices("cd", k=rnd.randrange(20)), *item[i : i + 10], *rnd.choices("cd", k=rnd.randrange(20))])))
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string"))
    assert all(r.contaminated and r.n_hit >= 10 for r in out.collect())


def test_winnowing_stays_native(spark):
    found = queries.op11_winnowed_contamination(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- divergence

def test_divergence_of_odd_rows(spark, same):
    import duckdb

    rnd = random.Random(6)
    rows = []
    for i in range(400):
        lang, source = rnd.choice([None, "", "x", "y"]), rnd.choice([None, "s1", "s2", "é"])
        rows.append((i, rnd.choice([None, ""]) if rnd.random() < 0.05 else " ".join(rnd.choices(["Alpha", "alpha", "beta", "Été", "ÉTÉ", "gamma9delta", "z" * 300, f"rare{i}"], k=rnd.randint(1, 12))), lang, source))
    rows += [(1000, None, "lonely", "only"), (1001, "few words here", "thin", "a"), (1002, "few words here", "thin", "b"), (1003, "-- 1 2", "x", "bare"), (3, "repeated row", "x", "s1"), (3, "repeated row", "x", "s1")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").withColumns({"term": F.lit("t"), "n": F.lit(1), "p": F.lit(2)})
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    got = sorted(map(repr, (tuple(r) for r in divergence.audit(docs, rows=2, width_bits=6).select("lang", "source", "part", "item", "value", "rank").collect())))  # a sketch too small to drop much
    want = sorted(map(repr, con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.oracle_sql()})").fetchall()))
    assert got == want and any("'lonely'" in w for w in want) is False and any("'thin'" in w for w in want)
    again = sorted(map(repr, (tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())))
    assert again == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    rnd = random.Random(8)
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    rows = [(rnd.choice(["a", "b"]), "s", " ".join(letters(int(rnd.paretovariate(0.6))) for _ in range(50))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(70)  # over two rounds of merging
    true = collections.Counter((lang, t) for lang, _, text in rows for t in set(divergence.terms(text)))
    raw = spark.createDataFrame(divergence.counted(docs).collect()).repartition(70)
    for rows_, width in ((2, 5), (4, 12)):
        counts = divergence.sketch(raw, 30, rows_, width)
        named = {(r.lang, r.term): r.h for r in raw.collect()}
        assert set(named) == set(true)
        for k, h in named.items():
            assert counts[divergence.cells(np.array([h]), rows_, width)].min() >= min(true[k], 30)
        left = {(r.lang, r.term) for r in divergence.may_reach(raw, counts, 30, rows_, width).collect()}
        assert {k for k in true if true[k] >= 30} <= left
    rare = [k for k in true if true[k] < 30]
    assert len([k for k in rare if k not in left]) > 0.8 * len(rare) > 50  # and the wide one drops most of what is rare


# ---------------------------------------------------------------- hard negatives

def plain_negatives(rows, anchors, label=lambda i, lab: lab, positives=5, k=5, low=80):
    by = {}
    for i, vec, lab in rows:
        if i is None or lab is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        by.setdefault(i, []).append((lab, [float(x) for x in vec]))
    v = {i: (label(i, min(x)[0]), [int(np.floor(256 * c)) for c in min(x)[1]]) for i, x in by.items()}
    out = []
    for a in filter(anchors, v):
        lab, vec = v[a]
        score = sorted((-sum(p * q for p, q in zip(vec, w)), i, m) for i, (m, w) in v.items() if i != a and len(w) == len(vec))
        for s, p, _ in [x for x in score if x[2] == lab][:positives]:
            near = [(t, i) for t, i, m in score if m != lab and low * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(near, 1)]
    return sorted(out)


def test_negatives_of_odd_rows(spark):
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(4, 6)) * 0.6
    rows = [(i, (centre[i % 4] + 0.4 * rnd.normal(size=6)).tolist(), int(rnd.integers(0, 3))) for i in range(300)]
    rows += [(300 + i, [0.25, 0.5, -0.25, 0.0, 1.0, 0.125], i % 3) for i in range(40)]  # ties
    rows += [(400, [0.0] * 6, 1), (401, None, 1), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1), (405, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    rows += [(410, [0.5, 0.5], 1), (411, [0.5, 0.4], 1), (412, [0.4, 0.5], 2), (420, [9.0] * 6, 0), (421, [-9.0] * 6, 0), (430, [], 1), (431, [], 1), (432, [], 2)]
    rows += [(20, rows[20][1], rows[20][2]), (20, [5.0] * 6, 9)]  # a repeated row, and another of its id
    rows = [(i, v, lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"id": F.lit(1), "shard": F.lit(2), "rank": F.lit(3)})
    for shard, block in ((16_384, 4096), (17, 5)):
        got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.expr("id % 10 = 0"), shard_rows=shard, anchor_block=block).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
        assert got == plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) > 300 and any(a == 410 for a, *_ in got) and any(a == 430 for a, *_ in got)
    assert negatives.hard_negatives(df.limit(0), F.expr("id % 10 = 0")).count() == 0


def test_sliced_products_are_exact_and_drop_early():
    rnd = np.random.default_rng(5)
    for d in (1, 63, 64, 65, 130):
        x = rnd.integers(-300, 300, size=(200, d))
        shard, a = negatives.Sliced(x), rnd.integers(-300, 300, size=d)
        rows, score = shard.refine(a, np.arange(200), lambda lo, hi: np.ones(len(lo), bool))
        assert (score == x @ a).all() and len(rows) == 200
        bounds = []
        shard.refine(a, np.arange(200), lambda lo, hi: bounds.append((lo.copy(), hi.copy())) or np.ones(len(lo), bool))
        for (lo, hi), (lo2, hi2) in zip(bounds, bounds[1:]):
            assert (lo <= lo2).all() and (hi2 <= hi).all() and (lo <= x @ a).all() and (x @ a <= hi).all()
    x = rnd.integers(-100, 100, size=(20_000, 64))
    left = []

    def keep(lo, hi):
        bar = negatives._largest(lo, 5)
        left.append(len(lo))
        return hi >= bar

    rows, score = negatives.Sliced(x).refine(x[0], np.arange(20_000), keep)
    assert left[-1] < 200 and (np.sort(score)[-5:] == np.sort(x @ x[0])[-5:]).all()


def test_products_that_no_long_holds(spark):
    df = spark.createDataFrame([(i, [1e18, 1.0], i % 2) for i in range(4)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="may not fit a long"):
        negatives.hard_negatives(df, F.expr("id = 0")).collect()
