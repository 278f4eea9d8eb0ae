"""Context packs and samples of diffs against the rules as they read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import context

SF = "/root/testdata/sf0.001"
DEFINES = re.compile(r"\b(?:class|function|interface|type|enum|def|fn|func|const|let|var)\b", re.ASCII)


def tokens_of(text):
    return -(-len(text.encode()) // 4)


def select_range(text, terms, names, allowance):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if tokens_of("\n".join(lines)) <= allowance:
        return 1, len(lines), "\n".join(lines)

    def says(line):
        low = line.lower()
        named = sum(12 if n in line else 7 if n.lower() in low else 0 for n in names)
        return named + 2 * sum(t.lower() in low for t in terms) + bool(DEFINES.search(line))

    best = max(range(len(lines)), key=lambda i: (says(lines[i]) - i / 100_000, -i))
    a = b = best
    content = lines[best]
    if tokens_of(content) > allowance:
        content = content.encode()[: allowance * 4].decode("utf-8", "ignore")
    size, before = tokens_of(content), True
    while size < allowance:
        for side in (before, not before):
            x, y = (a - 1, b) if side else (a, b + 1)
            if x < 0 or y >= len(lines):
                continue
            wider = "\n".join(lines[x : y + 1])
            if tokens_of(wider) <= allowance:
                a, b, content, size = x, y, wider, tokens_of(wider)
                break
        else:
            break
        before = not before
    return None if size < context.LEAST <= allowance and not content.strip() else (a + 1, b + 1, content)


def plain_pack(cands, texts, said, budgets):
    out = []
    for plan, budget in budgets.items():
        left = budget
        for ord_, path, role in sorted(c[1:] for c in cands if c[0] == plan):
            text, row = texts.get(path), [plan, ord_, path, None, None, None, None, None]
            if text is None:
                row[7] = "unavailable"
            elif not text.strip():
                row[7] = "empty"
            elif left < context.LEAST or (got := select_range(text, *said[plan], min(left, max(context.LEAST, int(budget * context.SHARES[role]))))) is None:
                row[7] = "budget"
            else:
                row[3:7] = [got[0], got[1], tokens_of(got[2]), got[2]]
                left -= row[5]
            out.append(tuple(row))
    return sorted(out)


def packed(spark, cands, texts, said, budgets):
    c = spark.createDataFrame(cands, "plan_id int, ord int, path string, role string")
    f = spark.createDataFrame([("r", p, x, True) for p, x in texts.items()], "repo_id string, path string, text string, text_complete boolean")
    s = spark.createDataFrame([(p, t, n, []) for p, (t, n) in said.items()], "plan_id int, tokens array<string>, identifiers array<string>, member_mentions array<string>")
    p = spark.createDataFrame([(p, "r", b) for p, b in budgets.items()], "plan_id int, repo_id string, budget int")
    out = context.pack(c, f, s, p)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return sorted(tuple(r) for r in out.select("plan_id", "ord", "path", "start_line", "end_line", "estimated_tokens", "content", "omitted").collect())


def test_pack_equals_the_plain_rule(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["alpha", "Beta", "function", "openSession", "opensession", "é" * 30, "", " ", "const x", "zz"])
    texts = {f"f{i}": rnd.choice(["\n", "\r\n"]).join(" ".join(word() for _ in range(rnd.choice((0, 1, 3, 9)))) for _ in range(rnd.choice((1, 5, 40, 200)))) for i in range(40)}
    texts |= {"empty": "", "blank": " \n\t\n", "long": "x" * 5000, "wide": "é" * 3000, "lines": "\n" * 900, "none": None, "mostly": "\n" * 400 + " " * 300 + "\n" * 400 + "a"}
    cands, said, budgets = [], {}, {}
    for plan in range(30):
        some = rnd.sample(sorted(texts), 12) + (["missing"] if plan % 3 else [])
        cands += [(plan, i, p, rnd.choice(["primary", "supporting"])) for i, p in enumerate(some)]
        said[plan] = (rnd.sample(["alpha", "beta", "zz", "session"], rnd.randint(0, 3)), rnd.sample(["openSession", "Beta"], rnd.randint(0, 2)))
        budgets[plan] = rnd.choice((20, 47, 48, 100, 400, 1000, 5000))
    want = plain_pack(cands, texts, said, budgets)
    assert packed(spark, cands, texts, said, budgets) == want
    assert {r[7] for r in want} == {None, "unavailable", "empty", "budget"}


def test_pack_of_all_benchmark_tasks(spark):
    """Every task of the query, its files and signals as they are."""
    from lodestar.operators.signals import task_signals
    from lodestar.plans import catalogue as C

    got = sorted(tuple(r) for r in C.QUERIES["context_pack"](spark, SF).select("plan_id", "ord", "path", "start_line", "end_line", "estimated_tokens", "content", "omitted").collect())
    tasks = C.passages(spark, SF).withColumn("repo_id", F.lit("docs")).withColumn("diff_text", F.lit(None).cast("string"))
    said = {r.task_id: (list(r.tokens), [*r.identifiers, *r.member_mentions]) for r in task_signals(tasks).collect()}
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert got == plain_pack([(r[0], r[1], r[2], "primary") for r in got], texts, said, dict.fromkeys(said, 1000)) and len(got) > 50


def plain_sample(text, budget):
    groups, current = [], None
    for line in re.split(r"\r?\n", text):
        if line.startswith("diff --git "):
            groups.append(current := [])
        elif line.startswith("+") and not line.startswith("+++"):
            if current is None:
                groups.append(current := [])
            current.append(line)
    taken, used = [], 0
    for i in range(max(map(len, groups), default=0)):
        for g in groups:
            if i < len(g) and used + len(g[i]) + (used > 0) <= budget:
                used += len(g[i]) + (used > 0)
                taken.append(g[i])
    return "\n".join(taken), len(taken), sum(map(len, groups))


def test_samples_of_diffs(spark):
    rnd = random.Random(7)
    diffs = []
    for i in range(12):
        rows = ["+early line"] if i % 2 else []
        for f in range(rnd.randint(1, 6)):
            rows += [f"diff --git a/{f} b/{f}", f"+++ b/{f}"] + [rnd.choice("+- ") + "y" * rnd.choice((0, 3, 30, 400)) for _ in range(rnd.randint(0, 60))]
        diffs.append((f"r{i}", "\n".join(rows)))
    got = {r.repo_id: (r.text, r.lines, r.total_lines) for r in context.sample_diff(spark.createDataFrame(diffs, "repo_id string, diff_text string"), 700).collect()}
    for repo, text in diffs:
        want = (text, None, None) if len(text) <= 700 else plain_sample(text, 700)
        assert got[repo] == want or want[2] == 0 and repo not in got, repo


def test_a_large_diff_is_passed_over_once(spark):
    """50 MB of added lines in one repository: what the task holds does not grow with them."""
    lines = spark.range(500_000).select(F.lit("r").alias("repo_id"), (F.col("id") % 7).alias("file"), F.col("id").alias("pos"), F.concat(F.lit("+"), F.repeat(F.lit("x"), (F.col("id") % 200).cast("int"))).alias("line"))
    taken = context.sample_lines(lines, 200_000)
    assert "mapInArrow" in taken._jdf.queryExecution().executedPlan().toString() or "MapInArrow" in taken._jdf.queryExecution().executedPlan().toString()
    n, size = taken.selectExpr("count(*)", "sum(length(line))").first()
    used = 0
    for i in range(500_000):
        cost = i % 200 + 1 + (used > 0)
        used += cost if used + cost <= 200_000 else 0
    assert size + n - 1 == used and pytest.approx(used, rel=0.01) == 200_000
