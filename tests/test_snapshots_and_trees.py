"""Back-tests at parents, trees read once, watches with keyed state, and rules of many repositories."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import exclusion, snapshots
from lodestar.plans import fixtures as X
from lodestar.sources import tree
from lodestar.streaming import verify


def _history(spark):
    return spark.createDataFrame(X.SNAPSHOT_COMMITS, "repo_id string, n int, hash string, message string, files array<string>"), spark.createDataFrame(X.SNAPSHOT_WRITES, "repo_id string, n int, path string, text string")


def test_versions_stand_until_the_next_write(spark):
    _, writes = _history(spark)
    rows = {(r.path, r.since): r.until for r in snapshots.versions(writes).collect()}
    assert rows["src/session.ts", 1] == 2 and rows["src/session.ts", 3] is None
    assert rows["src/password/reset_expiration.ts", 1] == 2 and ("src/password/reset_expiration.ts", 2) not in rows  # deleted


def test_a_case_sees_its_parent_only(spark):
    commits, writes = _history(spark)
    out = snapshots.arms_at_parents(commits, writes, last=1)
    tops = [(r.arm, r["rank"], r.path) for r in out["tops"].orderBy("arm", "rank").collect()]
    assert ("bm25", 1, "src/session.ts") in tops and ("rank", 1, "src/auth/reset.ts") in tops
    assert not any("password/" in p for _, _, p in tops)  # one is deleted before, one comes later
    assert not any(p.startswith("dist/") for arm, _, p in tops if arm != "bm25")
    rates = {(r.arm, r.cohort, r.k): (r.hits, r.n) for r in out["rates"].collect()}
    assert rates["bm25", "all", 1] == (1, 1) and rates["impact", "unmentioned", 5] == (1, 1) and ("rank", "mentioned", 5) not in rates
    # the newest commit has too few terms; of the case's other code the test is around, the session was ranked, the built file is neither
    assert [(r.reason, r.n) for r in out["skipped"].collect()] == [("too-few-terms", 1)]
    assert [(r.found, r.expected) for r in out["secondary"].collect()] == [(1, 3)]


def test_as_of_scores_equal_a_corpus_built_for_each_case(spark):
    from lodestar.operators import retrieval

    rnd = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    writes, commits = [], []
    for n in range(1, 31):
        paths = sorted({f"src/f{rnd.randrange(8)}.ts" for _ in range(3)})
        commits.append(("r", n, f"h{n}", " ".join(rnd.choices(words, k=4)), paths))
        writes += [("r", n, p, None if rnd.random() < 0.2 else " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for p in paths]
    commits = spark.createDataFrame(commits, "repo_id string, n int, hash string, message string, files array<string>")
    kept = snapshots.versions(spark.createDataFrame(writes, "repo_id string, n int, path string, text string"))
    rows = snapshots.cases(commits, kept, last=10)[0]
    tasks = rows.select("repo_id", "task_id", "n", "issue_text").distinct()
    got = sorted(tuple(r) for r in snapshots.bm25_as_of(kept, tasks).select("task_id", "rank", "path", "score").collect())
    files = snapshots.files_as_of(kept, tasks).select("repo_id", "path", F.concat_ws("\n", "path", "text").alias("text"))
    asked = tasks.select(snapshots.corpus().alias("repo_id"), "task_id", "issue_text")
    want = sorted(tuple(r) for r in retrieval.bm25(files, asked, by=["repo_id"]).select("task_id", "rank", "path", "score").collect())
    assert len(got) > 20 and got == want


def test_history_ends_before_the_case(spark):
    rows = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 2, "a"), ("r", 2, "c"), ("r", 3, "a"), ("r", 3, "d")], "repo_id string, n int, path string")
    tasks = spark.createDataFrame([("r", "t", 3)], "repo_id string, task_id string, n int")
    seeds = spark.createDataFrame([("r\0t", "a")], "corpus string, path string")
    assert {(r.hash, r.path) for r in snapshots.history_as_of(rows, tasks, seeds).collect()} == {("1", "a"), ("1", "b"), ("2", "a"), ("2", "c")}
    assert {r.hash for r in snapshots.history_as_of(rows, tasks, seeds, most=1).collect()} == {"2"}


# ---------------------------------------------------------------- trees

@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "repo"
    for i in range(200):
        f = root / f"pkg{i % 7}" / "src" / f"f{i}.ts"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"export const v = {i};")
    (root / "node_modules" / "x").mkdir(parents=True)
    os.mkfifo(root / "node_modules" / "x" / "pipe.ts")  # whoever opened it would wait for ever
    (root / "README.md").write_text("read me")
    return root


def test_listing_enters_no_skipped_folder(spark, folder):
    rows = {r.path: r for r in tree.listing(spark, f"file://{folder}").collect()}
    assert len(rows) == 201 and not any("node_modules" in p for p in rows)
    assert rows["README.md"].size_bytes == 7 and rows["README.md"].extension == ".md"
    only = tree.listing(spark, f"file://{folder}", extensions=(".md",))
    assert [r.path for r in only.collect()] == ["README.md"]
    assert ".md" not in only._jdf.queryExecution().executedPlan().toString()  # the source took the filter


def test_second_scan_reads_what_changed(spark, folder, tmp_path):
    uri, at, now = f"file://{folder}", f"file://{tmp_path}/kept", [1_800_000_000.0]
    run = lambda **k: tree.scan_incrementally(spark, uri, at, clock=lambda: now[0], **k)
    files, note = run()
    assert (note["state"], note["read"], note["reused"]) == ("none", 201, 0)
    changed = folder / "pkg0" / "src" / "f0.ts"
    changed.write_text("export const other = 1;")
    unseen = folder / "pkg1" / "src" / "f1.ts"
    stamp = unseen.stat()
    unseen.write_text("export const v = 9;")
    os.utime(unseen, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))  # same size and time: it is not opened again
    (folder / "pkg2" / "src" / "f2.ts").unlink()
    now[0] += 60
    files, note = run()
    assert (note["state"], note["read"], note["reused"], note["gone"], note["age"]) == ("used", 1, 199, 1, 60)
    text = {r.path: bytes(r.content).decode() for r in files.collect()}
    assert text["pkg0/src/f0.ts"] == "export const other = 1;" and text["pkg1/src/f1.ts"] == "export const v = 1;" and "pkg2/src/f2.ts" not in text
    assert {r.path for r in tree.records(files, "r").where("is_source").collect()} == set(text)


def test_snapshots_expire_and_are_pruned(spark, folder, tmp_path):
    uri, at, now = f"file://{folder}", f"file://{tmp_path}/kept", [1_800_000_000.0]
    run = lambda **k: tree.scan_incrementally(spark, uri, at, clock=lambda: now[0], **k)[1]
    run()
    stale, recent = (tmp_path / "kept" / f"writing-v1-{int((now[0] - age) * 1000)}-{'0' * 32}" for age in (8 * 86400, 60))
    stale.mkdir(), recent.mkdir()
    assert run()["state"] == "used" and not stale.exists() and recent.exists()
    now[0] += 8 * 86400
    note = run()
    assert note["state"] == "none" and note["read"] == 201 and note["pruned"] >= 2 and not recent.exists()


def test_what_cannot_be_trusted_is_not_kept(spark, folder, tmp_path):
    uri = f"file://{folder}"
    assert tree.scan_incrementally(spark, uri, f"{uri}/kept")[1]["state"] == "refused"
    loose = spark.createDataFrame([("draft.ts",)], "path string")
    files, note = tree.scan_incrementally(spark, uri, f"file://{tmp_path}/kept", untracked=loose)
    assert note["state"] == "refused" and "untracked" in note["reason"] and files.count() == 201 and not (tmp_path / "kept").exists()


def test_compare_of_listings(spark):
    kind = "path string, size_bytes bigint, modified bigint"
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 2), ("n", 1, 1)], kind)
    last = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("g", 1, 1)], kind)
    assert {r.path: r.state for r in tree.compare(now, last).collect()} == {"a": "same", "b": "changed", "c": "changed", "n": "new", "g": "gone"}


# ---------------------------------------------------------------- watches

def test_keyed_watch_over_batches_and_a_restart(spark, tmp_path):
    src, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    src.mkdir()
    kind = "repo_id string, observed_at timestamp, seq bigint, fingerprint string, changed array<string>"
    at = lambda s: f"2024-01-01 00:00:{s:02d}"

    def feed(*rows):
        made = spark.createDataFrame([(r, at(s), s, f, c) for r, s, f, c in rows], kind.replace("timestamp", "string"))
        made.coalesce(1).withColumn("observed_at", F.col("observed_at").cast("timestamp")).write.mode("append").parquet(f"file://{src}")
        return verify.run_available(spark.readStream.schema(kind).parquet(f"file://{src}"), tables, out, state)

    plans = spark.createDataFrame([("p", "r0")], "plan_id string, repo_id string")
    files = spark.createDataFrame([("r0", "src/a.ts", False, True, "code"), ("r0", "src/b.ts", False, True, "code")], "repo_id string, path string, is_test boolean, is_source boolean, kind string")
    planned = spark.createDataFrame([("p", "src/a.ts", 1, "medium")], "plan_id string, path string, rank int, confidence string")
    nothing = spark.createDataFrame([], "plan_id string, path string")
    tables = {"plans": plans, "planned": planned, "files": files, "tracked": files.select("repo_id", "path").limit(0), "routes": nothing, "impact": spark.createDataFrame([], "plan_id string, rank int, path string, confidence string"), "risks": spark.createDataFrame([], "plan_id string, area string")}
    first = feed(*[(f"r{i}", 1, "one", []) for i in range(40)], ("r0", 2, "one", []), ("r0", 3, "two", ["src/b.ts"]))
    assert [(p["rows"], p["updated"], p["held"]) for p in first] == [(42, 40, 40)]
    second = feed(("r0", 5, "two", ["src/b.ts"]), ("r1", 5, "two", ["x"]), ("r0", 2, "old", []))  # the last comes too late
    assert [(p["rows"], p["updated"], p["held"]) for p in second] == [(3, 1, 40)]
    third = feed(("r0", 6, "three", ["src/a.ts"]))
    assert [(p["rows"], p["updated"]) for p in third] == [(1, 1)]
    rows = verify.read_updates(spark, out).collect()
    assert sorted((r.sequence, r.seq) for r in rows if r.repo_id == "r0" and r.kind == "update") == [(1, 1), (2, 3), (3, 6)]
    assert [(r.repo_id, r.seq, r.sequence) for r in rows if r.kind == "late"] == [("r0", 2, None)]
    lines = [json.loads(r.value) for r in spark.read.text(f"{out}/lines").collect()]
    by = {x["sequence"]: x["verification"] for x in lines}
    assert {x["plan"] for x in lines} == {"p"} and set(by) == {1, 2, 3}
    assert by[1] == {"summary": "nothing has changed", "changedFiles": [], "findings": []}
    assert [f["code"] for f in by[2]["findings"]] == ["unmapped-change", "leading-file-untouched", "no-test-changed"]
    assert [f["code"] for f in by[3]["findings"]] == ["no-test-changed"] and by[3]["changedFiles"] == ["src/a.ts"]
    text = verify.markdown(*verify.verified(verify.read_updates(spark, out), **tables)).where("check_id = 'p\0002'").first().text
    assert text.startswith("## Watch update 2, 2024-01-01T00:00:03.000Z\n") and "- warning: unmapped-change `src/b.ts`" in text


# ---------------------------------------------------------------- rules

def test_rules_of_repositories(spark):
    files = spark.createDataFrame([("a", ".ignore", "# demo\napps\\web\n!apps/web/keep.ts\n"), ("b", ".ignore", "*.log"), ("b", "src/.ignore", "src")], "repo_id string, path string, text string")
    asked = spark.createDataFrame([("a", 0, "docs/**"), ("a", 1, "/home/me/a/src/x*"), ("a", 2, "nowhere/"), ("a", 3, "/"), ("b", 0, "C:\\work\\B\\gen/")], "repo_id string, ord int, pattern string")
    roots = spark.createDataFrame([("a", "/home/me/a/"), ("b", "c:/Work/b")], "repo_id string, root string")
    rules = exclusion.compiled(exclusion.combined(exclusion.ignore_lines(files, ".ignore"), asked), roots)
    kept = {(r.repo_id, r.pattern) for r in rules.collect()}
    assert kept == {("a", "apps/web"), ("a", "!apps/web/keep.ts"), ("a", "docs/**"), ("a", "/src/x*"), ("a", "nowhere/"), ("a", "/"), ("b", "*.log"), ("b", "/gen/")}
    paths = spark.createDataFrame([("a", p) for p in ("apps/web/page.ts", "apps/web/keep.ts", "docs/x/y.md", "src/x1.ts", "lib/src/x1.ts", "gen/a.ts", "a.log")] + [("b", p) for p in ("gen/a.ts", "x/gen/a.ts", "x/a.log", "apps/web/page.ts")], "repo_id string, path string")
    got = {(r.repo_id, r.path, r.pattern) for r in exclusion.excluded_by_repository(paths, rules).collect()}
    assert got == {("a", "apps/web/page.ts", "apps/web"), ("a", "docs/x/y.md", "docs/**"), ("a", "src/x1.ts", "/src/x*"), ("b", "gen/a.ts", "/gen/"), ("b", "x/a.log", "*.log")}
    assert {r.pattern for r in exclusion.unmatched_by_repository(paths, rules).collect()} == {"nowhere/", "/"}


def test_rules_equal_the_plain_expression(spark):
    import re

    rnd = random.Random(5)
    seg = lambda: rnd.choice(["a", "b", "src", "a.b", "x+y", "q"])
    paths = sorted({"/".join(seg() for _ in range(rnd.randint(1, 4))) for _ in range(150)})
    globs = sorted({rnd.choice(["", "/", "!"]) + "/".join(rnd.choice([seg(), seg(), "*", "**", "s?c", "a*", "**b"]) for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "/"]) for _ in range(250)})
    rules = exclusion.compiled(spark.createDataFrame([("r", i, g) for i, g in enumerate(globs)], "repo_id string, ord int, pattern string"))
    got = {(r.path, r.pattern) for r in exclusion.matches_by_repository(spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string"), rules).collect()}
    want = set()
    for g in globs:
        bare = g.removeprefix("!")
        expression = exclusion.glob_regex(bare)
        want |= {(p, g) for p in paths if expression and re.search(expression, p + "/" if bare.endswith("/") else p)}
    assert got == want and len(want) > 1000


def test_no_rule_meets_every_path(spark):
    rules = exclusion.compiled(spark.range(5000).select((F.col("id") % 2).cast("string").alias("repo_id"), F.col("id").alias("ord"), F.concat(F.lit("generated/"), F.col("id").cast("string"), F.lit("/**")).alias("pattern")))
    paths = spark.range(20000).select((F.col("id") % 2).cast("string").alias("repo_id"), F.concat(F.lit("generated/"), (F.col("id") % 9000).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"))
    out = exclusion.excluded_by_repository(paths, rules)
    assert out.count() == sum(i % 9000 < 5000 for i in range(20000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
