from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import cochange, exclusion, grounding, ranking, retrieval
from lodestar.operators.signals import scan_quotes
from lodestar.plans import fixtures as X
from lodestar.sources import scan
from lodestar.streaming import watch

SF = "/root/testdata/sf0.001"


def test_rank_explains_itself(spark):
    """The score is the sum of its features, ranks are dense, and a definition leads."""
    changed = spark.createDataFrame([("auth", "src/token.ts")], "repo_id string, path string")
    rows = ranking.rank(X.code_files(spark), X.tasks(spark), changed).collect()
    for r in rows:
        assert r.score == sum(r[f"f{k}"] for k in range(1, 22)) and r.score >= ranking.CUTOFF and r.reasons
    by = {}
    for r in rows:
        by.setdefault(r.task_id, []).append(r)
    for some in by.values():
        some.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in some] == list(range(1, len(some) + 1)) and len(some) <= ranking.LIMIT
        assert [(-r.score, r.path) for r in some] == sorted((-r.score, r.path) for r in some)
    assert by["t1"][0].path == "src/session.ts" and by["t1"][0].confidence == "high"
    assert by["t2"][0].path == "src/routes/login.ts" and by["t2"][0].f2 == 60
    assert all(r.confidence == "low" for r in by.get("t3", []))
    assert by["t5"][0].path == "packages/price/src/index.ts"


def test_quotes():
    assert [q["value"] for q in scan_quotes("it's 'a b' and `c`")] == ["a b", "c"]
    assert [q["value"] for q in scan_quotes('open "rest')] == ["rest"]


def test_globs():
    assert exclusion.glob_regex("/") is None
    assert exclusion.clean([" a ", "# c", "", "a", "b\\c"]) == ["a", "b/c"]


def test_watch_across_batches(spark, tmp_path):
    """State lasts between runs: the second one goes on counting and repeats nothing."""
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "repo_id string, observed_at timestamp, seq bigint, fingerprint string"

    def add(rows):
        spark.createDataFrame(rows, "repo_id string, t string, seq bigint, fingerprint string").select("repo_id", F.to_timestamp("t").alias("observed_at"), "seq", "fingerprint").coalesce(1).write.mode("append").parquet(str(src))

    def run():
        watch.run_available(spark.readStream.schema(schema).parquet(str(src)), out, state)
        return sorted((r.repo_id, r.sequence, r.seq) for r in spark.read.schema(watch.OUT).parquet(out).collect())

    add([("a", "2024-01-01 00:00:00", 1, "x"), ("a", "2024-01-01 00:00:01", 2, "x"), ("b", "2024-01-01 00:00:00", 3, "x")])
    assert run() == [("a", 1, 1), ("b", 1, 3)]
    add([("a", "2024-01-01 00:00:02", 4, "x"), ("a", "2024-01-01 00:00:03", 5, "y")])
    assert run() == [("a", 1, 1), ("a", 2, 5), ("b", 1, 3)]


def test_directory_scan(spark, tmp_path):
    for p, b in {"src/a.ts": b"const x = 1", "src/b.vue": b"<p></p><script>let q</script>", "node_modules/c.js": b"x", "dist/d.js": b"x", "vendor/e.js": b"y", "bin.py": b"a\0b", "big.md": b"z" * 70000, "img.png": b"\x89"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    rows = {r.path: r for r in scan.file_records(scan.directory(spark, f"file://{tmp_path}")).collect()}
    assert set(rows) == {"src/a.ts", "src/b.vue", "vendor/e.js", "bin.py", "big.md", "img.png"}
    assert rows["src/a.ts"].text == "const x = 1" and rows["src/b.vue"].text == "let q"
    assert rows["bin.py"].skip_reason == "not-text" and rows["big.md"].skip_reason == "too-large" and rows["big.md"].text == ""
    assert rows["img.png"].text_complete is None and not rows["img.png"].is_source


def test_cached_scan(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert scan.cached_scan(spark, f"file://{tmp_path}", "k", build).count() == 3
    assert built == [1]


def test_stem_of_nulls_and_blanks(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",)], "x string").select(T.tokenize(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [None, [], []]


def test_literal_search_of_long_passages(spark):
    """Every passage is searched, also long ones; counts as by brute force over whole texts."""
    from lodestar.plans import catalogue

    docs = [(1, "aaaa xAAAx session_token $mini"), (2, "tokens, tokenized; Session"), (3, "nothing"), (4, None), (5, ""), (6, "to" + "ken" * 50)]
    tasks = [("long", "session token aaa " + "filler " * 40), ("short", "$mini ken")]
    got = retrieval.literal_search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(tasks, "task_id string, issue_text string"), key="doc_id").collect()
    want = []
    for task, words in (("long", ("session", "token", "aaa", "filler")), ("short", ("$mini", "ken"))):
        counts = [(i, [(x or "").lower().count(w) for w in words]) for i, x in docs]
        found = sorted((-sum(map(bool, n)), -sum(n), i) for i, n in counts if any(n))
        want += [(task, k + 1, i, -a, -b) for k, (a, b, i) in enumerate(found)]
    assert sorted(map(tuple, got)) == sorted(want)
    asked = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) >= 120").collect()}
    assert asked & {r.task_id for r in catalogue.QUERIES["literal_search_topk"](spark, SF).collect()}


def test_cochange_of_every_seed(spark):
    from lodestar.plans import catalogue

    rows = catalogue.QUERIES["cochange_pairs"](spark, SF).select("seed", "companion", "occurrences").collect()
    pairs = {(r.seed, r.companion): r.occurrences for r in rows}
    assert {s % 10 for s, _ in pairs} == set(range(10)) and all(pairs[b, a] == n for (a, b), n in pairs.items())


def test_history_filter_of_missing_files(spark):
    """Large commits leave by all their files; then missing files leave, whatever their ids."""
    rows = [("small", i) for i in range(1, 6)] + [("large", i) for i in range(1, 32)] + [("full", i) for i in range(1, 31)]
    known = spark.createDataFrame([(1,), (2,), (5,)], "file int")
    got = cochange.eligible(spark.createDataFrame(rows, "day string, file int"), ["day"], "file", known).collect()
    assert sorted((r.day, r.file) for r in got) == [(d, i) for d in ("full", "small") for i in (1, 2, 5)]


def test_passages_that_texts_hold(spark):
    """Against a plain search, for long passages, passages cut within a word, and short ones."""
    docs = [(1, "the quick brown fox jumps"), (2, "a quick brownish thing; quick brown"), (3, None), (4, ""), (5, "e quick brown fo"), (6, "x")]
    passages = [("a", "e quick brown fo"), ("b", "quick brown"), ("c", "x"), ("d", "no such words here"), ("e", "the quick brown fox jumps")]
    got = retrieval.holding(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(passages, "task_id string, issue_text string")).collect()
    assert sorted(map(tuple, got)) == sorted((t, i) for t, p in passages for i, x in docs if x is not None and p in x)


def test_manifests_may_be_utf16(spark, tmp_path):
    for p, b in {"b/package.json": '{"name": "b", "scripts": {"test": "x"}}'.encode("utf-16"), "a.ts": b"const a", "z.ts": "const z".encode("utf-16")}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    files = scan.file_records(scan.directory(spark, f"file://{tmp_path}"))
    rows = sorted(files.collect(), key=lambda r: r.seq)
    assert [r.path for r in rows] == ["a.ts", "b/package.json", "z.ts"] and [r.skip_reason for r in rows] == [None, None, "not-text"]
    assert [(r.name, r.package_name) for r in scan.package_scripts(files).collect()] == [("test", "b")]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    import pytest

    from lodestar.sources import tables

    assert tables.written(spark.range(3)).count() == 3 and tables.drop_written(spark) >= 1

    class Far:
        master = "spark://far:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Far
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session)


def test_texts_that_may_hold_a_string_leave_none_out(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abAB_$7é ß.-") for _ in range(r.randint(0, 12)))
    files = [(f"r{i % 3}", f"p{i}", None if i == 7 else "" if i == 8 else " ".join(word() for _ in range(30))) for i in range(60)]
    texts = [t for _, _, t in files if t]
    cut = lambda t: t[(k := r.randint(0, len(t) - 1)):k + r.randint(1, 15)]
    needles = list({(f"r{r.randint(0, 3)}", cut(r.choice(texts))) for _ in range(120)}) + [("r0", ""), ("r1", "aab"), ("r2", "é")]
    n, f = spark.createDataFrame(needles, "repo_id string, needle string"), spark.createDataFrame(files, "repo_id string, path string, text string")
    found = {tuple(x) for x in grounding.may_hold(n, f).select("repo_id", "needle", "path").collect()}
    held = {(a, s, p) for a, s in needles for b, p, t in files if a == b and t is not None and s in t}
    assert held and held <= found
    assert not {x for x in found if x[0] == "r3"}  # no files


def test_mentions_meet_every_path_that_they_name(spark):
    from pyspark.sql import functions as F

    from lodestar.functions import paths as P

    paths = ["src/a.ts", "SRC/A.ts", "a.ts", "lib/src/a.ts", "README", "docs/readme.md", "x/.env", "a.b.ts", "src/a", "w\\v.py"]
    names = ["a.ts", "src/a.ts", "readme", "README.md", "a", "a.b", ".env", "far/off/src/a.ts", "v.py", "W/v.py", "", "none"]
    files = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    asked = spark.createDataFrame([("r", m) for m in names], "repo_id string, mention string")
    met = sorted(tuple(x) for x in grounding.paths_named(asked, files).select("mention", "path").collect())
    assert met == sorted(tuple(x) for x in asked.join(files, "repo_id").where(P.matches_mention(F.col("path"), F.col("mention"))).select("mention", "path").collect()) and met


def test_saved_reports_with_a_mark(spark, tmp_path):
    from lodestar.operators import reports

    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + b'{"contextFiles": [], "summary": "", "testRoutes": [], "risks": [], "changedFiles": [], "diagnostics": []}')
    (tmp_path / "b.json").write_bytes(b"\xff not json")
    got = {r.label: (r.valid, r.problem) for r in reports.validate(reports.saved(spark, f"file://{tmp_path}")).collect()}
    assert got == {"a.json": (True, None), "b.json": (False, "not a report")}


def test_a_wider_fail_level(spark):
    from lodestar.operators import reports

    plans = spark.createDataFrame([("p",), ("q",), ("r",)], "plan_id string")
    found = spark.createDataFrame([("p", "warning"), ("q", "info")], "plan_id string, severity string")
    failed = lambda level: {r.plan_id for r in reports.verify_summary(plans, found, level).where("failed").collect()}
    assert failed("error") == set() and failed("warning") == {"p"} and failed("info") == {"p", "q"}
