"""Steps whose work has to grow with their input, and no faster."""

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from lodestar.functions import text as T
from lodestar.llm import divergence
from lodestar.operators import baselines, cochange, exclusion, graph, grounding, holding, ranking, retrieval, snapshots
from lodestar.plans import catalogue
from lodestar.sources import scan
from lodestar.streaming import verify

SF = "/root/testdata/sf0.001"


def test_a_listing_in_pieces(spark):
    """Pieces are numbered on, a path counts once over all of them, and a link in one piece marks its path in another."""
    links = "160000 " + "a" * 40 + " 0\tlib\\sub\0"
    out = spark.createDataFrame([("r", 1, "c\0a\0lib/sub\0", ""), ("r", 0, "a\0b\0a\0", links), ("s", 0, "a\0", ""), ("t", 0, None, None)], "repo_id string, part int, listed string, staged string")
    rows = sorted(tuple(r) for r in scan.git_listing(out).collect())
    assert rows == [("r", 0, "a", False), ("r", 1, "b", False), ("r", 2, "c", False), ("r", 3, "lib/sub", True), ("s", 0, "a", False)]


def test_rules_with_wildcards_have_keys(spark):
    """A rule without a whole segment meets segments by how they begin or end; a path counts once, however many of its segments do."""
    globs = ["doc_7.??", "src/doc_1*", "**/x*.md", "**/package.json", "a**b", "*", "/*.ts/"]
    rules = exclusion.compiled(spark.createDataFrame([("r", i, g) for i, g in enumerate(globs)], "repo_id string, ord int, pattern string"))
    keys = {r.pattern: {(k.how, k.key) for k in r["keys"]} for r in rules.collect()}
    assert keys == {
        "doc_7.??": {("prefix", "doc_7.")}, "src/doc_1*": {("whole", "src"), ("prefix", "doc_1")}, "**/x*.md": {("suffix", ".md")}, "**/package.json": {("suffix", "package.json")},
        "a**b": {("prefix", "a"), ("suffix", "b")}, "*": set(), "/*.ts/": {("suffix", ".ts")}}
    paths = spark.createDataFrame([("r", p) for p in ("src/doc_12/doc_13.md", "doc_7.ts", "q/doc_7.ts", "doc_7.t", "q/xx.md", "my-package.json", "a/c/b", "a1/a2/b")], "repo_id string, path string")
    got = sorted((r.pattern, r.path) for r in exclusion.matches_by_repository(paths, rules.where("pattern <> '*'")).collect())
    assert got == [("**/package.json", "my-package.json"), ("**/x*.md", "q/xx.md"), ("/*.ts/", "doc_7.ts"), ("a**b", "a/c/b"), ("a**b", "a1/a2/b"), ("doc_7.??", "doc_7.ts"), ("doc_7.??", "q/doc_7.ts"), ("src/doc_1*", "src/doc_12/doc_13.md")]


def test_many_rules_meet_few_paths(spark):
    """Rules that begin a name of their own: rows from the join by key, and no rule is left to meet all paths."""
    n = 20000
    rules = exclusion.compiled(spark.range(n).select(F.lit("r").alias("repo_id"), F.col("id").alias("ord"), F.concat(F.lit("doc_"), F.col("id").cast("string"), F.lit(".??")).alias("pattern")))
    assert rules.where("size(keys) = 0").count() == 0
    paths = spark.range(n).select(F.lit("r").alias("repo_id"), F.concat(F.lit("src/doc_"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".ts").otherwise(".tsx")).alias("path"))
    assert exclusion.excluded_by_repository(paths, rules).count() == n // 2


def test_scores_of_all_pairs_do_not_travel(spark):
    """A document's terms stay together, so a (task, document) row is summed where it is; only the best of a partition are exchanged."""
    docs = spark.createDataFrame([(f"src/f{i}.ts", f"alpha beta{i % 3} gamma alpha{i}", ["raw", "code"] if i % 2 else ["raw"]) for i in range(3000)], "path string, text string, policies array<string>")
    tasks = spark.createDataFrame([(1, "alpha beta1"), (2, "gamma beta2 alpha")], "task_id int, issue_text string")
    for out in (retrieval.bm25(docs, tasks), retrieval.literal_search(docs, tasks), baselines.by_bm25(docs, tasks), baselines.by_literal(docs, tasks)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        sent = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "task_id#" in line]
        assert len(sent) == 1 and "path#" not in sent[0]  # the window over the best of each partition
    counts = {(r.task_id, r.path): (r.terms, r.occurrences) for r in retrieval.literal_counts(docs, tasks, more=["policies"]).collect()}
    assert len(counts) == 6000 and counts[1, "src/f1.ts"] == (2, 3) and counts[2, "src/f2.ts"] == (3, 4) and counts[2, "src/f1.ts"] == (2, 3)


def test_versions_cost_one_exchange_of_texts(spark):
    """Writes go to the place of their path once; versions without texts carry none."""
    writes = spark.createDataFrame([("r", 1, "a", "x"), ("r", 1, "a", "y"), ("r", 3, "a", None), ("r", 2, "b", "z"), ("r", 4, "b", "w")], "repo_id string, n int, path string, text string")
    out = snapshots.spans(writes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in out.collect()) == [("r", "a", 1, 3, "y"), ("r", "b", 2, 4, "z"), ("r", "b", 4, None, "w")]
    assert "max(text" not in out.drop("text")._jdf.queryExecution().optimizedPlan().toString()


def test_a_ranking_has_rows_of_what_it_may_show(spark, monkeypatch):
    """Only what may be shown is a row with reasons, and the rows are those of the whole ranking; asked-for pairs come back beyond the limit."""
    code = lambda i: f"import x from './f{(i * 7) % 200}'\nexport function openPart{i}() {{ return alpha beta{i % 5} gamma{i % 3}; }}"
    rows = [("r", i, f"src/d{i % 4}/f{i}.ts", code(i), False, True, "code", True) for i in range(200)]
    rows += [("r", 200 + i, p, code(i), False, True, "code", True) for i, p in enumerate(["dist/f3.js", "dist/f4.js", "dist/none.js"])]
    rows += [("r", 300, "docs/f9.md", "gamma1 alpha", False, True, "documentation", True), ("r", 301, "test/f3.test.ts", "openPart3", True, True, "code", True), ("s", 0, "a.ts", "beta1", False, True, "code", True)]
    files = spark.createDataFrame(rows, "repo_id string, seq long, path string, text string, is_test boolean, is_source boolean, kind string, text_complete boolean")
    said = [("r", "1", "openPart3 in test/f3.test.ts loses beta1 and gamma2"), ("r", "2", "gamma1 of `openPart44` in src/d0/f8.ts and dist/f4.js"), ("r", "3", "alpha beta4 part"), ("r", "4", "write docs on gamma1"), ("s", "5", "beta1")]
    tasks = spark.createDataFrame([(*x, None) for x in said], "repo_id string, task_id string, issue_text string, diff_text string")
    changed = spark.createDataFrame([("r", "src/d1/f5.ts"), ("r", "src/d2/f6.ts")], "repo_id string, path string")
    seen, score = [], ranking.score

    def counted(cands, *more):
        seen.append(cands.count())
        return score(cands, *more)

    every = {(r.task_id, r.path): r for r in ranking.rank(files, tasks, changed, limit=None, cutoff=None).collect()}
    monkeypatch.setattr(ranking, "score", counted)
    also = spark.createDataFrame([("r", "3", "src/d3/f199.ts"), ("r", "1", "no/such.ts"), ("r", "1", "dist/f4.js")], "repo_id string, task_id string, path string")
    got = {(r.task_id, r.path): r for r in ranking.rank(files, tasks, changed, cutoff=None, also=also).collect()}
    assert len(every) > 800 and sum(seen) < len(every) / 2
    first = {k: r for k, r in every.items() if r.rank <= 8}
    assert {k: r for k, r in got.items() if r.rank is not None} == first
    assert {k for k, r in got.items() if r.rank is None} == {(r.task_id, r.path) for r in also.collect()} & set(every) - set(first)
    assert all(got[k].score == every[k].score and got[k].reasons == every[k].reasons for k in got)


def test_a_string_that_all_files_hold_makes_no_rows(spark, monkeypatch):
    """Members and quoted texts are counted where the pairs are; rows with reasons are of what may be shown, however many files hold a string of the task."""
    rows = [("r", i, f"src/d{i % 4}/f{i}.ts", f"export function openPart{i}() {{ return shared.member1; }} alpha{i % 7}", False, True, "code", True) for i in range(300)]
    files = spark.createDataFrame(rows, "repo_id string, seq long, path string, text string, is_test boolean, is_source boolean, kind string, text_complete boolean")
    said = [("r", str(i), f'Fix openPart{i} where "return shared.member1;" loses alpha{i}', None) for i in range(3)]
    tasks = spark.createDataFrame(said, "repo_id string, task_id string, issue_text string, diff_text string")
    none, seen, score = files.select("repo_id", "path").limit(0), [], ranking.score

    def counted(cands, *more):
        seen.append(cands.count())
        return score(cands, *more)

    every = {(r.task_id, r.path): r for r in ranking.rank(files, tasks, none, limit=None, cutoff=None).where("rank <= 8").collect()}
    monkeypatch.setattr(ranking, "score", counted)
    got = {(r.task_id, r.path): r for r in ranking.rank(files, tasks, none, cutoff=None).collect()}
    assert got == every and all(r.f7 == r.f8 == 8 for r in got.values())
    assert sum(seen) <= 3 * 10


def test_texts_meet_the_words_of_tasks(spark):
    """The forms of a stem are all words that have it, and a text that holds a string has the string's word, whatever stands around it."""
    said = "stopped stop stops stopping passes pass boxes box carried carry carries running run scss css contributors contribute files filed filing file tries happening lying status kubernetes ciónñs"
    words = spark.createDataFrame([(w,) for w in said.split()], "w string").select("w", F.explode(T.tokenize(F.col("w"))).alias("token"))
    assert words.count() >= 26 and words.where(~F.array_contains(T.forms(F.col("token")), F.col("w"))).count() == 0
    texts = ["see openDoc5.", "functionopenDoc5 x", "function openDoc5() {", "xopenDoc5", "https://a.b/openDoc5/c", "x = const k = 'two words here'", "prewords two words hereafter", "_ab ab_ $ab", "a ΟΔΟΣ.Α", "openDoc52", "http2 Straße", "let v = \"q ΟΔΟΣ.Α z", None]
    files = spark.createDataFrame([("r", f"p{i}", i, x) for i, x in enumerate(texts)], "repo_id string, path string, fid long, text string")
    names, quoted = ["openDoc5", "ab", "_ab", "$ab", "ΟΔΟΣ", "Straße"], ["two words here", "words", "q ΟΔΟΣ.Α z", "openDoc5", "a.b/o"]
    signals = spark.createDataFrame([("r", names, [], quoted)], "repo_id string, member_mentions array<string>, identifiers array<string>, exact_fragments array<string>")
    needles = holding.needles_of(signals)
    keys = holding.needle_keys(needles)
    found = holding.held(files, holding.met(files, keys), needles, keys).join(needles, "id").collect()
    got = {k: {(r.needle, r.fid) for r in found if r[k]} for k in ("mentions", "defines", "has", "assigned")}
    pairs = files.where("text is not null").crossJoin(spark.createDataFrame([(x, x in names) for x in dict.fromkeys(names + quoted)], "n string, name boolean"))
    pairs = pairs.select("n", "fid", (F.col("name") & grounding.mentions(F.col("text"), F.col("n"))).alias("mentions"), (F.col("name") & grounding.defines(F.col("text"), F.col("n"))).alias("defines"), (F.col("n").isin(quoted) & F.col("text").contains(F.col("n"))).alias("has")).collect()
    for k in ("mentions", "defines", "has"):
        assert got[k] == {(r.n, r.fid) for r in pairs if r[k]} and got[k]
    assert got["assigned"] == {("q ΟΔΟΣ.Α z", 11), ("two words here", 5)}


def test_a_path_comes_back_as_all_roots_that_may_mean_it(spark):
    roots = ["a/b", "a/b.js", "a/b.mjs", "a/b.cjs", "a/b.ts", "a/b.tsx", "a", "a/b.vue", "a/index", "a/b.c", "a/.x"]
    r = spark.createDataFrame([(x,) for x in roots], "root string").select("root", F.explode(graph.candidates(F.col("root"))).alias("dst"))
    assert r.count() > 100 and r.where(~F.array_contains(graph.roots_of(F.col("dst")), F.col("root"))).count() == 0


def test_a_ranking_reads_the_imports_of_all_files(spark):
    """No file and no import is left out, however many there are, and the SQL of rankings has no such limit either."""
    n = 5002
    files = spark.range(n).select(F.lit("r").alias("repo_id"), F.col("id").alias("seq"), F.format_string("d/f%04d.ts", "id").alias("path"), F.concat(F.lit("import x from './f"), F.lpad(((F.col("id") + 1) % n).cast("string"), 4, "0"), F.lit("'")).alias("text"))
    assert graph.every_import(files).count() == n and graph.import_edges(files)[0].count() == 5000
    rows = [(i, f"f{i}.ts", "alpha") for i in range(205)] + [(300, "hub.ts", "\n".join(f"import x from './f{i}'" for i in range(205)))]
    few = spark.createDataFrame([("r", i, p, x, False, True, "code", True) for i, p, x in rows], "repo_id string, seq long, path string, text string, is_test boolean, is_source boolean, kind string, text_complete boolean")
    tasks = spark.createDataFrame([("r", "1", "alpha of hub.ts", None)], "repo_id string, task_id string, issue_text string, diff_text string")
    near = ranking.rank(few, tasks, few.select("repo_id", "path").limit(0), limit=None, cutoff=None).where("f21 = 4").count()
    assert near == 205
    assert all("n <= 5000" not in __spark_entry__.oracle_sql()[q] for q in ("rank_documents", "rank_documents_shape", "document_explanations"))


def test_two_runs_read_the_documents_once(spark):
    """Two rankings of the same documents are one job; their plans, and those of the cases, hold what was written and no search again."""
    for out in (*catalogue._two_runs(spark, SF), catalogue.doc_cases(spark, SF)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "row_number" not in plan


def test_words_of_one_part_need_no_pattern(spark):
    """Words and their parts, however they are written; a word without a border within goes through no replacement."""
    texts = ["fooBar foo_bar a_b aB_cdefg $x$ ab abc ABC aBC ABCdef x1Y2z abc__defg __abc_ _ fooBar", "caf\u00e9Bar \u0130stanbul \u212aelvin na\u00efve abc9Def", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", T.retrieval_tokens(F.col("x")).alias("t")).collect()
    got = {r.i: r.t for r in rows}
    assert got[0] == ["foobar", "foo", "bar", "foo_bar", "foo", "bar", "a_b", "ab_cdefg", "$x$", "abc", "abc", "abc", "abcdef", "x1y2z", "abc__defg", "abc", "defg", "__abc_", "foobar", "foo", "bar"]
    assert got[1] == ["caf", "bar", "stanbul", "elvin", "abc9def", "abc9", "def"] and got[2] == [] and got[3] is None


def test_pairs_are_two_numbers_in_more_tasks_as_they_grow(spark, monkeypatch):
    """A pair is dealt out once, as numbers, over partitions by how many pairs there are; seeds that are few, all or none of the files give the rows of the plain rule."""
    monkeypatch.setattr(cochange, "PART", 50)
    commits = {h: sorted({f"f{(h * k * k + k) % 23}" for k in range(1 + h % 6)}) for h in range(120)}
    rows = spark.createDataFrame([(h, p) for h, ps in commits.items() for p in ps] + [(None, "f1"), (None, "f2"), (7, None)], "hash int, path string")
    for seeds in (None, ["f1", "f2", "nowhere"], []):
        asked = None if seeds is None else spark.createDataFrame([(x,) for x in seeds], "seed string")
        out = cochange.pairs(rows, asked, ["hash"])
        want = {}
        for ps in commits.values():
            for a in ps:
                for b in ps:
                    if a != b and (seeds is None or a in seeds):
                        want[a, b] = want.get((a, b), 0) + 1
        changes = {p: sum(p in ps for ps in commits.values()) for ps in commits.values() for p in ps}
        got = sorted((r.seed, r.companion, r.occurrences, r.seed_changes) for r in out.collect())
        assert got == sorted((a, b, n, changes[a]) for (a, b), n in want.items() if n >= 2)
    assert sum(len(ps) * (len(ps) - 1) for ps in commits.values()) > 500
    plan = cochange.pairs(rows, None, ["hash"])._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and "hashpartitioning(a#" in dealt[0] and "_file#" not in dealt[0] and int(dealt[0].split("), REPARTITION")[0].rsplit(", ", 1)[1]) > 4


def test_updates_alike_are_verified_once(spark):
    """Updates with the same plan and the same changed paths, in any order, are one case; every check has its findings."""
    found = spark.createDataFrame([("r0", "update", k + 1, None, k, f"f{k}", c) for k, c in enumerate([["b", "a"], ["a", "b", "a"], ["a"], ["b", "a"], []])] + [("r0", "late", None, None, 9, "f", ["a"]), ("r1", "update", 1, None, 1, "f", ["a"])], verify.UPDATES)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    plans = frame([("p", "r0"), ("q", "r0"), ("s", "r1")], "plan_id string, repo_id string")
    files = frame([(r, p, False, True, "code") for r in ("r0", "r1") for p in "ab"], "repo_id string, path string, is_test boolean, is_source boolean, kind string")
    planned = frame([("p", "a", 1, "high"), ("q", "b", 1, "low"), ("s", "b", 1, "high")], "plan_id string, path string, rank int, confidence string")
    nothing = frame([], "plan_id string, path string")
    checks, findings = verify.verified(found, plans, planned, files, nothing.select(nothing.plan_id.alias("repo_id"), "path"), nothing, frame([], "plan_id string, rank int, path string, confidence string"), frame([], "plan_id string, area string"))
    assert checks.count() == 11 and checks.select("case_id").distinct().count() == 7
    assert findings.groupBy("case_id", "ord", "area").count().where("count > 1").count() == 0
    says = {(r.check_id, tuple((f.code, tuple(f.paths)) for f in r.findings)) for r in verify._gathered(checks, findings).select("check_id", "findings").collect()}
    both, one = [("unmapped-change", ("b",)), ("no-test-changed", ("a", "b"))], [("no-test-changed", ("a",))]
    other, lost = [("unmapped-change", ("a",)), ("no-test-changed", ("a", "b"))], [("unmapped-change", ("a",)), ("leading-file-untouched", ("b",)), ("no-test-changed", ("a",))]
    want = [("p", 1, both), ("p", 2, both), ("p", 3, one), ("p", 4, both), ("p", 5, []), ("q", 1, other), ("q", 2, other), ("q", 3, lost), ("q", 4, other), ("q", 5, []), ("s", 1, lost)]
    assert says == {(f"{p}\0{k}", tuple(f)) for p, k, f in want}


def test_terms_are_tallied_by_columns():
    """Terms of whole batches are counted in Arrow as the pattern finds them; no Python string for each."""
    odd = ["", "  ", "ÉCOLE École école", "a\0B\x7fc A a", "İstanbul K ſ", "\n\t1 2 3", "日本 x日本X", "a'b--c", "x y z\u0085w", "\U0001f600AB"]
    table = pa.table({"lang": ["en", "fr"] * 5, "source": ["", "s", "s", "s", ""] * 2, "text": odd})
    want = {}
    for lang, source, text in zip(*(table.column(k).to_pylist() for k in range(3))):
        found = divergence.terms(text)
        for term in set(found):
            n, docs = want.get((lang, source, term), (0, 0))
            want[lang, source, term] = n + found.count(term), docs + 1
    got = divergence.tallied(table).to_pylist()
    assert len(got) == len(want) and {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in got} == want
    assert divergence.tallied(table.slice(0, 0)).num_rows == divergence.tallied(table.slice(0, 2)).num_rows == 0


def test_runs_of_texts_do_not_travel(spark, monkeypatch):
    """However many runs hold a term, texts are dealt out by key once and no run is exchanged or written; counts are those of a plain search."""
    many = [(i, " ".join(f"alpha{i}x{k}beta" for k in range(100))) for i in range(60)]
    odd = ["aaaaaaa aaaa baaab", "alphabet alphabets alphabeta alpha alph alp", "\u0130stanbul \u212aelvin na\u00efve $x$x$x", "a_b-abc.ABCabcd", "", None, "ab" * 50_000 + "cde", "ananana\nana"]
    docs = spark.createDataFrame(many + list(enumerate(odd, 100)), "path int, text string")
    said = {"short": "aaa abc $x$ ana", "starts": "alpha alphabet alphabets alph alphax betas", "long": "ababababab abcde stanbul kelvin beta", "none": "zzzz of", "empty": ""}
    tasks = spark.createDataFrame(list(said.items()), "task_id string, issue_text string")
    wrote, write = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df: wrote.append(df.columns) or write(df))
    monkeypatch.setattr(retrieval, "PART", 100)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # a table of runs soon is no longer sent whole
    try:
        out = retrieval.literal_counts(docs, tasks)
        got = {(r.task_id, r.path): (r.terms, r.occurrences) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    terms = {r.task_id: r.t for r in tasks.select("task_id", T.query_terms(F.col("issue_text")).alias("t")).collect()}
    low = {r.path: r.t or "" for r in docs.select("path", F.lower("text").alias("t")).collect()}
    n = {(k, i): [text.count(t) for t in ts if t in text] for k, ts in terms.items() for i, text in low.items()}
    assert got == {k: (len(v), sum(v)) for k, v in n.items() if v} and {k for k, _ in got} == {"short", "starts", "long"}
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert wrote == [["task_id", "term"]] and not [line for line in dealt if "run#" in line or "start#" in line]
    assert len([line for line in dealt if "path#" in line]) == 1 and "REPARTITION_BY_NUM" in plan
