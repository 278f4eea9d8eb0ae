"""Test commands, related tests, languages, risk areas and skipped tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

# Manifests, and extensions of each language.
MANIFESTS = {"cargo.toml": "rust", "go.mod": "go", "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python", "pipfile": "python", "package.json": "node", "gemfile": "ruby", "composer.json": "php", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java"}
LANGUAGES = {".py": "python", ".go": "go", ".rs": "rust", ".ts": "node", ".tsx": "node", ".js": "node", ".jsx": "node", ".mjs": "node", ".cjs": "node", ".rb": "ruby", ".php": "php", ".java": "java", ".cs": "dotnet"}
RISKS = (
    ("authentication", "high", "auth login password"),
    ("billing", "high", "billing payment invoice"),
    ("automation", "medium", "config workflow action ci"),
    ("data", "high", "migration schema database sql"),
    ("public-api", "medium", "api route public"),
    ("dependencies", "medium", "dependency lock package"),
)
RUNNERS = {"go": "go test ./...", "rust": "cargo test", "ruby": "bundle exec rspec", "php": "composer test or vendor/bin/phpunit", "java": "mvn test or ./gradlew test", "dotnet": "dotnet test"}
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# How tests are skipped.
CONDITIONAL_SKIP = r"\.(?:skipIf|runIf)\s*\("
SKIP = "|".join((
    _B + r"(?:it|test|describe|context)\.(?:skip|todo)\s*\(",
    _B + r"(?:xit|xtest|xdescribe|xcontext)\s*\(",
    _B + r"this\.skip\s*\(",
    r"@(?:pytest\.mark\.(?:skip|skipif)|unittest\.skip(?:If|Unless)?)" + _E,
    _B + r"t\.Skip(?:f|Now)?\s*\(",
    r"#\[ignore(?:\s*=|\s*\])",
))
RELATED, ROUTES = 8, 3


def mapped(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def manifest_language(path: Column) -> Column:
    low = F.lower(P.name(path))
    return F.coalesce(mapped(low, MANIFESTS), F.when(low.rlike(r"\.(?:csproj|fsproj|vbproj)$"), "dotnet"))


def primary_language(files: DataFrame) -> DataFrame:
    """``(repo_id, language, evidence)``: the only root manifest decides, else the largest share of files."""
    m = files.select("repo_id", "seq", "path", manifest_language(F.col("path")).alias("language"), (F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("depth")).where("language is not null")
    root = m.where("depth = 0").groupBy("repo_id", "language").agg(F.min_by("path", "seq").alias("manifest")).withColumn("roots", F.count("*").over(Window.partitionBy("repo_id")))
    nested = m.groupBy("repo_id", "language").agg(F.min_by("path", F.struct("depth", "path")).alias("nested"))
    code = files.where(~F.col("is_test")).select("repo_id", mapped(P.extension(F.col("path")), LANGUAGES).alias("language")).where("language is not null")
    shares = code.groupBy("repo_id", "language").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("repo_id")))
    c = shares.join(root, ["repo_id", "language"], "full").join(nested, ["repo_id", "language"], "left")
    c = c.withColumn("roots", F.max("roots").over(Window.partitionBy("repo_id"))).withColumn("total", F.max("total").over(Window.partitionBy("repo_id")))
    c = c.where((F.coalesce("roots", F.lit(0)) == 0) | F.col("manifest").isNotNull()).withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "language")
    best = c.withColumn("k", F.row_number().over(w)).where("k = 1")
    share = F.concat(F.floor(100 * F.col("n") / F.col("total") + 0.5).cast("string"), F.lit("% of source files"))
    found = best.select(
        "repo_id",
        F.when((F.col("roots") == 1) | (F.col("n") > 0), F.col("language")).alias("language"),
        F.when(F.col("roots") == 1, F.col("manifest")).when(F.col("n") > 0, F.concat_ws(" and ", F.coalesce("manifest", "nested"), share)).alias("evidence"))
    every = files.select("repo_id").distinct().join(found, "repo_id", "left")
    return every.select("repo_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("evidence", F.lit("no root manifest and no known source files")).alias("evidence"))


def manifest_command(files: DataFrame, languages: DataFrame) -> DataFrame:
    """``(repo_id, command, reason)`` of the toolchain whose shallowest manifest is found; none for Python or Node."""
    m = files.select("repo_id", "path", manifest_language(F.col("path")).alias("language"), (F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("depth"))
    near = m.where("language is not null").groupBy("repo_id", "language").agg(F.min_by("path", F.struct("depth", "path")).alias("manifest"))
    j = languages.join(near, ["repo_id", "language"], "left").withColumn("dir", P.folder(F.col("manifest")))
    has, deep, lang = F.col("manifest").isNotNull(), F.col("dir") != "", F.col("language")
    command = (
        F.when(lang == "go", F.when(has & deep, F.concat(F.lit("go test -C "), "dir", F.lit(" ./..."))).otherwise("go test ./..."))
        .when(lang == "rust", F.when(has & deep, F.concat(F.lit("cargo test --manifest-path "), "manifest")).otherwise("cargo test"))
        .when((lang == "ruby") & has, "bundle exec rspec").when((lang == "php") & has, "composer test")
        .when((lang == "java") & has, F.when(F.lower("manifest").endswith("pom.xml"), "mvn test").otherwise("./gradlew test"))
        .when(lang == "dotnet", F.when(has & deep, F.concat(F.lit("dotnet test "), "manifest")).otherwise("dotnet test")))
    return j.select("repo_id", command.alias("command"), F.coalesce("manifest", F.concat(lang, F.lit(" source files"))).alias("reason")).where("command is not null")


def suggested_runner(files: DataFrame, languages: DataFrame) -> DataFrame:
    """``(repo_id, runner)`` to suggest where no route was found."""
    depth = F.length("path") - F.length(F.replace("path", F.lit("/")))
    low = F.lower(P.name(F.col("path")))
    conf = files.where(low.isin("tox.ini", "pytest.ini", "pyproject.toml", "setup.cfg")).groupBy("repo_id").agg(F.min_by(low, F.struct(depth, (low != "tox.ini").cast("int"), F.col("path"))).alias("conf"))
    py = F.when(F.col("conf") == "tox.ini", "tox").when(F.col("conf").isNotNull(), "pytest").otherwise("pytest or unittest")
    return languages.join(conf, "repo_id", "left").select("repo_id", F.when(F.col("language") == "python", py).otherwise(mapped(F.col("language"), RUNNERS)).alias("runner")).where("runner is not null")


def js_runner(files: DataFrame) -> DataFrame:
    """``(repo_id, runner)`` of the first known runner with a configuration file."""
    low = F.lower(P.name(F.col("path")))
    known = ((r"^vitest\.config\.[cm]?[jt]s$", "npx vitest run"), (r"^jest\.config\.([cm]?[jt]s|json)$", "npx jest"), (r"^playwright\.config\.[cm]?[jt]s$", "npx playwright test"), (r"^karma\.conf\.[cm]?[jt]s$", "npx karma start"))
    first = F.coalesce(*[F.when(low.rlike(p), F.struct(F.lit(i).alias("i"), F.lit(r).alias("r"))) for i, (p, r) in enumerate(known)])
    return files.select("repo_id", first.alias("f")).where("f is not null").groupBy("repo_id").agg(F.min("f.i").alias("i"), F.min_by("f.r", "f.i").alias("runner")).drop("i")


def related_tests(files: DataFrame, context: DataFrame, changed: DataFrame, most: int = RELATED) -> DataFrame:
    """``(plan_id, ord, path)``: changed tests by path, then tests whose path shares most terms with the context.

    ``context(plan_id, repo_id, path)``.
    """
    tests = files.where("is_test").select("repo_id", "path")
    plans = context.select("plan_id", "repo_id").distinct()
    mine = tests.join(changed.select("repo_id", "path"), ["repo_id", "path"], "left_semi").join(plans, "repo_id").select("plan_id", "path", F.lit(0).alias("p"), F.lit(0).alias("score"))
    terms = context.select("plan_id", "repo_id", F.explode(T.tokenize(F.col("path"))).alias("token")).distinct()
    others = tests.join(changed.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select("repo_id", "path", F.explode(T.tokenize(F.col("path"))).alias("token"))
    near = others.join(terms, ["repo_id", "token"]).groupBy("plan_id", "path").agg(F.count("*").cast("int").alias("score")).select("plan_id", "path", F.lit(1).alias("p"), "score")
    w = Window.partitionBy("plan_id").orderBy("p", F.desc("score"), "path")
    return mine.union(near).withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most).select("plan_id", "ord", "path")


def script_command(manager: Column, folder: Column, script: Column, package: Column) -> Column:
    deep = (
        F.when(manager == "npm", F.concat(F.lit("npm --prefix "), folder, F.lit(" run "), script))
        .when(manager == "pnpm", F.concat(F.lit("pnpm --dir "), folder, F.lit(" run "), script))
        .when((manager == "yarn") & package.isNotNull(), F.concat(F.lit("yarn workspace "), package, F.lit(" run "), script))
        .when(manager == "yarn", F.concat(F.lit("yarn --cwd "), folder, F.lit(" "), script))
        .otherwise(F.concat(F.lit("bun --cwd "), folder, F.lit(" run "), script)))
    return F.when(folder == "", F.concat(manager, F.lit(" run "), script)).otherwise(deep)


def test_routes(scripts: DataFrame, repos: DataFrame, context: DataFrame, files: DataFrame, most: int = ROUTES) -> DataFrame:
    """``(plan_id, ord, command, reason)`` of the nearest test scripts; ``scripts(repo_id, seq, name, package_dir, package_name)``."""
    low = F.lower("name")
    s = scripts.withColumn("exact", low.isin("test", "tests")).where(F.col("exact") | low.rlike("^tests?:[a-z0-9:_-]+$"))
    code = context.join(files.where("kind = 'code'").select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    # each context path offers its own folders, so a script finds its context by equality
    parts = F.split("path", "/")
    dirs = code.select("plan_id", "repo_id", F.explode(F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("package_dir")).distinct()
    near = s.join(dirs, ["repo_id", "package_dir"]).withColumn("proximity", F.when(F.col("package_dir") == "", 1).otherwise(10 + F.size(F.split("package_dir", "/"))))
    c = near.join(repos.select("repo_id", "package_manager"), "repo_id").withColumn("command", script_command(F.col("package_manager"), F.col("package_dir"), F.col("name"), F.col("package_name")))
    order = [F.desc("proximity"), F.desc("exact"), "package_dir", "seq"]
    once = c.withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "command").orderBy(*order))).where("k = 1")
    out = once.withColumn("ord", F.row_number().over(Window.partitionBy("plan_id").orderBy(*order))).where(F.col("ord") <= most)
    why = F.concat(F.when(F.col("package_dir") == "", F.lit("repository root")).otherwise(F.concat(F.lit("nearest package ("), "package_dir", F.lit(")"))), F.lit(" script "), "name")
    return out.select("plan_id", "ord", "command", why.alias("reason"), "package_dir")


def manifest_routes(files: DataFrame, context: DataFrame, languages: DataFrame) -> DataFrame:
    """``(plan_id, ord, command, reason, package_dir)``: the toolchain's own command, one a plan.

    A Rust plan is held to the deepest crate around its code; other commands reach all.
    """
    code = context.join(files.where("kind = 'code'").select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    crates = files.where(P.name(F.col("path")) == "Cargo.toml").select("repo_id", F.col("path").alias("manifest"), P.folder(F.col("path")).alias("package_dir")).where("package_dir <> ''")
    parts = F.split("path", "/")
    around = code.select("plan_id", "repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("package_dir")).distinct()
    near = around.join(crates, ["repo_id", "package_dir"]).join(languages.where("language = 'rust'"), "repo_id", "left_semi")
    near = near.groupBy("plan_id").agg(F.min_by(F.struct("manifest", "package_dir"), F.struct(-F.size(F.split("package_dir", "/")), "package_dir")).alias("crate"))
    plans = code.select("plan_id", "repo_id").distinct().join(manifest_command(files, languages), "repo_id").join(near, "plan_id", "left")
    held = F.col("crate").isNotNull()
    return plans.select(
        "plan_id", F.lit(1).alias("ord"), F.when(held, F.concat(F.lit("cargo test --manifest-path "), "crate.manifest")).otherwise(F.col("command")).alias("command"),
        F.when(held, F.col("crate.manifest")).otherwise(F.col("reason")).alias("reason"), F.coalesce("crate.package_dir", F.lit("")).alias("package_dir"))


def with_related(routes: DataFrame, related: DataFrame) -> DataFrame:
    """Routes with ``relatedFiles``: the related tests that lie in the folder a command runs in."""
    within = (F.col("package_dir") == "") | F.startswith(F.col("path"), F.concat("package_dir", F.lit("/")))
    hits = routes.select("plan_id", "ord", "package_dir").join(related.select("plan_id", F.col("ord").alias("k"), "path"), "plan_id").where(within)
    lists = hits.groupBy("plan_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x.path).alias("relatedFiles"))
    return routes.join(lists, ["plan_id", "ord"], "left").withColumn("relatedFiles", F.coalesce("relatedFiles", F.array().cast("array<string>")))


def risk_tokens(c: Column) -> Column:
    return F.array_distinct(F.concat(T.tokenize(c), F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")))


def risk_rules(spark) -> DataFrame:
    """Six rules: a row per term, raw and as its stem."""
    rows = [(i, a, s, w) for i, (a, s, words) in enumerate(RISKS) for w in words.split()]
    r = spark.createDataFrame(rows, "ord int, area string, severity string, word string")
    return r.select("ord", "area", "severity", F.explode(risk_tokens(F.col("word"))).alias("token")).distinct()


def risk_notes(context: DataFrame, changed: DataFrame) -> DataFrame:
    """``(plan_id, ord, area, severity)``: full severity where a changed path has a term, low where only context has.

    Both ``(plan_id, path)``; context in example or fixture folders is no evidence.
    """
    rules = F.broadcast(risk_rules(context.sparkSession))
    seen = context.where(~P.in_folder(F.col("path"), P.RISK_FREE_DIRS)).select("plan_id", "path", F.lit(False).alias("changed"))
    rows = seen.union(changed.select("plan_id", "path", F.lit(True))).select("plan_id", "changed", F.explode(risk_tokens(F.col("path"))).alias("token")).distinct()
    hits = rows.join(rules, "token").groupBy("plan_id", "ord", "area", "severity").agg(F.bool_or("changed").alias("changed"))
    return hits.select("plan_id", "ord", "area", F.when(F.col("changed"), F.col("severity")).otherwise("low").alias("severity"))


def gated_tests(files: DataFrame, routed: DataFrame) -> DataFrame:
    """Routed test files that skip tests: ``(repo_id, path, gate, env_names)``."""
    x = F.col("text")
    names = F.array_sort(F.array_distinct(F.concat(T.find_all(x, r"process\.env\.([A-Z][A-Z0-9_]*)", 1), T.find_all(x, r"""process\.env\[["']([A-Z][A-Z0-9_]*)["']\]""", 1))))
    gate = F.when(x.rlike(SKIP), "unconditional").when(x.rlike(CONDITIONAL_SKIP), "conditional")
    return files.where("is_test").join(routed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi").select("repo_id", "path", gate.alias("gate"), names.alias("env_names")).where("gate is not null")


def package_manager(paths: DataFrame) -> DataFrame:
    """``(repo_id, package_manager, conflict)``: lock files at the root, else nested ones that agree, else npm."""
    n = P.name(F.col("path"))
    kind = F.when(n.isin("pnpm-lock.yaml", "pnpm-workspace.yaml"), 0).when(n.isin("yarn.lock", ".yarnrc.yml"), 1).when(n.isin("bun.lock", "bun.lockb"), 2).when(n.isin("package-lock.json", "npm-shrinkwrap.json"), 3)
    names = F.array(*map(F.lit, ("pnpm", "yarn", "bun", "npm")))
    g = paths.select("repo_id", F.col("path").contains("/").alias("nested"), kind.alias("k")).groupBy("repo_id").agg(
        F.min(F.when(~F.col("nested"), F.col("k"))).alias("root"), F.count_distinct(F.when(~F.col("nested"), F.col("k"))).alias("roots"),
        F.min(F.when(F.col("nested"), F.col("k"))).alias("deep"), F.count_distinct(F.when(F.col("nested"), F.col("k"))).alias("deeps"))
    pick = F.when(F.col("roots") > 0, F.col("root")).when(F.col("deeps") == 1, F.col("deep")).otherwise(3)
    return g.select("repo_id", F.element_at(names, pick + 1).alias("package_manager"), ((F.col("roots") > 1) | ((F.col("roots") == 0) & (F.col("deeps") > 1))).alias("conflict"))
