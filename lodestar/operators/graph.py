"""Import edges and what lies within two hops of ranked files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..sources.tables import written

# Languages whose imports are read, and how specifiers resolve.
JS_EXTENSIONS = ".cjs .cts .js .jsx .mjs .mts .svelte .ts .tsx .vue".split()
RESOLVE = ".ts .tsx .mts .cts .js .jsx .mjs .cjs .vue .svelte".split()
COMPILED = {".js": (".ts", ".tsx"), ".mjs": (".mts",), ".cjs": (".cts",)}
# How a file names what it imports.  A pattern begins with its word, which is quickly found, and then looks back.
_IMPORT, _EXPORT, _REQUIRE = (rf"{w}(?<![A-Za-z0-9_]{w})" for w in ("import", "export", "require"))
SPECIFIERS = (
    _IMPORT + r"""\s+[^'"()]*?from\s*["']([^"'\n]+)["']""",
    _IMPORT + r"""\s*["']([^"'\n]+)["']""",
    _EXPORT + r"""\s+[^'"()]*?from\s*["']([^"'\n]+)["']""",
    _REQUIRE + r"""\s*\(\s*["']([^"'\n]+)["']\s*\)""",
    _IMPORT + r"""\s*\(\s*["']([^"'\n]+)["']\s*\)""",
)
MAX_FILES, MAX_EDGES = 5000, 200


def specifiers(text: Column) -> Column:
    found = {p: T.find_all(text, p, 1) for p in SPECIFIERS}
    required = SPECIFIERS[3]
    found[required] = F.when(text.contains("require"), found[required]).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*found.values()))


def fold_path(path: Column) -> Column:
    """``a/./b/../c`` as ``a/c``; null if it leads above the root."""
    step = lambda acc, s: (
        F.when(acc.isNull() | s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda a: F.array_join(a, "/"))


def candidates(root: Column) -> Column:
    """Paths that a resolved root may mean, in order."""
    last = P.name(root)
    ext = F.regexp_extract(last, r"[^/](\.[^./]*)$", 1)
    bare = root.substr(F.lit(1), F.length(root) - F.length(ext))
    none = F.array().cast("array<string>")
    compiled = none
    for e, sources in COMPILED.items():
        compiled = F.when(ext == e, F.array(*[F.concat(bare, F.lit(s)) for s in sources])).otherwise(compiled)
    plain = F.when(ext == "", F.array(*[F.concat(root, F.lit(e)) for e in RESOLVE])).otherwise(none)
    return F.concat(F.array(root), compiled, plain, F.array(*[F.concat(root, F.lit(f"/index{e}")) for e in RESOLVE]))


def roots_of(path: Column) -> Column:
    """All roots that have the path among their ``candidates``."""
    without = lambda end: F.when(path.endswith(end), T.cut(path, len(end)))
    ends = [without(e) for x in RESOLVE for e in (x, f"/index{x}")]
    compiled = [F.concat(without(s), F.lit(e)) for e, sources in COMPILED.items() for s in sources]
    return F.array_distinct(F.array_compact(F.array(path, *ends, *compiled)))


def workspace_roots(files: DataFrame) -> DataFrame:
    """``(repo_id, specifier, ord, root)`` of packages that manifests name."""
    m = files.where(P.name(F.col("path")) == "package.json").select("repo_id", P.folder(F.col("path")).alias("dir"), F.from_json("text", "name string, source string, module string, main string, types string").alias("m")).where("length(trim(m.name)) > 0")
    pre = F.when(F.col("dir") == "", F.lit("")).otherwise(F.concat("dir", F.lit("/")))
    declared = F.filter(F.transform(F.array("m.source", "m.module", "m.main", "m.types"), lambda e: F.when(e.isNotNull(), fold_path(F.concat(pre, e)))), lambda e: e.isNotNull())
    roots = F.concat(declared, F.array(F.concat(pre, F.lit("src/index")), F.concat(pre, F.lit("index"))))
    return m.select("repo_id", F.col("m.name").alias("specifier"), F.posexplode(roots).alias("ord", "root"))


def aliases(files: DataFrame) -> DataFrame:
    """``(repo_id, ord, prefix, suffix, target)`` of the path maps of compiler settings: by file, then pattern, then target."""
    c = files.where(F.col("path").rlike(r"(?i)(^|/)(?:tsconfig|jsconfig)(?:\.[^/]*)?\.json$")).select(
        "repo_id", "seq", P.folder(F.col("path")).alias("dir"), F.from_json("text", "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>").alias("c"))
    base = fold_path(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.coalesce("c.compilerOptions.baseUrl", F.lit("."))))
    rows = c.select("repo_id", "seq", base.alias("base"), F.posexplode("c.compilerOptions.paths").alias("at", "pattern", "targets"))
    rows = rows.select("repo_id", "seq", "at", "base", "pattern", F.posexplode("targets").alias("pos", "target")).withColumn("ord", F.struct("seq", "at", "pos"))
    star = F.instr("pattern", "*")
    whole = F.col("pattern")
    return rows.select(
        "repo_id", "ord",
        F.when(star == 0, whole).otherwise(F.substring_index(whole, "*", 1)).alias("prefix"),
        F.when(star == 0, "").otherwise(F.substring_index(whole, "*", -1)).alias("suffix"),
        fold_path(F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), F.col("target"))).alias("target"),
    ).where("target is not null")


def aliased(specs: DataFrame, known: DataFrame) -> DataFrame:
    """``specs(repo_id, specifier, ...)`` with ``root`` and ``ord`` of each alias of their repository that fits.

    A specifier is cut to the lengths that prefixes of its repository have, and these cuts
    meet the prefixes by equality.
    """
    lengths = known.groupBy("repo_id").agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # no longer than a specifier is of use
    fits = F.filter("_lengths", lambda n: n <= F.length("specifier"))
    cuts = specs.join(lengths, "repo_id").select(*specs.columns, F.explode(fits).alias("_n")).withColumn("prefix", F.col("specifier").substr(F.lit(1), F.col("_n"))).drop("_n")
    inner = F.expr("substring(specifier, length(prefix) + 1, greatest(0, length(specifier) - length(prefix) - length(suffix)))")
    both = cuts.join(known, ["repo_id", "prefix"]).where("endswith(specifier, suffix)")
    star = F.instr("target", "*")
    root = F.when(star == 0, F.col("target")).otherwise(F.concat(F.col("target").substr(F.lit(1), star - 1), inner, F.col("target").substr(star + 1, F.length("target"))))  # the first star alone
    return both.select(*specs.columns, root.alias("root"), "ord")


def _first_imports(files: DataFrame, read: DataFrame) -> DataFrame:
    """``(repo_id, src, spec_ord, dst)``: what each specifier of ``read(repo_id, path, text)`` leads to among ``files``."""
    specs = written(read.select("repo_id", F.col("path").alias("src"), F.posexplode(specifiers(F.col("text"))).alias("spec_ord", "specifier")))
    near = specs.where(F.col("specifier").startswith(".")).withColumn("root", fold_path(F.concat_ws("/", F.when(P.folder(F.col("src")) != "", P.folder(F.col("src"))), F.col("specifier")))).where("root <> ''").withColumn("ord", F.lit(0))
    far = specs.where(~F.col("specifier").startswith("."))
    named = far.join(workspace_roots(files), ["repo_id", "specifier"]).select("repo_id", "src", "spec_ord", "specifier", "root", "ord")
    mapped = aliased(far, aliases(files))
    place = lambda k, ord_: F.struct(F.lit(k).alias("kind"), ord_.alias("ord"))
    first_of = lambda c: F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("at"), c.alias("pos"))
    cols = ["repo_id", "src", "spec_ord", "specifier", "root"]
    roots = near.select(*cols, place(0, first_of(F.col("ord"))).alias("ord")).union(named.select(*cols, place(0, first_of(F.col("ord"))).alias("ord"))).union(mapped.select(*cols, place(1, F.col("ord")).alias("ord")))
    # paths come back as the few roots that may mean them, not roots as the many paths that they may mean
    known = files.select("repo_id", F.col("path").alias("dst"), F.explode(roots_of(F.col("path"))).alias("root"))
    found = roots.select("repo_id", "src", "spec_ord", "ord", "root").join(known, ["repo_id", "root"]).withColumn("cand", F.array_position(candidates(F.col("root")), F.col("dst"))).where("cand > 0")
    return found.groupBy("repo_id", "src", "spec_ord").agg(F.min_by("dst", F.struct("ord", "cand")).alias("dst")).where("src <> dst")


def _readable(files: DataFrame) -> DataFrame:
    return files.where(P.extension(F.col("path")).isin(*JS_EXTENSIONS) & (F.length("text") > 0))


def every_import(files: DataFrame) -> DataFrame:
    """``files(repo_id, path, text, seq)`` -> edges ``(repo_id, src, dst)`` of all files and all their imports."""
    return _first_imports(files, _readable(files).select("repo_id", "path", "text")).select("repo_id", "src", "dst").distinct()


def import_edges(files: DataFrame, max_files: int = MAX_FILES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """``files(repo_id, seq, path, text)`` -> edges ``(repo_id, src, dst)`` and cut counts per repository."""
    f = _readable(files)
    # keys alone are numbered; texts join what is to be read
    f_keys = f.select("repo_id", "seq", "path").withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("seq", "path")))
    read = f.select("repo_id", "path", "text").join(f_keys.where(F.col("n") <= max_files).select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    first = _first_imports(files, read)
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "src").orderBy("spec_ord")))
    cuts = f_keys.groupBy("repo_id").agg(F.count_if(F.col("n") > max_files).alias("truncated_files"))
    over = first.where(F.col("k") > max_edges).groupBy("repo_id").agg(F.count_distinct("src").alias("truncated_edges"))
    return first.where(F.col("k") <= max_edges).select("repo_id", "src", "dst").distinct(), cuts.join(over, "repo_id", "left").na.fill(0, ["truncated_edges"])


def neighbours(edges: DataFrame) -> DataFrame:
    """Both ways: what a file imports (``imported-by`` it), then what imports it (``imports``)."""
    return edges.select("repo_id", F.col("src").alias("at"), F.col("dst").alias("path"), F.lit("imported-by").alias("direction"), F.lit(0).alias("d")).union(
        edges.select("repo_id", F.col("dst").alias("at"), F.col("src").alias("path"), F.lit("imports").alias("direction"), F.lit(1).alias("d")))


def proximity(edges: DataFrame, seeds: DataFrame, by: list[str] = ["repo_id"]) -> DataFrame:  # noqa: B006
    """``seeds(by..., seed, ord)`` -> ``(by..., path, distance, seed, direction)``; the first hit wins.

    One hop goes by seed order, imports before importers, then path; two hops by the
    order in which the first were reached.  ``by`` begins with ``repo_id``: seeds of many
    tasks, and then what they reach, meet the edges of a repository, which are not copied.
    """
    near = neighbours(edges)
    at = [*by, "path"]
    is_seed = seeds.select(*by, F.col("seed").alias("path"))
    one = near.join(seeds.withColumnRenamed("seed", "at"), ["repo_id", "at"]).join(is_seed, at, "left_anti")
    first = Window.partitionBy(*at).orderBy("ord", "d")
    one = one.withColumn("k", F.row_number().over(first)).where("k = 1").select(*at, F.col("at").alias("seed"), "direction", "ord", "d")
    one = written(one.withColumn("reached", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "d", *T.in_order("path")))))
    two = near.join(one.select(*by, F.col("path").alias("at"), "seed", "reached"), ["repo_id", "at"]).join(is_seed, at, "left_anti").join(one.select(*at), at, "left_anti")
    two = two.withColumn("k", F.row_number().over(Window.partitionBy(*at).orderBy("reached", "d"))).where("k = 1")
    cols = (*at, "distance", "seed", "direction")
    return one.withColumn("distance", F.lit(1)).select(*cols).union(two.withColumn("distance", F.lit(2)).select(*cols))
