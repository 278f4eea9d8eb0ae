"""Files, scripts, histories, diffs and tasks as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import text as X
from .tables import written

MAX_SAMPLE, MAX_COMMITS, MAX_COMMIT_FILES, MAX_ISSUE = 64_000, 1_000, 30, 20_000

FILES = T.StructType([
    T.StructField("repo_id", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("path", T.StringType(), False),
    T.StructField("extension", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("is_test", T.BooleanType()),
    T.StructField("is_source", T.BooleanType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("text_complete", T.BooleanType()), T.StructField("skip_reason", T.StringType()),
])


def directory(spark: SparkSession, root: str, repo_id: str = "repo", keep_content: bool = True) -> DataFrame:
    """``(repo_id, path, size_bytes, content)`` under ``root``, by path; ignored and generated folders left out, vendor kept."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    rel = F.call_function("substring_index", F.col("path"), base, F.lit(-1))
    skip = [*P.IGNORED_DIRS, *[d for d in P.GENERATED_DIRS if d != "vendor"]]
    out = df.select(F.lit(repo_id).alias("repo_id"), rel.alias("path"), F.col("length").alias("size_bytes"), "content")
    out = out.where(~F.exists(P.folders(F.col("path")), lambda s: s.isin(*skip)))
    return out if keep_content else out.drop("content")


def sample(content: Column, size: Column, limit: int = MAX_SAMPLE) -> tuple[Column, Column]:
    """(text, skip reason): too large or binary content gives an empty text; bad bytes become U+FFFD."""
    binary = F.instr(F.decode(content, "ISO-8859-1"), "\0") > 0
    reason = F.when(content.isNull(), "unreadable").when(size > limit, "too-large").when(binary, "not-text")
    return F.when(reason.isNull(), F.make_valid_utf8(content.cast("string"))).otherwise(""), reason


def file_records(listing: DataFrame, limit: int = MAX_SAMPLE) -> DataFrame:
    """``listing(repo_id, path, size_bytes, content)`` -> files; only sources keep a text, components only their scripts.

    ``seq`` follows the order of the paths in all; a package manifest may be UTF-16.
    """
    p = F.col("path")
    src = P.is_source(p)
    listing = listing.orderBy("repo_id", "path").withColumn("seq", F.monotonically_increasing_id())  # sorted over all partitions
    text, reason = sample(F.col("content"), F.col("size_bytes"), limit)
    wide = (P.name(p) == "package.json") & (reason == "not-text")
    text = F.when(wide, decode_text(F.col("content"))).otherwise(text)
    reason = F.when(wide, None).otherwise(reason)
    component = P.extension(p).isin(".vue", ".svelte")
    return listing.select(
        "repo_id", "seq", "path", P.extension(p).alias("extension"), "size_bytes", P.is_test(p).alias("is_test"), src.alias("is_source"), P.kind(p).alias("kind"),
        F.when(~src, "").when(component, P.script_blocks(text)).otherwise(text).alias("text"),
        F.when(src, reason.isNull()).alias("text_complete"), F.when(src, reason).alias("skip_reason"))


def decode_text(content: Column) -> Column:
    """UTF-8 or UTF-16 with or without a mark: zero bytes on one side of most pairs tell the order."""
    head = F.hex(F.substring(content, 1, 3))
    raw = F.decode(F.substring(content, 1, 2000), "ISO-8859-1")
    # in big-endian text the first byte of most pairs is zero, in little-endian the second
    pairs = X.find_all(raw, r"(?s)..")
    n = F.greatest(F.size(pairs), F.lit(1))
    first = F.size(F.filter(pairs, lambda x: x.startswith("\0"))) / n
    second = F.size(F.filter(pairs, lambda x: x.endswith("\0"))) / n
    le = head.startswith("FFFE") | ((second >= 0.3) & (first < 0.1))
    be = head.startswith("FEFF") | ((first >= 0.3) & (second < 0.1))
    text = F.when(le, F.decode(content, "UTF-16LE")).when(be, F.decode(content, "UTF-16BE")).otherwise(F.make_valid_utf8(content.cast("string")))
    return X.rx(text, "^﻿")


def package_scripts(files: DataFrame) -> DataFrame:
    """``(repo_id, seq, name, command, package_dir, package_name)`` of all manifests."""
    m = files.where(P.name(F.col("path")) == "package.json").select("repo_id", "path", F.from_json("text", "name string, scripts map<string,string>").alias("m"))
    rows = m.select("repo_id", "path", F.col("m.name").alias("package_name"), F.posexplode(F.map_entries("m.scripts")).alias("seq", "e"))
    return rows.select("repo_id", "seq", F.col("e.key").alias("name"), F.col("e.value").alias("command"), P.folder(F.col("path")).alias("package_dir"), "package_name")


def history(log: DataFrame, files: DataFrame, commits: int = MAX_COMMITS, most: int = MAX_COMMIT_FILES) -> DataFrame:
    """``log(repo_id, hash, committed_at, files array)`` -> rows ``(repo_id, hash, path)``.

    The newest ``commits`` count; those of over ``most`` files leave, before files that
    no longer exist do.
    """
    w = Window.partitionBy("repo_id").orderBy(F.desc("committed_at"), "hash")
    kept = log.withColumn("k", F.row_number().over(w)).where((F.col("k") <= commits) & (F.size("files") <= most))
    return kept.select("repo_id", "hash", F.explode("files").alias("path")).distinct().join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def diff_paths(diffs: DataFrame, untracked: DataFrame) -> DataFrame:
    """Changed paths of ``diffs(repo_id, diff_text, spec)``: those the headers name, and untracked ones unless the spec is a range."""
    named = diffs.select("repo_id", F.explode(X.find_all(F.col("diff_text"), r"(?m)^diff --git a/.* b/(.*)$", 1)).alias("path"))
    open_ = diffs.where(~F.coalesce(F.col("spec"), F.lit("")).contains("..")).select("repo_id")
    return named.union(untracked.join(open_, "repo_id", "left_semi").select("repo_id", "path")).distinct()


def _zero_split(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\0"), lambda x: x != "")


def git_listing(out: DataFrame) -> DataFrame:
    """``out(repo_id, listed, staged)``, what ``git ls-files -z`` and its ``--stage`` form print -> ``(repo_id, seq, path, is_submodule)``.

    Each path once, in the order of first sight; links of mode 160000 are submodules.  A
    long listing may come in pieces, numbered in order by a further column ``part``.
    """
    if "part" not in out.columns:
        out = out.withColumn("part", F.lit(0))
    staged = F.filter(F.transform(_zero_split(F.col("staged")), lambda e: F.regexp_extract(e, r"(?is)^160000\s+[0-9a-f]+\s+\d+\t(.+)$", 1)), lambda x: x != "")
    links = out.select("repo_id", F.explode(staged).alias("_link")).select("repo_id", F.translate("_link", "\\", "/").alias("_link")).distinct().withColumn("is_submodule", F.lit(True))
    rows = out.select("repo_id", "part", F.posexplode(_zero_split(F.col("listed"))).alias("pos", "path"))
    rows = written(rows.groupBy("repo_id", "path").agg(F.min(F.struct("part", "pos")).alias("at")).select("repo_id", "path", "at.part", "at.pos"))
    # places within a piece, after those of the pieces before: no repository is sorted as a whole
    sizes = rows.groupBy("repo_id", "part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("repo_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("repo_id", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("repo_id", "part").orderBy("pos")) - 1
    rows = rows.withColumn("_at", place).join(before, ["repo_id", "part"]).select("repo_id", (F.col("_before") + F.col("_at")).alias("seq"), "path", F.translate("path", "\\", "/").alias("_link"))
    return rows.join(links, ["repo_id", "_link"], "left").select("repo_id", "seq", "path", F.coalesce("is_submodule", F.lit(False)).alias("is_submodule"))


def working_tree(out: DataFrame, untracked: DataFrame | None = None) -> DataFrame:
    """``out(repo_id, names)``, what ``git diff --name-only HEAD`` prints -> ``(repo_id, path)`` of staged and unstaged changes.

    ``untracked(repo_id, path)`` are counted where a caller hands them in.
    """
    names = F.filter(F.transform(F.split(F.coalesce("names", F.lit("")), r"\r?\n"), lambda x: F.translate(F.trim(x), "\\", "/")), lambda x: x != "")
    changed = out.select("repo_id", F.explode(names).alias("path"))
    if untracked is not None:
        changed = changed.union(untracked.join(out.select("repo_id"), "repo_id", "left_semi").select("repo_id", "path"))
    return changed.distinct()


def is_safe_ref(c: Column) -> Column:
    """A branch or tag name that git takes."""
    bad = r"(?i)^[.-]|[./]$|[\s\x00-\x1f\x7f~^:?*\[\\]|\.\.|//|@\{|(?:^|/)\.|(?:^|/)[^/]*\.lock(?:/|$)"
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= 255) & (c != "@") & ~c.rlike(bad), F.lit(False))


def issue_shorthand(c: Column) -> Column:
    """The link that ``owner/name#12`` stands for; a link of the host as it is; null for anything else."""
    pattern = r"^([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]+)#([1-9]\d*)$"
    x = F.trim(c)
    part = lambda k: F.regexp_extract(x, pattern, k)
    link = F.concat(F.lit("https://github.com/"), part(1), F.lit("/"), part(2), F.lit("/issues/"), part(3))
    return F.when(x.rlike(r"(?i)^https?://(?:www\.|api\.)?github\.com/"), x).when(x.rlike(pattern) & part(1).rlike("[A-Za-z]"), link)


def without_artifacts(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The command's own outputs are no part of what it reads."""
    return files.join(artifacts, ["repo_id", "path"], "left_anti")


def issue_reference(url: Column) -> Column:
    """``(owner, name, kind, number)`` of an issue or pull request link, null for any other."""
    pattern = r"^https://github\.com/([A-Za-z0-9-]+)/([A-Za-z0-9._-]+)/(issues|pull)/(\d+)(?:[/?#].*)?$"
    part = lambda k: F.regexp_extract(url, pattern, k)
    return F.when(url.rlike(pattern), F.struct(part(1).alias("owner"), part(2).alias("name"), part(3).alias("kind"), part(4).cast("bigint").alias("number")))


def issue_text(title: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", title, F.substring(body, 1, MAX_ISSUE))


def snapshot_key(*parts: Column) -> Column:
    """Key of a scan: what it depends on, joined by a character that no part holds."""
    return F.sha2(F.concat_ws("\0", *parts), 256).substr(1, 24)


def cached_scan(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """Files of an exact state from ``folder``, built and written there the first time."""
    path = f"{folder.rstrip('/')}/scan-{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def documents_as_files(documents: DataFrame, limit: int | None = MAX_SAMPLE) -> DataFrame:
    """Documents under paths made of their source, language and id, so that path rules apply to them.

    Texts of over ``limit`` bytes are left unread, as in a scan; none are without a limit.
    """
    b = F.pmod(F.col("doc_id"), F.lit(10))
    suffix = F.when(b <= 4, ".ts").when(b == 5, ".py").when(b == 6, ".test.ts").when(b == 7, ".md").when(b == 8, ".json").otherwise(".ts")
    path = F.concat("source", F.when(b == 9, "/dist/").otherwise("/src/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)
    size = F.octet_length("text").cast("bigint")
    d = documents.select("doc_id", "text", path.alias("path"), size.alias("size_bytes"))
    p = F.col("path")
    fits = F.lit(True) if limit is None else F.col("size_bytes") <= limit
    return d.select(
        F.lit("docs").alias("repo_id"), F.col("doc_id").alias("seq"), "path", P.extension(p).alias("extension"), "size_bytes", P.is_test(p).alias("is_test"), P.is_source(p).alias("is_source"), P.kind(p).alias("kind"),
        F.when(fits, F.col("text")).otherwise("").alias("text"), fits.alias("text_complete"), F.when(~fits, "too-large").alias("skip_reason"))
