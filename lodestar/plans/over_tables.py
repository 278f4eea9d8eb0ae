"""Functions of texts, paths, listings and histories over the whole driver tables, with their SQL.

What tasks, tools and repositories would hold is derived from the rows, so that each rule
meets as many cases as there are rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import backtest, evaluation, exclusion, plan, ranking, reports
from ..operators.signals import quotes
from ..sources import scan
from ..sources.tables import spread, written
from . import render
from . import sql as S
from .catalogue import CASES_SQL, RANK_SQL, doc_cases, doc_files, document_tasks, passages, query, t


def _n(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _docs(spark, sf_dir):
    return spread(t(spark, sf_dir, "documents"))


def _mod(c: str, k: int) -> Column:
    return F.pmod(F.col(c), F.lit(k))


# ---------------------------------------------------------------- texts

@query(r"""WITH d AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents),
m AS (SELECT doc_id, [CASE WHEN (i + doc_id) % 3 = 0 OR doc_id % 7 = 0 THEN '- [ ] ' || ls[i + 1] ELSE ls[i + 1] END FOR i IN range(0, len(ls))] AS ls FROM d),
k AS (SELECT *, list_filter(ls, lambda s: NOT regexp_matches(s, '^\s*[-*]\s*\[\s\]\s+')) AS kept FROM m),
s AS (SELECT *, len(ls) - len(kept) AS n, len(list_filter(kept, lambda s: length(trim(s)) > 0 AND NOT regexp_matches(trim(s), '^#{1,6}\s+'))) > 0 AS solid FROM k)
SELECT doc_id, md5(CASE WHEN n > 0 AND solid THEN array_to_string(kept, chr(10)) ELSE array_to_string(ls, chr(10)) END) AS text_md5, CAST(CASE WHEN solid THEN n ELSE 0 END AS INTEGER) AS removed, CAST(CASE WHEN solid THEN 0 ELSE n END AS INTEGER) AS preserved FROM s""")
def document_checklists(spark, sf_dir):
    """Every third line of a document as an unchecked item, all lines of every seventh document."""
    open_ = lambda x, i: F.when((F.pmod(i + F.col("doc_id"), F.lit(3)) == 0) | (_mod("doc_id", 7) == 0), F.concat(F.lit("- [ ] "), x)).otherwise(x)
    x = _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", r"\r?\n"), open_), "\n").alias("x"))
    return x.select("doc_id", T.checklist(F.col("x")).alias("c")).select("doc_id", F.md5("c.text").alias("text_md5"), "c.removed", "c.preserved")


@query("SELECT doc_id, left(text, list_max([k FOR k IN range(0, 301) IF octet_length(encode(left(text, k))) <= 1 + doc_id % 300])) AS s FROM documents")
def document_cuts(spark, sf_dir):
    """Documents cut to so many bytes, at a whole character."""
    return _docs(spark, sf_dir).select("doc_id", T.truncate_utf8(F.substring("text", 1, 301), (1 + _mod("doc_id", 300)).cast("int")).alias("s"))


@query("SELECT doc_id, repeat(chr(CAST(97 + doc_id % 26 AS INTEGER)), k) AS token FROM documents, (SELECT unnest(range(3, 9)) AS k) WHERE k >= doc_id % 7 AND k <= doc_id % 11")
def document_patterns(spark, sf_dir):
    """Patterns with counts, put after each document: the runs that they stand for."""
    pattern = F.concat("text", F.lit(" /"), F.char(97 + _mod("doc_id", 26)), F.lit("{"), _n(_mod("doc_id", 7)), F.lit(","), _n(_mod("doc_id", 11)), F.lit("}/"))
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.regex_tokens(pattern)).alias("token"))


@query(r"""WITH x AS (SELECT doc_id, repeat('`', CAST(doc_id % 5 AS INTEGER)) || source || repeat(' ', CAST(doc_id % 2 AS INTEGER)) || repeat('''', CAST(doc_id % 3 AS INTEGER)) || lang || repeat('`', CAST(doc_id % 4 AS INTEGER)) AS x, greatest(doc_id % 5, doc_id % 4) AS run FROM documents),
p AS (SELECT *, CASE WHEN regexp_matches(x, '^[` ]|[` ]$') THEN ' ' ELSE '' END AS pad FROM x)
SELECT doc_id, repeat('`', CAST(run + 1 AS INTEGER)) || pad || x || pad || repeat('`', CAST(run + 1 AS INTEGER)) AS span, repeat('`', CAST(greatest(3, run + 1) AS INTEGER)) AS fence,
  CASE WHEN regexp_matches(x, '^[a-z0-9]+$') THEN x ELSE '''' || replace(x, '''', '''\''''') || '''' END AS quoted FROM p""")
def document_spans(spark, sf_dir):
    """Names with back-ticks, blanks and quotes as Markdown code, under a fence, and for a shell."""
    times = lambda s, k: F.repeat(F.lit(s), _mod("doc_id", k).cast("int"))
    x = F.concat(times("`", 5), "source", times(" ", 2), times("'", 3), "lang", times("`", 4))
    return _docs(spark, sf_dir).select("doc_id", x.alias("x")).select("doc_id", T.code_span(F.col("x")).alias("span"), T.safe_fence(F.col("x")).alias("fence"), T.shell_quote(F.col("x")).alias("quoted"))


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations), k AS (SELECT * FROM w WHERE len(w) >= 4)
SELECT conv_id, turn, p.pos, CASE p.pos WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN w[3] ELSE w[4] || ' end' END AS value FROM k, (SELECT unnest([0, 1, 2]) AS pos) AS p""")
def conversation_quotes(spark, sf_dir):
    """Two words in quotes, one in back-ticks and an open end, of every turn of four words or more."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w")).where(F.size("w") >= 4)
    x = F.concat(F.lit('say "'), F.col("w")[0], F.lit(" "), F.col("w")[1], F.lit("\" it's `"), F.col("w")[2], F.lit("` then “"), F.col("w")[3], F.lit(" end"))
    return c.select("conv_id", "turn", F.posexplode(quotes(x)).alias("pos", "q")).select("conv_id", "turn", "pos", "q.value")


@query("SELECT doc_id, doc_id % 5 AS kind, md5(text) AS text_md5 FROM documents")
def document_encodings(spark, sf_dir):
    """Documents as UTF-8 and UTF-16 of either order, with a mark and without, read back."""
    k, x = _mod("doc_id", 5), F.col("text")
    mark = lambda h: F.unhex(F.lit(h))
    content = (
        F.when(k == 0, F.encode(x, "UTF-8")).when(k == 1, F.concat(mark("EFBBBF"), F.encode(x, "UTF-8"))).when(k == 2, F.concat(mark("FFFE"), F.encode(x, "UTF-16LE")))
        .when(k == 3, F.concat(mark("FEFF"), F.encode(x, "UTF-16BE"))).otherwise(F.encode(x, "UTF-16LE")))
    return _docs(spark, sf_dir).select("doc_id", k.alias("kind"), content.alias("content")).select("doc_id", "kind", F.md5(scan.decode_text(F.col("content"))).alias("text_md5"))


@query(r"SELECT doc_id, md5('+' || regexp_replace(text, '\r?\n', chr(10) || '+', 'g') || chr(10) || '+last') AS added_md5 FROM documents")
def document_added_lines(spark, sf_dir):
    """Documents as what a diff adds, between lines that it keeps and takes away."""
    diff = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n kept\n+"), T.rx(F.col("text"), r"\r?\n", "\n+"), F.lit("\n-gone\n+last"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.added_lines(diff)).alias("added_md5"))


# ---------------------------------------------------------------- paths and mentions

@query(f"WITH {S.FILES} SELECT path, {S.module_stem('path')} AS stem FROM files")
def document_stems(spark, sf_dir):
    return doc_files(spark, sf_dir).select("path", P.module_stem(F.col("path")).alias("stem"))


@query(f"""WITH {S.FILES}, built AS (SELECT seq, path FROM files UNION ALL SELECT seq, replace(replace(path, '/src/', '/build/'), '.ts', '.js') FROM files WHERE seq % 3 = 0 AND ends_with(path, '.ts')),
c AS (SELECT path, {S.module_stem('path')} AS stem, {S.is_generated('path')} AS g, {S.is_backup('path')} AS b, {S.is_source('path')} AS s FROM built)
SELECT DISTINCT a.path, m.path AS maintained FROM c a JOIN c m ON a.stem = m.stem AND a.path <> m.path WHERE a.g AND NOT m.g AND NOT m.b AND m.s""")
def document_twins(spark, sf_dir):
    """Built copies of every third source: an equi-join on the stem finds what each is made from."""
    f = doc_files(spark, sf_dir).select("seq", "path")
    p = F.col("path")
    f = f.union(f.where((_mod("seq", 3) == 0) & p.endswith(".ts")).select("seq", F.replace(F.replace(p, F.lit("/src/"), F.lit("/build/")), F.lit(".ts"), F.lit(".js"))))
    f = f.select("path", P.module_stem(p).alias("stem"), P.is_source(p).alias("s"), P.is_generated(p).alias("g"), P.is_backup(p).alias("b"))
    m = f.where("s and not g and not b").select("stem", F.col("path").alias("maintained"))
    return f.where("g").join(m, "stem").where("path <> maintained").select("path", "maintained").distinct()


_ASKED = """asked AS (SELECT seq, path, CASE seq % 6 WHEN 0 THEN upper(path) WHEN 1 THEN replace(regexp_extract(path, '[^/]+/[^/]+$'), '/', chr(92)) WHEN 2 THEN regexp_extract(path, '[^/]+$') WHEN 3 THEN regexp_extract(path, '/([^/.]+)[^/]*$', 1) WHEN 4 THEN 'vendor/' || path ELSE 'x' || regexp_extract(path, '[^/]+$') END AS mention FROM files)"""


def _asked(spark, sf_dir):
    p, k = F.col("path"), _mod("seq", 6)
    tail, name = F.substring_index(p, "/", -2), P.name(p)
    mention = F.when(k == 0, F.upper(p)).when(k == 1, F.translate(tail, "/", "\\")).when(k == 2, name).when(k == 3, F.substring_index(name, ".", 1)).when(k == 4, F.concat(F.lit("vendor/"), p)).otherwise(F.concat(F.lit("x"), name))
    return doc_files(spark, sf_dir).select("seq", "path", mention.alias("mention"))


@query(f"""WITH {S.FILES}, {_ASKED} SELECT path, mention, lower(path) = m OR ends_with(lower(path), '/' || m) OR (contains(path, '/') AND ends_with(m, '/' || lower(path)))
 OR (NOT contains(m, '/') AND NOT contains(m, '.') AND regexp_replace({S.name_of('lower(path)')}, '\\.[^.]+$', '') = m) AS matches FROM (SELECT *, lower(replace(mention, chr(92), '/')) AS m FROM asked)""")
def document_path_mentions(spark, sf_dir):
    """Whole paths in capitals, tails with backslashes, names with and without their ending, longer paths and other names."""
    return _asked(spark, sf_dir).select("path", "mention", P.matches_mention(F.col("path"), F.col("mention")).alias("matches"))


@query(f"""WITH {S.FILES} SELECT seq AS doc_id, CASE seq % 5 WHEN 0 THEN 'full-path' WHEN 1 THEN 'path-suffix' WHEN 2 THEN 'basename' WHEN 3 THEN 'full-path' ELSE 'none' END AS tier FROM files""")
def document_mention_tiers(spark, sf_dir):
    """How much of its own path a task of each document gives away."""
    p, k = F.col("path"), _mod("seq", 5)
    said = F.when(k == 0, p).when(k == 1, F.substring_index(p, "/", -2)).when(k == 2, P.name(p)).when(k == 3, F.concat(F.lit("https://github.com/o/r/blob/main/"), p, F.lit("#L3"))).otherwise(F.concat(F.lit("x"), P.name(p)))
    return doc_files(spark, sf_dir).select(F.col("seq").alias("doc_id"), backtest.mention_tier(F.concat(F.lit("look at "), said, F.lit(" now")), p).alias("tier"))


@query(f"""WITH {S.FILES} SELECT seq AS doc_id, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ignored' WHEN 2 THEN 'no-such-path' ELSE 'outside' END AS cause FROM files""")
def document_missing(spark, sf_dir):
    """Why a path was not scanned: half of what is asked for was not listed, or cannot be."""
    f = doc_files(spark, sf_dir).select("repo_id", "seq", "path")
    k = _mod("seq", 4)
    asked = f.select("repo_id", "seq", F.when(k == 3, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), F.lit("not-scanned").alias("status"))
    limited = f.select(F.lit("other").alias("repo_id")).limit(1)
    out = plan.clarify_missing(asked, f.where(k == 0).select("repo_id", "path"), f.where(k == 1).select("repo_id", "path"), limited)
    return out.select(F.col("seq").alias("doc_id"), "cause")


# ---------------------------------------------------------------- what tools print

@query(f"""WITH {S.FILES}, r AS (SELECT regexp_extract(path, '^[^/]*') AS repo_id, path, seq % 9 = 0 AS is_submodule FROM files) SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1 AS seq, path, is_submodule FROM r""")
def document_git_listing(spark, sf_dir):
    """What git prints of the paths of each source, some as links to submodules."""
    f = doc_files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("repo_id"), "path", (_mod("seq", 9) == 0).alias("link"))
    f = f.repartitionByRange("repo_id", "path").withColumn("part", F.spark_partition_id())  # listings in pieces, none as one row
    zero = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\0")
    staged = F.concat(F.when(F.col("link"), "160000 ").otherwise("100644 "), F.repeat(F.lit("a"), 40), F.lit(" 0\t"), "path")
    out = f.groupBy("repo_id", "part").agg(F.concat(zero("path"), F.lit("\0"), F.min("path"), F.lit("\0")).alias("listed"), F.concat(zero(staged), F.lit("\0")).alias("staged"))
    return scan.git_listing(out)


_WORK = "r AS (SELECT regexp_extract(path, '^[^/]*') AS repo_id, seq, path FROM files)"


@query(f"WITH {S.FILES}, {_WORK} SELECT DISTINCT repo_id, path FROM r WHERE seq % 3 <> 2 UNION SELECT repo_id, path || '.new' FROM r WHERE seq % 5 = 0")
def document_working_tree(spark, sf_dir):
    """Changed names as git prints them, with backslashes and blank lines, and untracked files of the same repositories."""
    f = doc_files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("repo_id"), "seq", "path")
    names = F.array_join(F.array_sort(F.collect_list(F.when(_mod("seq", 3) == 0, F.col("path")).when(_mod("seq", 3) == 1, F.concat(F.translate("path", "/", "\\"), F.lit("\r\n"))))), "\n")
    more = f.where(_mod("seq", 5) == 0).select("repo_id", F.concat("path", F.lit(".new")).alias("path"))
    return scan.working_tree(f.groupBy("repo_id").agg(names.alias("names")), more)


@query(f"WITH {S.FILES}, {_WORK} SELECT DISTINCT repo_id, path FROM r WHERE seq % 3 = 0 UNION SELECT repo_id, path FROM r WHERE seq % 3 = 1 AND right(repo_id, 1) <> '7' AND repo_id IN (SELECT repo_id FROM r)")
def document_diff_paths(spark, sf_dir):
    """Paths that diffs name, and untracked ones where the diff is no range."""
    f = doc_files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("repo_id"), "seq", "path")
    head = F.when(_mod("seq", 3) == 0, F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n+x")))
    diffs = f.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(head)), "\n").alias("diff_text")).withColumn("spec", F.when(F.col("repo_id").endswith("7"), F.lit("main..head")))
    return scan.diff_paths(diffs, f.where(_mod("seq", 3) == 1).select("repo_id", "path"))


@query("""WITH v AS (SELECT p_partkey AS n, CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN '   ' WHEN 3 THEN p_brand || chr(92) || p_size ELSE '!' || p_type END AS value FROM part),
c AS (SELECT n, replace(trim(value), chr(92), '/') AS pattern FROM v) SELECT min(n) AS n, pattern FROM c WHERE pattern <> '' AND NOT starts_with(pattern, '#') GROUP BY pattern""")
def part_ignore_lines(spark, sf_dir):
    """Lines of an ignore file, one for each part: comments, blanks, backslashes and repeats."""
    k = _mod("p_partkey", 5)
    value = F.when(k == 0, F.concat(F.lit("# "), "p_name")).when(k == 1, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(k == 2, F.lit("   ")).when(k == 3, F.concat("p_brand", F.lit("\\"), _n("p_size"))).otherwise(F.concat(F.lit("!"), "p_type"))
    return exclusion.parse_ignore_file(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), value.alias("value")))


@query("SELECT p_partkey, p_partkey % 9 IN (0, 1) AS safe FROM part")
def part_refs(spark, sf_dir):
    """Branch names of parts, with all that git does not take."""
    base, k = F.concat(F.lit("feature/"), F.replace("p_name", F.lit(" "), F.lit("-"))), _mod("p_partkey", 9)
    end = lambda s: F.concat(base, F.lit(s))
    ref = F.when(k == 0, base).when(k == 1, end("_v1.2")).when(k == 2, end("..x")).when(k == 3, end(".lock")).when(k == 4, end("@{1}")).when(k == 5, end(" x")).when(k == 6, F.concat(F.lit("-"), base)).when(k == 7, end("/.x")).otherwise(end("//x"))
    return t(spark, sf_dir, "part").select("p_partkey", scan.is_safe_ref(ref).alias("safe"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://github.com/owner' || c_custkey || '/name.x/issues/' || (c_custkey + 1) WHEN 1 THEN 'https://github.com/o/r/issues/' || (c_custkey + 1) END AS link FROM customer""")
def customer_shorthands(spark, sf_dir):
    """Short names of issues, whole links, and what is neither."""
    k, n = _mod("c_custkey", 4), _n(F.col("c_custkey") + 1)
    said = F.when(k == 0, F.concat(F.lit(" owner"), _n("c_custkey"), F.lit("/name.x#"), n)).when(k == 1, F.concat(F.lit("https://github.com/o/r/issues/"), n)).when(k == 2, F.concat(F.lit("123/name#"), F.lit("0"), n)).otherwise(F.concat(F.lit("#"), n))
    return t(spark, sf_dir, "customer").select("c_custkey", scan.issue_shorthand(said).alias("link"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN 'owner' || c_custkey END AS owner, CASE c_custkey % 3 WHEN 0 THEN 'issues' WHEN 1 THEN 'pull' END AS kind, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey END AS number FROM customer""")
def customer_links(spark, sf_dir):
    """Links of issues and pull requests, with anchors and queries, and others."""
    k = _mod("c_custkey", 3)
    url = F.concat(F.lit("https://github.com/owner"), _n("c_custkey"), F.when(k == 0, "/r/issues/").when(k == 1, "/r/pull/").otherwise("/r/wiki/"), _n("c_custkey"), F.when(k == 0, "#top").otherwise("?x=1"))
    return t(spark, sf_dir, "customer").select("c_custkey", scan.issue_reference(url).alias("r")).select("c_custkey", "r.owner", "r.kind", "r.number")


@query("""SELECT 'shop' AS repo_id, name, 'packages/part' || p_partkey AS package_dir, '@shop/' || replace(p_name, ' ', '-') AS package_name, CASE name WHEN 'test' THEN 'run ' || p_brand ELSE 'build ' || p_size END AS command FROM part, (SELECT unnest(['test', 'build']) AS name)""")
def part_scripts(spark, sf_dir):
    """Scripts of a manifest for each part."""
    text = F.to_json(F.struct(F.concat(F.lit("@shop/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"), F.struct(F.concat(F.lit("run "), "p_brand").alias("test"), F.concat(F.lit("build "), _n("p_size")).alias("build")).alias("scripts")))
    f = t(spark, sf_dir, "part").select(F.lit("shop").alias("repo_id"), F.concat(F.lit("packages/part"), _n("p_partkey"), F.lit("/package.json")).alias("path"), text.alias("text"))
    return scan.package_scripts(f).select("repo_id", "name", "package_dir", "package_name", "command")


# ---------------------------------------------------------------- histories and scores

@query("""WITH l AS (SELECT DISTINCT o_orderpriority AS repo_id, o_orderkey, o_orderdate, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey), g AS (SELECT repo_id, o_orderkey, o_orderdate, count(l_partkey) AS n FROM l GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS k FROM g)
SELECT repo_id, CAST(o_orderkey AS VARCHAR) AS hash, 'part/' || l_partkey AS path FROM l JOIN c USING (repo_id, o_orderkey) WHERE k <= 1000 AND n <= 30 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)""")
def order_history(spark, sf_dir):
    """Orders as the history of their priority's repository: the newest thousand, of parts that are still there."""
    path = lambda c: F.concat(F.lit("part/"), _n(c))
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(path("l_partkey")).alias("files"))
    log = t(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(F.col("o_orderpriority").alias("repo_id"), _n("o_orderkey").alias("hash"), F.col("o_orderdate").alias("committed_at"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    repos = log.select("repo_id").distinct()
    there = t(spark, sf_dir, "part").where(_mod("p_partkey", 10) != 3).select(path("p_partkey").alias("path"))
    return scan.history(log, repos.join(there))  # a row for each repository and part


@query("""WITH c AS (SELECT lang, doc_id % 3 = 0 AS a, doc_id % 4 = 0 OR doc_id % 35 = 3 AS b FROM documents), x AS (SELECT lang, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM c GROUP BY lang)
SELECT lang, only_a, only_b, round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM unnest(range(0, least(only_a, only_b) + 1)) AS r(i))), 6) AS p FROM x""")
def document_mcnemar(spark, sf_dir):
    """Exact paired tests of two rules over the documents of each language, however many differ."""
    d = t(spark, sf_dir, "documents").select("lang", (_mod("doc_id", 3) == 0).alias("a"), ((_mod("doc_id", 4) == 0) | (_mod("doc_id", 35) == 3)).alias("b"))
    return evaluation.mcnemar(d, "a", "b", ["lang"])


@query(f"""WITH {CASES_SQL}, c AS (SELECT list_position(['low', 'medium', 'high'], confidence) AS got, CASE task_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS most FROM cases)
SELECT round(avg((got > most)::INT), 3) AS false_confidence_rate, count(*) FILTER (got <= most) AS passed, count(*) AS n FROM c""")
def passage_false_confidence(spark, sf_dir):
    """Confidence of the search for each passage against what its number allows."""
    most = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (_mod("task_id", 3) + 1).cast("int"))
    return evaluation.false_confidence(doc_cases(spark, sf_dir).withColumn("max_confidence", most))


@query(r"""WITH b AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM benchmark) SELECT item_id, len(w) >= 2 AS mentioned FROM b""")
def passage_mentions(spark, sf_dir):
    """Whether a passage names the file that it expects: all do in whose path two of its words stand."""
    w = F.regexp_extract_all("issue_text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    b = passages(spark, sf_dir).select("task_id", w.alias("w"), "issue_text")
    path = F.concat(F.lit("src/"), F.coalesce(F.try_element_at("w", F.lit(1)), F.lit("none")), F.lit("/"), F.coalesce(F.try_element_at("w", F.lit(2)), F.lit("none")), F.lit(".ts"))
    said = F.when(F.size("w") >= 2, F.concat("issue_text", F.lit(" See "), F.upper(F.substring_index(path, "/", -2)), F.lit(" please"))).otherwise(F.col("issue_text"))
    out = backtest.mentions_expected(b.select("task_id", said.alias("issue_text")), b.select("task_id", path.alias("path")))
    return out.select(F.col("task_id").alias("item_id"), "mentioned")


# ---------------------------------------------------------------- explanations

@query(f"""WITH {RANK_SQL}, seen AS (SELECT task_id, count(*) AS n, min(score) FILTER (rank <= 8) AS lowest FROM r GROUP BY task_id),
targets AS (SELECT task_id, u.kind, CASE u.kind WHEN 'nowhere' THEN 'nowhere/' || task_id || '.ts' ELSE f.path END AS path FROM tasks CROSS JOIN (SELECT unnest(['own', 'test', 'text', 'nowhere']) AS kind, unnest([NULL, 6, 7, NULL]) AS last) AS u LEFT JOIN files f ON f.seq = CASE u.kind WHEN 'own' THEN k ELSE k - k % 10 + u.last END),
j AS (SELECT t.task_id, t.kind, t.path, x.score, r.rank, n, lowest, n >= 8 AS is_full FROM targets t LEFT JOIN (SELECT task_id, path, base + f21 AS score FROM scored) x USING (task_id, path) LEFT JOIN r ON r.task_id = t.task_id AND r.path = t.path LEFT JOIN seen s ON s.task_id = t.task_id WHERE t.path IS NOT NULL),
s AS (SELECT *, CASE WHEN kind = 'nowhere' THEN 'not-scanned' WHEN score IS NULL THEN 'excluded' WHEN rank <= 8 THEN 'ranked' WHEN is_full AND score >= lowest THEN 'outside-limit' ELSE 'below-cutoff' END AS status FROM j)
SELECT task_id, kind, status, CASE status WHEN 'ranked' THEN 'Rank ' || rank || ' with a score of ' || score || ' and high confidence.' WHEN 'outside-limit' THEN 'A score of ' || score || ' reaches the lowest that is shown, ' || lowest || ', but others come first.'
  WHEN 'below-cutoff' THEN 'A score of ' || score || ' is under ' || CASE WHEN is_full THEN lowest ELSE 4 END || '. A name, a quoted text or a path of this file in the task raises it.' WHEN 'excluded' THEN 'No candidate: tests, lock files and generated copies are not ranked.' ELSE 'Not scanned: no such file was read.' END AS says FROM s""")
def document_explanations(spark, sf_dir):
    """Why the file that a task names, a test, a text and a file that is not there are or are not among its files."""
    f, tasks, changed = document_tasks(spark, sf_dir)
    named = tasks.select("repo_id", "task_id", F.regexp_extract("issue_text", r"Fix openDoc(\d+) in", 1).cast("bigint").alias("k"))
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("k") if last is None else F.col("k") - F.pmod("k", F.lit(10)) + last).alias("seq")) for kind, last in (("own", None), ("test", 6), ("text", 7))]))
    there = named.select("repo_id", "task_id", kinds.alias("x")).select("repo_id", "task_id", "x.kind", "x.seq").join(f.select("seq", "path"), "seq").select("repo_id", "task_id", "kind", "path")
    targets = written(there.union(named.select("repo_id", "task_id", F.lit("nowhere").alias("kind"), F.concat(F.lit("nowhere/"), "task_id", F.lit(".ts")).alias("path"))))
    shown = ranking.rank(f, tasks, changed, cutoff=None, also=targets)  # the best and the targets are all that an explanation reads
    none = spark.createDataFrame([], "repo_id string, path string, pattern string")
    told = written(reports.explain(shown, targets.select("repo_id", "task_id", "path"), f, none))
    text = render.explanation_markdown(told).select("task_id", "path", F.element_at(F.split("text", "\n"), 3).alias("says"))
    return targets.join(told.select("task_id", "path", "status"), ["task_id", "path"]).join(text, ["task_id", "path"]).select("task_id", "kind", "status", "says")
