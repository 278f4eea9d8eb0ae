"""The same functions in the SQL of the checking engine, written for it and not derived from the Spark ones."""

from __future__ import annotations

from ..functions import paths as P
from ..functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def array(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def verb_stem(s: str) -> str:
    p = f"regexp_replace(regexp_replace(regexp_replace({s}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        p = f"replace(replace({p}, 'Cy', 'CV'), 'Vy', 'VC')"
    twice = "|".join(c + c for c in "abcdefghijklmnopqrtuvwxyz")
    short = f"(regexp_matches({p}, '^C*V+C+V*$') AND regexp_matches({p}, 'CVC$') AND NOT regexp_matches({s}, '[wxy]$'))"
    return f"CASE WHEN regexp_matches({s}, '({twice})$') THEN left({s}, length({s}) - 1) WHEN regexp_matches({s}, '({T.SILENT_E})$') OR {short} THEN {s} || 'e' ELSE {s} END"


def stem(t: str) -> str:
    cut = lambda n: f"left({t}, length({t}) - {n})"
    return (
        f"CASE WHEN {t} = 'kubernetes' THEN {t} WHEN {t} IN ('scss', 'sass', 'less') THEN 'css' WHEN {t} IN ('contributor', 'contributors') THEN 'contribute' "
        f"WHEN length({t}) > 5 AND ends_with({t}, 'ies') THEN {cut(3)} || 'y' WHEN length({t}) > 4 AND ends_with({t}, 'ied') THEN {cut(3)} || 'y' "
        f"WHEN length({t}) > 5 AND ends_with({t}, 'ing') THEN {verb_stem(cut(3))} WHEN length({t}) > 3 AND ends_with({t}, 'ed') THEN {verb_stem(cut(2))} "
        f"WHEN length({t}) > 4 AND regexp_matches({t}, '(sses|shes|ches|xes|zes)$') THEN {cut(2)} "
        f"WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN {cut(1)} ELSE {t} END"
    )


def searchable(t: str) -> str:
    return f"(length({t}) <= 64 AND (length({t}) >= 3 OR {t} IN ('ci', 'ui') OR regexp_matches({t}, '^[A-Za-z][0-9]$')))"


def raw_words(c: str) -> str:
    """Lower-case words as a list, repeats kept."""
    padded = rf"regexp_replace({c}, '(?i)\bhttp\s*/\s*([123])\b', 'http h\1', 'g')"
    linkless = rf"regexp_replace({padded}, '(?i)https?://[^\s<>()\[\]{{}}]+', ' ', 'g')"
    camel = rf"regexp_replace({linkless}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return rf"string_split_regex(lower({camel}), '[^\p{{L}}\p{{N}}]+')"


def tokens(source: str, key: str, text: str, name: str = "tokens") -> str:
    """CTEs that end in ``name(key, token)``: the distinct search terms of each row."""
    ok = lambda t: f"{searchable(t)} AND {t} NOT IN {names(T.STOP_WORDS)}"
    return f"""{name}_raw AS (SELECT {key}, unnest({raw_words(text)}) AS w FROM {source}),
{name}_dict AS (SELECT w, {stem('w')} AS token FROM (SELECT DISTINCT w FROM {name}_raw) WHERE {ok('w')}),
{name} AS (SELECT DISTINCT r.{key}, d.token FROM {name}_raw r JOIN {name}_dict d USING (w) WHERE {ok('d.token')})"""


def retrieval_tokens(source: str, key: str, text: str, name: str = "rt") -> str:
    """CTEs that end in ``name(key, token)``: BM25 tokens with repeats."""
    split = r"regexp_replace(w, '([a-z0-9])([A-Z])', '\1_\2', 'g')"
    return rf"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z0-9_$]+')) AS w FROM {source}),
{name}_p AS (SELECT {key}, w, list_filter(string_split({split}, '_'), lambda p: length(p) >= 3) AS parts FROM {name}_w),
{name} AS (SELECT {key}, lower(w) AS token FROM {name}_p WHERE length(w) >= 3
  UNION ALL SELECT {key}, lower(unnest(parts)) AS token FROM {name}_p WHERE len(parts) > 1)"""


def name_of(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$')"


def extension(p: str) -> str:
    return rf"lower(regexp_extract({name_of(p)}, '[^.](\.[^.]*)$', 1))"


def in_folder(p: str, values) -> str:
    return rf"regexp_matches(lower({p}), '(^|/)({'|'.join(v.replace('.', chr(92) + '.') for v in values)})/')"


def is_test(p: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({p}, {lit(x)})" for x in P.TEST_PATTERNS) + ")"


def kind(p: str) -> str:
    low = f"lower({p})"
    return (
        f"CASE WHEN lower({name_of(p)}) IN {names(P.DOCUMENT_NAMES)} THEN 'documentation' "
        rf"WHEN lower({name_of(p)}) IN {names(P.CONFIG_NAMES)} OR regexp_matches(lower({name_of(p)}), '\.(csproj|fsproj|vbproj)$') THEN 'config' "
        f"WHEN {extension(p)} = '.md' OR starts_with({low}, 'docs/') THEN 'documentation' "
        rf"WHEN starts_with({low}, '.github/') OR {extension(p)} IN ('.json', '.yaml', '.yml') OR regexp_matches({low}, '(^|/)([^/]+\.config|\.[^/]*rc)\.[^/]+$') THEN 'config' "
        f"WHEN {extension(p)} IN {names(P.SOURCE_EXTENSIONS)} THEN 'code' ELSE 'other' END"
    )


def is_source(p: str) -> str:
    return rf"({extension(p)} IN {names(P.SOURCE_EXTENSIONS)} OR lower({name_of(p)}) IN {names([*P.DOCUMENT_NAMES, *P.CONFIG_NAMES])} OR regexp_matches(lower({name_of(p)}), '\.(csproj|fsproj|vbproj)$'))"


def is_generated(p: str) -> str:
    return rf"({in_folder(p, P.GENERATED_DIRS)} OR regexp_matches({p}, '(?i)^benchmarks/[^/]+/(results|savings-results)\.json$'))"


def is_backup(p: str) -> str:
    files = " OR ".join(f"regexp_matches({name_of(p)}, {lit(x.replace('(?<![A-Za-z0-9_])', chr(92) + 'b').replace('(?![A-Za-z0-9_])', chr(92) + 'b'))})" for x in P.BACKUP_FILES)
    return f"(regexp_matches(lower({p}), '(^|[^a-z0-9])({'|'.join(P.BACKUP_WORDS)})([^a-z0-9/][^/]*)?/') OR {files})"


def module_stem(p: str) -> str:
    roots = "|".join(v.replace(".", "\\.") for v in (*P.GENERATED_DIRS, *P.SOURCE_ROOTS))
    bare = rf"regexp_replace({p}, '\.[^./]+$', '')"
    # the first segment that is a layout root goes, whether a folder or the last name
    return rf"regexp_replace(regexp_replace({bare}, '(?i)(^|/)({roots})(/|$)', '\1'), '/$', '')"


FILES = r"""files AS (SELECT 'docs' AS repo_id, doc_id AS seq, source || CASE WHEN doc_id % 10 = 9 THEN '/dist/' ELSE '/src/' END || lang || '/doc_' || doc_id
    || CASE WHEN doc_id % 10 <= 4 THEN '.ts' WHEN doc_id % 10 = 5 THEN '.py' WHEN doc_id % 10 = 6 THEN '.test.ts' WHEN doc_id % 10 = 7 THEN '.md' WHEN doc_id % 10 = 8 THEN '.json' ELSE '.ts' END AS path,
    octet_length(encode(text)) AS size_bytes, text FROM documents)"""


def wilson(h: str, n: str, z: float = 1.96) -> tuple[str, str]:
    p, n_ = f"({h}::DOUBLE / {n})", f"({n})::DOUBLE"
    middle, half, width = f"({p} + {z * z} / (2 * {n_}))", f"({z} * sqrt({p} * (1 - {p}) / {n_} + {z * z} / (4 * {n_} * {n_})))", f"(1 + {z * z} / {n_})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, ({middle} - {half}) / {width}), 3) END", f"CASE WHEN {n} > 0 THEN round(least(1.0, ({middle} + {half}) / {width}), 3) END"
