"""Path classes as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import find_all, rx

# Name conventions of repositories.
SOURCE_EXTENSIONS = (".cjs .cs .css .cts .go .gradle .java .js .json .jsx .md .mjs .mts .php .py .rb .rs .svelte .ts .tsx .vue .yaml .yml").split()
LOCKFILES = "package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock bun.lock bun.lockb".split()
GENERATED_DIRS = ".idea .netlify .next .nuxt .output .turbo .vercel .vscode build coverage dist target vendor".split()
SOURCE_ROOTS = "lib source src".split()
IGNORED_DIRS = ".cache .git .venv node_modules".split()
BACKUP_WORDS = "archive archived archives backup backups bak deprecated legacy old quarantine".split()
DOCUMENT_NAMES = "authors changelog code_of_conduct contributing license notice readme security".split()
CONFIG_NAMES = (
    ".dockerignore .editorconfig .gitattributes .gitignore .npmignore codeowners dockerfile gemfile jenkinsfile "
    "makefile procfile rakefile vagrantfile pom.xml build.gradle settings.gradle"
).split()
AUXILIARY_DIRS = "demo demos example examples sample samples".split()
RISK_FREE_DIRS = [*AUXILIARY_DIRS, "fixture", "fixtures"]
TEST_PATTERNS = (
    r"\.test(?:\.|-d\.)",
    r"\.spec\.",
    r"(^|/|\\)__tests__(/|\\)",
    r"(^|/|\\)tests?(/|\\)",
    r"(^|/|\\)spec(/|\\)",
    r"(?i)_spec\.rb$",
    r"(?i)(?:Test\.java|Tests?\.cs|Test\.php)$",
    r"_test\.go$",
    r"(^|/|\\)(?:test_[^/\\]+|[^/\\]+_test)\.py$",
)
BACKUP_FILES = (
    r"(?i)\.(?:bak|orig|rej|old|save|swp)$",
    r"~$",
    r"(?i)(?<![A-Za-z0-9_])conflicted copy(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])conflict(?:ed)?[-_ ]copy(?![A-Za-z0-9_])",
    r"(?i)(?: copy|[-_]copy\s*\(\d+\))\.[^.]+$",
    r"(?i)\s\(\d+\)\.[^.]+$",
)
# Traces of bundlers.
BUNDLE_MARKS = (
    r"(?<![A-Za-z0-9_])__webpack_require__(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])webpackChunk",
    r"/\*\s*webpack/runtime/",
    r"/\*\s*harmony (?:export|import)\s*\*/",
    r"(?<![A-Za-z0-9_])__commonJS\s*=",
    r"(?<![A-Za-z0-9_])__toESM\s*=",
    r"(?<![A-Za-z0-9_])__defProp\s*=",
    r"//# sourceMappingURL=",
)


def _any(c: Column, patterns) -> Column:
    return functools.reduce(Column.__or__, [c.rlike(p) for p in patterns])


def segments(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def folder(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.when(path.contains("/"), rx(path, "/[^/]*$")).otherwise(F.lit(""))


def folders(path: Column) -> Column:
    return F.slice(segments(path), F.lit(1), F.size(segments(path)) - 1)


def extension(path: Column) -> Column:
    """Lower-case, with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(name(path), r"[^.](\.[^.]*)$", 1))


def in_folder(path: Column, names) -> Column:
    return F.exists(folders(path), lambda s: F.lower(s).isin(*names))


def is_test(path: Column) -> Column:
    return _any(path, TEST_PATTERNS)


def is_project_file(path: Column) -> Column:
    return F.lower(name(path)).rlike(r"\.(?:csproj|fsproj|vbproj)$")


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS) | F.lower(name(path)).isin(*DOCUMENT_NAMES, *CONFIG_NAMES) | is_project_file(path)


def kind(path: Column) -> Column:
    low, ext = F.lower(path), extension(path)
    return (
        F.when(F.lower(name(path)).isin(*DOCUMENT_NAMES), "documentation")
        .when(F.lower(name(path)).isin(*CONFIG_NAMES) | is_project_file(path), "config")
        .when((ext == ".md") | low.startswith("docs/"), "documentation")
        .when(low.startswith(".github/") | ext.isin(".json", ".yaml", ".yml") | low.rlike(r"(^|/)(?:[^/]+\.config|\.[^/]*rc)\.[^/]+$"), "config")
        .when(ext.isin(*SOURCE_EXTENSIONS), "code")
        .otherwise("other")
    )


def is_recorded_output(path: Column) -> Column:
    return path.rlike(r"(?i)^benchmarks/[^/]+/(?:results|savings-results)\.json$")


def is_generated(path: Column) -> Column:
    return in_folder(path, GENERATED_DIRS) | is_recorded_output(path)


def is_backup(path: Column) -> Column:
    words = F.flatten(F.transform(folders(path), lambda s: F.split(F.lower(s), "[^a-z0-9]+")))
    return F.exists(words, lambda w: w.isin(*BACKUP_WORDS)) | _any(name(path), BACKUP_FILES)


def module_stem(path: Column) -> Column:
    """The module that a path names: no extension, and without the first layout folder."""
    s = segments(rx(path, r"\.[^./]+$"))
    roots = F.transform(s, lambda x: F.lower(x).isin(*GENERATED_DIRS, *SOURCE_ROOTS))
    at = F.array_position(roots, True)
    return F.array_join(F.filter(s, lambda x, i: (at == 0) | (i != at - 1)), "/")


def is_lockfile(path: Column) -> Column:
    return name(path).isin(*LOCKFILES)


def is_auxiliary(path: Column) -> Column:
    bare = F.lower(rx(name(path), r"\.[^.]+$"))
    return in_folder(path, AUXILIARY_DIRS) | ((bare == "sample-repo") & in_folder(path, ("web", "website")))


def is_presentation(path: Column) -> Column:
    return F.lower(name(path)).rlike(r"^(?:page|layout|demo)\.[cm]?[jt]sx?$|\.(?:css|less|sass|scss)$")


def is_declaration(path: Column) -> Column:
    return path.rlike(r"(?i)\.d\.(?:ts|mts|cts)$")


def is_interactive(text: Column) -> Column:
    # plain searches first: most texts hold none of these
    handled = text.contains("onChange") | text.contains("onClick") | text.contains("onInput") | text.contains("onSubmit")
    return (
        (text.contains("<") & text.rlike(r"<(?:button|form|input|select|textarea)(?![A-Za-z0-9_])")) | (handled & text.rlike(r"(?<![A-Za-z0-9_])on(?:Change|Click|Input|Submit)\s*="))
        | (text.contains("useState") & text.rlike(r"(?<![A-Za-z0-9_])useState\s*\(")))


def is_bundled(text: Column, path: Column) -> Column:
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    marks = sum((text.rlike(p).cast("int") for p in BUNDLE_MARKS), F.lit(0))
    place = is_generated(path) | in_folder(path, ("compiled",))
    some = functools.reduce(Column.__or__, [text.contains(w) for w in ("webpack", "harmony", "__commonJS", "__toESM", "__defProp", "sourceMappingURL")])  # one of these is in each mark
    return (F.length(text) >= 2000) & ((F.length(text) / lines >= 400) | F.when(some, (marks >= 2) | ((marks >= 1) & place)).otherwise(False))


def matches_mention(path: Column, mention: Column) -> Column:
    """A mention names a path: equal, a tail of it, longer than it, or its bare file name."""
    p, m = (F.lower(F.translate(c, "\\", "/")) for c in (path, mention))
    bare = ~m.contains("/") & ~m.contains(".") & (rx(name(p), r"\.[^.]+$") == m)
    return (p == m) | p.endswith(F.concat(F.lit("/"), m)) | (p.contains("/") & m.endswith(F.concat(F.lit("/"), p))) | bare


def is_safe_relative(path: Column) -> Column:
    return (F.length(path) > 0) & ~path.rlike(r"^(?:[A-Za-z]:|[/\\])") & ~F.exists(F.split(path, r"[/\\]"), lambda s: s == "..")


def script_blocks(html: Column) -> Column:
    """What stands in the script elements, or the whole text where there are none."""
    found = find_all(html, r"(?is)<script(?![A-Za-z0-9_])[^>]*>(.*?)</script>", 1)
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(html)


# Fence names of extensions that are not their own.
FENCES = {"cjs": "javascript", "js": "javascript", "mjs": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "yml": "yaml", "md": "markdown", "sh": "bash", "ps1": "powershell"}


def fence_language(path: Column) -> Column:
    """Language name of a Markdown fence: the extension, or its usual name."""
    base = name(F.translate(path, "\\", "/"))
    ext = F.when(base.contains("."), F.lower(F.element_at(F.split(base, r"\."), -1))).otherwise("")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FENCES.items() for x in kv])[ext], ext)
