"""Small relations of source code, which the driver tables lack: as Spark rows and as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

# (repo_id, path, text)
CODE = [
    ("auth", "src/session.ts", "import { readToken } from './token.js';\nexport async function openSession(user) {\n  return readToken(user);\n}\n"),
    ("auth", "src/token.ts", "export function readToken(user) {\n  const SESSION_LIMIT = 30;\n  return user.token;\n}\n"),
    ("auth", "src/routes/login.ts", "import { openSession } from '../session';\nexport const loginRoute = (user) => openSession(user);\n"),
    ("auth", "src/routes/index.ts", "export * from './login';\nexport { loginRoute } from \"./login\";\n"),
    ("auth", "src/legacy/old_login.ts", "import { openSession } from '../session';\n"),
    ("auth", "dist/session.js", "function openSession(user) { return readToken(user) }\n"),
    ("auth", "test/login.test.ts", "import { loginRoute } from '../src/routes';\nit.skip('login works', () => loginRoute());\n"),
    ("auth", "test/token.test.ts", "const run = process.env.TOKEN_TESTS ? it : it;\ndescribe.runIf(process.env.TOKEN_TESTS)('token', () => {});\n"),
    ("auth", "docs/login.md", "# Login\nCall openSession() to log in.\n"),
    ("auth", "package.json", '{"name": "auth", "scripts": {"test": "vitest run", "test:unit": "vitest run unit", "build": "tsc"}}'),
    ("auth", "examples/demo/page.tsx", "import { openSession } from '../../src/session';\nexport const Page = () => <button onClick={openSession}>in</button>;\n"),
    ("shop", "packages/cart/src/index.ts", "import { priceOf } from '@shop/price';\nimport { round } from '~/money';\nexport const total = (items) => items.map(priceOf);\n"),
    ("shop", "packages/cart/package.json", '{"name": "@shop/cart", "main": "dist/index.js", "scripts": {"test": "jest"}}'),
    ("shop", "packages/price/src/index.ts", "export function priceOf(item) { return item.price }\n"),
    ("shop", "packages/price/package.json", '{"name": "@shop/price", "source": "./src/index.ts", "scripts": {"tests:all": "jest --all"}}'),
    ("shop", "lib/money.ts", "export const round = (x) => x;\n"),
    ("shop", "tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["lib/*"]}}}'),
    ("shop", "yarn.lock", ""),
    ("shop", "db/migrations/payment_schema.py", "def migrate(): pass\n"),
    ("svc", "go.mod", "module svc\n"),
    ("svc", "main.go", "package main\nfunc main() { serve() }\n"),
    ("svc", "serve/serve.go", "package serve\nfunc serve() {}\n"),
    ("svc", "serve/serve_test.go", "func TestServe(t *testing.T) { t.Skip() }\n"),
]
# (repo_id, task_id, issue_text)
TASKS = [
    ("auth", "t1", "`openSession` fails for an expired token"),
    ("auth", "t2", "Update src/routes/login.ts so the login route keeps its session"),
    ("auth", "t3", "please improve the codebase"),
    ("auth", "t4", "closeSessionNow() is missing from the API"),
    ("shop", "t5", "priceOf returns the wrong cart total"),
    ("svc", "t6", "serve crashes on start"),
]
# (repo_id, hash, committed_at, files)
COMMITS = [
    ("auth", "c1", 40, ["src/session.ts", "src/token.ts", "test/token.test.ts"]),
    ("auth", "c2", 30, ["src/session.ts", "src/token.ts"]),
    ("auth", "c3", 20, ["src/session.ts", "src/routes/login.ts", "src/gone.ts"]),
    ("auth", "c4", 10, ["src/routes/login.ts", "test/login.test.ts"]),
    ("auth", "c5", 5, [f"src/bulk{i}.ts" for i in range(31)] + ["src/session.ts", "docs/login.md"]),
]
GLOBS = ["docs/", "*.json", "!package.json", "/src/legacy", "**/demo/*", "  # note", "nothing*.zip", "src/r?utes/index.ts"]


def sql_values(rows, columns: str) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return "'" + v.replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns}))"


def code_files(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(r, i, p, t) for i, (r, p, t) in enumerate(CODE)], "repo_id string, seq bigint, path string, text string")
    p = F.col("path")
    return df.select("repo_id", "seq", "path", P.extension(p).alias("extension"), F.octet_length("text").cast("bigint").alias("size_bytes"), P.is_test(p).alias("is_test"), P.is_source(p).alias("is_source"), P.kind(p).alias("kind"), "text", F.lit(True).alias("text_complete"), F.lit(None).cast("string").alias("skip_reason"))


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, t, x, None) for r, t, x in TASKS], "repo_id string, task_id string, issue_text string, diff_text string")


def commits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMITS, "repo_id string, hash string, committed_at bigint, files array<string>")


def code_sql() -> str:
    return sql_values([(r, i, p, t) for i, (r, p, t) in enumerate(CODE)], "repo_id, seq, path, text")


#: A history in which a fourth commit, which comes after the case, adds the file that fits its task best.
SNAPSHOT_COMMITS = [
    ("auth", 1, "h1", "initial authentication implementation", ["src/auth/reset.ts", "dist/auth/reset.js", "src/session.ts", "src/password/reset_expiration.ts", "test/auth/reset.test.ts"]),
    ("auth", 2, "h2", "fix password reset session expiration", ["src/auth/reset.ts", "dist/auth/reset.js", "src/session.ts", "src/password/reset_expiration.ts", "test/auth/reset.test.ts"]),
    ("auth", 3, "h3", "correct password reset expiration behavior", ["src/auth/reset.ts", "dist/auth/reset.js", "src/session.ts", "test/auth/reset.test.ts"]),
    ("auth", 4, "h4", "x", ["src/password/expiration.ts"]),
]
SNAPSHOT_WRITES = [
    *[("auth", n, p, text) for n, limit in ((1, 10), (2, 20), (3, 30)) for p, text in (
        ("src/auth/reset.ts", f"import {{ sessionExpiry }} from '../session';\nexport const resetPassword = () => sessionExpiry + {limit};"),
        ("dist/auth/reset.js", f"export const resetPassword = () => {limit};"),
        ("src/session.ts", f"// password expiration\nexport const sessionExpiry = {limit};"),
        ("test/auth/reset.test.ts", f"import '../../src/auth/reset';\ntest('expiry', () => {limit});"))],
    ("auth", 1, "src/password/reset_expiration.ts", "password reset expiration behavior"), ("auth", 2, "src/password/reset_expiration.ts", None),
    ("auth", 4, "src/password/expiration.ts", "correct password reset expiration behavior"),
]
