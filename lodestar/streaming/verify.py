"""A watch with keyed state: each change of a repository is verified against its plan as it comes in.

What is known of a repository is one value in Spark's state store, written only when it
changes; updates are joined with the tables of the plans and leave as lines of JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as T
from ..operators import reports
from ..sources.tables import written

#: What a feed has, and what comes out of it: ``kind`` is ``update``, or ``late`` for a row that stands before its repository's last update.
FEED = ("repo_id", "observed_at", "seq", "fingerprint", "changed")
UPDATES = "repo_id string, kind string, sequence bigint, observed_at timestamp, seq bigint, fingerprint string, changed array<string>"
_OUT = "repo_id string, kind string, sequence bigint, at bigint, seq bigint, fingerprint string, changed array<string>"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch writes what it changed, not the store
}


class LastState(StatefulProcessor):
    """The last fingerprint of a repository, with the number and the place of its update.

    Rows of a repository in a micro-batch are put in order first; the source's limit of a
    batch bounds them.
    """

    def init(self, handle) -> None:
        self._last = handle.getValueState("last", "fingerprint string, sequence bigint, at bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self._last.get()  # None where there is none; asking for that first would be another call to the store
        before = last = tuple(held) if held else None
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            place = (r.at, r.seq)
            if last and place < last[2:]:
                yield Row(repo_id=key[0], kind="late", sequence=None, at=r.at, seq=r.seq, fingerprint=r.fingerprint, changed=r.changed)
            elif last is None or r.fingerprint != last[0]:
                last = (r.fingerprint, (last[1] if last else 0) + 1, *place)
                yield Row(repo_id=key[0], kind="update", sequence=last[1], at=r.at, seq=r.seq, fingerprint=r.fingerprint, changed=r.changed)
        if last != before:
            self._last.update(last)

    def close(self) -> None:
        pass


def updates(feed: DataFrame) -> DataFrame:
    """A streaming ``feed`` -> its updates and late rows."""
    rows = feed.select("repo_id", F.unix_micros("observed_at").alias("at"), F.col("seq").cast("bigint").alias("seq"), "fingerprint", F.coalesce("changed", F.array().cast("array<string>")).alias("changed"))
    out = rows.groupBy("repo_id").transformWithState(LastState(), _OUT, "Append", "None")
    return out.select("repo_id", "kind", "sequence", F.timestamp_micros("at").alias("observed_at"), "seq", "fingerprint", "changed")


def verified(found: DataFrame, plans: DataFrame, planned: DataFrame, files: DataFrame, tracked: DataFrame, routes: DataFrame, impact: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each update against each plan of its repository: ``(check_id, plan_id, repo_id, sequence, observed_at, changed, case_id)`` and findings by ``case_id``.

    What is found depends on the plan and on the set of changed paths alone: checks that
    share these are one case, verified once.  Tables as of ``reports.verify``, which they
    are handed to once for all cases.
    """
    check = F.concat_ws("\0", "plan_id", F.col("sequence").cast("string"))
    paths = F.array_sort(F.array_distinct("changed"))
    checks = found.where("kind = 'update'").join(plans, "repo_id").select(check.alias("check_id"), "plan_id", "repo_id", "sequence", "observed_at", "changed", F.to_json(F.struct("plan_id", "repo_id", paths.alias("paths"))).alias("case_id"))
    cases = written(checks.select("case_id", "plan_id", "repo_id", paths.alias("paths")).distinct())
    keys = cases.select("case_id", "plan_id")
    of = lambda df: df.join(keys, "plan_id").drop("plan_id").withColumnRenamed("case_id", "plan_id")
    edits = cases.select(F.col("case_id").alias("plan_id"), F.explode("paths").alias("path"))
    findings = reports.verify(cases.select(F.col("case_id").alias("plan_id"), "repo_id"), of(planned), edits, files, tracked, of(routes), of(impact), of(risks))
    return checks, findings.withColumnRenamed("plan_id", "case_id")


def _gathered(checks: DataFrame, findings: DataFrame) -> DataFrame:
    entry = F.struct("ord", "area", F.struct("code", "severity", "paths", "area").alias("v"))
    listed = findings.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"]).alias("findings"))
    j = checks.join(listed, "case_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<code:string,severity:string,paths:array<string>,area:string>>")))
    n = F.size("findings")
    says = F.when(F.size("changed") == 0, "nothing has changed").when(n == 0, "what changed is what was planned").otherwise(F.concat(n.cast("string"), F.when(n == 1, " finding").otherwise(" findings")))
    return j.withColumn("summary", says)


def json_lines(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """One ``value`` for each check: a line of JSON."""
    g = _gathered(checks, findings)
    body = F.struct("summary", F.array_sort("changed").alias("changedFiles"), "findings")
    return g.select(F.to_json(F.struct(F.lit(1).alias("watchVersion"), F.col("plan_id").alias("plan"), F.col("repo_id").alias("repository"), "sequence", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("observedAt"), body.alias("verification"))).alias("value"))


def markdown(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """``(check_id, text)``: a heading with number and time, then what was found."""
    g = _gathered(checks, findings)
    line = lambda f: F.concat(F.lit("- "), f["severity"], F.lit(": "), f["code"], F.when(F.size(f["paths"]) > 0, F.concat(F.lit(" "), F.array_join(F.transform(f["paths"], T.code_span), ", "))).otherwise(""))
    head = F.concat(F.lit("## Watch update "), F.col("sequence").cast("string"), F.lit(", "), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return g.select("check_id", F.concat(head, F.lit("\n\n"), "summary", F.lit("\n"), F.when(F.size("findings") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("findings", line), "\n"), F.lit("\n"))).otherwise("")).alias("text"))


def _with_store(spark: SparkSession, run) -> None:
    held = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        run()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(feed: DataFrame, tables: dict[str, DataFrame] | None, folder: str, checkpoint: str) -> list[dict]:
    """Process what is there and stop: updates under ``folder/updates``, and with ``tables`` (as of ``verified``) lines of JSON under ``folder/lines``.

    A batch that runs again overwrites what it wrote, and the state store starts it from
    the state before it.  Gives, for each batch with rows, how many states it wrote and held.
    """

    def step(batch: DataFrame, k: int) -> None:
        path = f"{folder}/updates/batch={k}"
        batch.write.mode("overwrite").parquet(path)  # once: what follows reads it several times
        if tables is not None:
            found = batch.sparkSession.read.schema(UPDATES).parquet(path)
            json_lines(*verified(found, **tables)).write.mode("overwrite").text(f"{folder}/lines/batch={k}")

    seen = []

    def run() -> None:
        query = updates(feed).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        for p in query.recentProgress:
            for s in p["stateOperators"] if p["numInputRows"] else []:
                seen.append({"batch": p["batchId"], "rows": p["numInputRows"], "updated": s["numRowsUpdated"], "held": s["numRowsTotal"]})

    _with_store(feed.sparkSession, run)
    return seen


def read_updates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(UPDATES).parquet(f"{folder}/updates")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(repo_id, plan_id, sequence, summary, changed, findings)`` of the lines written."""
    kind = "watchVersion int, plan string, repository string, sequence bigint, observedAt string, verification struct<summary:string,changedFiles:array<string>,findings:array<struct<code:string,severity:string,paths:array<string>,area:string>>>"
    x = spark.read.text(f"{folder}/lines").select(F.from_json("value", kind).alias("x"))
    return x.select(F.col("x.repository").alias("repo_id"), F.col("x.plan").alias("plan_id"), "x.sequence", "x.verification.summary", F.col("x.verification.changedFiles").alias("changed"), "x.verification.findings")
