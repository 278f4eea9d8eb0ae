"""A folder as a partitioned source, and scans that read only what has changed.

The source lists: folders are walked in parallel, those that no scan wants are not
entered, and no file is opened.  What has another size or time than in the last snapshot
is read then, a partition of paths to a task; the rest comes from the snapshot.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import paths as P
from . import scan
from .tables import spread

FORMAT = "source_tree"
LISTED = "path string, extension string, size_bytes bigint, modified bigint"  # modified: nanoseconds
SKIPPED = tuple([*P.IGNORED_DIRS, *[d for d in P.GENERATED_DIRS if d != "vendor"]])
LEAST_PARTS, MOST_SPLITS = 64, 4096
VERSION, MAX_AGE = 1, 7 * 24 * 3600
_ARROW = pa.schema([("path", pa.string()), ("extension", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.int64())])


def _open(uri: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(uri)


def _extension(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


class TreePart(InputPartition):
    """Folders to walk with all below them, or, not ``deep``, folders of which only the files count."""

    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: frozenset[str], least: int):
        self.root, self.skip, self.least, self.wanted = root.rstrip("/"), skip, least, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("extension",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def _children(self, system: afs.FileSystem, folder: str) -> list[afs.FileInfo]:
        return system.get_file_info(afs.FileSelector(folder, allow_not_found=False))

    def partitions(self) -> list[TreePart]:
        """Folders are opened level by level until there are enough to share out."""
        system, base = _open(self.root)
        flat, todo = [], [base]
        while todo and len(todo) < self.least and len(flat) < MOST_SPLITS:
            flat, below = flat + todo, []
            for folder in todo:
                below += [c.path for c in self._children(system, folder) if c.type == afs.FileType.Directory and c.base_name not in self.skip]
            todo = below
        step = max(1, -(-len(todo) // self.least))
        return [TreePart([f], False) for f in flat] + [TreePart(todo[i : i + step], True) for i in range(0, len(todo), step)]

    def read(self, part: TreePart) -> Iterator[pa.RecordBatch]:
        system, base = _open(self.root)
        todo, rows = list(part.folders), []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            rows.clear()
            return out

        while todo:
            for c in self._children(system, todo.pop()):
                if c.type == afs.FileType.Directory:
                    if part.deep and c.base_name not in self.skip:
                        todo.append(c.path)
                elif c.type == afs.FileType.File and (self.wanted is None or _extension(c.base_name) in self.wanted):
                    rows.append({"path": c.path[len(base) :].lstrip("/"), "extension": _extension(c.base_name), "size_bytes": c.size, "modified": c.mtime_ns})
                    if len(rows) >= 10_000:
                        yield batch()
        if rows:
            yield batch()


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(uri)``; options ``skip`` (folder names, comma-separated) and ``parts``.

    ``uri`` is one that all executors reach (``file:`` on a shared mount, ``hdfs:``,
    ``s3:``).  Symbolic links are followed as the file system does.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> TreeReader:
        skip = self.options.get("skip")
        return TreeReader(self.options["path"], frozenset(SKIPPED if skip is None else filter(None, skip.split(","))), int(self.options.get("parts", LEAST_PARTS)))


def listing(spark: SparkSession, uri: str, skip: tuple[str, ...] = SKIPPED, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """``(path, extension, size_bytes, modified)`` below ``uri``; no file is opened, no skipped folder entered.

    ``extensions`` are handed to the source, which passes over other files while it lists.
    """
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format(FORMAT).option("skip", ",".join(skip)).load(uri)
    return df if extensions is None else df.where(F.col("extension").isin(*extensions))


def contents(listed: DataFrame, uri: str, limit: int = scan.MAX_SAMPLE) -> DataFrame:
    """``listed`` with ``content``; files of over ``limit`` bytes are not opened, one that is gone or unreadable has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(uri.rstrip("/"))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, out = b.slice(i, 256), []
                for path, size in zip(part.column("path").to_pylist(), part.column("size_bytes").to_pylist()):
                    data = b"" if size > limit else None
                    if data is None:
                        try:
                            with system.open_input_stream(f"{base}/{path}") as f:
                                data = f.read(limit + 1)
                        except OSError:
                            pass
                    out.append(data)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "content"])

    return spread(listed.select("path", "extension", "size_bytes", "modified")).mapInArrow(read, f"{LISTED}, content binary")


def compare(now: DataFrame, last: DataFrame) -> DataFrame:
    """``(path, state)``: ``same`` size and time as in ``last``, ``changed``, ``new`` or ``gone``."""
    a = now.select("path", F.col("size_bytes").alias("_s"), F.col("modified").alias("_m"), F.lit(True).alias("_now"))
    b = last.select("path", "size_bytes", "modified", F.lit(True).alias("_then"))
    j = a.join(b, "path", "full")
    same = F.col("_s").eqNullSafe(F.col("size_bytes")) & F.col("_m").eqNullSafe(F.col("modified"))
    state = F.when(F.col("_now").isNull(), "gone").when(F.col("_then").isNull(), "new").when(same, "same").otherwise("changed")
    return j.select("path", state.alias("state"))


class Snapshots:
    """Snapshots of one tree in ``folder``, a table each, published by renaming it when it is whole.

    One of another version or older than ``max_age`` seconds is not used, and goes at the
    next write, as do unfinished ones of that age.
    """

    def __init__(self, spark: SparkSession, folder: str, max_age: int = MAX_AGE, clock=time.time):
        self.spark, self.folder, self.max_age, self.clock = spark, folder.rstrip("/"), max_age, clock

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _all(self) -> list[tuple[str, int, bool]]:
        """(path, age in seconds, published) of everything there."""
        at, system = self._fs(self.folder)
        if not system.exists(at):
            return []
        out = []
        for s in system.listStatus(at):
            name = s.getPath().getName()
            parts = name.split("-")
            if parts[0] in ("snapshot", "writing") and len(parts) == 4 and parts[2].isdigit():
                out.append((f"{self.folder}/{name}", int(self.clock() - int(parts[2]) / 1000), parts[0] == "snapshot" and parts[1] == f"v{VERSION}"))
        return out

    def latest(self) -> str | None:
        fresh = [(age, path) for path, age, done in self._all() if done and 0 <= age <= self.max_age]
        return min(fresh)[1] if fresh else None

    def publish(self, files: DataFrame) -> str:
        name = f"v{VERSION}-{int(self.clock() * 1000)}-{uuid.uuid4().hex}"
        files.write.parquet(f"{self.folder}/writing-{name}")
        to = f"{self.folder}/snapshot-{name}"
        at, system = self._fs(f"{self.folder}/writing-{name}")
        if not system.rename(at, self._fs(to)[0]):
            raise OSError(f"could not publish {to}")
        return to

    def prune(self) -> list[str]:
        old = [path for path, age, _ in self._all() if age > self.max_age]
        for path in old:
            at, system = self._fs(path)
            system.delete(at, True)
        return old


def scan_incrementally(spark: SparkSession, uri: str, folder: str, untracked: DataFrame | None = None, skip: tuple[str, ...] = SKIPPED, limit: int = scan.MAX_SAMPLE, max_age: int = MAX_AGE, clock=time.time) -> tuple[DataFrame, dict]:
    """``(path, extension, size_bytes, modified, content, fresh)`` of a tree, and a note of how it was read.

    ``fresh`` files were read now, the others stand in the last snapshot with this size
    and time.  The note: ``state`` (``none``: no snapshot to use, ``used``, or
    ``refused`` with a ``reason``), ``read``, ``reused``, ``gone``, ``age`` in seconds and
    ``pruned``.  A folder within the tree is refused, and so is a tree with files in
    ``untracked(path)``: these can change without a trace; then nothing is kept.
    """
    inside = folder.rstrip("/").removeprefix("file://").startswith(uri.rstrip("/").removeprefix("file://") + "/") or folder.rstrip("/") == uri.rstrip("/")
    reason = "the folder of snapshots lies within the tree" if inside else "there are untracked files" if untracked is not None and not untracked.isEmpty() else None
    now = listing(spark, uri, skip)
    if reason:
        return contents(now, uri, limit).withColumn("fresh", F.lit(True)), {"state": "refused", "reason": reason}
    kept = Snapshots(spark, folder, max_age, clock)
    last = kept.latest()
    note = {"state": "used" if last else "none", "pruned": len(kept.prune())}
    if last:
        before = spark.read.parquet(last).drop("fresh")
        note["age"] = int(clock() - int(last.rsplit("-", 2)[1]) / 1000)
        facts = ["path", "size_bytes", "modified"]
        again = contents(now.join(before.select(*facts), facts, "left_anti"), uri, limit)
        files = before.join(now.select(*facts), facts, "left_semi").withColumn("fresh", F.lit(False)).select(*again.columns, "fresh").union(again.withColumn("fresh", F.lit(True)))
    else:
        files = contents(now, uri, limit).withColumn("fresh", F.lit(True))
    path = kept.publish(files)
    files = spark.read.parquet(path)
    sums = files.agg(F.count_if("fresh").alias("read"), F.count_if(~F.col("fresh")).alias("reused")).first()
    note |= {"read": sums["read"], "reused": sums["reused"]}
    if last:
        note["gone"] = spark.read.parquet(last).join(files.select("path"), "path", "left_anti").count()
    return files, note


def records(files: DataFrame, repo_id: str) -> DataFrame:
    """Files of a tree as a scan's file records."""
    return scan.file_records(files.select(F.lit(repo_id).alias("repo_id"), "path", "size_bytes", "content"))
