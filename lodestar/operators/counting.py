"""Points of (task, file) pairs, counted in arrays for a part of a repository's files at a time; only the best of each task leave."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# How many of what a file holds count, and the points of each.
GAIN = {"content": (8, 2), "regex": (2, 12), "members": (3, 8), "literal": (3, 8), "task_defs": (2, 4)}
IN_PATH, SEVERAL, ONE_NAME = 3, 4, 5
LONG_NAME, PARTS = 6, 2  # a defined name of so many characters needs one part of the task's terms, others so many
FILES, TASKS = 8192, 256  # files of a part, tasks whose points are in memory together
BEST = "repo_id string, tno bigint, box int, base int, place bigint"
_OUT = pa.schema([("repo_id", pa.string()), ("tno", pa.int64()), ("box", pa.int32()), ("base", pa.int32()), ("place", pa.int64())])


def _whole(c: pa.ChunkedArray) -> pa.Array:
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def _listed(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a column of lists."""
    a = _whole(c)
    sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(a)), sizes), a.flatten().to_numpy(zero_copy_only=False)


def _shared(asked: tuple, held: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number on both sides, where it is asked for (places in ``asked``) and the rows that hold it."""
    (_, x), (f, y) = asked, held
    i, j = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    x, f, y = x[i], f[j], y[j]
    both = np.intersect1d(x, y)
    ends = zip(*(np.searchsorted(a, both, side) for a in (x, y) for side in ("left", "right")), strict=True)
    for a, b, c, d in ends:
        yield i[a:b], f[c:d]


def _counted(shape: tuple[int, int], asked: tuple, held: tuple) -> np.ndarray:
    out = np.zeros(shape, np.int32)
    for at, f in _shared(asked, held):
        out[asked[0][at][:, None], f] += 1
    return out


def _most(shape: tuple[int, int], asked: tuple, weights: np.ndarray, held: tuple) -> np.ndarray:
    out = np.zeros(shape, np.int32)
    for at, f in _shared(asked, held):
        cells = asked[0][at][:, None], f
        out[cells] = np.maximum(out[cells], weights[at][:, None])
    return out


def _named(shape: tuple[int, int], asked: tuple, files: pa.Table) -> np.ndarray:
    """How many names each file defines with enough parts among a task's terms."""
    out = np.zeros(shape, np.int32)
    names = _whole(files["def_ids"])
    owner = np.repeat(np.arange(shape[1]), pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False))
    if not len(owner) or not len(asked[0]):
        return out
    held, long = _listed(pa.chunked_array([names.flatten()])), _whole(files["def_long"]).flatten().to_numpy(zero_copy_only=False)
    cells = [(asked[0][at][:, None].astype(np.int64) * len(owner) + n).ravel() for at, n in _shared(asked, held)]
    if cells:
        cell, k = np.unique(np.concatenate(cells), return_counts=True)
        t, n = np.divmod(cell, len(owner))
        enough = (k >= PARTS) | long[n].astype(bool)
        np.add.at(out, (t[enough], owner[n[enough]]), 1)
    return out


def best_of(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``most`` best files of each task, and as many changed ones; ties go to the earlier place.

    Files: ``place, cls, is_changed, one_word`` and the numbers of what each holds; tasks:
    ``tno, base`` (points by class of file) and the numbers of what each asks for.
    """

    def best(files: pa.Table, tasks: pa.Table) -> pa.Table:
        out, n = [], files.num_rows
        files = files.sort_by("place")
        for begin in range(0, tasks.num_rows if n else 0, TASKS):
            out.append(_scored(files, tasks.slice(begin, TASKS).combine_chunks(), most))
        return pa.concat_tables(out) if out else _OUT.empty_table()

    return best


def _scored(files: pa.Table, tasks: pa.Table, most: int) -> pa.Table:
    n, shape = files.num_rows, (tasks.num_rows, files.num_rows)
    flag = lambda c: files[c].to_numpy().astype(bool)
    terms, tells = _listed(tasks["terms"]), _listed(tasks["tells"])
    points = lambda k, c: np.minimum(c, GAIN[k][0]) * GAIN[k][1]
    base = _listed(tasks["base"])[1].reshape(shape[0], -1)[:, files["cls"].to_numpy()].astype(np.int64)
    in_path = _counted(shape, terms, _listed(files["in_path"]))
    base += in_path * IN_PATH + (in_path >= 2) * SEVERAL
    base += ((in_path >= 2) & flag("one_word") & (_counted(shape, terms, _listed(files["in_name"])) == 1)) * ONE_NAME
    base += points("content", _counted(shape, tells, _listed(files["content"])))
    base += points("regex", _counted(shape, terms, _listed(files["runs"])))
    base += points("members", _counted(shape, _listed(tasks["members"]), _listed(files["members"])))
    base += points("literal", _most(shape, _listed(tasks["fragments"]), _listed(tasks["times"])[1], _listed(files["fragments"])))
    base += points("task_defs", _named(shape, _listed(tasks["by_name"]), files))

    key = base * n + np.arange(n - 1, -1, -1)
    tno = tasks["tno"].to_numpy()
    f, t = _listed(files["apart"])  # pairs that are scored elsewhere
    order = np.argsort(tno)
    at = np.minimum(np.searchsorted(tno[order], t), len(tno) - 1)
    ours = tno[order][at] == t
    none = np.iinfo(np.int64).min
    key[order[at[ours]], f[ours]] = none
    found = []
    for box, among in enumerate((np.arange(n), np.flatnonzero(flag("is_changed")))):
        k = min(most, len(among))
        if k:
            part = key[:, among]
            top = np.argpartition(part, len(among) - k, axis=1)[:, len(among) - k :]
            t, c = np.repeat(np.arange(shape[0]), k), among[top.ravel()]
            keep = key[t, c] != none
            found.append((t[keep], np.full(keep.sum(), box), c[keep]))
    t, box, c = (np.concatenate(x) for x in zip(*found, strict=True))
    repo = pa.array([files["repo_id"][0].as_py()] * len(t), pa.string())
    return pa.table([repo, pa.array(tno[t], pa.int64()), pa.array(box, pa.int32()), pa.array(base[t, c], pa.int32()), pa.array(files["place"].to_numpy()[c], pa.int64())], schema=_OUT)
