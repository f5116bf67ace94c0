"""Runs of a job, each in a folder of its own, and the numbered commits that tell readers which one to see.

A run writes ``destination/runs/<run>``. When all its tables are there, the run is committed: ``destination/commits/<number>`` is
created under the next free number, which only one writer can do; a writer who comes second takes the number after. The
commit names the run, and for tables that lie elsewhere their folders. Readers follow the commit with the highest number, so
they see one whole run, also while others write or commit.

What a commit names stays for a retention time after the next commit, so a reader who has opened a table can finish.
Commits whose columns the newest commit holds back are the exception: they go at once. Runs that were never committed are
another writer's work in progress and stay, until they are so old that their writer must be gone.

Files are put, listed and removed by the file system that Spark uses, which needs a session with a JVM of its own (a
Connect session has none). Putting is as safe as the store: HDFS and local disks let one writer win.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

RUNS, COMMITS = "runs", "commits"
#: Seconds after which a run without a commit counts as abandoned.
ABANDONED = 7 * 86_400.0


@dataclass(frozen=True)
class Commit:
    """What readers see: a run, folders of tables that lie outside it, all folders needed, and the columns shown.

    Paths are relative to the destination where they lie in it. ``more`` is for the writer's own use.
    """

    number: int
    run: str
    at: float
    tables: dict[str, list[str]] = field(default_factory=dict)
    folders: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    more: dict = field(default_factory=dict)


def new_run() -> str:
    """A name that tells when the run began."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def run_folder(destination: str, run: str) -> str:
    return f"{destination}/{RUNS}/{run}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a readable table."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), java


def _names(spark: SparkSession, path: str, folders: bool) -> list[str]:
    system, java = _files(spark, path)
    if not system.exists(java):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(java) if s.isDirectory() == folders)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path; none if it is not there."""
    return _names(spark, path, True)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder or file with all it holds."""
    system, java = _files(spark, path)
    system.delete(java, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; false if it is there already."""
    system, java = _files(spark, path)
    system.mkdirs(java.getParent())
    if system.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            handle = os.open(java.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as file:
            file.write(text)
        return True
    if system.exists(java):
        return False
    try:
        out = system.create(java, False)
    except Exception:
        if system.exists(java):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _path(destination: str, number: int) -> str:
    return f"{destination}/{COMMITS}/{number:012d}.json"


def commit_numbers(spark: SparkSession, destination: str) -> list[int]:
    """Numbers of the commits that are kept, ascending."""
    names = _names(spark, f"{destination}/{COMMITS}", False)
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def read_commit(spark: SparkSession, destination: str, number: int) -> Commit | None:
    """A commit; none while its writer still writes it, or once it is removed."""
    try:
        rows = spark.read.option("wholetext", True).text(_path(destination, number)).collect()  # one small file
        return Commit(**json.loads("".join(r[0] for r in rows)))
    except json.JSONDecodeError:
        return None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_commit(spark: SparkSession, destination: str) -> Commit | None:
    """What readers see now."""
    for number in reversed(commit_numbers(spark, destination)):
        found = read_commit(spark, destination, number)
        if found:
            return found
    return None


def current_run(spark: SparkSession, destination: str) -> str:
    """The run that readers see."""
    return current_commit(spark, destination).run


def current_commit(spark: SparkSession, destination: str) -> Commit:
    found = latest_commit(spark, destination)
    if found is None:
        raise FileNotFoundError(f"nothing is published under {destination}")
    return found


def table_path(destination: str, commit: Commit, name: str) -> str:
    """Where a table of a commit lies; ``name`` may go on into its folder. A table in several folders has one path for all."""
    head, slash, rest = name.partition("/")
    paths = commit.tables.get(head) or [f"{RUNS}/{commit.run}/{head}"]
    if len(paths) > 1:
        parent = paths[0].rpartition("/")[0]
        return f"{destination}/{parent}/{{{','.join(p.rpartition('/')[2] for p in paths)}}}{slash}{rest}"
    return f"{destination}/{paths[0]}{slash}{rest}"


def publish_run(spark: SparkSession, destination: str, run: str, columns: Sequence[str] = (), held_back: Iterable[str] = (),
                tables: Mapping[str, list[str]] | None = None, folders: Sequence[str] = (), more: dict | None = None,
                retention: float = 0.0) -> Commit:
    """Commit a finished run and remove what no reader needs any more."""
    number = (commit_numbers(spark, destination) or [0])[-1] + 1
    while True:
        commit = Commit(number, run, time.time(), dict(tables or {}), [f"{RUNS}/{run}", *folders], list(columns), more or {})
        if put_if_absent(spark, _path(destination, number), json.dumps(commit.__dict__)):
            break
        number += 1
    clean(spark, destination, retention, held_back)
    return commit


def clean(spark: SparkSession, destination: str, retention: float, held_back: Iterable[str] = ()) -> None:
    """Remove commits superseded longer than ``retention`` seconds ago, or showing a column of ``held_back``, and folders that
    only they need; then runs that were abandoned before they were committed."""
    now, hidden = time.time(), set(held_back)
    found = [c for c in (read_commit(spark, destination, n) for n in commit_numbers(spark, destination)) if c]
    old, kept = [], found[-1:]
    for commit, following in zip(found, found[1:]):
        outdated = now - following.at >= retention or hidden & set(commit.columns)
        (old if outdated else kept).append(commit)
    needed = {folder for commit in kept for folder in commit.folders}
    place = lambda folder: folder if "://" in folder or folder.startswith("/") else f"{destination}/{folder}"
    for commit in old:
        for folder in commit.folders:
            if folder not in needed:
                remove(spark, place(folder))
        remove(spark, _path(destination, commit.number))
    committed = {commit.run for commit in found}
    for run in listed(spark, f"{destination}/{RUNS}"):
        began = run.partition("-")[0]
        if run not in committed and began.isdigit() and now - int(began) / 1e9 > ABANDONED + retention:
            remove(spark, run_folder(destination, run))
