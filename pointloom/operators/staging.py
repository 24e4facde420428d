"""Tables written to the shared folder so that lineage ends there.

A plan that reads the same intermediate more than once, or that loops, writes it
with `stage` and goes on from the files. Lost executors then cost a re-read, never
a recomputation from the sources. The folder is `spark.checkpoint.dir`; without it a
local session uses a temporary folder and a cluster uses the warehouse folder, if
that is one that its executors share; a folder of one machine is refused there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables, read from the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.TemporaryDirectory(prefix="pointloom-")
        return "file://" + _local_dirs[app].name
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if folder.startswith("file:") or "://" not in folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` to the shared folder and return the table as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pointloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._pl_path = path
    return table


def _delete(session: SparkSession, path: str) -> None:
    try:
        target = session._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def discard(table: DataFrame) -> None:
    """Delete a table returned by `stage` that nothing reads any more, such as the last round's of a loop."""
    path = table.__dict__.get("_pl_path")
    if path is not None:
        _delete(table.sparkSession, path)
        _staged[:] = [(s, p) for s, p in _staged if p != path]


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables staged so far; their frames can't be read afterwards."""
    keep = []
    for session, path in _staged:
        if spark is not None and session is not spark:
            keep.append((session, path))
            continue
        _delete(session, path)
    _staged[:] = keep


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what was staged in it: for sessions that run many queries and keep none of their frames."""
    before = {path for _, path in _staged}
    try:
        yield
    finally:
        for session, path in list(_staged):
            if session is spark and path not in before:
                _delete(session, path)
        _staged[:] = [(s, p) for s, p in _staged if s is not spark or p in before]


atexit.register(release)
