"""Tables written once and read by many reports, and named views.

A table lives until it is released, until the scope it was written in is closed, or until the program that wrote it ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's setting that removes the shuffle files of a job when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes that a batch of rows for tasks' Python may have.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Where a frame that materialize has returned keeps the path of its table.
_PATH = "_tabulon_table"
_local_folders: dict[str, str] = {}
#: Paths of this program that may still be there, with their sessions.
_kept: dict[str, SparkSession] = {}
#: Per session and setting the blocks that hold it, and its value before them.
_holders: dict[tuple[SparkSession, str], tuple[int, str | None]] = {}
_lock = threading.Lock()
_scope: ContextVar[list[str] | None] = ContextVar("paths of the innermost scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session's spark.checkpoint.dir names it.

    Only a local session without the setting gets a temporary folder of its own, removed at exit.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        folder = tempfile.mkdtemp(prefix="tabulon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[application] = folder
    return _local_folders[application]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files of a job, which go as the tables of materialize() do."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_remove_all)
    _kept[path] = spark
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them from there.

    Later reports read only the columns they need, with filters pushed into the scan, and a lost executor
    costs a re-read instead of a recomputation from the source; the shuffle files of the write go with it. release() removes the table, and so do the end of an
    enclosing table_scope() and of the program: frames built on it must have been computed by then.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _PATH, path)
    return table


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of jobs that end inside go at their end, not when the driver happens to collect garbage."""
    return held_setting(spark, CLEANUP, "true")


def small_arrow_batches(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Jobs that run inside pass rows to tasks' Python in batches of about that many bytes; a longer row goes alone.

    Without it a batch is 10,000 rows of any length, which a task holds whole outside of the heap, and its worker once more.
    """
    return held_setting(spark, BATCH_BYTES, str(size))


@contextmanager
def held_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting has the value inside. It is put back when the last of the blocks that hold it side by side has ended."""
    with _lock:
        holders, before = _holders.get((spark, key), (0, None))
        if not holders:
            before = spark.conf.get(key, None)
            spark.conf.set(key, value)
        _holders[spark, key] = (holders + 1, before)
    try:
        yield
    finally:
        with _lock:
            holders, before = _holders.pop((spark, key))
            if holders > 1:
                _holders[spark, key] = (holders - 1, before)
            else:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _remove(path: str) -> None:
    spark = _kept.pop(path, None)
    # A stopped session has no file system; its temporary folder goes by itself.
    if spark is not None and spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for path in list(_kept):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def release(*frames: DataFrame) -> None:
    """Remove the tables of frames that materialize() has returned; nothing that is still to be computed may read them."""
    for frame in frames:
        if (path := getattr(frame, _PATH, None)) is not None:
            _remove(path)


@contextmanager
def table_scope(*, keep_on_error: bool = False) -> Iterator[None]:
    """Owns the tables written inside and removes them at its end.

    Compute and save the results inside: frames of the job cannot be computed after it. A scope inside another one removes
    its own tables only. keep_on_error leaves them in place when the job raises, to look into it.
    """
    tables: list[str] = []
    token = _scope.set(tables)
    try:
        yield
    except BaseException:
        if not keep_on_error:
            _close(tables)
        raise
    else:
        _close(tables)
    finally:
        _scope.reset(token)


def _close(tables: list[str]) -> None:
    for path in tables:
        _remove(path)


def register_views(**frames: DataFrame) -> None:
    """Make each frame readable from spark.sql under the given name."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
