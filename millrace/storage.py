"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_run: ContextVar[Run | None] = ContextVar("run", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local (tests), a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; release() deletes it."""
    path = f"{scratch_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if (run := _run.get()) is not None:
        run.paths.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage, survives lost executors and runs the plan once (an eager checkpoint() runs its last stage
    twice).
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _forget(paths: list[tuple[SparkSession, str]]) -> None:
    for spark, path in paths:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
        if (spark, path) in _written:
            _written.remove((spark, path))


@atexit.register
def release() -> None:
    """Deletes all that staged() and fresh_path() have named; frames that read it are void afterwards."""
    _forget(list(_written))


class Run:
    """What is named within it, by this thread (or task) alone, whatever other runs name meanwhile."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Run:
        self._token = _run.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _run.reset(self._token)

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        """staged(df, label); whatever else the run has named before goes once that is written."""
        out = staged(df, label)
        _forget(self.paths[:-1])
        self.paths = self.paths[-1:]
        return out
