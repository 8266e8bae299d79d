"""The folder that driver and executors share, and stages written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only a local session without it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors.

    Within scratch() the folder goes when the scope ends, unless the frame is kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose written() folders are removed at its end, but for frames given to the function that it yields.

    Kept folders belong to the scope around it, or else to the caller, who may
    discard() the frames when no result reads them any more.
    """
    outer, paths, kept = _scope.get(), [], set()
    token = _scope.set(paths)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_to)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scope.reset(token)
        for path in paths:
            if path not in kept:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run within remove their shuffles' files as they end, not when the driver next collects garbage.

    For written stages, whose shuffles nothing reads again; the session's setting is put back afterwards.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Remove the folders of frames that written() gave."""
    for df in frames:
        remove(df.sparkSession, df._written_to)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)
