"""What the operators of this subpackage share: table reading and written stages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, scratch, shuffles_removed, written

__all__ = ["ASCII_LOWER", "ASCII_UPPER", "crc_mod", "discard", "free_name", "scratch", "shuffles_removed", "small_batches", "table", "written"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n (null for null)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Texts handed to Python at once where an operator runs its own job. Some are
#: very long, and an executor holds a batch twice for each of its tasks.
BATCH = 500


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Jobs run within hand so many rows to Python at once; the session's setting is put back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
