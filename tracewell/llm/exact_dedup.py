"""Exact deduplication through a persistent digest index.

The index is a folder of Parquet files, bucketed and sorted by digest, with one
partition for each batch that it took in. Any session that knows the folder can
open it: the bucketing is written beside the files, and each session registers
them as an external table. A batch is reduced to one row per digest before
anything is shuffled by digest, so a text that fills a third of the batch costs
one row per map task. New digests are found by a sort-merge anti-join against
the index, whose side is read bucket by bucket and not shuffled, and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists, remove, shared_dir
from .common import ASCII_LOWER, ASCII_UPPER, scratch, written

#: A digest held by more than 1/HOT_SHARE of the rows is joined by broadcast;
#: at most HOT_SHARE digests can be, whatever the number of rows.
HOT_SHARE = 1000
#: Digests that a bucket of a new index is meant for.
BUCKET_ROWS = 4_000_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, digest, row): SHA-256 of the text with A-Z lower-cased.

    A null text counts as empty. ``row`` tells apart rows that repeat a doc_id;
    it is drawn here unless a column of unique values is named.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
    )


def entries_of(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size): one row per digest; the largest doc_id stays, null ids last."""
    entries = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return entries.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


class DigestIndex:
    """A digest index in a folder that executors share: (digest, keep_id, batch).

    ``buckets`` counts for a new index; one that is there keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        if not self.exists():
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_spec")
        self.buckets = spark.read.schema("buckets int").json(f"{path}/_spec").first()["buckets"]
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/entries'"
        )
        if exists(spark, f"{path}/entries"):
            spark.catalog.recoverPartitions(self.name)

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/_spec/_SUCCESS")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def before(self, batch_id: str) -> DataFrame:
        """(digest, old_id) of every batch but this one, which may be on its second try."""
        return self.rows().where(F.col("batch") != batch_id).select("digest", F.col("keep_id").alias("old_id"))

    def _dealt(self, entries: DataFrame) -> DataFrame:
        """Entries in the index's buckets, so that the index itself stays where it is."""
        return entries.repartition(self.buckets, "digest")

    def fresh(self, entries: DataFrame, batch_id: str) -> DataFrame:
        """The entries that no other batch brought."""
        return self._dealt(entries).join(self.before(batch_id).hint("merge"), "digest", "left_anti")

    def known(self, entries: DataFrame, batch_id: str) -> DataFrame:
        """The entries that another batch brought, with its keep_id; the largest, should two have brought them at once."""
        found = self._dealt(entries).join(self.before(batch_id).hint("merge"), "digest")
        no_row = F.lit(None).cast(entries.schema["keep_row"].dataType)
        return found.groupBy("digest").agg(
            F.max("old_id").alias("keep_id"), no_row.alias("keep_row"), F.max("group_size").alias("group_size")
        )

    def append(self, fresh: DataFrame, batch_id: str) -> None:
        """Write the batch's partition; a second try replaces what the first one wrote."""
        rows = self._dealt(fresh.select("digest", "keep_id", F.lit(batch_id).alias("batch")))
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            rows.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(key, before)

    def decide(self, entries: DataFrame, batch_id: str) -> DataFrame:
        """(digest, keep_id, keep_row, group_size) of a batch's entries, written; its new digests are in the index afterwards."""
        entries = written(entries, "entries")
        fresh = written(self.fresh(entries, batch_id), "fresh")
        known = written(self.known(entries, batch_id), "known")
        self.append(fresh, batch_id)
        return fresh.unionByName(known)

    def ingest(
        self,
        batch: DataFrame,
        batch_id: str,
        id_col: str = "doc_id",
        text_col: str = "text",
        row_col: str | None = None,
    ) -> DataFrame:
        """Deduplicate ``batch`` against the index and itself, and append its new digests.

        Returns a row per batch row: doc_id, keep_id, group_size, kept,
        text_sha256, known, row. Of equal new texts the row with the largest doc_id
        stays (null ids last; of rows that repeat that id, one). A text that the
        index already has is ``known``: none of its rows is kept and keep_id is
        the index's. group_size counts the batch's rows with the text. Null texts
        count as empty; texts of any length are read whole; an empty batch gives an
        empty result; further columns, whatever their names, are ignored.

        A batch is named by ``batch_id``. A second try of it, after any failure,
        gives the same result: what it brought itself is never ``known`` to it.
        """
        with scratch(self.spark) as keep:
            rows = keep(written(digests(batch, id_col, text_col, row_col), "digests"))
            verdicts = keep(written(self.decide(entries_of(rows), batch_id), "verdicts"))
        return with_verdicts(rows, verdicts)

    def forget(self) -> None:
        """Remove the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each row with its digest's verdict; frequent digests are joined by broadcast, of which there can be HOT_SHARE."""
    hot_at = rows.count() // HOT_SHARE
    hot = verdicts.where(F.col("group_size") > hot_at) if hot_at else verdicts.limit(0)
    by_hot = rows.join(F.broadcast(hot), "digest")
    by_rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(
        verdicts.where(F.col("group_size") <= hot_at) if hot_at else verdicts, "digest"
    )
    return by_hot.unionByName(by_rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("keep_row").isNotNull() & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("keep_row").isNull().alias("known"),
        "row",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Deduplicate one table through an index of its own, which is removed once all verdicts are written.

    The table comes in two batches, the larger half of the ids first, so that
    what the index kept is the largest doc_id over all batches. Columns, nulls,
    ties and odd tables as in DigestIndex.ingest; group_size counts the table's
    rows with the text, and nothing is ``known``.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = keep(written(digests(docs, id_col, text_col, row_col), "digests"))
        n, least, most = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
        middle = least + (most - least) // 2 if least is not None else 0
        upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
        index = DigestIndex(spark, f"{shared_dir(spark)}/digest_index-{uuid.uuid4().hex}", max(8, n // BUCKET_ROWS))
        try:
            first = index.decide(entries_of(rows.where(upper)), "1")
            second = index.decide(entries_of(rows.where(~upper)), "2")
            # A digest has a row of the batch that kept it, and may have one more where it was known.
            both = first.unionByName(second).groupBy("digest").agg(
                F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("group_size").alias("group_size")
            )
            verdicts = keep(written(both, "verdicts"))
        finally:
            index.forget()
    return with_verdicts(rows, verdicts)


ORACLE_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
