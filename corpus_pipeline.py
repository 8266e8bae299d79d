"""Corpus preparation: documents in, packed pieces out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents, whatever further columns those have. Every
stage takes null and empty texts, null and repeated ids, very long texts and an
empty table; what becomes of them is stated at each. Stages that hand texts to
Python run that job themselves, in small batches, as an executor's memory has to
do for very long texts. Stages that drop documents write the keys of dropped
rows and no texts; a row's key is its file and its place there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, minhash, packing, pii, quality, simhash
from tracewell.llm.common import discard, free_name, scratch, small_batches, table, written
from tracewell.llm.queries import tokenizer_path

#: Keys of dropped rows that are joined to the texts by broadcast, 16 bytes each; more go by shuffle.
FEW = 1_000_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go.

    Null and empty texts are judged by their score like any other; of repeated
    rows all stay or all go; an empty table stays empty.
    """
    with scratch(spark) as keep:
        keyed, row = _keyed(docs, keep)
        with small_batches(spark):
            dropped = written(quality.rejected(keyed, table(spark, sf_dir, "labels"), row).toDF(row), "dropped")
        return _without(keyed, keep(dropped), row, docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts one row stays, that with the largest doc_id.

    Null texts equal empty ones; a null id is smaller than any other; of rows
    that repeat the largest id, one stays; an empty table stays empty.
    """
    with scratch(spark) as keep:
        keyed, row = _keyed(docs, keep)
        dropped = exact_dedup.dedup(keyed, row_col=row).where("NOT kept").select(F.col("row").alias(row))
        return _without(keyed, keep(written(dropped, "dropped")), row, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 as a stage: one document of each group of near-duplicates stays, that with the smallest doc_id.

    Groups are linked by 5-word shingles at Jaccard 0.8; candidates are those of
    the operator's fingerprints and covering masks, and of MinHash bands for
    similar texts that are further apart than its 3 bits. Null, empty and
    wordless texts are one group; a null id comes after any other; of rows that
    repeat the smallest id, one stays; an empty table stays empty.
    """
    with scratch(spark) as keep:
        keyed, row = _keyed(docs, keep)
        found = minhash.near_duplicates(keyed, row)
        dropped = found.select("row").join(simhash.keepers(found), "row", "left_anti").select(F.col("row").alias(row))
        return _without(keyed, keep(written(dropped, "dropped")), row, docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: spans of personal data are replaced by their kind.

    All rows stay, repeated ones too; null texts stay null and empty ones empty.
    """
    with scratch(spark) as keep, small_batches(spark):
        return keep(written(pii.redact(docs), "redacted"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of documents, in sequences.

    Null and empty texts are packed as their end id; rows that repeat an id, or
    have none, are documents of their own; an empty table gives no piece.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Classifier, shingle similarity, weak supervision and tokenizer are beyond SQL; see tests/llm.
ORACLE_SQL = None


def _keyed(docs: DataFrame, keep) -> tuple[DataFrame, str]:
    """The documents with a key of their own for each row, and that column's name.

    Rows that a plan reads from Parquet files, and only filters and projects, have
    one that stays, however often they are read: a hash of the file's path, and
    the row's place in the file. Rows of any other plan, which may repeat those of
    a file, are numbered and written.
    """
    row = free_name(docs, "_corpus_row")
    if "_metadata" not in (c.lower() for c in docs.columns) and _reads_each_row_once(docs):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        try:
            return docs.select("*", place.alias(row)), row
        except AnalysisException:
            pass
    return keep(written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")), row


def _reads_each_row_once(docs: DataFrame) -> bool:
    """Whether the plan is one scan below filters and projections, of folders or files that do not overlap."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() not in ("LogicalRelation", "LogicalRelationWithTable") or "HadoopFsRelation" not in node.relation().getClass().getName():
        return False
    found = node.relation().location().rootPaths()
    roots = sorted(f"{found.apply(i).toString().rstrip('/')}/" for i in range(found.size()))
    return not any(after.startswith(before) for before, after in zip(roots, roots[1:]))


def _without(keyed: DataFrame, dropped: DataFrame, row: str, docs: DataFrame) -> DataFrame:
    """The rows whose key was not dropped; texts move only if very many rows were."""
    few = dropped.count() <= FEW
    return keyed.join(F.broadcast(dropped) if few else dropped, row, "left_anti").select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of what they write only the last stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
        if before is not None:
            discard(before)
        before = docs
    return docs
