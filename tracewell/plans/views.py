"""Fixed views of the given tables as evidence data, for Spark and, as text, for SQL.

The given tables hold orders, documents, pages and events; these views read them
as investigations, candidates, passages and cases. Probabilities are whole
percents, so that thresholds compare integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: line items in a partition of gathered candidates, so that a task's sorts take the same memory at any size.
ITEMS_A_PART = 250_000


def candidates(spark: SparkSession, sf_dir: str, gathered: bool = False) -> DataFrame:
    """A line item as a retrieved candidate of the investigation of its order's customer.

    With ``gathered``, an investigation's items are moved to one partition as they
    are in the tables, narrower than the candidates made of them, so that no
    window or grouping within an investigation moves them again. There are as
    many partitions as the items ask for: those that are merged up to a number of
    compressed bytes hold too many narrow rows for the sorts of one task.
    """
    c = F.col
    items = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")
    )
    if gathered:
        parts = table(spark, sf_dir, "lineitem").count() // ITEMS_A_PART + 1
        items = items.repartition(max(parts, spark.sparkContext.defaultParallelism), "o_custkey")
    d, t = F.round(c("l_discount") * 100).cast("int"), F.round(c("l_tax") * 100).cast("int")
    even = c("l_partkey") % 2 == 0
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return items.select(
        c("o_custkey").alias("inv"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), c("l_quantity").cast("int")
        ).alias("cand_id"),
        F.element_at(kinds, c("l_linenumber")).alias("kind"),
        F.when(c("l_returnflag") == "A", "EXACT_MATCH").when(c("l_returnflag") == "R", "NEAR_MATCH").otherwise("VISUAL_LEAD").alias("relationship"),
        F.concat(F.lit("d"), c("l_suppkey") % 12).alias("domain"),
        F.concat(F.lit("g"), c("l_partkey") % 7).alias("grp"),
        F.when(even, "separate_origin_evidenced")
        .when(c("l_linestatus") == "O", "shared_origin_evidenced")
        .otherwise("unresolved")
        .alias("origin_status"),
        F.when(c("l_linenumber") % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(c("l_linenumber") % 3 == 1, F.date_format("l_shipdate", "yyyy-MM"))
        .otherwise(F.date_format("l_shipdate", "yyyy"))
        .alias("published_at"),
        F.when(c("l_linenumber") % 3 == 0, "day").when(c("l_linenumber") % 3 == 1, "month").otherwise("year").alias("precision"),
        F.when(c("l_linenumber") == 7, "disputed").otherwise("usable").alias("date_status"),
        c("l_quantity").cast("int").alias("position"),
        (100 - 4 * d).alias("relevance"),
        (12 * t).alias("different"),
        (96 - 12 * t).alias("same"),
        (10 * d).alias("contradicts"),
        (100 - 10 * d).alias("supports"),
        (12 * ((d + t) % 9)).alias("loc_different"),
        (12 * ((2 * d + t) % 9)).alias("historical"),
        (10 * ((d + 3 * t) % 9)).alias("fact_check"),
        (10 * ((3 * d + t) % 10)).alias("reporting"),
        F.concat(F.lit("https://d"), c("l_suppkey") % 12, F.lit(".example.com/p"), c("l_partkey") % 25).alias("url"),
        F.when(c("l_partkey") % 5 != 0, F.concat(F.lit("title "), c("l_partkey"))).alias("title"),
    )


#: The kind of retrieval by line number, and the order of kinds in a pool.
KINDS = ("lens_exact", "lens_visual", "about_image", "google_search", "google_news", "source_link", "google_search")

CANDIDATES = """
cand AS (
  SELECT *, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cand_v AS (
  SELECT o_custkey AS inv,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS INT)) AS cand_id,
    ['lens_exact','lens_visual','about_image','google_search','google_news','source_link','google_search'][l_linenumber] AS kind,
    CASE l_returnflag WHEN 'A' THEN 'EXACT_MATCH' WHEN 'R' THEN 'NEAR_MATCH' ELSE 'VISUAL_LEAD' END AS relationship,
    'd' || (l_suppkey % 12) AS domain, 'g' || (l_partkey % 7) AS grp,
    CASE WHEN l_partkey % 2 = 0 THEN 'separate_origin_evidenced' WHEN l_linestatus = 'O' THEN 'shared_origin_evidenced'
         ELSE 'unresolved' END AS origin_status,
    CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y-%m')
         ELSE strftime(l_shipdate, '%Y') END AS published_at,
    CASE l_linenumber % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS precision,
    CASE WHEN l_linenumber = 7 THEN 'disputed' ELSE 'usable' END AS date_status,
    CAST(l_quantity AS INT) AS position,
    100 - 4 * d AS relevance, 12 * t AS different, 96 - 12 * t AS same, 10 * d AS contradicts, 100 - 10 * d AS supports,
    12 * ((d + t) % 9) AS loc_different, 12 * ((2 * d + t) % 9) AS historical,
    10 * ((d + 3 * t) % 9) AS fact_check, 10 * ((3 * d + t) % 10) AS reporting,
    'https://d' || (l_suppkey % 12) || '.example.com/p' || (l_partkey % 25) AS url,
    CASE WHEN l_partkey % 5 <> 0 THEN 'title ' || l_partkey END AS title
  FROM cand),
core_v AS (SELECT *, relationship <> 'VISUAL_LEAD' AS core, relevance >= 70 AS relevant,
    relationship <> 'VISUAL_LEAD' AND relevance >= 70 AND (different >= 75 OR contradicts >= 75 OR loc_different >= 75) AS conflict,
    relationship <> 'VISUAL_LEAD' AND relevance >= 70 AND (same >= 75 OR supports >= 75) AS support
  FROM cand_v),
dated_v AS (
  SELECT *, CASE precision WHEN 'month' THEN published_at || '-01' WHEN 'year' THEN published_at || '-01-01' ELSE published_at END AS day_start,
    CASE precision WHEN 'month' THEN strftime(last_day(CAST(published_at || '-01' AS DATE)), '%Y-%m-%d')
         WHEN 'year' THEN published_at || '-12-31' ELSE published_at END AS day_end
  FROM core_v WHERE date_status = 'usable' AND published_at IS NOT NULL AND core)
"""
