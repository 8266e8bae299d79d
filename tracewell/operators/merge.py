"""Merging of candidates that share a canonical URL, and resolution of their dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

# The order of retrieval kinds in a pool, and the strength of relationships.
KIND_ORDER = {"lens_exact": 0, "lens_visual": 1, "about_image": 2, "google_search": 3, "google_news": 4, "source_link": 5}
STRENGTH = {"EXACT_MATCH": 2, "NEAR_MATCH": 1, "VISUAL_LEAD": 0}
DATE_SOURCES = {"json_ld": 0, "meta": 1, "time": 2, "provider": 3}


def _lookup(values: dict[str, int], column: str, default: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(default))


def pool_order(candidates: DataFrame) -> DataFrame:
    """Adds ord: kind, provider rank (missing last), then id."""
    by = (_lookup(KIND_ORDER, "kind", 9), F.coalesce(F.col("position"), F.lit(2**31 - 1)), F.col("cand_id"))
    return candidates.withColumn("ord", F.row_number().over(Window.partitionBy("inv").orderBy(*by)))


def first_known(column: str) -> Column:
    """The first value in order that is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("ord")))


#: Fields of which the first known value is kept.
FIELDS = (
    "title", "snippet", "position", "search_id", "published_at", "date_source", "thumbnail", "image", "page_text", "judgment", "excerpt_source",
)


def by_canonical_url(candidates: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each (inv, url): the first row's id, the first known value of each field, the strongest relationship.

    The strongest relationship comes with its identity evidence, from the first
    row that has it. Date status and precision come together from the first row
    with a known status, and the date from the first that has one. Needs ord, as
    pool_order() gives it; those of ``fields`` and of identity that are no
    columns are left out. ``kinds`` are the kinds of retrieval; retrievals() has
    the retrievals themselves. Partial aggregates alone: a URL with very many
    rows costs one row a task.
    """
    there = set(candidates.columns)
    known = F.when(F.col("date_status") != "unknown", F.col("ord"))
    strength = F.struct(_lookup(STRENGTH, "relationship", -1), -F.col("ord"))
    held = [F.max_by(n, strength).alias(n) for n in ("relationship", "identity") if n in there]
    dated = [F.min_by(n, known).alias(n) for n in ("precision",) if n in there]
    return candidates.groupBy("inv", "url").agg(
        F.min_by("cand_id", "ord").alias("base_id"),
        *[first_known(f).alias(f) for f in fields if f in there],
        *held,
        *dated,
        F.coalesce(F.min_by("date_status", known), F.lit("unknown")).alias("date_status"),
        F.count(F.lit(1)).alias("n_merged"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
    )


def retrievals(candidates: DataFrame) -> DataFrame:
    """(inv, url, kind, search_id, place): the distinct retrievals of each merged row, in order of their first row, from 1."""
    once = candidates.groupBy("inv", "url", "kind", "search_id").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("inv", "url").orderBy("ord"))
    return once.withColumn("place", place).drop("ord")


def resolve_dates(sources: DataFrame) -> DataFrame:
    """(inv, url, value, precision, source, status, n_rejected) from date texts (inv, url, source, value, precision, ord).

    json_ld comes before meta, time and provider. Page sources that disagree, or
    provider texts that do while no page source is there, are disputed and give no
    date. A page's date stands against a provider's. Unparsed texts count as rejected.
    """
    rank = _lookup(DATE_SOURCES, "source", 9)
    rows = sources.withColumn("rank", rank).withColumn("tier", (F.col("source") == "provider").cast("int"))
    by = F.struct("rank", "ord", "value", "precision", "source", "tier")
    rows = rows.withColumn("w", F.min(F.when(F.col("value").isNotNull(), by)).over(Window.partitionBy("inv", "url")))
    differs = F.col("value").isNotNull() & dates.disagree(F.col("value"), F.col("precision"), F.col("w.value"), F.col("w.precision"))
    out = rows.groupBy("inv", "url").agg(
        F.any_value("w").alias("w"),
        F.bool_or(differs & (F.col("tier") == F.col("w.tier"))).alias("disputed"),
        F.count_if(differs).alias("differ"),
        F.count_if(F.col("value").isNull()).alias("unparsed"),
    )
    usable = F.col("w").isNotNull() & ~F.col("disputed")
    return out.select(
        "inv",
        "url",
        F.when(usable, F.col("w.value")).alias("value"),
        F.when(usable, F.col("w.precision")).otherwise("unknown").alias("precision"),
        F.when(usable, F.col("w.source")).alias("source"),
        F.when(F.col("w").isNull(), "unknown").when(F.col("disputed"), "disputed").otherwise("usable").alias("status"),
        (F.coalesce("differ", F.lit(0)) + F.col("unparsed")).alias("n_rejected"),
    )
