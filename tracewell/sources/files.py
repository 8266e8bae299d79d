"""Sources and sinks: event lines, search responses, case snapshots, ledgers.

Lines that cannot be read are rows of a rejects table, never an exception in a
task. Writing is append-only; the current state is a query (operators.cases).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The event types of a stream, and the arrays of a search response by kind of search.
EVENT_TYPES = (
    "investigation.started", "stage.started", "stage.completed", "search.batch", "evidence.discovered", "evidence.classified",
    "provenance.partial", "verdict.preliminary", "divergence.detected", "investigation.completed", "investigation.error",
)
#: Nested values of an event stay JSON texts.
EVENT = (
    "type string, investigationId string, stage string, detail string, engine string, count long, evidence string, id string, "
    "publicJudgment string, timeline string, verdict string, divergence string, result string, code string, message string"
)
LEAD = "array<struct<link string, title string, snippet string, position int, date string>>"
SURFACES = {
    "search": "organic_results", "news": "news_results", "visual": "visual_matches", "exact": "exact_matches", "about": "about_this_image",
}
RESPONSE = (
    f"search_metadata struct<status string, id string>, error string, organic_results {LEAD}, news_results {LEAD}, "
    f"visual_matches {LEAD}, exact_matches {LEAD}, about_this_image struct<sections array<struct<page_results {LEAD}>>>"
)
CASE_VERSION = "tracewell-case-v1"
CASE = (
    "version string, case_id string, revision int, created_at timestamp, evidence array<struct<id string, source_url string, title string, "
    "text string, published string, precision string, attribution string, retrieved_at timestamp>>"
)
LEDGER = "period string, seq long, kind string, amount long"


def event_lines(lines: DataFrame) -> DataFrame:
    """Event rows of lines (column ``value``), with told, whether a line is an object with a text as type, and ok, whether the type is known.

    Blank lines are no rows. Other columns of ``lines`` stay.
    """
    variant = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(variant, "$.type", "variant"))
    told = F.trim("value").startswith("{") & F.coalesce(kind == "STRING", F.lit(False))
    rows = lines.where(F.trim("value") != "").select("*", told.alias("told"), F.from_json("value", EVENT).alias("e"))
    return rows.select(
        *lines.columns,
        "told",
        (F.col("told") & F.coalesce(F.col("e.type").isin(*EVENT_TYPES), F.lit(False))).alias("ok"),
        "e.type",
        F.col("e.investigationId").alias("investigation_id"),
        "e.stage", "e.detail", "e.engine", F.col("e.count").alias("n"),
        F.coalesce("e.id", F.get_json_object("e.evidence", "$.id")).alias("evidence_id"),
        "e.evidence", F.col("e.publicJudgment").alias("judgment"), "e.timeline", "e.verdict", "e.divergence", "e.result", "e.code", "e.message",
    )


def read_events(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of NDJSON files.

    The tolerant reader skips what it cannot read and lines without a text type;
    the strict one rejects unknown types as well. A last line without a line end is read.
    """
    rows = event_lines(spark.read.text(path))
    good = F.col("ok") if strict else F.col("told")
    return rows.where(good).drop("value", "told", "ok"), rows.where(~good).select("value")


def write_events(events: DataFrame, path: str) -> None:
    """Append events as lines; ``payload``, if there, is the line, else the columns are."""
    if "payload" in events.columns:
        events.select("payload").write.mode("append").text(path)
    else:
        events.write.mode("append").json(path)


def response_state(kind: str, raw: Column) -> Column:
    """success, provider_error, empty or malformed. Empty needs the status Success and a message that there are no results."""
    status = F.get_json_object(raw, "$.search_metadata.status")
    error = F.get_json_object(raw, "$.error")
    surface = F.get_json_object(raw, f"$.{SURFACES[kind]}")
    nothing = F.coalesce(error.rlike(r"(?i)(?:no|hasn't returned any) results"), F.lit(False))
    return (
        F.when(F.try_parse_json(raw).isNull(), "malformed")
        .when((status == "Success") & surface.isNotNull(), "success")
        .when((status == "Success") & nothing, "empty")
        .when(error.isNotNull() | (status != "Success"), "provider_error")
        .otherwise("malformed")
    )


def leads(responses: DataFrame, kind: str) -> DataFrame:
    """(inv, search_id, kind, n, link, title, snippet, position, date) from raw responses (inv, raw); n is their place from 0.

    Leads without a text link are dropped; their number is in lead_counts.
    """
    rows = responses.select("inv", F.from_json("raw", RESPONSE).alias("r"))
    items = F.flatten(F.transform("r.about_this_image.sections", lambda s: s["page_results"])) if kind == "about" else F.col(f"r.{SURFACES[kind]}")
    flat = rows.select("inv", F.col("r.search_metadata.id").alias("search_id"), F.posexplode(items).alias("n", "lead"))
    return flat.select("inv", "search_id", F.lit(kind).alias("kind"), "n", "lead.*").where(F.col("link").rlike("^https?://"))


def lead_counts(responses: DataFrame, kind: str) -> DataFrame:
    """(inv, returned, usable) of each response."""
    rows = responses.select("inv", F.from_json("raw", RESPONSE).alias("r"))
    items = F.flatten(F.transform("r.about_this_image.sections", lambda s: s["page_results"])) if kind == "about" else F.col(f"r.{SURFACES[kind]}")
    usable = F.size(F.filter(items, lambda x: x["link"].rlike("^https?://")))
    return rows.select("inv", F.coalesce(F.size(items), F.lit(0)).alias("returned"), F.greatest(F.coalesce(usable, F.lit(0)), F.lit(0)).alias("usable"))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects) of JSON snapshots; another version than the known one is rejected."""
    rows = spark.read.schema(CASE).option("multiLine", True).json(path)
    good = F.coalesce(F.col("version") == CASE_VERSION, F.lit(False)) & F.col("case_id").isNotNull() & F.col("revision").isNotNull()
    return rows.where(good), rows.where(~good)


def append_revisions(accepted: DataFrame, path: str, buckets: int = 64) -> None:
    """Append accepted revisions, partitioned by a bucket of the case; old revisions stay readable."""
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")
    accepted.withColumn("case_bucket", bucket).repartition("case_bucket").write.mode("append").partitionBy("case_bucket").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) of ledger files: header lines, which have a key of that name, are skipped, kinds other than grant and reserve rejected."""
    rows = spark.read.text(path).where(F.get_json_object("value", "$.header").isNull()).select("value", F.from_json("value", LEDGER).alias("l"))
    good = F.coalesce(F.col("l.kind").isin("grant", "reserve") & (F.col("l.amount") >= 0), F.lit(False))
    return rows.where(good).select("l.*"), rows.where(~good).select("value")
