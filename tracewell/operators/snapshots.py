"""What all events of an investigation say together, as entries that each event writes.

An investigation's snapshot is not one row: it is a row for each of its entries
(a stage's status, a field of an evidence item, a search's count), so that a
long-running investigation is never rewritten whole, in a batch or in a stream.
An entry has the value that the event with the largest seq wrote to it; only the
investigation's own id stays with the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "inv long, seq long, type string, key string, count long, text string, fields map<string,string>, items array<string>"
ENTRY = "array<struct<part string, key string, field string, value string>>"
#: What an error says that has no code or message of its own.
NO_CODE, NO_MESSAGE = "investigation_failed", "The investigation could not be completed."
#: What an investigation's error says that ended by its timer.
STALLED = "stream_stalled"
RUNNING = "streaming"
# The stages that are known, in their order; others follow in the order of their first event.
STAGES = (
    "CLIENT_PREPROCESS", "INITIAL_RETRIEVAL", "NORMALIZE", "VERIFY_MEDIA", "SCREEN_REPORTING_ORIGINS", "FAST_CLASSIFY", "PRELIMINARY",
    "EXPAND_IF_NEEDED", "DEEP_READ", "REFINED_CLASSIFY", "REFINE_REPORTING_ORIGINS", "CHRONOLOGY", "DIVERGENCE", "FINAL_POLICY", "COMPLETE",
)


def _entry(part: str, key: Column, field: str, value: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(field).alias("field"), value.cast("string").alias("value"))


def writes(events: DataFrame, keep_silent: bool = False) -> DataFrame:
    """(inv, seq, part, key, field, value) that each event writes; events of other types, or without what theirs needs, write nothing.

    Evidence without an id is an item of its own, named by its event. With
    ``keep_silent``, an event that writes nothing gives a row without an entry.
    """
    c, none, record = F.col, F.lit(""), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    item = F.coalesce("key", F.concat(F.lit("#"), "seq"))
    named = lambda part: F.transform(
        F.map_entries("fields"), lambda e: F.struct(F.lit(part).alias("part"), item.alias("key"), e["key"].alias("field"), e["value"].alias("value"))
    )
    of = {
        "investigation.started": (c("key").isNotNull(), F.array(_entry("id", none, "id", c("key")))),
        "stage.started": (c("key").isNotNull(), F.array(_entry("stage", c("key"), "status", F.lit("running")))),
        "stage.completed": (
            c("key").isNotNull(), F.array(_entry("stage", c("key"), "status", F.lit("completed")), _entry("stage", c("key"), "detail", c("text"))),
        ),
        "search.batch": (c("key").isNotNull() & c("count").isNotNull(), F.array(_entry("search", c("key"), "count", c("count")))),
        "evidence.discovered": (c("fields").isNotNull(), F.concat(F.array(_entry("evidence", item, "", F.lit("discovered"))), named("evidence"))),
        "evidence.classified": (c("key").isNotNull() & c("fields").isNotNull(), F.array(_entry("classification", c("key"), "", record))),
        "provenance.partial": (c("items").isNotNull(), F.array(_entry("timeline", none, "items", F.size(F.array_compact("items"))))),
        "verdict.preliminary": (c("text").isNotNull(), F.array(_entry("verdict", none, "preliminary", c("text")))),
        "divergence.detected": (c("fields").isNotNull(), F.array(_entry("divergence", none, "", record))),
        "investigation.completed": (
            c("fields").isNotNull(), F.array(_entry("phase", none, "", F.lit("completed")), _entry("result", none, "", record)),
        ),
        "investigation.error": (
            F.lit(True),
            F.array(
                _entry("phase", none, "", F.lit("failed")),
                _entry("error", none, "code", F.coalesce("key", F.lit(NO_CODE))),
                _entry("error", none, "message", F.coalesce(F.nullif("text", none), F.lit(NO_MESSAGE))),
            ),
        ),
    }
    made = F.array().cast(ENTRY)
    for kind, (valid, entries) in of.items():
        made = F.when((c("type") == kind) & valid, entries.cast(ENTRY)).otherwise(made)
    exploded = F.explode_outer(made) if keep_silent else F.explode(made)
    return events.select("inv", "seq", exploded.alias("w")).select("inv", "seq", "w.*")


def snapshots(events: DataFrame) -> DataFrame:
    """(inv, part, key, field, value, seq, first_seq): the entries of each investigation.

    ``seq`` is the event that wrote the value, ``first_seq`` the first that wrote
    the entry. Every investigation has a phase, and one with an error says
    whether it had evidence by then (``partial``). Partial aggregates by entry, so
    that no investigation is a hot partition.
    """
    rows = writes(events)
    order = F.when(F.col("part") == "id", -F.col("seq")).otherwise(F.col("seq"))
    entries = rows.groupBy("inv", "part", "key", "field").agg(
        F.max_by("value", order).alias("value"), F.max_by("seq", order).alias("seq"), F.min("seq").alias("first_seq")
    )
    failed = F.when((F.col("part") == "error") & (F.col("field") == "code"), F.col("seq"))
    states = rows.groupBy("inv").agg(F.max(failed).alias("failed"), F.min(F.when(F.col("part") == "evidence", F.col("seq"))).alias("evidence"), F.count_if(F.col("part") == "phase").alias("phases"))
    partial = states.where("failed IS NOT NULL").select(
        "inv", F.lit("error").alias("part"), F.lit("").alias("key"), F.lit("partial").alias("field"),
        F.coalesce(F.col("evidence") < F.col("failed"), F.lit(False)).cast("string").alias("value"), F.col("failed").alias("seq"), F.col("failed").alias("first_seq"),
    )
    every = events.select("inv").distinct().join(states.where("phases > 0").select("inv"), "inv", "left_anti")
    null = F.lit(None).cast("long")
    running = every.select("inv", F.lit("phase").alias("part"), F.lit("").alias("key"), F.lit("").alias("field"), F.lit(RUNNING).alias("value"), null.alias("seq"), null.alias("first_seq"))
    return entries.unionByName(partial).unionByName(running)


def stages(entries: DataFrame) -> DataFrame:
    """(inv, place, stage, status, detail): the stages of each investigation, from snapshots(); there are few."""
    rows = entries.where("part = 'stage'").groupBy("inv", F.col("key").alias("stage")).agg(
        F.max(F.when(F.col("field") == "status", F.col("value"))).alias("status"),
        F.max(F.when(F.col("field") == "detail", F.col("value"))).alias("detail"),
        F.min("first_seq").alias("first_seq"),
    )
    known = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    rank = F.when(known > 0, known).otherwise(len(STAGES) + 1)
    place = F.row_number().over(Window.partitionBy("inv").orderBy(rank, "first_seq"))
    return rows.select("inv", place.alias("place"), "stage", "status", "detail")
