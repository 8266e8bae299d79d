"""Batch twins of the streaming operators, and audits over runs, ledgers and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def watch_changes(checks: DataFrame, seen: DataFrame) -> DataFrame:
    """(watch_id, url, seq, change): each check row against the row of its URL before it, or the stored digest.

    Checks are (watch_id, url, seq, digest, attribution); seen is (watch_id, url,
    seen_digest). A URL that a check lacks changes nothing.
    """
    before = F.lag("digest").over(Window.partitionBy("watch_id", "url").orderBy("seq"))
    rows = checks.withColumn("before", before).join(seen, ["watch_id", "url"], "left")
    prior = F.coalesce("before", "seen_digest")
    change = (
        F.when(prior.isNull(), F.when(F.col("attribution") == "page_quote", "new_passage").otherwise("new_lead"))
        .when(prior != F.col("digest"), "changed_sample")
    )
    return rows.select("watch_id", "url", "seq", change.alias("change")).where("change IS NOT NULL")


def due(watches: DataFrame, now: Column) -> DataFrame:
    """Active watches whose next check is not after now."""
    return watches.where(F.col("active") & (F.col("next_check") <= now))


def after_check(watches: DataFrame, succeeded: Column) -> DataFrame:
    """A success puts the next check off by the watch's 1 or 24 hours; a failure pauses the watch."""
    later = F.col("next_check") + F.make_dt_interval(hours=F.col("every_hours"))
    return watches.withColumn("next_check", F.when(succeeded, later).otherwise(F.col("next_check"))).withColumn("active", F.col("active") & succeeded)


def recent(rows: DataFrame, key: str, order: str, most: int = 50) -> DataFrame:
    """The last ``most`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def fold(events: DataFrame) -> DataFrame:
    """(inv, phase, n_evidence, n_stages, last_seq): what an event stream says of each investigation.

    The phase is the terminal event's if there is one, else "running". Partial
    aggregates, so one very long investigation is no hot partition.
    """
    terminal = F.col("event_type").isin("completed", "failed")
    rows = events.groupBy("inv").agg(
        F.max_by("event_type", F.when(terminal, F.col("seq"))).alias("phase"),
        F.count_distinct(F.when(F.col("event_type") == "evidence", F.col("key"))).alias("n_evidence"),
        F.count_distinct(F.when(F.col("event_type") == "stage", F.col("key"))).alias("n_stages"),
        F.max("seq").alias("last_seq"),
    )
    return rows.withColumn("phase", F.coalesce("phase", F.lit("running")))


def first_emissions(events: DataFrame) -> DataFrame:
    """(inv, key, seq): the first row of each evidence key."""
    return events.groupBy("inv", "key").agg(F.min("seq").alias("seq"))


def stage_durations(events: DataFrame) -> DataFrame:
    """(inv, stage, seconds): from the first to the last event of each stage, in whole seconds."""
    rows = events.groupBy("inv", F.col("event_type").alias("stage")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rows.select("inv", "stage", (F.unix_seconds("b") - F.unix_seconds("a")).alias("seconds"))


def stalls(events: DataFrame, seconds: int = 90) -> DataFrame:
    """(inv, seq, gap): events that came more than ``seconds`` after the one before."""
    before = F.lag("ts").over(Window.partitionBy("inv").orderBy("ts", "seq"))
    gap = F.unix_seconds("ts") - F.unix_seconds(before)
    return events.withColumn("gap", gap).where(F.col("gap") > seconds).select("inv", "seq", "gap")


#: Lines of a period that one task sums, on average.
LEDGER_BLOCK = 100_000


def ledger(lines: DataFrame, cap: int) -> DataFrame:
    """(period, seq, spent, allowed, overdrawn): running totals of reserve lines against the cap, which grants raise.

    A period's lines are cut into runs of seq, each summed on its own and started
    from the total of the runs before it, so that no period goes through one task.
    seq is unique in a period.
    """
    amount = lambda kind: F.when(F.col("kind") == kind, F.col("amount")).otherwise(F.lit(0).cast("long"))
    rows = lines.select("period", "seq", amount("reserve").alias("out"), amount("grant").alias("in"))
    bounds = rows.groupBy("period").agg(F.min("seq").alias("least"), F.max("seq").alias("most"), F.count(F.lit(1)).alias("n"))
    # Periods are few beside their lines; Spark broadcasts them only while they are.
    blocks = F.ceil(F.col("n") / LEDGER_BLOCK)
    block = F.floor((F.col("seq") - F.col("least")) * blocks / (F.col("most") - F.col("least") + 1)).cast("long")
    rows = rows.join(bounds, "period").select("period", "seq", "out", "in", block.alias("block"))
    sums = rows.groupBy("period", "block").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    before = Window.partitionBy("period").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("period", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("out", "in")])
    within = Window.partitionBy("period", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.select("period", "seq", "block", F.sum("out").over(within).alias("o"), F.sum("in").over(within).alias("i"))
    found = totals.join(starts, ["period", "block"]).select(
        "period", "seq", (F.col("o") + F.col("out_before")).alias("spent"), (F.lit(cap) + F.col("i") + F.col("in_before")).alias("allowed")
    )
    return found.withColumn("overdrawn", F.col("spent") > F.col("allowed"))


def daily_runs(events: DataFrame, most: int = 3) -> DataFrame:
    """(owner, day, n, over): runs of an owner on a day, and whether they exceed the limit."""
    rows = events.groupBy("owner", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("over", F.col("n") > most)


def request_log(requests: DataFrame, pool: DataFrame) -> DataFrame:
    """(inv, search, returned, retained): how many of a search's URLs are in the pool."""
    kept = pool.select("inv", "url").distinct().withColumn("kept", F.lit(1))
    return requests.join(kept, ["inv", "url"], "left").groupBy("inv", "search").agg(
        F.count(F.lit(1)).alias("returned"), F.count("kept").alias("retained")
    )


def candidate_audit(rows: DataFrame) -> DataFrame:
    """(inv, normalized, dropped, duplicate, withheld, retained, consistent) from rows with canonical url and safe."""
    keys = rows.groupBy("inv", "canonical").agg(F.count(F.lit(1)).alias("n"), F.bool_or("safe").alias("safe"))
    audit = keys.groupBy("inv").agg(
        F.coalesce(F.sum(F.when(F.col("canonical").isNotNull(), F.col("n"))), F.lit(0)).alias("normalized"),
        F.coalesce(F.sum(F.when(F.col("canonical").isNull(), F.col("n"))), F.lit(0)).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("canonical").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate"),
        F.count_if(F.col("canonical").isNotNull() & ~F.col("safe")).alias("withheld"),
        F.count_if(F.col("canonical").isNotNull() & F.col("safe")).alias("retained"),
    )
    return audit.withColumn("consistent", F.col("normalized") == F.col("duplicate") + F.col("withheld") + F.col("retained"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(expected, hit, miss): counts of observed against expected."""
    return pairs.groupBy("expected").pivot("observed", ["hit", "miss"]).count().na.fill(0, ["hit", "miss"])


def segment_violations(segments: DataFrame) -> DataFrame:
    """(media_id, start_ms, rule): segments that start before the one before, do not end after they start, or overrun."""
    before = F.lag("start_ms").over(Window.partitionBy("media_id").orderBy("seq"))
    rows = segments.withColumn("before", before)
    each = F.array_compact(
        F.array(
            F.when(F.col("start_ms") < F.col("before"), F.lit("starts_before_previous")),
            F.when(F.col("end_ms") <= F.col("start_ms"), F.lit("ends_before_start")),
            F.when(F.col("end_ms") > F.col("duration_ms"), F.lit("beyond_duration")),
        )
    )
    return rows.select("media_id", "start_ms", F.explode(each).alias("rule"))


def repetitive(segments: DataFrame) -> DataFrame:
    """(media_id, n, most, low_confidence): four segments or more of which one text makes up three and half."""
    texts = segments.groupBy("media_id", "norm").agg(F.count(F.lit(1)).alias("k"))
    rows = texts.groupBy("media_id").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    return rows.withColumn("low_confidence", (F.col("n") >= 4) & (F.col("most") >= 3) & (F.col("most") * 2 >= F.col("n")))


def speech_lead(segments: DataFrame, most_chars: int = 300) -> DataFrame:
    """(media_id, lead): all texts in order if they fit, else first, middle and last, cut at a word."""
    order = Window.partitionBy("media_id").orderBy("seq")
    rows = segments.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("media_id")))
    rows = rows.withColumn("chars", F.sum(F.length("text") + 1).over(Window.partitionBy("media_id")))
    middle = F.floor((F.col("n") + 1) / 2)
    kept = rows.where((F.col("chars") - 1 <= most_chars) | (F.col("i") == 1) | (F.col("i") == F.col("n")) | (F.col("i") == middle))
    said = kept.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    cut = F.regexp_replace(F.left(joined, F.lit(most_chars)), r"\s\S*\z", "")
    return said.select("media_id", F.when(F.length(joined) <= most_chars, joined).otherwise(cut).alias("lead"))


def merge_surfaces(leads: DataFrame) -> DataFrame:
    """(topic, url, search, position, n_alternates): the first owner of each URL in plan order; further dates are alternates."""
    rows = leads.groupBy("topic", "url").agg(
        F.min(F.struct("search", "position")).alias("f"), F.count_distinct("date_text").alias("n_dates")
    )
    return rows.select("topic", "url", "f.search", "f.position", F.greatest(F.col("n_dates") - 1, F.lit(0)).alias("n_alternates"))


def first_distinct(rows: DataFrame, key: str, value: str, order: str, most: int = 5) -> DataFrame:
    """(key, value, place): the first ``most`` distinct non-blank values in order of first appearance."""
    firsts = rows.where(F.trim(value) != "").groupBy(key, value).agg(F.min(order).alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at", value))
    return firsts.withColumn("place", place).where(F.col("place") <= most).select(key, value, "place")


def distinct_frames(frames: DataFrame) -> DataFrame:
    """(media_id, kept, skipped): frames kept by content hash, and how many repeats were skipped."""
    rows = frames.groupBy("media_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("skipped"))
