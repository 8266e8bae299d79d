"""Queries on event streams, watches, ledgers, transcripts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, snapshots, watches
from ..streaming import jobs
from ..streaming import snapshots as snapshot_stream
from .views import CANDIDATES, candidates, table

KINDS = {"view": "stage", "click": "evidence", "purchase": "completed", "error": "failed"}


def _events(spark, sf_dir) -> DataFrame:
    """User events as investigation events; the JSON's k is the evidence or stage key."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("inv"),
        F.col("event_id").alias("seq"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other")).alias("event_type"),
        F.get_json_object("props", "$.k").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").alias("value"),
    )


EVENTS = """ev_v AS (SELECT user_id AS inv, event_id AS seq, CASE event_type WHEN 'view' THEN 'stage' WHEN 'click' THEN 'evidence'
    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'other' END AS event_type,
    json_extract_string(props, '$.k') AS key, ts, CAST(floor(value) AS BIGINT) AS value FROM events)"""


def event_fold(spark, sf_dir):
    return watches.fold(_events(spark, sf_dir))


def first_emissions(spark, sf_dir):
    return watches.first_emissions(_events(spark, sf_dir).where("event_type = 'evidence'"))


def stage_durations(spark, sf_dir):
    return watches.stage_durations(_events(spark, sf_dir))


def stalled_streams(spark, sf_dir):
    return watches.stalls(_events(spark, sf_dir), 3600)


def watch_changes(spark, sf_dir):
    """Events as watch checks of a key, with a tenth of their value as digest; every third key was seen before as 10."""
    rows = _events(spark, sf_dir).select(
        F.col("inv").alias("watch_id"), F.col("key").alias("url"), "seq", F.floor(F.col("value") / 10).cast("string").alias("digest"),
        F.when(F.col("event_type") == "evidence", "page_quote").otherwise("snippet").alias("attribution"),
    )
    seen = rows.where("cast(url as int) % 3 = 0").select("watch_id", "url", F.lit("1").alias("seen_digest")).distinct()
    return watches.watch_changes(rows, seen)


def recent_checks(spark, sf_dir):
    return watches.recent(_events(spark, sf_dir), "inv", "seq").select("inv", "seq", "place")


def ledger_totals(spark, sf_dir):
    """Events as ledger lines of their day: purchases grant, the rest reserve."""
    lines = _events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd").alias("period"), "seq", "value",
        F.when(F.col("event_type") == "completed", "grant").otherwise("reserve").alias("kind"), F.col("value").alias("amount"),
    )
    return watches.ledger(lines, 500)


def daily_runs(spark, sf_dir):
    return watches.daily_runs(_events(spark, sf_dir).withColumnRenamed("inv", "owner"))


def request_log(spark, sf_dir):
    """Candidates by kind of search, against the pool of those with a top-20 rank."""
    rows = candidates(spark, sf_dir)
    return watches.request_log(rows.select("inv", F.col("kind").alias("search"), "url"), rows.where("position <= 20"))


def candidate_audit(spark, sf_dir):
    rows = candidates(spark, sf_dir).select(
        "inv", F.when(F.col("position") % 7 != 0, F.col("url")).alias("canonical"), (F.col("domain") != "d3").alias("safe")
    )
    return watches.candidate_audit(rows)


def match_confusion(spark, sf_dir):
    """Labels as expected outcomes, with texts of 400 characters or more as hits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 400, "hit").otherwise("miss").alias("observed"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("expected")).join(docs, "doc_id")
    return watches.confusion(rows)


def _segments(spark, sf_dir) -> DataFrame:
    """Conversation turns as transcript segments, as long as their text."""
    length = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), (F.col("turn") * 100 - length % 150).alias("start_ms"),
        (F.col("turn") * 100 + length % 90 - 10).alias("end_ms"), F.lit(650).alias("duration_ms"), "text",
        F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", "").alias("norm"),
    )


SEGMENTS = """sg_v AS (SELECT conv_id AS media_id, turn AS seq, turn * 100 - length(text) % 150 AS start_ms, turn * 100 + length(text) % 90 - 10 AS end_ms,
    text, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS norm FROM conversations)"""


def segment_violations(spark, sf_dir):
    return watches.segment_violations(_segments(spark, sf_dir))


def repetitive_recognition(spark, sf_dir):
    return watches.repetitive(_segments(spark, sf_dir))


def speech_leads(spark, sf_dir):
    return watches.speech_lead(_segments(spark, sf_dir))


def merged_surfaces(spark, sf_dir):
    rows = candidates(spark, sf_dir).select(
        F.col("inv").alias("topic"), "url", F.col("kind").alias("search"), "position", F.col("published_at").alias("date_text")
    )
    return watches.merge_surfaces(rows)


def related_queries(spark, sf_dir):
    rows = candidates(spark, sf_dir).select("inv", "title", "position").where("title IS NOT NULL")
    return watches.first_distinct(rows, "inv", "title", "position")


def distinct_frames(spark, sf_dir):
    rows = candidates(spark, sf_dir).select(F.col("inv").alias("media_id"), F.col("grp").alias("hash"))
    return watches.distinct_frames(rows)


def resolved_dates(spark, sf_dir):
    """Candidates' dates as date texts of their URL, from four sources by kind."""
    sources = F.create_map(
        *[F.lit(x) for x in ("lens_exact", "json_ld", "lens_visual", "meta", "about_image", "time", "google_search", "provider", "google_news", "provider", "source_link", "provider")]
    )
    rows = merge.pool_order(candidates(spark, sf_dir, gathered=True)).select(
        "inv", "url", F.element_at(sources, F.col("kind")).alias("source"), "precision", "ord",
        F.when(F.col("date_status") == "usable", F.col("published_at")).alias("value"),
    )
    return merge.resolve_dates(rows)


#: Event types by turns, and one that no reader knows yet.
TYPES = (
    "investigation.started", "stage.started", "stage.completed", "search.batch", "evidence.discovered", "evidence.classified",
    "provenance.partial", "verdict.preliminary", "divergence.detected", "investigation.completed", "investigation.error", "future.type",
)


def _typed(raw: DataFrame) -> DataFrame:
    """Rows of the events table as events of every type, some of which lack what their type needs."""
    k, v, c = F.get_json_object("props", "$.k").cast("int"), F.floor("value").cast("string"), F.col
    stage = F.concat(F.lit("stage."), k % 5)
    key = F.when(k % 2 == 0, F.element_at(F.array(*[F.lit(s) for s in snapshots.STAGES]), k % 15 + 1)).otherwise(stage)
    return raw.select(
        c("user_id").cast("long").alias("inv"),
        c("event_id").cast("long").alias("seq"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (c("event_id") * 7 % 12).cast("int") + 1).alias("type"),
        F.when(k % 10 != 0, key).alias("key"),
        F.when(k % 4 != 0, F.floor("value")).alias("count"),
        F.when(k % 3 == 1, F.lit("")).when(k % 3 == 2, F.concat(F.lit("t"), v)).alias("text"),
        F.when(k % 6 != 0, F.create_map(F.concat(F.lit("f"), c("event_id") % 3), v, F.lit("g"), k.cast("string"))).alias("fields"),
        F.when(k % 5 != 0, F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))).alias("items"),
    )


def investigation_snapshots(spark, sf_dir):
    """Every entry of each investigation after all its events."""
    found = snapshots.snapshots(_typed(table(spark, sf_dir, "events")))
    return found.select("inv", "part", "key", "field", "value", "seq")


def investigation_stages(spark, sf_dir):
    return snapshots.stages(snapshots.snapshots(_typed(table(spark, sf_dir, "events"))))


def streamed_snapshots(spark, sf_dir):
    """investigation_snapshots as a stateful stream over the event files; of what it gives for an entry the last stands."""
    read = lambda s, path: _typed(s.readStream.schema(jobs.SCHEMA).parquet(path))
    rows = jobs.run_once(spark, f"{sf_dir}/event[s].parquet", lambda stream: snapshot_stream.snapshots(stream, None), read=read)
    order = F.when(F.col("part") == "id", -F.col("seq")).otherwise(F.coalesce("seq", F.lit(-1)))
    return rows.groupBy("inv", "part", "key", "field").agg(F.max_by("value", order).alias("value"), F.max_by("seq", order).alias("seq"))


def streamed_first_emissions(spark, sf_dir):
    """first_emissions as a stream over the event files; its state is one row for each key that was ever seen."""
    return jobs.run_once(spark, f"{sf_dir}/event[s].parquet", jobs.first_emissions)


def streamed_recent_emissions(spark, sf_dir):
    """First emissions with bounded state: duplicates are dropped within the watermark. All files are one micro-batch here."""
    return jobs.run_once(spark, f"{sf_dir}/event[s].parquet", jobs.recent_first_emissions).select("inv", "key")


def streamed_event_fold(spark, sf_dir):
    """The phase of each investigation, by a stateful stream over the event files."""
    return jobs.run_once(spark, f"{sf_dir}/event[s].parquet", jobs.phases, last_by=("inv", "last_seq"))


def streamed_watch_changes(spark, sf_dir):
    """Changes of watched keys against the state of the stream."""
    return jobs.run_once(spark, f"{sf_dir}/event[s].parquet", jobs.watch_changes)


def streamed_event_windows(spark, sf_dir):
    """Events of each type in windows of an hour that the watermark has closed."""
    return jobs.run_once(spark, f"{sf_dir}/event[s].parquet", jobs.hourly)


QUERIES = {
    f.__name__: f
    for f in (
        event_fold, first_emissions, stage_durations, stalled_streams, watch_changes, recent_checks, ledger_totals, daily_runs, request_log,
        candidate_audit, match_confusion, segment_violations, repetitive_recognition, speech_leads, merged_surfaces, related_queries,
        distinct_frames, resolved_dates, streamed_first_emissions, streamed_recent_emissions, streamed_event_fold, investigation_snapshots, investigation_stages, streamed_snapshots, streamed_watch_changes, streamed_event_windows,
    )
}

_FOLD = """SELECT inv, coalesce(arg_max(event_type, seq) FILTER (event_type IN ('completed', 'failed')), 'running') AS phase,
  count(DISTINCT key) FILTER (event_type = 'evidence') AS n_evidence, count(DISTINCT key) FILTER (event_type = 'stage') AS n_stages,
  max(seq) AS last_seq FROM ev_v GROUP BY inv"""
_CHANGES = """, w AS (SELECT inv AS watch_id, key AS url, seq, CAST(value // 10 AS VARCHAR) AS digest, event_type = 'evidence' AS quote,
    lag(CAST(value // 10 AS VARCHAR)) OVER (PARTITION BY inv, key ORDER BY seq) AS before FROM ev_v)"""

_RECORD = """'{"f' || (event_id % 3) || '":"' || v || '","g":"' || k || '"}'"""
SNAPSHOTS = f"""
typed_v AS (
  SELECT user_id AS inv, event_id AS seq, event_id, {list(TYPES)}[event_id * 7 % 12 + 1] AS type, k, CAST(floor(value) AS BIGINT) AS v,
    CASE WHEN k % 10 <> 0 THEN CASE WHEN k % 2 = 0 THEN {list(snapshots.STAGES)}[k % 15 + 1] ELSE 'stage.' || (k % 5) END END AS key,
    CASE k % 3 WHEN 1 THEN '' WHEN 2 THEN 't' || CAST(floor(value) AS BIGINT) END AS text
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
writes_v AS (
  SELECT inv, seq, 'id' AS part, '' AS key, 'id' AS field, key AS value FROM typed_v WHERE type = 'investigation.started' AND key IS NOT NULL
  UNION ALL SELECT inv, seq, 'stage', key, 'status', split_part(type, '.', 2) FROM (SELECT * REPLACE (replace(type, 'started', 'running') AS type) FROM typed_v
    WHERE type IN ('stage.started', 'stage.completed')) WHERE key IS NOT NULL
  UNION ALL SELECT inv, seq, 'stage', key, 'detail', text FROM typed_v WHERE type = 'stage.completed' AND key IS NOT NULL
  UNION ALL SELECT inv, seq, 'search', key, 'count', CAST(v AS VARCHAR) FROM typed_v WHERE type = 'search.batch' AND key IS NOT NULL AND k % 4 <> 0
  UNION ALL SELECT inv, seq, 'evidence', coalesce(key, '#' || seq), unnest(['', 'f' || (event_id % 3), 'g']), unnest(['discovered', CAST(v AS VARCHAR), CAST(k AS VARCHAR)])
    FROM typed_v WHERE type = 'evidence.discovered' AND k % 6 <> 0
  UNION ALL SELECT inv, seq, 'classification', key, '', {_RECORD} FROM typed_v WHERE type = 'evidence.classified' AND key IS NOT NULL AND k % 6 <> 0
  UNION ALL SELECT inv, seq, 'timeline', '', 'items', '2' FROM typed_v WHERE type = 'provenance.partial' AND k % 5 <> 0
  UNION ALL SELECT inv, seq, 'verdict', '', 'preliminary', text FROM typed_v WHERE type = 'verdict.preliminary' AND text IS NOT NULL
  UNION ALL SELECT inv, seq, 'divergence', '', '', {_RECORD} FROM typed_v WHERE type = 'divergence.detected' AND k % 6 <> 0
  UNION ALL SELECT inv, seq, unnest(['phase', 'result']), '', '', unnest(['completed', {_RECORD}]) FROM typed_v WHERE type = 'investigation.completed' AND k % 6 <> 0
  UNION ALL SELECT inv, seq, unnest(['phase', 'error', 'error']), '', unnest(['', 'code', 'message']),
    unnest(['failed', coalesce(key, '{snapshots.NO_CODE}'), coalesce(nullif(text, ''), '{snapshots.NO_MESSAGE}')]) FROM typed_v WHERE type = 'investigation.error'),
entries_v AS (
  SELECT inv, part, key, field, arg_max({{'v': value}}, CASE WHEN part = 'id' THEN -seq ELSE seq END).v AS value,
    CASE WHEN part = 'id' THEN min(seq) ELSE max(seq) END AS seq, min(seq) AS first_seq FROM writes_v GROUP BY inv, part, key, field),
failed_v AS (SELECT inv, max(seq) FILTER (part = 'error') AS failed, min(seq) FILTER (part = 'evidence') AS evidence, count(*) FILTER (part = 'phase') AS phases FROM writes_v GROUP BY inv),
snap_v AS (
  SELECT * EXCLUDE first_seq FROM entries_v
  UNION ALL SELECT inv, 'error', '', 'partial', CASE WHEN evidence < failed THEN 'true' ELSE 'false' END, failed FROM failed_v WHERE failed IS NOT NULL
  UNION ALL SELECT DISTINCT inv, 'phase', '', '', '{snapshots.RUNNING}', NULL FROM typed_v WHERE inv NOT IN (SELECT inv FROM failed_v WHERE phases > 0))
"""

ORACLE_SQL = {
    "investigation_snapshots": f"WITH {SNAPSHOTS} SELECT * FROM snap_v",
    "streamed_snapshots": f"WITH {SNAPSHOTS} SELECT * FROM snap_v",
    "investigation_stages": f"""WITH {SNAPSHOTS}, s AS (SELECT inv, key AS stage, max(value) FILTER (field = 'status') AS status, max(value) FILTER (field = 'detail') AS detail,
          min(first_seq) AS first_seq FROM entries_v WHERE part = 'stage' GROUP BY inv, key)
        SELECT inv, CAST(row_number() OVER (PARTITION BY inv ORDER BY coalesce(list_position({list(snapshots.STAGES)}, stage), 16), first_seq) AS INT) AS place, stage, status, detail FROM s""",
    "event_fold": f"WITH {EVENTS} {_FOLD}",
    "first_emissions": f"WITH {EVENTS} SELECT inv, key, min(seq) AS seq FROM ev_v WHERE event_type = 'evidence' GROUP BY inv, key",
    "stage_durations": f"""WITH {EVENTS} SELECT inv, event_type AS stage, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds
        FROM ev_v GROUP BY inv, event_type""",
    "stalled_streams": f"""WITH {EVENTS}, g AS (SELECT inv, seq, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY inv ORDER BY ts, seq))) AS BIGINT) AS gap FROM ev_v)
        SELECT * FROM g WHERE gap > 3600""",
    "watch_changes": f"""WITH {EVENTS} {_CHANGES}, p AS (SELECT *, coalesce(before, CASE WHEN CAST(url AS INT) % 3 = 0 THEN '1' END) AS prior FROM w)
        SELECT watch_id, url, seq, CASE WHEN prior IS NULL THEN CASE WHEN quote THEN 'new_passage' ELSE 'new_lead' END ELSE 'changed_sample' END AS change
        FROM p WHERE prior IS NULL OR prior <> digest""",
    "recent_checks": f"""WITH {EVENTS}, r AS (SELECT inv, seq, CAST(row_number() OVER (PARTITION BY inv ORDER BY seq DESC) AS INT) AS place FROM ev_v)
        SELECT * FROM r WHERE place <= 50""",
    "ledger_totals": f"""WITH {EVENTS}, l AS (SELECT strftime(ts, '%Y-%m-%d') AS period, seq, value, event_type = 'completed' AS g FROM ev_v),
        t AS (SELECT period, seq, CAST(sum(CASE WHEN g THEN 0 ELSE value END) OVER w AS BIGINT) AS spent,
          CAST(500 + sum(CASE WHEN g THEN value ELSE 0 END) OVER w AS BIGINT) AS allowed FROM l WINDOW w AS (PARTITION BY period ORDER BY seq))
        SELECT *, spent > allowed AS overdrawn FROM t""",
    "daily_runs": f"""WITH {EVENTS} SELECT inv AS owner, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) > 3 AS over FROM ev_v GROUP BY 1, 2""",
    "request_log": f"""WITH {CANDIDATES}, p AS (SELECT DISTINCT inv, url FROM cand_v WHERE position <= 20)
        SELECT c.inv, c.kind AS search, count(*) AS returned, count(p.url) AS retained FROM cand_v c LEFT JOIN p ON c.inv = p.inv AND c.url = p.url
        GROUP BY c.inv, c.kind""",
    "candidate_audit": f"""WITH {CANDIDATES}, k AS (SELECT inv, CASE WHEN position % 7 <> 0 THEN url END AS canonical, count(*) AS n, bool_or(domain <> 'd3') AS safe
          FROM cand_v GROUP BY 1, 2), a AS (SELECT inv, coalesce(sum(n) FILTER (canonical IS NOT NULL), 0)::BIGINT AS normalized,
          coalesce(sum(n) FILTER (canonical IS NULL), 0)::BIGINT AS dropped, coalesce(sum(n - 1) FILTER (canonical IS NOT NULL), 0)::BIGINT AS duplicate,
          count(*) FILTER (canonical IS NOT NULL AND NOT safe) AS withheld, count(*) FILTER (canonical IS NOT NULL AND safe) AS retained FROM k GROUP BY inv)
        SELECT *, normalized = duplicate + withheld + retained AS consistent FROM a""",
    "match_confusion": """SELECT CAST(quality AS VARCHAR) AS expected, count(*) FILTER (n_chars >= 400) AS hit, count(*) FILTER (NOT n_chars >= 400) AS miss
        FROM labels JOIN documents USING (doc_id) GROUP BY quality""",
    "segment_violations": f"""WITH {SEGMENTS}, b AS (SELECT *, lag(start_ms) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM sg_v)
        SELECT media_id, start_ms, 'starts_before_previous' AS rule FROM b WHERE start_ms < before
        UNION ALL SELECT media_id, start_ms, 'ends_before_start' FROM b WHERE end_ms <= start_ms
        UNION ALL SELECT media_id, start_ms, 'beyond_duration' FROM b WHERE end_ms > 650""",
    "repetitive_recognition": f"""WITH {SEGMENTS}, t AS (SELECT media_id, norm, count(*) AS k FROM sg_v GROUP BY 1, 2),
        m AS (SELECT media_id, CAST(sum(k) AS BIGINT) AS n, max(k) AS most FROM t GROUP BY media_id)
        SELECT *, n >= 4 AND most >= 3 AND most * 2 >= n AS low_confidence FROM m""",
    "speech_leads": f"""WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY media_id) AS n,
          sum(length(text) + 1) OVER (PARTITION BY media_id) - 1 AS chars FROM sg_v),
        j AS (SELECT media_id, string_agg(text, ' ' ORDER BY i) AS s FROM r WHERE chars <= 300 OR i = 1 OR i = n OR i = (n + 1) // 2 GROUP BY media_id)
        SELECT media_id, CASE WHEN length(s) <= 300 THEN s ELSE regexp_replace(left(s, 300), '\\s\\S*$', '') END AS lead FROM j""",
    "merged_surfaces": f"""WITH {CANDIDATES} SELECT inv AS topic, url, arg_min(kind, (kind, position)) AS search, arg_min(position, (kind, position)) AS position,
          greatest(count(DISTINCT published_at) - 1, 0) AS n_alternates FROM cand_v GROUP BY inv, url""",
    "related_queries": f"""WITH {CANDIDATES}, f AS (SELECT inv, title, min(position) AS pos FROM cand_v WHERE title IS NOT NULL GROUP BY inv, title),
        r AS (SELECT inv, title, CAST(row_number() OVER (PARTITION BY inv ORDER BY pos, title) AS INT) AS place FROM f) SELECT * FROM r WHERE place <= 5""",
    "distinct_frames": f"""WITH {CANDIDATES} SELECT inv AS media_id, count(DISTINCT grp) AS kept, count(*) - count(DISTINCT grp) AS skipped FROM cand_v GROUP BY inv""",
    "streamed_first_emissions": f"WITH {EVENTS} SELECT DISTINCT inv, key FROM ev_v WHERE event_type = 'evidence'",
    "streamed_recent_emissions": f"WITH {EVENTS} SELECT DISTINCT inv, key FROM ev_v WHERE event_type = 'evidence'",
    "streamed_event_fold": f"WITH {EVENTS}, f AS ({_FOLD}) SELECT inv, phase, last_seq FROM f",
    "streamed_watch_changes": f"""WITH {EVENTS} {_CHANGES} SELECT watch_id, url, seq, CASE WHEN before IS NULL THEN CASE WHEN quote THEN 'new_passage' ELSE 'new_lead' END
        ELSE 'changed_sample' END AS change FROM w WHERE before IS NULL OR before <> digest""",
}
