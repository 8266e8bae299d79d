"""Case snapshots: diffs between revisions, heads, integrity, staleness, notices.

Revisions are an append-only table; a snapshot of evidence is (case_id, revision,
evidence_id, digest, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest URL of a case's evidence.
MOST_URL = 4096


def diff(before: DataFrame, after: DataFrame, confirmed: Column | None = None) -> DataFrame:
    """(case_id, evidence_id, change, before, after): added, changed, removed, or unconfirmed_removal.

    A missing row is a removal only where ``confirmed`` holds for its case.
    """
    old = before.select("case_id", "evidence_id", F.col("digest").alias("before"))
    new = after.select("case_id", "evidence_id", F.col("digest").alias("after"))
    both = old.join(new, ["case_id", "evidence_id"], "full_outer")
    gone = F.when(F.lit(True) if confirmed is None else confirmed, "removed").otherwise("unconfirmed_removal")
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), gone).when(F.col("before") != F.col("after"), "changed")
    )
    return both.withColumn("change", change).where("change IS NOT NULL").select("case_id", "evidence_id", "change", "before", "after")


def heads(rows: DataFrame, key: list[str]) -> DataFrame:
    """The latest revision of each key; max_by over partial aggregates, so a long history is no hot partition."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("head")).select(*key, "head.*")


def revision_gaps(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose revision does not directly follow the one before."""
    before = F.lag("revision").over(Window.partitionBy(*key).orderBy("revision"))
    return rows.withColumn("prior", before).where(F.col("revision") != F.coalesce(F.col("prior"), F.lit(0)) + 1)


def upsert(rows: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with those replaced or added whose key is in ``edits``."""
    return rows.join(edits, key, "left_anti").unionByName(edits)


def stale(bindings: DataFrame, current: DataFrame) -> DataFrame:
    """(binding_id, stale, missing): bindings (binding_id, case_id, evidence_id, digest) against the current digests."""
    now = current.select("case_id", "evidence_id", F.col("digest").alias("now"))
    rows = bindings.join(now, ["case_id", "evidence_id"], "left")
    return rows.groupBy("binding_id").agg(
        (~F.bool_and(F.col("digest").eqNullSafe(F.col("now")))).alias("stale"), F.bool_or(F.col("now").isNull()).alias("missing")
    )


def historical(bindings: DataFrame, revisions: DataFrame) -> DataFrame:
    """(binding_id, evidence_id, revision): the latest revision whose digest is the saved one; none is null."""
    past = revisions.select("case_id", "evidence_id", "digest", "revision")
    rows = bindings.join(past, ["case_id", "evidence_id", "digest"], "left")
    return rows.groupBy("binding_id", "evidence_id").agg(F.max("revision").alias("revision"))


def affected(relations: DataFrame, changes: DataFrame, revised: DataFrame) -> DataFrame:
    """(case_id, relation_id): relations that refer to changed evidence and were not themselves revised."""
    ids = changes.select("case_id", "evidence_id").distinct()
    touched = relations.join(ids, ["case_id", "evidence_id"], "left_semi").select("case_id", "relation_id").distinct()
    return touched.join(revised, ["case_id", "relation_id"], "left_anti")


def sticky(history: DataFrame) -> DataFrame:
    """Adds flagged: once a row was changed, later ones stay flagged until one is revised. In order of revision."""
    order = Window.partitionBy("case_id", "evidence_id").orderBy("revision")
    rows = history.withColumn("era", F.sum(F.col("revised").cast("int")).over(order))
    own = Window.partitionBy("case_id", "evidence_id", "era").orderBy("revision")
    return rows.withColumn("flagged", F.max(F.col("changed") & ~F.col("revised")).over(own)).drop("era")


def missing_references(rows: DataFrame, column: str, targets: DataFrame, target: str, rule: str) -> DataFrame:
    """(id, rule) of rows whose reference is not null and not among the targets."""
    known = targets.select(F.col(target).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, column, "left_anti").select("id", F.lit(rule).alias("rule"))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for each rule that fails; a rule that is null fails."""
    each = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select("id", F.explode(each).alias("rule"))


def watchlist_matches(evidence: DataFrame, watchlists: DataFrame) -> DataFrame:
    """(watch_id, evidence_id): evidence (evidence_id, host, hay, rights) on a host of a list whose phrase it has whole.

    ``watchlists`` is (watch_id, host, phrase), a row for each host and phrase; phrases
    and ``hay`` are normalised. The join is on the host; the phrase is a filter.
    """
    public = evidence.where("rights = 'public_reference'")
    rows = public.join(watchlists.where("phrase <> ''"), "host")
    whole = F.concat(F.lit(" "), "hay", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    return rows.where(whole).select("watch_id", "evidence_id").distinct()


def notices(matches: DataFrame, changes: DataFrame, revision: Column) -> DataFrame:
    """(notice_id, watch_id, case_id, n_changes): one notice for each list and case with matching changes."""
    rows = changes.join(matches, "evidence_id").groupBy("watch_id", "case_id").agg(
        F.count(F.lit(1)).alias("n_changes"), F.bit_xor(F.xxhash64("evidence_id", "change", "after")).alias("content")
    )
    listed = F.concat_ws("|", F.col("watch_id"), F.col("case_id").cast("string"), revision.cast("string"), F.col("content").cast("string"))
    return rows.select(F.concat(F.lit("sha256:"), F.sha2(listed, 256)).alias("notice_id"), "watch_id", "case_id", "n_changes")


def _first_of_buckets(timeline: DataFrame) -> DataFrame:
    """(inv, cand_id, r): the first row of each candidate over the four buckets in their order."""
    order = F.create_map(*[F.lit(x) for x in ("dated_core", 0, "undated", 1, "dated_lead", 2, "dated_contextual", 3)])
    rows = timeline.withColumn("o", F.try_element_at(order, F.col("bucket")))
    kept = F.col("safe") & (F.length("url") <= MOST_URL)
    row = F.struct("bucket", "url", F.coalesce(kept, F.lit(False)).alias("kept"))
    return rows.groupBy("inv", "cand_id").agg(F.min_by(row, "o").alias("r"))


def case_projection(timeline: DataFrame) -> DataFrame:
    """(inv, cand_id, bucket, url): a candidate's first row, unless its URL is unsafe, missing or too long.

    A later row of the same candidate never stands in for one that is left out.
    """
    return _first_of_buckets(timeline).where("r.kept").select("inv", "cand_id", "r.bucket", "r.url")


def case_omissions(timeline: DataFrame) -> DataFrame:
    """(inv, omitted): how many candidates case_projection leaves out; 0 where it leaves out none."""
    left_out = F.count_if(~F.col("r.kept"))
    return _first_of_buckets(timeline).groupBy("inv").agg(left_out.alias("omitted"))


def relation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, relation_id, before, after): relations of two revisions whose digests differ; null where one has none."""
    old = before.select("case_id", "relation_id", F.col("digest").alias("before"))
    new = after.select("case_id", "relation_id", F.col("digest").alias("after"))
    return old.join(new, ["case_id", "relation_id"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def union_of_frames(frames: DataFrame) -> DataFrame:
    """(video_id, first_ms, n_frames, searches, omitted, limitations): the cases of a video's sampled frames as one.

    ``frames`` is (video_id, ms, searches, omitted, limitations), one row for
    each of the few frames that are sampled of a video. The first frame's case is
    the one that is kept; searches follow each other in frame order, omitted
    counts add up, and limitations are kept once, sorted. Evidence, occurrences
    and relations are rows already and need no union.
    """
    in_order = F.array_sort(F.collect_list(F.struct("ms", "searches")))
    return frames.groupBy("video_id").agg(
        F.min("ms").alias("first_ms"),
        F.count(F.lit(1)).alias("n_frames"),
        F.flatten(F.transform(in_order, lambda f: f["searches"])).alias("searches"),
        F.sum("omitted").alias("omitted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("limitations")))).alias("limitations"),
    )


def coverage_measures(evidence: DataFrame, reads: DataFrame) -> DataFrame:
    """(run_id, n_sources, n_quotes, n_reads, n_failures): what a run retained and read.

    ``evidence`` is (run_id, attribution) and ``reads`` (run_id, outcome); a
    failure is a fetch that failed or a page that is not the one asked for.
    """
    kept = evidence.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("attribution") == "page_quote").alias("n_quotes"))
    failed = F.col("outcome").isin("fetch_failed", "binding_rejected")
    read = reads.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(failed).alias("n_failures"))
    return kept.join(read, "run_id", "full_outer").na.fill(0, ["n_sources", "n_quotes", "n_reads", "n_failures"])


def candidate_audit(searches: DataFrame) -> DataFrame:
    """(run_id, rule): the counts of a topic run's candidate audit that don't agree with each other.

    ``searches`` has a row for each search of a run: run_id, outcome (succeeded,
    unavailable), returned, retained, normalized, dropped, duplicate, safe,
    withheld, kept, not_kept, captured, uncaptured, kept_captured, limit.
    A search's own counts are checked in its row, the run's as sums over them.
    """
    c, bad = F.col, F.col("outcome") == "unavailable"
    own = {
        "unavailable_is_empty": bad & ((c("returned") != 0) | (c("retained") != 0) | F.coalesce("normalized", "dropped", "duplicate").isNotNull()),
        "known_outcome": ~c("outcome").isin("succeeded", "unavailable"),
        "duplicates_within_normalized": ~bad & (c("duplicate") > c("normalized")),
        "returned_is_normalized_and_dropped": ~bad & (c("normalized") + c("dropped") != c("returned")),
        "retained_rows_are_captured": ~bad & (c("kept_captured") != c("retained")),
        "captured_within_unique": ~bad & (c("captured") > c("normalized") - c("duplicate")),
        "no_negative_count": F.least("returned", "retained", "normalized", "dropped", "duplicate", "safe", "withheld", "kept", "not_kept", "captured", "uncaptured") < 0,
    }
    sums = searches.groupBy("run_id").agg(
        *[F.bool_or(F.coalesce(test, F.lit(False))).alias(name) for name, test in own.items()],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("retained", "normalized", "duplicate", "safe", "withheld", "kept", "not_kept", "captured", "uncaptured", "kept_captured")],
        F.max("limit").alias("limit"),
    )
    whole = {
        "unique_is_safe_and_withheld": c("normalized") - c("duplicate") != c("safe") + c("withheld"),
        "safe_is_kept_and_not_kept": c("safe") != c("kept") + c("not_kept"),
        "safe_is_captured_and_uncaptured": c("safe") != c("captured") + c("uncaptured"),
        "captured_up_to_the_limit": c("captured") != F.least("safe", "limit"),
        "captured_kept_is_kept": c("kept_captured") != c("kept"),
        "kept_is_retained": c("kept") != c("retained"),
    }
    broken = F.array_compact(F.array(*[F.when(c(n), F.lit(n)) for n in own], *[F.when(t, F.lit(n)) for n, t in whole.items()]))
    return sums.select("run_id", F.explode(broken).alias("rule"))
