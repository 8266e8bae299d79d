"""Judgments, anchors, excerpts and place names of evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as text_fn

# How far a distribution may be from one, for each key, and its winner from the largest value.
SUM_SLACK, WINNER_SLACK = 0.0005, 0.001


def valid_distribution(probabilities: Column, winner: Column, keys: tuple[str, ...]) -> Column:
    """Whether a map of probabilities has exactly the keys, values in 0..1, sum one and the stated winner on top. Never repaired."""
    names = F.array(*[F.lit(k) for k in keys])
    own, values = F.map_keys(probabilities), F.map_values(probabilities)
    same = (F.size(F.array_except(own, names)) == 0) & (F.size(F.array_except(names, own)) == 0)
    bounded = F.forall(values, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, p: a + p)
    top = F.try_element_at(probabilities, winner) >= F.array_max(values) - WINNER_SLACK
    fine = same & bounded & (F.abs(total - 1) <= len(keys) * SUM_SLACK + 1e-12) & top
    return F.coalesce(fine, F.lit(False))


def judgments(answers: DataFrame, keys: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """(inv, cand_id, surface map): judgments from answers (inv, cand_id, surface, probabilities, winner, model).

    Without a verified model, or where a required surface is missing or invalid,
    there is no judgment; other invalid surfaces are left out.
    """
    valid = F.lit(False)
    for surface, names in keys.items():
        valid = valid | ((F.col("surface") == surface) & valid_distribution(F.col("probabilities"), F.col("winner"), names))
    rows = answers.where(F.col("model").isNotNull()).where(valid)
    grouped = rows.groupBy("inv", "cand_id").agg(F.map_from_entries(F.collect_set(F.struct("surface", "winner"))).alias("winners"))
    has = F.lit(True)
    for name in required:
        has = has & F.map_contains_key("winners", name)
    return grouped.where(has)


def anchor_holds(text: Column, start: Column, quote: Column) -> Column:
    """Whether a text has the quote at its offset, in code points from 0."""
    return F.coalesce((start >= 0) & (F.substring(text, start + F.lit(1), F.length(quote)) == quote), F.lit(False))


def cell_holds(rows: Column, row: Column, column: Column, value: Column) -> Column:
    """Whether a retained table (array of rows of cells) has the value in its cell, counted from 0."""
    return F.coalesce(F.try_element_at(F.try_element_at(rows, row + F.lit(1)), column + F.lit(1)) == value, F.lit(False))


def region_holds(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Whether a region is not empty and inside its image."""
    inside = (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= image_width) & (y + height <= image_height)
    return F.coalesce(inside, F.lit(False))


def span_holds(start: Column, duration: Column, length: Column) -> Column:
    """Whether a time span is not empty and within its asset."""
    return F.coalesce((start >= 0) & (duration > 0) & (start + duration <= length), F.lit(False))


def shape_holds(rows: Column, columns: Column) -> Column:
    """Whether every row of a retained table has as many cells as there are columns."""
    return F.coalesce(F.forall(rows, lambda r: F.size(r) == F.size(columns)), F.lit(False))


def split_composite(raw: Column) -> Column:
    """struct(title, snippet, body) of a composite excerpt; parts that are missing are null."""
    title = F.nullif(F.regexp_extract(raw, r"^Title: ([^\n]*)", 1), F.lit(""))
    snippet = F.nullif(F.regexp_extract(raw, r"(?:^|\n\n)Snippet: ([^\n]*)", 1), F.lit(""))
    body = F.nullif(F.trim(F.regexp_replace(raw, r"^(?:Title: [^\n]*(?:\n\n|$))?(?:Snippet: [^\n]*(?:\n\n|$))?", "")), F.lit(""))
    return F.struct(title.alias("title"), snippet.alias("snippet"), body.alias("body"))


def media_relationship(exact: Column, distance: Column, verified: Column) -> Column:
    """EXACT_MATCH from a validated collection, NEAR_MATCH from a verified distance of eight bits or less, else LEAD."""
    near = F.coalesce((distance <= 8) & verified, F.lit(False))
    return F.when(F.coalesce(exact, F.lit(False)), "EXACT_MATCH").when(near, "NEAR_MATCH").otherwise("VISUAL_LEAD")


def recheck_identity(relationship: Column, kinds: Column, verified: Column) -> Column:
    """Demotes an exact match without an exact retrieval, and a near match without a verification, to a lead. Null stays null."""
    exact = F.coalesce(F.array_contains(kinds, "lens_exact"), F.lit(False))
    lost = ((relationship == "EXACT_MATCH") & ~exact) | ((relationship == "NEAR_MATCH") & ~F.coalesce(verified, F.lit(False)))
    return F.when(lost, "VISUAL_LEAD").otherwise(relationship)


def excerpt(paragraphs: DataFrame, heads: DataFrame, most: int = 8_000) -> DataFrame:
    """(page_id, excerpt): title, snippet, the first two paragraphs, then others that share words with title and claim.

    ``paragraphs`` is (page_id, ord, paragraph) and heads (page_id, title, snippet, claim).
    """
    query = text_fn.page_words(F.concat_ws(" ", "title", "claim"))
    rows = paragraphs.where("paragraph <> ''").join(heads.withColumn("query", query), "page_id")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")))
    overlap = F.size(F.array_intersect(text_fn.page_words(F.col("paragraph")), "query"))
    rows = rows.withColumn("overlap", F.when(F.col("nth") <= 2, F.lit(2**31 - 1)).otherwise(overlap)).where("overlap > 0")
    said = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("o"), "nth", "paragraph"))).alias("p"))
    parts = F.concat(
        F.array_compact(F.array(F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Snippet: "), "snippet"))),
        F.transform(F.coalesce("p", F.array().cast("array<struct<o int, nth int, paragraph string>>")), lambda x: x["paragraph"]),
    )
    joined = heads.join(said, "page_id", "left").select("page_id", F.left(F.array_join(parts, "\n\n"), F.lit(most)).alias("excerpt"))
    return joined.withColumn("excerpt", F.nullif("excerpt", F.lit("")))


#: Candidates that are judged in one investigation, and those kept from searches and links.
MOST_CLASSIFIED, MOST_FOUND = 24, 5


def follow_links(links: DataFrame, pool: DataFrame, most_classified: int = MOST_CLASSIFIED, most_found: int = MOST_FOUND) -> DataFrame:
    """(inv, url, parent, at, state): what becomes of each link of the pages that were read; one of an investigation is selected.

    ``links`` is (inv, url, relevance, parent, at, late): canonical URL (null if it
    has none), the parent's relevance and canonical URL, the place on the page, and
    whether the deadline had passed. ``pool`` is (inv, url, kind, classified, read).

    Links are taken by relevance, parent and place. A link whose source is read is
    already_read, as is any later one to the page selected. A source that is not
    classified needs a place among the classified, and one that is not in the pool
    also one among those found; the first link that has what it needs is selected,
    and those after it meet page_limit. As nothing is admitted before that one, each
    link's own state does not depend on the others', and the first is a minimum: no
    investigation is gathered or walked.
    """
    c = F.col
    counts = pool.groupBy("inv").agg(F.count_if("classified").alias("n_classified"), F.count_if(c("kind").isin("google_search", "source_link")).alias("n_found"))
    known = pool.groupBy("inv", "url").agg(F.max("classified").alias("classified"), F.max("read").alias("read"))
    rows = links.join(counts, "inv", "left").join(known, ["inv", "url"], "left")
    place = F.struct((-F.coalesce("relevance", F.lit(0))).alias("less"), F.coalesce("parent", F.lit("")).alias("parent"), "at", F.coalesce("url", F.lit("")).alias("url"))
    new = c("read").isNull()
    own = (
        F.when(c("late"), "deadline")
        .when(F.coalesce("read", F.lit(False)), "already_read")
        .when((new | ~c("classified")) & (F.coalesce("n_classified", F.lit(0)) >= most_classified), "classification_limit")
        .when(c("url").isNull() | (new & (F.coalesce("n_found", F.lit(0)) >= most_found)), "retention_limit")
        .otherwise("open")
    )
    rows = rows.select("inv", "url", "parent", c("at"), place.alias("place"), own.alias("own"))
    first = rows.where("own = 'open'").groupBy("inv").agg(F.min("place").alias("first"))
    after = F.coalesce(c("place") > c("first"), F.lit(False))
    state = (
        F.when(c("own").isin("deadline", "already_read"), c("own"))
        .when(after & (c("url") == c("first.url")), "already_read")
        .when(after, "page_limit")
        .when(c("own") == "open", "selected")
        .otherwise(c("own"))
    )
    return rows.join(first, "inv", "left").select("inv", "url", "parent", "at", state.alias("state"))


def place_spans(claims: DataFrame, lexicon: DataFrame, most_words: int = 4) -> DataFrame:
    """(claim_id, place, at): lexicon names after a locative preposition; the longest wins at each place.

    ``claims`` is (claim_id, text) and ``lexicon`` (place) in lower case.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0))
    before = ("in", "at", "near", "from", "outside", "inside", "around")

    def hits(w: Column) -> Column:
        place = lambda i: F.struct((i - 1).alias("at"), F.element_at(w, i).alias("word"), F.slice(w, i + 1, most_words).alias("next"))
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), place)
        return F.filter(F.when(F.size(w) > 0, every), lambda h: h["word"].isin(*before))

    after = claims.select("claim_id", F.explode(text_fn.let(words, hits)).alias("h"))
    runs = after.select("claim_id", "h.at", "h.next", F.explode(F.sequence(F.lit(1), F.lit(most_words))).alias("n"))
    names = runs.where("n <= size(next)").select("claim_id", "at", "n", F.array_join(F.slice("next", 1, F.col("n")), " ").alias("place"))
    found = names.join(lexicon.select("place").distinct(), "place")
    return found.groupBy("claim_id", "at").agg(F.max_by("place", "n").alias("place"))


def luminance_cut(frames: DataFrame, least: float = 0.08) -> DataFrame:
    """(media_id, ts_ms): the frame with the largest change of luminance, away from both ends, else the middle one.

    ``frames`` is (media_id, ts_ms, luma array<double>, duration_ms).
    """
    order = Window.partitionBy("media_id").orderBy("ts_ms")
    before = F.lag("luma").over(order)
    change = F.aggregate(F.zip_with("luma", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("luma")
    margin = F.greatest(F.lit(500), F.least(F.lit(1000), F.col("duration_ms") / 6))
    rows = frames.withColumn("before", before).withColumn("change", change)
    inside = (F.col("ts_ms") >= margin) & (F.col("ts_ms") <= F.col("duration_ms") - margin) & (F.col("change") >= least)
    return rows.groupBy("media_id").agg(
        F.coalesce(
            F.min_by("ts_ms", F.when(inside, F.struct(-F.col("change"), "ts_ms"))),
            F.min_by("ts_ms", F.struct(F.abs(F.col("ts_ms") * 2 - F.col("duration_ms")), "ts_ms")),
        ).alias("ts_ms")
    )


def _frame_scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"pair_id": frame["pair_id"], "score": [frame_score(a, b) for a, b in zip(frame["left"], frame["right"])]})


def frame_score(left: bytes, right: bytes, side: int = 24, shift: int = 24) -> float:
    """Share of 16 tiles that agree, of two grey rasters, after the best common shift of brightness; flat rasters score 0."""
    a, b = (np.frombuffer(x, np.uint8).astype(float).reshape(side, side) for x in (left, right))
    if a.std() < 4 or b.std() < 4:
        return 0.0
    offset = float(np.clip(np.median(a - b), -shift, shift))
    off = np.abs(a - b - offset).reshape(4, side // 4, 4, side // 4).mean(axis=(1, 3)).ravel()
    return float((np.sort(off)[:12] <= 8).mean())


def score_frames(pairs: DataFrame) -> DataFrame:
    """(pair_id, score) of frame pairs (pair_id, left, right), 24 x 24 grey bytes each."""
    return pairs.select("pair_id", "left", "right").mapInPandas(_frame_scores, "pair_id long, score double")


# The roles of pages to read, and those that need no judgment.
ROLES = ("core_anchor", "conflict", "support", "fact_check", "current_reporting", "core_recovery", "historical_lead", "filler")
UNJUDGED_ROLES = ("core_anchor", "current_reporting")


def read_selection_violations(rows: DataFrame, most_pages: int) -> DataFrame:
    """(inv, rule): what is wrong with an audit of read selections (inv, evidence_id, place, role, judged, fact_check, winner, withheld).

    ``place`` and ``role`` are null where a candidate was not selected; ``withheld``
    is how many candidates the audit left out, whose places may be missing.
    """
    c, selected = F.col, F.col("place").isNotNull()
    grouped = rows.groupBy("inv").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("evidence_id").alias("ids"), F.count("place").alias("n_places"), F.count_distinct("place").alias("places"),
        F.max("place").alias("last"), F.max("withheld").alias("withheld"), F.count_if("winner").alias("winners"),
        F.count_if(selected & ~c("place").between(1, most_pages)).alias("outside"),
        F.count_if(selected & ~F.coalesce(c("role").isin(*ROLES), F.lit(False))).alias("unknown"),
        F.count_if(selected & ~c("judged") & c("role").isin(*ROLES) & ~c("role").isin(*UNJUDGED_ROLES)).alias("unjudged"),
        F.count_if(c("winner") & (~c("judged") | (c("fact_check") <= 0))).alias("unearned"),
    )
    rules = {
        "ids_repeat": c("n") > c("ids"),
        "places_repeat": c("n_places") > c("places"),
        "place_out_of_range": c("outside") > 0,
        "unknown_role": c("unknown") > 0,
        "role_without_judgment": c("unjudged") > 0,
        "places_missing": F.coalesce("last", F.lit(0)) - c("places") > c("withheld"),
        "several_winners": c("winners") > 1,
        "winner_without_judgment": c("unearned") > 0,
    }
    failed = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return grouped.select("inv", F.explode(failed).alias("rule"))


def rederived(saved: DataFrame, computed: DataFrame) -> DataFrame:
    """Saved rows that a recomputation does not give, and the reverse, with their side."""
    lost = saved.exceptAll(computed).withColumn("side", F.lit("saved_only"))
    return lost.unionByName(computed.exceptAll(saved).withColumn("side", F.lit("computed_only")))


def registrable_domain(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, domain): the public suffix and one label more, for (host) by rules (suffix, kind) of kind plain, wildcard or exception.

    The longest rule wins, an exception before a wildcard; without a rule the last label counts. A host that
    is a suffix itself, or an address, is its own domain.
    """
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("tail")))
    each = hosts.select("host").distinct().select("host", F.size(labels).alias("n"), F.explode(tails).alias("t")).select("host", "n", "t.i", "t.tail")
    hit = each.join(suffixes, each["tail"] == suffixes["suffix"])
    own = F.col("n") - F.col("i") + 1
    length = F.when(F.col("kind") == "wildcard", own + 1).when(F.col("kind") == "exception", own - 1).otherwise(own)
    best = hit.groupBy("host").agg(F.max_by(length, F.struct((F.col("kind") == "exception"), length)).alias("len"))
    rows = hosts.select("host").distinct().join(best, "host", "left").withColumn("labels", labels)
    want = F.coalesce("len", F.lit(1)) + 1
    cut = F.array_join(F.slice("labels", F.size("labels") - want + 1, want), ".")
    literal = F.col("host").rlike(r"^[\d.]+$|\[")
    return rows.select("host", F.when(literal | (F.size("labels") < want), F.col("host")).otherwise(cut).alias("domain"))
