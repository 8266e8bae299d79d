"""Citations between evidence: targets, quote checks, shared targets, duplicate passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import source_key


def targets(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, citation_id, target_id, result, matched_start) of each citation and each retained target.

    Citations are (case_id, citation_id, from_id, target_url, quote, start) and
    evidence is (case_id, evidence_id, url, text); start counts code points from 0.
    A citation without a retained target has target_id null and result unknown.
    """
    cited = citations.withColumn("key", source_key(F.col("target_url")))
    held = evidence.select("case_id", source_key(F.col("url")).alias("key"), F.col("evidence_id").alias("target_id"), "text")
    rows = cited.join(held, ["case_id", "key"], "left")
    found = F.coalesce(F.col("start"), F.instr(F.col("text"), F.col("quote")) - 1)
    rows = rows.withColumn("at", found)
    exact = (F.col("at") >= 0) & (F.substring("text", F.col("at") + F.lit(1), F.length("quote")) == F.col("quote"))
    result = (
        F.when(F.col("quote").isNull() | F.col("text").isNull(), "unknown")
        .when(exact, "exact_match")
        .when(F.col("start").isNull(), "not_found_in_retained_passage")
        .otherwise("offset_mismatch")
    )
    return rows.select(
        "case_id", "citation_id", "target_id", result.alias("result"), F.when(result == "exact_match", F.col("at")).alias("matched_start")
    )


def shared_targets(citations: DataFrame) -> DataFrame:
    """(case_id, target_key, n_evidence, n_citations, first_id, last_id): targets that two or more evidence items cite."""
    keyed = citations.select("case_id", "from_id", source_key(F.col("target_url")).alias("target_key"))
    # Distinct citing items first, so that a target cited by very many is counted and not gathered.
    pairs = keyed.groupBy("case_id", "target_key", "from_id").agg(F.count(F.lit(1)).alias("n"))
    shared = pairs.groupBy("case_id", "target_key").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.sum("n").alias("n_citations"), F.min("from_id").alias("first_id"), F.max("from_id").alias("last_id")
    )
    return shared.where("n_evidence >= 2")


def duplicate_passages(evidence: DataFrame) -> DataFrame:
    """(case_id, passage_sha, n, first_id): whole passages that two or more items of a case share byte for byte."""
    keyed = evidence.where("text IS NOT NULL").select("case_id", "evidence_id", F.sha2("text", 256).alias("passage_sha"))
    rows = keyed.groupBy("case_id", "passage_sha").agg(F.count(F.lit(1)).alias("n"), F.min("evidence_id").alias("first_id"))
    return rows.where("n > 1")


def url_mentions(evidence: DataFrame) -> DataFrame:
    """(case_id, from_id, to_id): items whose text has another item's URL as one of its words."""
    words = evidence.select("case_id", F.col("evidence_id").alias("from_id"), F.explode(F.regexp_extract_all("text", F.lit(r"https?://[^\s<>\"')]+"), F.lit(0))).alias("url"))
    held = evidence.select("case_id", "url", F.col("evidence_id").alias("to_id"))
    return words.join(held, ["case_id", "url"]).where("from_id <> to_id").select("case_id", "from_id", "to_id").distinct()


def disagreements(relations: DataFrame) -> DataFrame:
    """(case_id, support_id, challenge_id): each supporting with each challenging item of a case."""
    of = lambda kind, name: relations.where(F.col("relation") == kind).select("case_id", F.col("evidence_id").alias(name))
    return of("support", "support_id").join(of("challenge", "challenge_id"), "case_id")


# Headlines of an account.
SAID = "What the sources say."
HEADLINES = {
    "both": "The retained excerpts disagree.",
    "challenge": "There is evidence against this claim.",
    "support": "There is evidence supporting this claim.",
    "none": "The claim is still unresolved.",
}


def account(sources: DataFrame, mode: str = "claim") -> DataFrame:
    """(case_id, n_support, n_challenge, n_read, n_leads, headline) of a case.

    Only sources of a relevance of 50 or more with a quote support or challenge;
    an item is read if its text is the page's own quote, else a lead. In the mode
    source_assertions nothing is claimed, and the headline says so.
    """
    counts = (F.col("relevance") >= 50) & F.col("quote").isNotNull()
    read = F.coalesce(F.col("attribution") == "page_quote", F.lit(False))
    rows = sources.groupBy("case_id").agg(
        F.count_if(counts & (F.col("relation") == "support")).alias("n_support"),
        F.count_if(counts & (F.col("relation") == "challenge")).alias("n_challenge"),
        F.count_if(read).alias("n_read"),
        F.count_if(~read).alias("n_leads"),
    )
    headline = (
        F.when(F.lit(mode == "source_assertions"), SAID)
        .when((F.col("n_support") > 0) & (F.col("n_challenge") > 0), HEADLINES["both"])
        .when(F.col("n_challenge") > 0, HEADLINES["challenge"])
        .when(F.col("n_support") > 0, HEADLINES["support"])
        .otherwise(HEADLINES["none"])
    )
    return rows.withColumn("headline", headline)


#: Why a source's relation to a claim is what it is, in the order in which they are given.
REASONS = ("low_relevance", "no_claim", "not_page_quote", "unassessed", "scope_withheld", "no_verdict")


def claim_relation(sources: DataFrame) -> DataFrame:
    """Adds relation and its reasons, from whole percents; a quote and an assessment by a verified model come first.

    With both, and a relevance of 50, any of three at 85 makes context; support or
    challenge only comes from a page's own quote that is not the claim itself,
    with all three scopes compatible at 85. ``verified`` says that the model is
    pinned: without it, nothing that it says counts.
    """
    c, said = F.col, F.coalesce("verified", F.lit(False))
    known = said & c("context").isNotNull() & c("supports").isNotNull() & c("challenges").isNotNull()
    relevant = said & (c("relevance") >= 50)
    compatible = said & (F.least("entity_property", "time", "variant") >= 85)
    page, claimed = F.coalesce(c("attribution") == "page_quote", F.lit(False)) & c("quote").isNotNull(), c("claim").isNotNull()
    own = page & claimed & compatible & (F.trim("quote") != F.trim("claim"))
    base = c("quote").isNotNull() & known & relevant
    relation = (
        F.when(base & own & (c("supports") >= 85), "support")
        .when(base & own & (c("challenges") >= 85), "challenge")
        .when(base & (F.greatest("context", "supports", "challenges") >= 85), "context")
        .otherwise("insufficient")
    )
    holds = (said & (c("relevance") < 50), ~claimed, ~page, ~known, claimed & ~F.coalesce(compatible, F.lit(False)), F.lit(True))
    reasons = F.array_compact(F.array(*[F.when(h, F.lit(r)) for r, h in zip(REASONS, holds)]))
    return sources.withColumn("relation", relation).withColumn("reasons", reasons)
