"""Policy over a pool of candidates: relevance, conflicts, corroboration, claim status.

All functions take candidates with the columns inv, cand_id, relationship,
domain, grp, origin_status, relevance, same, different, supports, contradicts and
loc_different (whole percents, null where a judgment is missing) and group by inv.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

RELEVANT, STRONG = 70, 75
SEPARATE, UNRESOLVED = "separate_origin_evidenced", "unresolved"


def at_least(value: str, threshold: int) -> Column:
    return F.coalesce(F.col(value), F.lit(0)) >= threshold


def flags(candidates: DataFrame) -> DataFrame:
    """Adds relevant, core, conflict and support."""
    core = F.coalesce(F.col("relationship").isin("EXACT_MATCH", "NEAR_MATCH"), F.lit(False))
    both = F.col("core") & F.col("relevant")
    against = at_least("different", STRONG) | at_least("contradicts", STRONG) | at_least("loc_different", STRONG)
    return (
        candidates.withColumn("relevant", at_least("relevance", RELEVANT))
        .withColumn("core", core)
        .withColumn("conflict", both & against)
        .withColumn("support", both & (at_least("same", STRONG) | at_least("supports", STRONG)))
    )


def _gate(condition: Column) -> Column:
    """Two rows of different domain and group exist exactly where there are two domains and two groups: a least and another largest."""
    rows = condition & (F.col("origin_status") == SEPARATE)
    several = lambda name: F.coalesce(F.min(F.when(rows, F.col(name))) < F.max(F.when(rows, F.col(name))), F.lit(False))
    return several("domain") & several("grp")


def _distinct(value: Column) -> Column:
    """How many values there are. Several count_distinct() would move a copy of every row for each; a set has an investigation's few names."""
    return F.size(F.collect_set(value)).cast("long")


def claim_status(candidates: DataFrame, *more: Column, names: tuple[str, ...] = ()) -> DataFrame:
    """(inv, status, n_conflicts, n_core, n_domains, n_groups, n_unresolved, n_support, corroborated, limited).

    ``more`` are aggregates of the same rows, kept under ``names``, so that what else is asked of them takes no other pass.
    """
    relevant_core = F.col("core") & F.col("relevant")
    resolved = relevant_core & (F.col("origin_status") != UNRESOLVED)
    pool = (
        flags(candidates)
        .groupBy("inv")
        .agg(
            F.count_if("conflict").alias("n_conflicts"),
            F.count_if(relevant_core).alias("n_core"),
            _distinct(F.when(relevant_core, F.col("domain"))).alias("n_domains"),
            _distinct(F.when(resolved, F.col("grp"))).alias("n_groups"),
            F.count_if(relevant_core & (F.col("origin_status") == UNRESOLVED)).alias("n_unresolved"),
            F.count_if("support").alias("n_support"),
            _gate(F.col("conflict")).alias("conflict_pair"),
            _gate(relevant_core).alias("core_pair"),
            F.count_if(F.col("conflict") & (F.col("origin_status") == UNRESOLVED)).alias("open_conflicts"),
            *[m.alias(name) for m, name in zip(more, names, strict=True)],
        )
    )
    corroborated = (F.col("n_core") >= 3) & (F.col("n_domains") >= 2) & (F.col("n_groups") >= 2) & F.col("core_pair")
    status = (
        F.when((F.col("n_conflicts") >= 2) & F.col("conflict_pair"), "CONTEXT_CONFLICT")
        .when(F.col("n_conflicts") >= 1, "POSSIBLE_CONTEXT_CONFLICT")
        .when(corroborated & (F.col("n_support") >= 1), "NO_CONFLICT_FOUND")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
    limited = (
        F.when(status == "CONTEXT_CONFLICT", False)
        .when(F.col("n_conflicts") >= 1, F.col("open_conflicts") > 0)
        .otherwise(F.col("n_unresolved") > 0)
    )
    pair = F.when(F.col("n_conflicts") >= 2, F.col("conflict_pair")).otherwise(F.col("core_pair"))
    return pool.select(
        "inv", status.alias("status"), "n_conflicts", "n_core", "n_domains", "n_groups", "n_unresolved", "n_support",
        pair.alias("corroborated"), limited.alias("limited"), *names,
    )


def gates(statuses: DataFrame) -> DataFrame:
    """(inv, gate, passed) of each gate that was looked at: two with several conflicts, one with one, else six."""
    gate = lambda name, passed: F.struct(F.lit(name).alias("gate"), passed.alias("passed"))
    conflicts = gate("qualifying_conflicts", F.col("n_conflicts") >= 2)
    pair = gate("corroborating_pair", F.col("corroborated"))
    rest = [
        gate("relevant_core_coverage", F.col("n_core") >= 3),
        gate("distinct_domains", F.col("n_domains") >= 2),
        gate("distinct_reporting_groups", F.col("n_groups") >= 2),
        pair,
        gate("strong_support", F.col("n_support") > 0),
    ]
    several, one = F.array(conflicts, pair), F.array(conflicts)
    looked = F.when(F.col("n_conflicts") >= 2, several).when(F.col("n_conflicts") == 1, one).otherwise(F.array(conflicts, *rest))
    return statuses.select("inv", F.explode(looked).alias("g")).select("inv", "g.gate", "g.passed")


def corroborating_pair(candidates: DataFrame, which: str = "conflict") -> DataFrame:
    """(inv, first_id, second_id): the first pair, in id order, of separately evidenced rows that differ in domain and group.

    The first row is the least that has a partner at all, and its partner the
    least that differs in both. A row has no partner only if every other shares
    its domain or its group, so counts per inv, domain and group decide, and no
    row is paired with another before that.
    """
    rows = flags(candidates).where(F.col(which) & (F.col("origin_status") == SEPARATE)).select("inv", "cand_id", "domain", "grp")
    cells = rows.groupBy("inv", "domain", "grp").agg(F.min("cand_id").alias("least"), F.count(F.lit(1)).alias("n"))
    inv, dom, grp = Window.partitionBy("inv"), Window.partitionBy("inv", "domain"), Window.partitionBy("inv", "grp")
    partners = F.sum("n").over(inv) - F.sum("n").over(dom) - F.sum("n").over(grp) + F.col("n")
    open_cells = cells.withColumn("partners", partners).where("partners > 0")
    first = open_cells.groupBy("inv").agg(F.min_by(F.struct("least", "domain", "grp"), "least").alias("f")).select("inv", "f.*")
    other = cells.select("inv", F.col("domain").alias("d2"), F.col("grp").alias("g2"), F.col("least").alias("second"))
    found = first.join(other, "inv").where("domain <> d2 AND grp <> g2")
    return found.groupBy("inv").agg(F.min("least").alias("first_id"), F.min("second").alias("second_id"))


# The codes of takeaways, in their order.
TAKEAWAYS = ("temporal_conflict", "location_conflict", "historical_reuse", "no_current_media_corroboration")


def takeaways(candidates: DataFrame, claim_day: Column) -> DataFrame:
    """(inv, place, takeaway, n_evidence, first_id): at most three takeaways in their order, with what supports them.

    A temporal conflict is a relevant core row that predates the claim by over a
    day; historical reuse is one that is judged a historical reference as well.
    That nothing current corroborates is said only where news came back at all,
    and no core row among it; it rests on no evidence.
    """
    early = (F.col("date_status") == "usable") & F.coalesce(dates.predates(F.col("published_at"), F.col("precision"), claim_day), F.lit(False))
    news = F.col("kind") == "google_news"
    rows = flags(candidates).withColumn("both", F.col("core") & F.col("relevant")).withColumn("early", early)
    tests = (
        F.col("both") & F.col("early"),
        F.col("both") & at_least("loc_different", STRONG),
        F.col("both") & F.col("early") & at_least("historical", STRONG),
    )
    found = rows.groupBy("inv").agg(
        *[x for i, t in enumerate(tests) for x in (F.count_if(t).alias(f"n{i}"), F.min(F.when(t, F.col("cand_id"))).alias(f"id{i}"))],
        (F.bool_or(news) & ~F.bool_or(news & F.col("core"))).alias("silent"),
    )
    item = lambda i, n, first: F.struct(F.lit(TAKEAWAYS[i]).alias("takeaway"), n.alias("n_evidence"), first.alias("first_id"))
    named = [F.when(F.col(f"n{i}") > 0, item(i, F.col(f"n{i}"), F.col(f"id{i}"))) for i in range(3)]
    named.append(F.when(F.col("silent"), item(3, F.lit(0).cast("long"), F.lit(None).cast("string"))))
    first = F.slice(F.array_compact(F.array(*named)), 1, 3)
    return found.select("inv", F.posexplode(first).alias("place", "t")).select("inv", "place", "t.*")


def limitations(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """(inv, code): what an investigation could not see, by a fixed vocabulary of seventeen codes.

    ``runs`` has a row for each inv: exact_state (success, empty, malformed,
    unavailable), search_failed, news_failed, page_failures, deadline, claim_mode,
    claim_day, attempted and succeeded classifications, and eligible, selected,
    orderable and compared occurrences.
    """
    core = F.col("core")
    dated = core & (F.col("date_status") == "usable") & F.col("published_at").isNotNull()
    pool = flags(candidates).groupBy("inv").agg(
        F.bool_or(core & (F.col("origin_status") == UNRESOLVED)).alias("open_origin"),
        F.bool_or(F.coalesce(F.col("relationship") == "VISUAL_LEAD", F.lit(False))).alias("visual"),
        F.bool_or(F.col("date_status") == "disputed").alias("disputed"),
        F.bool_or(F.col("date_status") == "unknown").alias("unknown"),
        F.count_if(dated).alias("n_dated"),
    )
    c = F.col
    rules = {
        "exact_match_retrieval_unavailable": c("exact_state").isin("malformed", "unavailable"),
        "no_exact_occurrences_returned": c("exact_state") == "empty",
        "web_context_unavailable": c("search_failed"),
        "news_unavailable": c("news_failed"),
        # The surface is no longer offered.
        "about_this_image_unavailable": F.lit(True),
        "semantic_classification_unavailable": (c("attempted") > 0) & (c("succeeded") == 0),
        "semantic_classification_partial": (c("succeeded") > 0) & (c("succeeded") < c("attempted")),
        "reporting_origins_unresolved": c("open_origin"),
        "unverified_visual_leads_present": c("visual"),
        "near_match_verifier_disabled": c("visual"),
        "page_fetch_partial_failure": c("page_failures") > 0,
        "analysis_time_limit_reached": c("deadline"),
        "insufficient_dated_occurrences": F.coalesce(c("n_dated"), F.lit(0)) < 2,
        "comparison_coverage_incomplete": (c("selected") < c("eligible")) | (c("compared") < c("orderable")),
        "claim_date_unresolved": c("claim_mode") & c("claim_day").isNull(),
        "disputed_dates_present": c("disputed"),
        "unknown_dates_present": c("unknown"),
    }
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return runs.join(pool, "inv", "left").select("inv", F.explode(codes).alias("code"))


def trace_headline(candidates: DataFrame) -> DataFrame:
    """(inv, n_relevant_core, n_dated_core, headline): a trace is shown with two relevant and two dated core rows."""
    dated = F.col("core") & (F.col("date_status") == "usable") & F.col("published_at").isNotNull()
    pool = flags(candidates).groupBy("inv").agg(
        F.count_if(F.col("core") & F.col("relevant")).alias("n_relevant_core"), F.count_if(dated).alias("n_dated_core")
    )
    enough = (F.col("n_relevant_core") >= 2) & (F.col("n_dated_core") >= 2)
    return pool.withColumn("headline", F.when(enough, "trace_established").otherwise("trace_limited"))


def claim_expansion(candidates: DataFrame) -> DataFrame:
    """(inv, expand, reason): whether a checked claim asks for one more search, and why."""
    weak = ~at_least("different", STRONG) & ~at_least("same", STRONG)
    more = (
        F.bool_or(F.col("conflict") & (F.col("origin_status") == UNRESOLVED)),
        F.bool_or(F.col("relationship").isNotNull()),
        F.coalesce(F.bool_and(F.when(F.col("conflict"), weak)), F.lit(True)),
    )
    c = F.col
    reason = (
        F.when(c("status").isin("CONTEXT_CONFLICT", "NO_CONFLICT_FOUND"), "already_conclusive")
        .when(c("status") == "INSUFFICIENT_EVIDENCE", "insufficient_evidence")
        .when((c("n_conflicts") == 1) | ~c("corroborated") | c("open_conflict"), "corroboration_limited")
        .when(c("visual") & c("weak"), "weak_context_evidence")
        .otherwise("already_conclusive")
    )
    pool = claim_status(candidates, *more, names=("open_conflict", "visual", "weak")).select("inv", reason.alias("reason"))
    return pool.select("inv", (c("reason") != "already_conclusive").alias("expand"), "reason")


def trace_expansion(candidates: DataFrame, grounded: Column) -> DataFrame:
    """(inv, expand, reason): a trace is covered by two domains of relevant core rows with a usable day.

    ``grounded`` says, as an expression on inv, whether there is a query to ask.
    """
    day = F.col("core") & F.col("relevant") & (F.col("date_status") == "usable") & (F.col("precision") == "day") & F.col("published_at").isNotNull()
    pool = flags(candidates).groupBy("inv").agg(F.count_distinct(F.when(day, F.col("domain"))).alias("n"))
    reason = F.when(F.col("n") >= 2, "already_conclusive").when(grounded, "trace_coverage_unmet").otherwise("no_grounded_query")
    return pool.select("inv", (reason == "trace_coverage_unmet").alias("expand"), reason.alias("reason"))


def source_roles(candidates: DataFrame) -> DataFrame:
    """(inv, cand_id, role_basis, event_role, caption_circulation, correction_publication, original_publication).

    A document's role is a model's assessment or unresolved; an image on a page
    proves an occurrence of the media and neither that a caption went round nor
    where it was published first, so those stay unresolved.
    """
    judged = F.col("relevance").isNotNull()
    return flags(candidates).select(
        "inv",
        "cand_id",
        F.when(judged, "model_assessed").otherwise(UNRESOLVED).alias("role_basis"),
        F.when(F.col("core"), "media_occurrence").otherwise(UNRESOLVED).alias("event_role"),
        *[F.lit(UNRESOLVED).alias(n) for n in ("caption_circulation", "correction_publication", "original_publication")],
    )


def signals(candidates: DataFrame) -> DataFrame:
    """(inv, cand_id, signal, percent): each strong signal of a relevant row, as a row of its own."""
    names = ("same", "different", "supports", "contradicts")
    each = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("percent")) for n in names])
    rows = flags(candidates).where("relevant").select("inv", "cand_id", F.explode(each).alias("s"))
    return rows.select("inv", "cand_id", "s.signal", "s.percent").where(F.col("percent") >= STRONG)


def reporting_groups(candidates: DataFrame) -> DataFrame:
    """(inv, grp, n_members, n_domains, basis): the resolved groups of an investigation."""
    resolved = candidates.where(F.col("origin_status") != UNRESOLVED)
    return resolved.groupBy("inv", "grp").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.count_distinct("domain").alias("n_domains"),
        F.array_join(F.array_sort(F.collect_set("origin_status")), ",").alias("basis"),
    )


def metrics(candidates: DataFrame) -> DataFrame:
    """(inv, n_domains, n_groups, n_unresolved, earliest, earliest_id): provenance metrics of the core.

    The earliest date is the least as text, so that a year is before its days.
    """
    core = flags(candidates).where("core")
    dated = F.when((F.col("date_status") == "usable") & F.col("published_at").isNotNull(), F.struct("published_at", "cand_id"))
    pool = core.groupBy("inv").agg(
        F.count_distinct("domain").alias("n_domains"),
        F.count_distinct(F.when(F.col("origin_status") != UNRESOLVED, F.col("grp"))).alias("n_groups"),
        F.count_if(F.col("origin_status") == UNRESOLVED).alias("n_unresolved"),
        F.min(dated).alias("first"),
    )
    return pool.select("inv", "n_domains", "n_groups", "n_unresolved", F.col("first.published_at").alias("earliest"), F.col("first.cand_id").alias("earliest_id"))
