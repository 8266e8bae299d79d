"""Bounded selections: retention, classification, deep reads, excerpts, top-k by text overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.text import let
from .policy import STRONG, UNRESOLVED, at_least, flags

# Rows kept for each kind of retrieval.
CAPS = {"lens_exact": 8, "lens_visual": 8, "google_search": 5, "google_news": 5, "about_image": 5, "source_link": 1}


def retain(candidates: DataFrame, reserve_link: bool = False) -> DataFrame:
    """At most the cap of each kind, best provider rank first; adds place. A source link takes one place of the searches'."""
    links = F.least(F.count_if(F.col("kind") == "source_link").over(Window.partitionBy("inv")), F.lit(CAPS["source_link"]))
    taken = F.greatest(F.lit(CAPS["source_link"] if reserve_link else 0), links)
    caps = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    cap = F.coalesce(F.try_element_at(caps, F.col("kind")), F.lit(0)) - F.when(F.col("kind") == "google_search", F.col("taken")).otherwise(0)
    place = F.row_number().over(Window.partitionBy("inv", "kind").orderBy(F.col("position").asc_nulls_last(), "cand_id"))
    # No kind keeps more than the largest cap, so that part of the ranking needs no other row.
    few = candidates.withColumn("place", place)
    few = few.withColumn("taken", taken).where(F.col("place") <= max(CAPS.values()))
    return few.where(F.col("place") <= cap).drop("taken")


def for_classification(candidates: DataFrame, most: int = 24) -> DataFrame:
    """The first ``most`` rows by tier (exact, dated), then new domain or group first, then rank; adds place.

    A row is new if it is the first of its domain, or of its resolved group, in
    preference order: no row before it has either.
    """
    return placed(candidates).where(F.col("place") <= most)


def placed(candidates: DataFrame) -> DataFrame:
    """Every row with its place in the order of for_classification()."""
    exact = (F.col("relationship") != "EXACT_MATCH").cast("int")
    dated = (~((F.col("date_status") == "usable") & F.col("published_at").isNotNull())).cast("int")
    rows = candidates.withColumn("t1", exact).withColumn("t2", dated)
    pref = ["t1", "t2", F.col("position").asc_nulls_last(), "cand_id"]
    open_ = F.col("origin_status") == UNRESOLVED
    in_domain = F.row_number().over(Window.partitionBy("inv", "domain").orderBy(*pref))
    in_group = F.row_number().over(Window.partitionBy("inv", open_, "grp").orderBy(*pref))
    rows = rows.withColumn("old", ~((in_domain == 1) | ((in_group == 1) & ~open_)))
    place = F.row_number().over(Window.partitionBy("inv").orderBy("t1", "t2", "old", F.col("position").asc_nulls_last(), "cand_id"))
    return rows.withColumn("place", place).drop("t1", "t2", "old")


def deep_reads(candidates: DataFrame, most: int = 5) -> DataFrame:
    """(inv, cand_id, role, place): at most five pages to read, no row twice.

    In order: the core anchor (the earliest dated core row, else the strongest
    judged one), the strongest unresolved conflict of another domain than the
    anchor's, the strongest support, the strongest fact check, the strongest
    current report. Each of these is one winner, which is not replaced if it is
    taken already. Without a dated core row, judged core rows follow, those of
    new domains first, and then one historical lead, if none is among the rows
    taken. Judged rows fill up. "Strongest" is by relevance, rank, id; a row is
    judged if it has a relevance. Needs url and cue (whether its texts hint at an
    earlier use of the media) as well.

    One order of strength within each investigation numbers the rows of every
    later role, of which only the first can be taken; winners and those rows are
    aggregates of each domain and then of the investigation, so that nothing is
    joined and a bounded number of rows is gathered.
    """
    c = F.col
    judged, safe = c("relevance").isNotNull(), urls.safe_reference(c("url"))
    rows = flags(candidates).withColumn("judged", judged).withColumn("lead", c("relevant") & safe & F.coalesce(c("cue"), F.lit(False)))
    strongest = F.struct((-F.coalesce(c("relevance"), F.lit(0))).alias("weak"), F.coalesce(c("position"), F.lit(10**9)).alias("rank"), c("cand_id").alias("id"))
    rows = rows.withColumn("by", strongest).withColumn("r", F.struct("by", F.struct("cand_id", "domain", "lead").alias("row")))
    dated = c("core") & (c("date_status") == "usable") & c("published_at").isNotNull()
    checked = F.struct((-c("fact_check")).alias("check"), c("by"), c("r.row").alias("row"))
    days = F.struct(dates.day_start(c("published_at"), c("precision")).alias("a"), dates.day_end(c("published_at"), c("precision")).alias("b"), "cand_id", c("r.row").alias("row"))
    news = F.coalesce((c("kind") == "google_news") | at_least("reporting", STRONG), F.lit(False))
    later = {"core": F.coalesce(c("core") & c("judged"), F.lit(False)), "leads": F.coalesce(c("lead"), F.lit(False)), "judged": c("judged")}
    so_far = Window.partitionBy("inv").orderBy("by").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of each later role at most twice as many rows as are taken can matter.
    rows = rows.withColumns({f"of_{n}": F.when(is_in & (F.count_if(is_in).over(so_far) <= 2 * most), c("r")) for n, is_in in later.items()})
    winners = {
        "first_dated": F.when(dated, days),
        "first_core": F.when(later["core"], c("r")),
        "support": F.when(c("support"), c("r")),
        "fact_check": F.when(c("fact_check") > 0, checked),
        "current_reporting": F.when(news, c("r")),
    }
    of_domain = rows.groupBy("inv", "domain").agg(
        *[F.min(w).alias(n) for n, w in winners.items()],
        F.min(F.when(c("conflict") & (c("origin_status") == UNRESOLVED), c("r"))).alias("against"),
        *[F.collect_list(f"of_{n}").alias(n) for n in later],
    )
    # The strongest conflict of another domain than the anchor's is among those of two domains.
    nth = lambda name: F.row_number().over(Window.partitionBy("inv").orderBy(F.asc_nulls_last(c(name)["by"])))
    of_domain = of_domain.withColumn("against", F.when(nth("against") <= 2, c("against")))
    of_domain = of_domain.withColumn("domains", F.when(nth("first_core") <= 2 * most, c("first_core")))
    in_order = lambda rows_: F.transform(F.array_sort(rows_), lambda x: x["row"])
    plan = of_domain.groupBy("inv").agg(
        *[F.min(n)["row"].alias(n) for n in winners],
        in_order(F.collect_list("against")).alias("against"),
        in_order(F.collect_list("domains")).alias("domains"),
        *[in_order(F.flatten(F.collect_list(n))).alias(n) for n in later],
    ).withColumn("core_anchor", F.coalesce("first_dated", "first_core"))
    plan = plan.withColumn("conflict", F.get(F.filter("against", lambda r: ~r["domain"].eqNullSafe(c("core_anchor.domain"))), F.lit(0)))

    taken_as = lambda r, role: F.struct(F.lit(role).alias("role"), r["cand_id"].alias("cand_id"), r["domain"].alias("domain"), r["lead"].alias("lead"))
    kind = "array<struct<role:string,cand_id:string,domain:string,lead:boolean>>"
    has = lambda taken, field, value: F.exists(taken, lambda t: t[field].eqNullSafe(value))

    def add(taken, r, role, also=lambda taken, r: F.lit(True)):
        def added(t):
            fits = r["cand_id"].isNotNull() & (F.size(t) < most) & ~has(t, "cand_id", r["cand_id"]) & also(t, r)
            return F.when(fits, F.concat(t, F.array(taken_as(r, role)))).otherwise(t)

        return let(taken, added)

    def fill(taken, rows_, role, also=lambda taken, r: F.lit(True)):
        return F.aggregate(rows_, taken, lambda acc, r: add(acc, r, role, also))

    plan = plan.withColumn("taken", F.array().cast(kind))
    for role in ("core_anchor", "conflict", "support", "fact_check", "current_reporting"):
        plan = plan.withColumn("taken", add(c("taken"), c(role), role))
    plan = plan.withColumn("undated", c("first_dated").isNull())
    none = F.array().cast("array<struct<cand_id:string,domain:string,lead:boolean>>")
    if_undated = lambda name: F.when(c("undated"), F.coalesce(c(name), none)).otherwise(none)
    new_domain = lambda taken, r: ~has(taken, "domain", r["domain"])
    plan = plan.withColumn("taken", fill(c("taken"), if_undated("domains"), "core_recovery", new_domain))
    plan = plan.withColumn("taken", fill(c("taken"), if_undated("core"), "core_recovery"))
    plan = plan.withColumn("taken", fill(c("taken"), if_undated("leads"), "historical_lead", lambda taken, r: ~F.exists(taken, lambda t: t["lead"])))
    plan = plan.withColumn("taken", fill(c("taken"), F.coalesce(c("judged"), none), "filler"))
    return plan.select("inv", F.posexplode("taken").alias("n", "t")).select("inv", "t.cand_id", "t.role", (c("n") + 1).alias("place"))


def best_paragraphs(paragraphs: DataFrame, claims: DataFrame, most: int = 3) -> DataFrame:
    """(claim_id, page_id, ord, overlap): of each page, the paragraphs that share most words with a claim.

    ``paragraphs`` is (page_id, ord, words) and ``claims`` (claim_id, words); they
    meet on shared words, never as all pairs. Ties go to the earlier paragraph.
    """
    said = paragraphs.select("page_id", "ord", F.explode(F.array_distinct("words")).alias("word"))
    asked = claims.select("claim_id", F.explode(F.array_distinct("words")).alias("word"))
    shared = said.join(asked, "word").groupBy("claim_id", "page_id", "ord").agg(F.count(F.lit(1)).alias("overlap"))
    by = Window.partitionBy("claim_id", "page_id").orderBy(F.desc("overlap"), "ord")
    return shared.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def topic_passages(paragraphs: DataFrame, claims: DataFrame, most: int = 3, longest: int = 2400) -> DataFrame:
    """(claim_id, page_id, passages): the best paragraphs of a page, each cut at ``longest``, with a blank line between.

    ``paragraphs`` is (page_id, ord, text, words). Of paragraphs with the same
    trimmed text the first counts; blank ones and those without a shared word don't.
    """
    trimmed = paragraphs.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    first = trimmed.groupBy("page_id", F.sha2("text", 256).alias("same")).agg(F.min_by(F.struct("ord", "text", "words"), "ord").alias("p"))
    first = first.select("page_id", "p.*")
    best = best_paragraphs(first, claims, most).join(first.select("page_id", "ord", F.substring("text", 1, longest).alias("part")), ["page_id", "ord"])
    parts = F.array_sort(F.collect_list(F.struct("place", "part")))
    joined = F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n")
    return best.groupBy("claim_id", "page_id").agg(joined.alias("passages"))
