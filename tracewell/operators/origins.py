"""Reporting origins of pages from their texts, in three passes of which later ones may overrule earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as text_fn
from ..sources.shared import written

#: Code points of a text that is long enough to judge an origin by.
LEAST_TEXT = 400


def refine_origins(pages: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(inv, cand_id, status, group_id, basis, n_supports, first_support, spans, changed) for every page.

    ``pages`` is (inv, cand_id, ord, domain, text, status, group_id): the page's place
    in its investigation, its registrable domain, its text and the origin so far.
    ``duplicates`` is (inv, cand_id, grp), the groups of pages with much the same text.

    1. Pages of a group of two or more share an origin, whatever they had.
    2. A page that is still unresolved and attributes itself to another origin than its own outlet shares that one.
    3. Pages that two or more pages credit to one outside name share that name's origin, also against passes 1 and 2,
       unless they had a separate one from the start; of several such names the last counts, in order of the first page
       and place that gives each. A page that credits its own outlet with the media, and no other, is separate if unresolved.

    Each pass is a partial aggregate by its key and a join of narrow rows: texts don't
    shuffle, and pages are not gathered. Pages without a text, or with one of under 400
    code points, keep what they had. Rows of one cand_id must not repeat.
    """
    c = F.col
    held = pages.where(F.length("text") >= LEAST_TEXT).select(
        "inv", "cand_id", "ord", "domain", "status", "group_id", text_fn.origin_key(c("text")).alias("origin"),
        text_fn.credits(c("text")).alias("credit"),
    )
    own = text_fn.own_outlet_key(c("domain"))
    keys = lambda names: F.transform(names, text_fn.name_key)
    outside = F.array_distinct(F.filter(keys(F.concat("credit.media", "credit.hosting", "credit.bylines")), lambda k: k != ""))
    held = held.withColumn("own", F.coalesce(own, F.lit("")))
    held = held.withColumn("outside", F.filter(outside, lambda k: k != c("own"))).withColumn(
        "self_bound", (c("own") != "") & F.array_contains(keys(c("credit.media")), c("own"))
    )

    # Written, since each pass reads it and the texts are costly to judge.
    held = written(held, "origins")
    members = duplicates.select("inv", "cand_id", "grp").join(held.select("inv", "cand_id", "ord"), ["inv", "cand_id"])
    least = F.struct("ord", "cand_id")
    shared = members.groupBy("inv", "grp").agg(F.count(F.lit(1)).alias("n_dup"), F.min(least)["cand_id"].alias("dup")).where("n_dup > 1")
    dup = members.join(shared, ["inv", "grp"]).select("inv", "cand_id", "dup", "n_dup")

    # Only pages that pass 3 looks at count towards a name: a separate origin that pass 1 did not take back stays out.
    rows = held.join(dup, ["inv", "cand_id"], "left")
    looked = rows.where(c("dup").isNotNull() | (F.coalesce("status", F.lit("unresolved")) != "separate_origin_evidenced"))
    named = looked.select("inv", "cand_id", "ord", F.posexplode("outside").alias("at", "provider"))
    place = F.struct("ord", "at", "cand_id")
    several = named.groupBy("inv", "provider").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    last = named.join(several, ["inv", "provider"]).groupBy("inv", "cand_id").agg(F.max(F.struct("first", "provider", "n")).alias("p"))

    foreign = c("origin").isNotNull() & (c("origin") != F.coalesce("domain", F.lit(""))) & (text_fn.name_key(F.substring("origin", F.lit(6), F.length("origin"))) != c("own"))
    open_ = F.coalesce("status", F.lit("unresolved")) == "unresolved"
    step = (
        F.when(c("p").isNotNull(), "shared_named_provider")
        .when(c("dup").isNotNull(), "article_text_duplication")
        .when(open_ & foreign, "explicit_syndication_attribution")
        .when(open_ & (F.size("outside") == 0) & c("self_bound"), "separate_reporting_evidence")
    )
    rows = rows.join(last, ["inv", "cand_id"], "left").withColumn("basis", step)
    by = lambda provider, duplicate, attributed, separate: (
        F.when(c("basis") == "shared_named_provider", provider)
        .when(c("basis") == "article_text_duplication", duplicate)
        .when(c("basis") == "explicit_syndication_attribution", attributed)
        .when(c("basis") == "separate_reporting_evidence", separate)
    )
    none = F.array().cast("array<string>")
    found = rows.where(c("basis").isNotNull()).select(
        "inv", "cand_id", "basis",
        F.when(c("basis") == "separate_reporting_evidence", "separate_origin_evidenced").otherwise("shared_origin").alias("new_status"),
        by(F.concat(F.lit("provider:"), "p.provider"), F.concat(F.lit("dup:"), c("dup").cast("string")), c("origin"), F.concat(F.lit("origin:"), "domain")).alias("new_group"),
        by(c("p.n"), c("n_dup"), F.lit(1), F.lit(1)).cast("long").alias("n_supports"),
        by(c("p.first.cand_id"), c("dup"), c("cand_id"), c("cand_id")).alias("first_support"),
        by(c("credit.spans"), none, c("credit.said"), c("credit.spans")).alias("spans"),
    )
    was = pages.select("inv", "cand_id", F.coalesce("status", F.lit("unresolved")).alias("status"), "group_id")
    return was.join(found, ["inv", "cand_id"], "left").select(
        "inv", "cand_id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_group", "group_id").alias("group_id"), "basis",
        "n_supports", "first_support", F.coalesce("spans", none).alias("spans"), c("basis").isNotNull().alias("changed"),
    )
