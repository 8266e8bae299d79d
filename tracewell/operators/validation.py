"""Validation of cases: bounds, vocabularies, dates, digests, spans, source reads and references.

A case is five tables of rows with case_id and id: claims, assets, evidence,
occurrences and relations; source reads are a sixth. Every rule is a boolean
column that holds for a sound row; what breaks one is a row of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Bounds and vocabularies of a case.
LONGEST_ID, LONGEST_TEXT, LONGEST_URL, MOST_ITEMS = 256, 20_000, 4_096, 1_000
LONGEST_REFERENCE, LONGEST_SUPPORT = 400, 1_200
CONTENT = ("text", "media", "reference")
ATTRIBUTION = ("page_quote", "search_snippet", "classification_context")
DATE_STATUS = ("observed", "inferred", "disputed", "unknown")
DATE_SOURCE = ("page_json_ld", "page_meta", "page_time", "search_metadata", "retrieval_log", "user_statement")
METHOD = ("user_submission", "retrieval", "page_extraction", "model_assessment", "manual")
RIGHTS, RETENTION = ("unknown", "user_provided", "public_reference"), ("reference_only", "not_retained")
ASSET_KIND, SPAN_KIND, ASSESSED = ("image", "video", "audio"), ("whole", "time"), ("observed", "inferred", "unknown")
RELATIONSHIPS = {
    "evidence_claim": ("supports", "challenges", "context"),
    "claim_claim": ("paraphrase", "translation", "contradiction"),
    "occurrence_occurrence": ("repost", "quotation", "source_link", "similar_media"),
}
BINDING = ("same_resource", "normalized_resource", "different_resource", "blocked_destination", "not_established", "reference_destination")
OUTCOME = ("not_attempted", "fetch_failed", "binding_rejected", "no_readable_text", "no_matching_quote", "page_quote")
DATE_FORMS = {"day": r"^\d{4}-\d{2}-\d{2}$", "month": r"^\d{4}-\d{2}$", "year": r"^\d{4}$"}
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z$"
SHA256 = r"^sha256:[a-f0-9]{64}$"

Rules = dict[str, Column]


def _text(name: str, most: int = LONGEST_TEXT) -> Column:
    return (F.trim(name) != "") & (F.length(name) <= most)


def _or_null(name: str, rule: Column) -> Column:
    return F.col(name).isNull() | rule


def _one_of(name: str, values: tuple[str, ...]) -> Column:
    return F.col(name).isin(*values)


def _instant(name: str) -> Column:
    """A UTC time to the second or millisecond, of a day that there is."""
    day = F.left(F.col(name), F.lit(10))
    hours = F.substring(name, 12, 8)
    real = F.try_to_date(day, "yyyy-MM-dd").isNotNull() & hours.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d$")
    return F.col(name).rlike(INSTANT) & real


def _url(name: str) -> Column:
    url = F.col(name)
    return (F.length(url) <= LONGEST_URL) & (urls.host(url) != "") & (urls.userinfo(url) == "")


def _date_rules() -> Rules:
    value, precision, status = F.col("date_value"), F.col("date_precision"), F.col("date_status")
    form = F.when(precision == "instant", _instant("date_value"))
    for name, pattern in DATE_FORMS.items():
        first = F.rpad(value, 10, "-01-01") if name == "year" else F.concat(value, F.lit("-01")) if name == "month" else value
        form = form.when(precision == name, value.rlike(pattern) & F.try_to_date(first, "yyyy-MM-dd").isNotNull())
    stated = status.isin("observed", "inferred")
    backed = (F.col("date_source") == "user_statement") | F.coalesce(_url("date_url"), F.lit(False))
    return {
        "date_status": _one_of("date_status", DATE_STATUS),
        "date_form": ~stated | F.coalesce(form, F.lit(False)),
        "date_source": ~stated | _one_of("date_source", DATE_SOURCE),
        "date_source_has_a_url": ~stated | backed,
        "inferred_date_has_a_rationale": (status != "inferred") | _text("date_rationale"),
    }


def _provenance_rules() -> Rules:
    return {
        "method": _one_of("method", METHOD),
        "rights": _one_of("rights", RIGHTS),
        "retention": _one_of("retention", RETENTION),
        "content_hash": _or_null("content_hash", F.col("content_hash").rlike(SHA256)),
        "retrieved_at": _or_null("retrieved_at", _instant("retrieved_at")),
    }


def _span_rules(has_span: Column) -> Rules:
    timed = has_span & (F.col("span_kind") == "time")
    return {
        "span_kind": ~has_span | _one_of("span_kind", SPAN_KIND),
        "span_bounds": ~timed | ((F.col("start_ms") >= 0) & (F.col("duration_ms") >= 1)),
    }


def _assessment_rules() -> Rules:
    known = F.col("assessed") != "unknown"
    return {
        "assessed": _one_of("assessed", ASSESSED),
        "assessment_has_evidence": ~known | (F.size("evidence_ids") > 0),
        "inference_has_a_rationale": (F.col("assessed") != "inferred") | _text("rationale"),
    }


def claim_rules() -> Rules:
    return {"id": _text("id", LONGEST_ID), "text": _text("text"), "language": _or_null("language", _text("language"))}


def asset_rules() -> Rules:
    timed = F.col("duration_ms").isNull() | ((F.col("kind") != "image") & (F.col("duration_ms") >= 1))
    return {"id": _text("id", LONGEST_ID), "kind": _one_of("kind", ASSET_KIND), "location": _or_null("url", _url("url")), "duration": timed}


def evidence_rules() -> Rules:
    content = F.col("content")
    return {
        "id": _text("id", LONGEST_ID),
        "source_url": _url("source_url"),
        "title": _or_null("title", _text("title")),
        "content": _one_of("content", CONTENT),
        "text": (content != "text") | (_text("text") & _one_of("attribution", ATTRIBUTION)),
        "media_has_an_asset": (content != "media") | _text("asset_id", LONGEST_ID),
        **_span_rules(content == "media"),
        **_date_rules(),
        **_provenance_rules(),
    }


def occurrence_rules() -> Rules:
    return {"id": _text("id", LONGEST_ID), **_span_rules(F.lit(True)), **_assessment_rules()}


def relation_rules() -> Rules:
    relationship = F.lit(False)
    for kind, values in RELATIONSHIPS.items():
        relationship = relationship | ((F.col("kind") == kind) & F.col("relationship").isin(*values))
    pair = F.col("kind") != "evidence_claim"
    return {
        "id": _text("id", LONGEST_ID),
        "kind": _one_of("kind", tuple(RELATIONSHIPS)),
        "relationship": relationship,
        "no_self_relation": ~pair | (F.col("left_id") != F.col("right_id")),
        "similarity_is_inferred": (F.col("relationship") != "similar_media") | (F.col("assessed") != "observed"),
        **_assessment_rules(),
    }


def read_rules() -> Rules:
    binding, outcome, final = F.col("binding"), F.col("outcome"), F.col("final_url")
    referred = F.col("reference_text").isNotNull()
    bound = binding.isin("same_resource", "normalized_resource") | ((binding == "reference_destination") & referred)
    return {
        "requested_url": urls.safe_reference(F.col("requested_url")),
        "final_url": _or_null("final_url", urls.safe_reference(final)),
        "binding": _one_of("binding", BINDING),
        "outcome": _one_of("outcome", OUTCOME),
        "reference_length": ~referred | ((F.length("reference_text") <= LONGEST_REFERENCE) & (F.length("reference_support") <= LONGEST_SUPPORT)),
        "reference_destination_has_a_reference": (binding != "reference_destination") | referred,
        "bound_read_has_a_final_url": ~bound | final.isNotNull(),
        "unattempted_read_binds_nothing": (outcome != "not_attempted") | (final.isNull() & (binding == "not_established")),
        "rejected_read_is_not_bound": (outcome != "binding_rejected") | ~bound,
        "extracted_read_is_bound": ~outcome.isin("no_readable_text", "no_matching_quote", "page_quote") | bound,
    }


RULES = {
    "claims": claim_rules, "assets": asset_rules, "evidence": evidence_rules, "occurrences": occurrence_rules, "relations": relation_rules, "reads": read_rules,
}

#: Keys that must be there: (rule, table, the rows that have the key, the key, the table that has it).
KEYS = (
    ("evidence_asset", "evidence", "content = 'media'", "asset_id", "assets"),
    ("occurrence_asset", "occurrences", "true", "asset_id", "assets"),
    ("occurrence_evidence", "occurrences", "true", "evidence_id", "evidence"),
    ("relation_evidence", "relations", "kind = 'evidence_claim'", "left_id", "evidence"),
    ("relation_claim", "relations", "kind = 'evidence_claim'", "right_id", "claims"),
    ("relation_claims", "relations", "kind = 'claim_claim'", "left_id", "claims"),
    ("relation_claims", "relations", "kind = 'claim_claim'", "right_id", "claims"),
    ("relation_occurrences", "relations", "kind = 'occurrence_occurrence'", "left_id", "occurrences"),
    ("relation_occurrences", "relations", "kind = 'occurrence_occurrence'", "right_id", "occurrences"),
)


def broken_rules(rows: DataFrame, path: str) -> DataFrame:
    """(case_id, path, id, rule) of each rule that a row of the table breaks; an unknown value breaks it."""
    failing = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in RULES[path]().items()]
    flat = rows.select("case_id", F.lit(path).alias("path"), "id", F.explode(F.array_compact(F.array(*failing))).alias("rule"))
    return flat


def _missing(rows: DataFrame, path: str, key: Column, held: DataFrame, rule: str) -> DataFrame:
    asked = rows.select("case_id", "id", key.alias("ref")).where("ref IS NOT NULL")
    there = held.select("case_id", F.col("id").alias("ref")).distinct()
    return asked.join(there, ["case_id", "ref"], "left_anti").select("case_id", F.lit(path).alias("path"), "id", F.lit(rule).alias("rule"))


def broken_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(case_id, path, id, rule): references to rows that the case lacks, ids that a table repeats, and spans beyond their media."""
    found = [_missing(tables[t].where(some), t, F.col(key), tables[to], rule) for rule, t, some, key, to in KEYS]
    for t, rule in (("occurrences", "identity_evidence"), ("relations", "assessment_evidence")):
        each = tables[t].where("assessed <> 'unknown'").select("case_id", "id", F.explode("evidence_ids").alias("ref"))
        found.append(_missing(each, t, F.col("ref"), tables["evidence"], rule))
    for t in ("claims", "assets", "evidence", "occurrences", "relations"):
        twice = tables[t].groupBy("case_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(twice.select("case_id", F.lit(t).alias("path"), "id", F.lit("duplicate_id").alias("rule")))
    media = tables["assets"].select("case_id", F.col("id").alias("asset_id"), F.col("kind").alias("media"), F.col("duration_ms").alias("whole_ms"))
    for t, some in (("evidence", "content = 'media'"), ("occurrences", "true")):
        spans = tables[t].where(some).where("span_kind = 'time'").join(media, ["case_id", "asset_id"])
        beyond = (F.col("media") == "image") | (F.col("start_ms") + F.col("duration_ms") > F.col("whole_ms"))
        found.append(spans.where(beyond).select("case_id", F.lit(t).alias("path"), "id", F.lit("span_beyond_media").alias("rule")))
    return reduce(DataFrame.unionByName, found).distinct()


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """(case_id, path, id, rule): everything that is unsound in cases, given as the six tables."""
    own = [broken_rules(tables[t], t) for t in RULES]
    return reduce(DataFrame.unionByName, own).unionByName(broken_references(tables))
