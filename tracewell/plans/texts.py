"""Queries on texts, pages, citations and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as text_fn
from ..functions import urls
from ..operators import cases, citations, pages, research, similarity, validation
from ..sources.shared import written
from .views import table

#: Cases that documents are dealt to by their id.
CASES = 97


def _documents(spark, sf_dir) -> DataFrame:
    """Documents as evidence of the case of their id, with a publication day from their id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % CASES).alias("case_id"),
        F.col("doc_id").alias("evidence_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("source").alias("host"),
        F.date_format(day, "yyyy-MM-dd").alias("published"),
    )


def _revisions(spark, sf_dir) -> DataFrame:
    """Two revisions of each case: in the second every tenth text is corrected, every 17th gone, every 23rd dated a day later."""
    first = _documents(spark, sf_dir).withColumn("revision", F.lit(1))
    second = first.where("evidence_id % 17 <> 0").withColumn("revision", F.lit(2))
    second = second.withColumn("text", F.when(F.col("evidence_id") % 10 == 0, F.concat("text", F.lit(" (corrected)"))).otherwise(F.col("text")))
    later = F.date_format(F.date_add(F.col("published").cast("date"), 1), "yyyy-MM-dd")
    second = second.withColumn("published", F.when(F.col("evidence_id") % 23 == 0, later).otherwise(F.col("published")))
    rows = first.unionByName(second)
    return rows.withColumn("digest", F.sha2(F.concat_ws("|", "text", "published"), 256)).drop("text")


REVISIONS = f"""
doc_v AS (SELECT doc_id % {CASES} AS case_id, doc_id AS evidence_id, coalesce(text, '') AS text, source AS host,
    strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') AS published FROM documents),
rev_v AS (SELECT case_id, evidence_id, host, published, 1 AS revision, sha256(text || '|' || published) AS digest FROM doc_v
  UNION ALL SELECT case_id, evidence_id, host, p, 2, sha256(CASE WHEN evidence_id % 10 = 0 THEN text || ' (corrected)' ELSE text END || '|' || p)
  FROM (SELECT *, CASE WHEN evidence_id % 23 = 0 THEN strftime(CAST(published AS DATE) + 1, '%Y-%m-%d') ELSE published END AS p
        FROM doc_v WHERE evidence_id % 17 <> 0))
"""


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 7).alias("case_id"), F.col("page_id").alias("evidence_id"), "url", F.col("html").alias("text")
    )


def _citations(spark, sf_dir) -> DataFrame:
    """Each document cites the page with its id modulo the largest page id and one, if there is one, with a quote of three kinds."""
    pages = table(spark, sf_dir, "pages")
    n = (pages.agg(F.max("page_id")).first()[0] or 0) + 1
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("page_id"))
    cited = docs.join(pages, "page_id")
    kind = F.col("doc_id") % 4
    return cited.select(
        (F.col("page_id") % 7).alias("case_id"),
        F.concat(F.lit("c"), "doc_id").alias("citation_id"),
        F.col("doc_id").alias("from_id"),
        F.col("url").alias("target_url"),
        F.when(kind == 0, F.substring("html", 11, 20)).when(kind == 1, F.lit("no such passage")).when(kind == 2, F.substring("html", 11, 20)).alias("quote"),
        F.when(kind == 0, F.lit(10)).when(kind == 2, F.lit(12)).alias("start"),
    )


CITATIONS = """
key_v AS (SELECT page_id, url, html, page_id % 7 AS case_id, regexp_replace(url, '#.*$', '') AS key FROM pages),
cite_v AS (SELECT p.case_id, 'c' || doc_id AS citation_id, doc_id AS from_id, p.key, p.url,
    CASE doc_id % 4 WHEN 0 THEN substr(html, 11, 20) WHEN 1 THEN 'no such passage' WHEN 2 THEN substr(html, 11, 20) END AS quote,
    CASE doc_id % 4 WHEN 0 THEN 10 WHEN 2 THEN 12 END AS start
  FROM documents d JOIN key_v p ON d.doc_id % (SELECT max(page_id) + 1 FROM pages) = p.page_id)
"""


def canonical_urls(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(url).alias("canonical"), urls.host(url).alias("host"))


def source_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.source_key(F.col("url")).alias("source_key"))


def audit_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.audit(F.col("url")).alias("audit_url"))


def safe_references(spark, sf_dir):
    """URLs as they are, and with a token, a user, a local and a private host, and a harmless parameter."""
    url, kind = F.regexp_replace(F.col("url"), "#.*$", ""), F.col("page_id") % 6
    more = F.when(url.contains("?"), "&").otherwise("?")
    tail = F.regexp_replace(url, "^[a-z]+://[^/?]*", "")
    odd = (
        F.when(kind == 1, F.concat(url, more, F.lit("access_token=x")))
        .when(kind == 2, F.regexp_replace(url, "://", "://user:pw@"))
        .when(kind == 3, F.concat(F.lit("http://printer.local"), tail))
        .when(kind == 4, F.concat(F.lit("http://192.168.7.1"), tail))
        .when(kind == 5, F.concat(url, more, F.lit("q=x")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.safe_reference(odd).alias("safe"))


def redirect_bindings(spark, sf_dir):
    """URLs that lead to themselves, over to https or http, with a tracking parameter, to another host and to a log-in page."""
    url, kind = F.col("url"), F.col("page_id") % 6
    bare = F.regexp_replace(url, "#.*$", "")
    final = (
        F.when(kind == 1, F.regexp_replace(url, "^http://", "https://"))
        .when(kind == 2, F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_source=x")))
        .when(kind == 3, F.regexp_replace(url, "^https://", "http://"))
        .when(kind == 4, F.lit("https://other.example.org/x"))
        .when(kind == 5, F.concat(F.regexp_extract(url, "^([a-z]+://[^/?#]*)", 1), F.lit("/account/Login/")))
        .otherwise(url)
    )
    asked = F.when(F.col("page_id") % 35 == 0, "http://localhost/x").otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", urls.binding(asked, final).alias("binding"))


def merged_pages(spark, sf_dir):
    """Pages merged by canonical URL."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))
    return rows.groupBy("canonical").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))


def citation_checks(spark, sf_dir):
    return citations.targets(_citations(spark, sf_dir), _pages(spark, sf_dir))


def shared_citations(spark, sf_dir):
    return citations.shared_targets(_citations(spark, sf_dir))


def duplicate_passages(spark, sf_dir):
    return citations.duplicate_passages(_documents(spark, sf_dir))


def url_mentions(spark, sf_dir):
    """Pages as texts that mention each other: each text is the URLs of its own and of the next page."""
    pages = _pages(spark, sf_dir)
    nxt = pages.select((F.col("evidence_id") - 7).alias("evidence_id"), F.col("url").alias("other"))
    texts = pages.join(nxt, "evidence_id", "left").select("case_id", "evidence_id", "url", F.concat_ws(" and ", "url", "other").alias("text"))
    return citations.url_mentions(texts)


def _shingled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 400)
    return docs.select(F.lit("all").alias("scope"), F.col("doc_id").alias("id"), text_fn.shingle_hashes(F.col("text")).alias("tokens"))


def near_duplicate_texts(spark, sf_dir):
    """Pairs of distinct long texts with 5-gram Jaccard of 60 % or more, by their shingles."""
    pairs = similarity.similar_sets(similarity.set_classes(_shingled(spark, sf_dir)), 60)
    return pairs.select("a", "b", "common", "union")


def duplicate_groups(spark, sf_dir):
    """Groups of texts linked by near_duplicate_texts or equal shingles, each named by its least id."""
    classes = similarity.set_classes(_shingled(spark, sf_dir))
    return similarity.groups(classes, similarity.similar_links(classes, 60))


def _statements(spark, sf_dir) -> DataFrame:
    """Turns of conversations, and benchmark texts, as statements: a conversation is a case, and a role a source."""
    c = F.col
    said = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND text IS NOT NULL").select(
        (c("conv_id").cast("long") * 4_294_967_296 + c("turn")).alias("id"), c("conv_id").alias("case_id"), c("turn").alias("evidence_id"), c("role").alias("url"), "text"
    )
    asked = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(
        (-1 - c("item_id")).alias("id"), (-1 - c("item_id")).alias("case_id"), c("item_id").alias("evidence_id"), F.lit("benchmark").alias("url"), "text"
    )
    return said.unionByName(asked)


STATEMENTS = """
st_v AS (SELECT CAST(conv_id AS BIGINT) * 4294967296 + turn AS id, conv_id AS case_id, turn AS evidence_id, role AS url, text FROM conversations
    WHERE conv_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT -1 - item_id, -1 - item_id, item_id, 'benchmark', text FROM benchmark WHERE text IS NOT NULL)
"""


def statement_appearances(spark, sf_dir):
    found = research.appearances(_statements(spark, sf_dir))
    return found.select("url", F.sha2("text", 256).alias("text_sha"), "id", "n", F.size("case_ids").alias("n_cases"))


def statement_families(spark, sf_dir):
    return research.families(_statements(spark, sf_dir))


def statement_connections(spark, sf_dir):
    return research.connections(_statements(spark, sf_dir))


def near_vector_hashes(spark, sf_dir):
    """Pairs of distinct 64-bit sign hashes of vectors at most eight bits apart."""
    v = F.col("embedding")
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda h, i: h.bitwiseOR(F.when(F.element_at(v, i + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )
    hashed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("hash"))
    return similarity.near_hashes(hashed)


def contained_sentences(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("case_id", F.col("evidence_id").alias("id"), "text")
    return similarity.contained_sentences(rows).select("case_id", "a", "b", F.sha2("sentence", 256).alias("sentence_sha"))


def evidence_diff(spark, sf_dir):
    rows = written(_revisions(spark, sf_dir), "revisions")
    found = cases.diff(rows.where("revision = 1"), rows.where("revision = 2"), F.col("case_id") % 2 == 0)
    return found.select("case_id", "evidence_id", "change")


def current_heads(spark, sf_dir):
    return cases.heads(_revisions(spark, sf_dir), ["case_id", "evidence_id"]).select("case_id", "evidence_id", "revision", "digest")


def revision_gaps(spark, sf_dir):
    """Revisions without their first: those of every 29th document are out of order."""
    rows = _revisions(spark, sf_dir).where("NOT (evidence_id % 29 = 0 AND revision = 1)")
    return cases.revision_gaps(rows, ["case_id", "evidence_id"]).select("evidence_id", "revision")


def stale_bindings(spark, sf_dir):
    """Findings that bind three neighbouring documents at their first revision, against the heads."""
    rows = written(_revisions(spark, sf_dir), "revisions")
    now = cases.heads(rows.where("evidence_id % 17 <> 0"), ["case_id", "evidence_id"])
    bindings = rows.where("revision = 1").withColumn("binding_id", F.floor(F.col("evidence_id") / 3))
    return cases.stale(bindings, now)


def historical_versions(spark, sf_dir):
    rows = written(_revisions(spark, sf_dir), "revisions")
    bindings = rows.where("revision = 1").withColumn("binding_id", F.col("evidence_id")).drop("revision")
    return cases.historical(bindings, rows)


def upserted_heads(spark, sf_dir):
    rows = _revisions(spark, sf_dir)
    out = cases.upsert(rows.where("revision = 1"), rows.where("revision = 2 AND evidence_id % 10 = 0"), ["case_id", "evidence_id"])
    return out.select("case_id", "evidence_id", "revision")


def affected_relations(spark, sf_dir):
    """Relations between neighbouring documents; every fifth was revised."""
    rows = written(_revisions(spark, sf_dir), "revisions")
    changes = cases.diff(rows.where("revision = 1"), rows.where("revision = 2"))
    relations = rows.where("revision = 1").select("case_id", "evidence_id", F.concat(F.lit("r"), F.floor(F.col("evidence_id") / 194)).alias("relation_id"))
    revised = relations.where("cast(substring(relation_id, 2) as int) % 5 = 0").select("case_id", "relation_id").distinct()
    return cases.affected(relations, changes, revised)


def relation_changes(spark, sf_dir):
    """Each document as a relation of its case, in two revisions."""
    rows = _revisions(spark, sf_dir).select("case_id", "revision", "digest", F.concat(F.lit("r"), "evidence_id").alias("relation_id"))
    found = cases.relation_changes(rows.where("revision = 1"), rows.where("revision = 2"))
    return found.select("case_id", "relation_id", "before", "after")


def frame_unions(spark, sf_dir):
    """Orders as videos, and their items as frames."""
    c = F.col
    frames = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("video_id"),
        (c("l_linenumber") * 100_000_000 + c("l_partkey") * 1000 + c("l_suppkey")).cast("long").alias("ms"),
        F.array(F.concat(F.lit("google:"), "l_partkey"), F.concat(F.lit("lens:"), "l_suppkey")).alias("searches"),
        c("l_quantity").cast("long").alias("omitted"),
        F.array(F.concat(F.lit("limit "), "l_returnflag"), F.concat(F.lit("limit "), "l_linestatus")).alias("limitations"),
    )
    found = cases.union_of_frames(frames)
    return found.select("video_id", "first_ms", "n_frames", F.array_join("searches", ",").alias("searches"), "omitted", F.array_join("limitations", ",").alias("limitations"))


def coverage_runs(spark, sf_dir):
    """Orders as runs: their items are sources, and those of the first three lines were read."""
    items = table(spark, sf_dir, "lineitem")
    evidence = items.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "A", "page_quote").otherwise("search_snippet").alias("attribution"))
    outcome = F.when(F.col("l_suppkey") % 3 == 0, "fetch_failed").when(F.col("l_suppkey") % 7 == 0, "binding_rejected").otherwise("quoted")
    return cases.coverage_measures(evidence, items.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("run_id"), outcome.alias("outcome")))


def topic_audits(spark, sf_dir):
    """Orders as topic runs and their items as searches; some were unavailable, and some report a lead more than they have."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("run_id"),
        F.when(c("l_partkey") % 13 == 0, "unavailable").otherwise("succeeded").alias("outcome"),
        F.when(c("l_partkey") % 26 == 0, 0).otherwise(c("l_quantity").cast("int")).alias("returned"),
        c("l_linenumber"), c("l_partkey"), c("l_suppkey"),
    )
    up = c("outcome") == "succeeded"
    rows = rows.withColumn("dropped", F.when(up, c("returned") % 3)).withColumn("normalized", c("returned") - c("dropped"))
    rows = rows.withColumn("duplicate", c("normalized") % 2).withColumn("unique", F.coalesce(c("normalized") - c("duplicate"), F.lit(0)))
    rows = rows.withColumn("withheld", F.least(c("unique"), (c("l_partkey") % 2).cast("int"))).withColumn("safe", c("unique") - c("withheld"))
    rows = rows.withColumn("kept", F.least(c("safe"), c("l_linenumber") % 3)).withColumn("not_kept", c("safe") - c("kept"))
    rows = rows.withColumns({
        "captured": c("safe"), "uncaptured": F.lit(0), "kept_captured": c("kept"), "limit": F.lit(48),
        "retained": c("kept") + F.when(c("l_suppkey") % 17 == 0, 1).otherwise(0),
    })
    return cases.candidate_audit(rows)


def recognized_segments(spark, sf_dir):
    """Turns as recognised segments; a word's probability is from its length."""
    tokens = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), ((F.length(w) % 9) / 8).alias("p")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text_fn.recognition(tokens).alias("recognition"))


def capped_attributes(spark, sf_dir):
    """Texts as descriptions, and their words as names."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text_fn.capped(text), 256).alias("value_sha"), F.array_join(text_fn.capped_names(F.split(text, " ")), "|").alias("names")
    )


def sticky_warnings(spark, sf_dir):
    """Three revisions of each document: changed in the second for every tenth, revised in the third for every 20th."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % CASES).alias("case_id"), F.col("doc_id").alias("evidence_id"))
    rows = docs.withColumn("revision", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = rows.withColumn("changed", (F.col("revision") == 2) & (F.col("evidence_id") % 10 == 0))
    rows = rows.withColumn("revised", (F.col("revision") == 3) & (F.col("evidence_id") % 20 == 0))
    return cases.sticky(rows).select("case_id", "evidence_id", "revision", "flagged")


def integrity_violations(spark, sf_dir):
    """Labels without a document, documents that cite a page that is not there, and pages that cite a benchmark item that is not."""
    docs, pages_ = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ref"))
    cited = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ref"))
    items = pages_.select(F.col("page_id").alias("id"), F.col("page_id").alias("ref"))
    found = cases.missing_references(labels, "ref", docs, "doc_id", "label_to_document")
    found = found.unionByName(cases.missing_references(cited, "ref", pages_, "page_id", "citation_to_page"))
    return found.unionByName(cases.missing_references(items, "ref", table(spark, sf_dir, "benchmark"), "item_id", "page_to_item"))


def repeated_items(spark, sf_dir):
    return cases.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _case_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """Documents as cases of a claim, an asset, two items of evidence, two occurrences, a relation and a read, some of them unsound."""
    n, c = F.col("n"), F.col
    rows = table(spark, sf_dir, "documents").select(c("doc_id").alias("n"), c("doc_id").alias("case_id"), "text")
    pick = lambda m, r, odd, sound: F.when(n % m == r, odd).otherwise(sound)
    none = F.lit(None).cast("string")
    said = rows.select(
        "case_id", F.lit("e1").alias("id"), pick(31, 0, "ftp://a.org/x", "https://a.org/x").alias("source_url"), none.alias("title"),
        F.lit("text").alias("content"), "text", F.lit("page_quote").alias("attribution"), none.alias("asset_id"), none.alias("span_kind"),
        F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("duration_ms"), pick(23, 0, "guessed", "observed").alias("date_status"),
        pick(7, 0, "2023-02-29", "2024-02-29").alias("date_value"), F.lit("day").alias("date_precision"), F.lit("page_meta").alias("date_source"),
        pick(11, 0, none, F.lit("https://a.org/x")).alias("date_url"), none.alias("date_rationale"), F.lit("retrieval").alias("method"),
        F.lit("unknown").alias("rights"), F.lit("reference_only").alias("retention"), pick(13, 0, "sha256:0", none).alias("content_hash"),
        F.lit("2024-03-01T10:00:00Z").alias("retrieved_at"),
    )
    seen = said.withColumns({
        "id": F.lit("e2"), "content": F.lit("media"), "asset_id": F.when(c("case_id") % 17 == 0, "m9").otherwise("m1"), "span_kind": F.lit("time"),
        "start_ms": F.lit(5).cast("long"), "duration_ms": F.when(c("case_id") % 19 == 0, 50).otherwise(5).cast("long"),
    })
    assessed = [F.lit("observed").alias("assessed"), F.array(pick(29, 0, "e9", "e1")).alias("evidence_ids"), none.alias("rationale")]
    occurrences = rows.select(
        "case_id", F.explode(F.array(F.lit("o1"), F.lit("o2"))).alias("id"), F.lit("m1").alias("asset_id"), F.lit("e2").alias("evidence_id"),
        F.lit("whole").alias("span_kind"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("duration_ms"),
        F.lit("unknown").alias("assessed"), F.lit(None).cast("array<string>").alias("evidence_ids"), none.alias("rationale"),
    )
    return {
        "claims": rows.select("case_id", F.lit("c1").alias("id"), F.lit("a claim").alias("text"), none.alias("language")),
        "assets": rows.select("case_id", F.lit("m1").alias("id"), F.lit("video").alias("kind"), none.alias("url"), F.lit(10).cast("long").alias("duration_ms")),
        "evidence": said.unionByName(seen),
        "occurrences": occurrences,
        "relations": rows.select(
            "case_id", F.lit("r1").alias("id"), F.lit("occurrence_occurrence").alias("kind"), F.lit("o1").alias("left_id"), pick(5, 0, "o1", "o2").alias("right_id"),
            pick(3, 0, "similar_media", "repost").alias("relationship"), *assessed,
        ),
        "reads": rows.select(
            "case_id", F.lit("e1").alias("id"), F.lit("https://a.org/x").alias("requested_url"), pick(37, 0, none, F.lit("https://a.org/x")).alias("final_url"),
            pick(41, 0, "different_resource", "same_resource").alias("binding"), F.lit("page_quote").alias("outcome"), none.alias("reference_text"), none.alias("reference_support"),
        ),
    }


def case_validation(spark, sf_dir):
    return validation.validate(_case_tables(spark, sf_dir))


def case_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    rules = {
        "text_bounds": F.length("text").between(1, 20_000),
        "language": F.col("lang").isin("en", "fr", "de"),
        "length_matches": F.col("n_chars") == F.length("text"),
        "source_form": F.col("source").rlike(r"^src\d$"),
    }
    return cases.violations(rows, rules)


def watchlist_matches(spark, sf_dir):
    """Texts as evidence, on lists of hosts with phrases of the invented languages."""
    hay = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    evidence = _documents(spark, sf_dir).select("evidence_id", "host", hay.alias("hay"), F.lit("public_reference").alias("rights"))
    return cases.watchlist_matches(evidence, _lists(spark))


def _lists(spark) -> DataFrame:
    rows = [("w1", "src0", "that the"), ("w1", "src1", "that the"), ("w2", "src5", "de la"), ("w3", "src3", "der die"), ("w3", "src3", "")]
    return spark.createDataFrame(rows, "watch_id string, host string, phrase string")


def change_notices(spark, sf_dir):
    rows = written(_revisions(spark, sf_dir), "revisions")
    changes = cases.diff(rows.where("revision = 1"), rows.where("revision = 2"))
    found = cases.notices(watchlist_matches(spark, sf_dir), changes, F.lit(2))
    return found.select("watch_id", "case_id", "n_changes")


def word_counts(spark, sf_dir):
    """Sizes of the five tokenizers' word sets of each text."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(text_fn.page_words(t)).alias("page"),
        F.size(text_fn.topic_words(t)).alias("topic"),
        F.size(text_fn.passage_words(t)).alias("passage"),
        F.size(text_fn.family_words(t)).alias("family"),
        F.size(text_fn.dossier_words(t)).alias("dossier"),
        F.size(text_fn.shingles(t)).alias("shingles"),
    )


def extracted_pages(spark, sf_dir):
    """Title, number of paragraphs and their digest of each page."""
    found = pages.pages(table(spark, sf_dir, "pages"))
    joined = F.array_join("paragraphs", "\n")
    return found.select("page_id", "title", F.size("paragraphs").alias("n_paragraphs"), F.sha2(joined, 256).alias("paragraphs_sha"), F.size("links").alias("n_links"))


def claim_disagreements(spark, sf_dir):
    return citations.disagreements(_relations(spark, sf_dir).select("case_id", "evidence_id", "relation"))


def claim_accounts(spark, sf_dir):
    return citations.account(_relations(spark, sf_dir))


def _relations(spark, sf_dir) -> DataFrame:
    """Orders' items as assessed sources of the case of their part."""
    d, t = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("case_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"),
        (100 - 5 * d).alias("relevance"),
        (12 * t).alias("supports"),
        (100 - 12 * t).alias("challenges"),
        (10 * d).alias("context"),
        (100 - d).alias("entity_property"),
        (100 - 2 * d).alias("time"),
        (100 - t).alias("variant"),
        F.when(F.col("l_returnflag") == "A", "page_quote").otherwise("search_snippet").alias("attribution"),
        F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("quote "), F.col("l_suppkey"))).alias("quote"),
        F.when(F.col("l_suppkey") % 7 != 0, "quote 1").alias("claim"),
        (F.col("l_quantity") % 5 != 0).alias("verified"),
    )
    return citations.claim_relation(rows)


def claim_reasons(spark, sf_dir):
    """How often each reason goes with each relation."""
    rows = _relations(spark, sf_dir).select("relation", F.explode("reasons").alias("reason"))
    return rows.groupBy("relation", "reason").agg(F.count(F.lit(1)).alias("n"))


def claim_relations(spark, sf_dir):
    return _relations(spark, sf_dir).groupBy("case_id", "relation").agg(F.count(F.lit(1)).alias("n"))


RELATIONS = """
src_v AS (SELECT *, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS t, l_suppkey % 9 <> 0 AS quoted, l_suppkey % 7 <> 0 AS claimed,
    l_quantity % 5 <> 0 AS verified FROM lineitem),
fit_v AS (SELECT *, verified AND least(100 - d, 100 - 2 * d, 100 - t) >= 85 AS compatible, quoted AND l_returnflag = 'A' AS page,
    quoted AND verified AND 100 - 5 * d >= 50 AS base FROM src_v),
rel_v AS (SELECT l_partkey AS case_id, l_orderkey * 10 + l_linenumber AS evidence_id, l_returnflag = 'A' AS read,
    CASE WHEN base AND page AND claimed AND compatible AND l_suppkey <> 1 AND 12 * t >= 85 THEN 'support'
         WHEN base AND page AND claimed AND compatible AND l_suppkey <> 1 AND 100 - 12 * t >= 85 THEN 'challenge'
         WHEN base AND greatest(10 * d, 12 * t, 100 - 12 * t) >= 85 THEN 'context' ELSE 'insufficient' END AS relation,
    list_filter([CASE WHEN verified AND 100 - 5 * d < 50 THEN 'low_relevance' END, CASE WHEN NOT claimed THEN 'no_claim' END,
      CASE WHEN NOT page THEN 'not_page_quote' END, CASE WHEN NOT verified THEN 'unassessed' END,
      CASE WHEN claimed AND NOT compatible THEN 'scope_withheld' END, 'no_verdict'], lambda x: x IS NOT NULL) AS reasons FROM fit_v)
"""

SHINGLES = r"""
long_v AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w
  FROM documents WHERE length(text) >= 400),
gram_v AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] for i in range(1, len(w) - 3)]) AS g
  FROM long_v WHERE len(w) >= 5),
class_v AS (SELECT *, min(doc_id) OVER (PARTITION BY list_sort(g)) AS rep FROM gram_v),
one_v AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM class_v WHERE doc_id = rep),
sim_v AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS "union"
  FROM one_v a JOIN one_v b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING count(*) * 100 >= (any_value(a.n) + any_value(b.n) - count(*)) * 60)
"""

_STOPS = {
    "page": text_fn.PAGE_STOP, "topic": text_fn.TOPIC_STOP, "passage": text_fn.PASSAGE_STOP,
    "family": text_fn.FAMILY_STOP, "dossier": text_fn.DOSSIER_STOP,
}
_IN = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in _STOPS.items()}
_PLAIN = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_LETTER = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_FAMILY = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3 AND NOT list_contains({_IN['family']}, x)))"
_DOSSIER = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 AND NOT list_contains({_IN['dossier']}, x)))"

QUERIES = {
    f.__name__: f
    for f in (
        canonical_urls, source_keys, audit_urls, safe_references, redirect_bindings, merged_pages, citation_checks, shared_citations,
        duplicate_passages, url_mentions, near_duplicate_texts, duplicate_groups, statement_appearances, statement_families,
        statement_connections, near_vector_hashes, relation_changes, frame_unions, coverage_runs, topic_audits, recognized_segments,
        capped_attributes, case_validation,
        contained_sentences, evidence_diff, current_heads, revision_gaps, stale_bindings, historical_versions, upserted_heads,
        affected_relations, sticky_warnings, integrity_violations, repeated_items, case_violations, watchlist_matches, change_notices,
        word_counts, extracted_pages, claim_disagreements, claim_accounts, claim_relations, claim_reasons,
    )
}

_CANONICAL = """
parts_v AS (SELECT page_id, url, lower(regexp_extract(url, '^(\\w+)://', 1)) AS scheme,
    regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages),
canon_v AS (SELECT page_id, url, host, scheme || '://' || host ||
    CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END ||
    CASE WHEN k = '' THEN '' ELSE '?' || k END AS canonical
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))), '&') AS k
        FROM parts_v))
"""

ORACLE_SQL = {
    "canonical_urls": f"WITH {_CANONICAL} SELECT page_id, canonical, host FROM canon_v",
    "source_keys": "SELECT page_id, regexp_replace(url, '#.*$', '') AS source_key FROM pages",
    "audit_urls": "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS audit_url FROM pages",
    "safe_references": "SELECT page_id, page_id % 6 IN (0, 5) AS safe FROM pages",
    "redirect_bindings": """SELECT page_id, CASE WHEN page_id % 35 = 0 THEN 'not_established' WHEN page_id % 6 = 0 THEN 'same_resource'
        WHEN page_id % 6 = 1 THEN CASE WHEN url LIKE 'https:%' THEN 'same_resource' ELSE 'normalized_resource' END
        WHEN page_id % 6 = 2 THEN 'normalized_resource'
        WHEN page_id % 6 = 3 THEN CASE WHEN url LIKE 'http:%' THEN 'same_resource' ELSE 'different_resource' END
        WHEN page_id % 6 = 4 THEN 'different_resource' ELSE 'blocked_destination' END AS binding FROM pages""",
    "merged_pages": f"WITH {_CANONICAL} SELECT canonical, min(page_id) AS first_page, count(*) AS n FROM canon_v GROUP BY canonical",
    "citation_checks": f"""WITH {CITATIONS}, r AS (SELECT c.*, t.page_id AS target_id, t.html AS text,
          coalesce(start, instr(t.html, quote) - 1) AS pos FROM cite_v c LEFT JOIN key_v t ON c.case_id = t.case_id AND c.key = t.key),
        x AS (SELECT *, CASE WHEN quote IS NULL OR text IS NULL THEN 'unknown' WHEN pos >= 0 AND substr(text, pos + 1, length(quote)) = quote THEN 'exact_match'
          WHEN start IS NULL THEN 'not_found_in_retained_passage' ELSE 'offset_mismatch' END AS result FROM r)
        SELECT case_id, citation_id, target_id, result, CASE WHEN result = 'exact_match' THEN pos END AS matched_start FROM x""",
    "shared_citations": f"""WITH {CITATIONS} SELECT case_id, key AS target_key, count(DISTINCT from_id) AS n_evidence, count(*) AS n_citations,
          min(from_id) AS first_id, max(from_id) AS last_id FROM cite_v GROUP BY case_id, key HAVING count(DISTINCT from_id) >= 2""",
    "duplicate_passages": f"""WITH {REVISIONS} SELECT case_id, sha256(text) AS passage_sha, count(*) AS n, min(evidence_id) AS first_id
        FROM doc_v GROUP BY case_id, text HAVING count(*) > 1""",
    "url_mentions": """WITH p AS (SELECT page_id % 7 AS case_id, page_id, url FROM pages)
        SELECT DISTINCT a.case_id, a.page_id AS from_id, c.page_id AS to_id FROM p a JOIN p c ON a.case_id = c.case_id AND a.page_id <> c.page_id
        LEFT JOIN p b ON b.page_id = a.page_id + 7 WHERE c.url = a.url OR c.url = b.url""",
    "near_duplicate_texts": f"WITH {SHINGLES} SELECT * FROM sim_v",
    "duplicate_groups": f"""WITH RECURSIVE {SHINGLES}, e AS (SELECT a, b FROM sim_v UNION SELECT b, a FROM sim_v),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM class_v WHERE doc_id = rep UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a),
        g AS (SELECT x AS rep, min(y) AS group_id FROM reach GROUP BY x), m AS (SELECT doc_id AS id, group_id FROM class_v JOIN g USING (rep))
        SELECT id, group_id FROM m WHERE group_id IN (SELECT group_id FROM m GROUP BY group_id HAVING count(*) > 1)""",
    "statement_appearances": f"""WITH {STATEMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY url, text ORDER BY id) AS r FROM st_v)
        SELECT url, sha256(text) AS text_sha, min(id) AS id, count(*) AS n, CAST(count(DISTINCT case_id) FILTER (r <= 20) AS INT) AS n_cases
        FROM n GROUP BY url, text""",
    "statement_families": f"""WITH {STATEMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY url, text ORDER BY id) AS r FROM st_v),
        a AS (SELECT url, text, min(id) AS id, list(DISTINCT case_id) FILTER (r <= 20) AS cases, {_FAMILY} AS g FROM n GROUP BY url, text),
        c AS (SELECT *, min(id) OVER (PARTITION BY url, list_sort(g)) AS rep FROM a WHERE len(g) > 0),
        o AS (SELECT id, len(g) AS k, unnest(g) AS s FROM c WHERE id = rep),
        p AS (SELECT x.id AS a, y.id AS b FROM o x JOIN o y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id
          HAVING count(*) >= 6 AND count(*) * 100 >= (any_value(x.k) + any_value(y.k) - count(*)) * 40
          UNION SELECT l, id FROM (SELECT id, min(id) OVER (PARTITION BY text) AS l FROM a) WHERE l <> id)
        SELECT p.a, p.b, CASE WHEN x.url = y.url THEN 'same_source_variant' WHEN x.text = y.text THEN 'same_retained_wording' ELSE 'plausible_connection' END AS status
        FROM p JOIN a x ON p.a = x.id JOIN a y ON p.b = y.id WHERE x.url <> y.url OR NOT list_has_any(x.cases, y.cases)""",
    "statement_connections": f"""WITH {STATEMENTS}, w AS (SELECT *, {_DOSSIER} AS g FROM st_v),
        p AS (SELECT x.case_id, x.id AS a, y.id AS b, x.text = y.text AS same, len(list_intersect(x.g, y.g)) AS common, len(x.g) + len(y.g) AS both_
          FROM w x JOIN w y ON x.case_id = y.case_id AND x.id < y.id AND x.evidence_id <> y.evidence_id AND x.url <> y.url),
        r AS (SELECT case_id, a, b, CASE WHEN same THEN 'same_retained_wording' ELSE 'plausible_connection' END AS status,
          row_number() OVER (PARTITION BY case_id ORDER BY a, b) AS place FROM p WHERE same OR common >= 4 AND common * 100 >= (both_ - common) * 40)
        SELECT case_id, a, b, status, CAST(place AS INT) AS place FROM r WHERE place <= 12""",
    "case_validation": r"""WITH d AS (SELECT doc_id AS n, coalesce(regexp_matches(text, '[^ ]') AND length(text) <= 20000, false) AS fine FROM documents),
        v(path, id, rule, m) AS (VALUES ('evidence', 'e1', 'source_url', 31), ('evidence', 'e2', 'source_url', 31), ('evidence', 'e1', 'date_status', 23),
          ('evidence', 'e2', 'date_status', 23), ('evidence', 'e1', 'content_hash', 13), ('evidence', 'e2', 'content_hash', 13),
          ('evidence', 'e2', 'evidence_asset', 17), ('relations', 'r1', 'assessment_evidence', 29), ('relations', 'r1', 'no_self_relation', 5),
          ('relations', 'r1', 'similarity_is_inferred', 3), ('reads', 'e1', 'extracted_read_is_bound', 41))
        SELECT n AS case_id, path, id, rule FROM d JOIN v ON n % m = 0
        UNION ALL SELECT n, 'evidence', e, 'date_form' FROM d, (VALUES ('e1'), ('e2')) x(e) WHERE n % 7 = 0 AND n % 23 <> 0
        UNION ALL SELECT n, 'evidence', e, 'date_source_has_a_url' FROM d, (VALUES ('e1'), ('e2')) x(e) WHERE n % 11 = 0 AND n % 23 <> 0
        UNION ALL SELECT n, 'evidence', 'e2', 'span_beyond_media' FROM d WHERE n % 19 = 0 AND n % 17 <> 0
        UNION ALL SELECT n, 'reads', 'e1', 'bound_read_has_a_final_url' FROM d WHERE n % 37 = 0 AND n % 41 <> 0
        UNION ALL SELECT n, 'evidence', 'e1', 'text' FROM d WHERE NOT fine""",
    "relation_changes": f"""WITH {REVISIONS} SELECT coalesce(a.case_id, b.case_id) AS case_id, 'r' || coalesce(a.evidence_id, b.evidence_id) AS relation_id,
          a.digest AS before, b.digest AS after FROM (SELECT * FROM rev_v WHERE revision = 1) a FULL JOIN (SELECT * FROM rev_v WHERE revision = 2) b
          ON a.evidence_id = b.evidence_id WHERE a.digest IS DISTINCT FROM b.digest""",
    "frame_unions": """WITH f AS (SELECT l_orderkey AS v, CAST(l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS BIGINT) AS ms, l_quantity AS q,
          'google:' || l_partkey || ',lens:' || l_suppkey AS s, 'limit ' || l_returnflag AS a, 'limit ' || l_linestatus AS b FROM lineitem)
        SELECT v AS video_id, min(ms) AS first_ms, count(*) AS n_frames, string_agg(s, ',' ORDER BY ms) AS searches, CAST(sum(CAST(q AS BIGINT)) AS BIGINT) AS omitted,
          array_to_string(list_sort(list_distinct(list_concat(list(a), list(b)))), ',') AS limitations FROM f GROUP BY v""",
    "coverage_runs": """SELECT l_orderkey AS run_id, count(*) AS n_sources, count(*) FILTER (l_returnflag = 'A') AS n_quotes,
          count(*) FILTER (l_linenumber <= 3) AS n_reads, count(*) FILTER (l_linenumber <= 3 AND (l_suppkey % 3 = 0 OR l_suppkey % 7 = 0)) AS n_failures
        FROM lineitem GROUP BY l_orderkey""",
    "topic_audits": """WITH a AS (SELECT l_orderkey AS run_id, l_partkey % 13 <> 0 AS up, CASE WHEN l_partkey % 26 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS returned,
          l_linenumber % 3 AS most, l_partkey % 2 AS hidden, CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END AS extra FROM lineitem),
        b AS (SELECT *, CASE WHEN up THEN (returned - returned % 3) - (returned - returned % 3) % 2 ELSE 0 END AS uniq FROM a),
        c AS (SELECT *, uniq - least(uniq, hidden) AS safe FROM b),
        d AS (SELECT *, least(safe, most) AS kept FROM c),
        s AS (SELECT run_id, bool_or(NOT up AND (returned <> 0 OR kept + extra <> 0)) AS r1, bool_or(up AND extra > 0) AS r2, sum(safe) > 48 AS r3, sum(extra) > 0 AS r4
          FROM d GROUP BY run_id)
        SELECT run_id, unnest(list_filter([CASE WHEN r1 THEN 'unavailable_is_empty' END, CASE WHEN r2 THEN 'retained_rows_are_captured' END,
          CASE WHEN r3 THEN 'captured_up_to_the_limit' END, CASE WHEN r4 THEN 'kept_is_retained' END], lambda x: x IS NOT NULL)) AS rule FROM s""",
    "recognized_segments": """SELECT conv_id, turn, role, CASE WHEN list_avg([(length(w) % 9) / 8.0 for w in string_split(text, ' ')]) >= 0.6 THEN 'unreviewed'
        ELSE 'low_confidence' END AS recognition FROM conversations""",
    "capped_attributes": """SELECT doc_id, sha256(left(nullif(trim(text, ' '), ''), 400)) AS value_sha,
        array_to_string(list_filter([left(trim(w, ' '), 400) for w in string_split(text, ' ')], lambda x: x <> '')[1:8], '|') AS names FROM documents""",
    "near_vector_hashes": """WITH h AS (SELECT min(vec_id) AS id, s FROM (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding] AS s
          FROM embeddings) GROUP BY s), p AS (SELECT a.id AS a, b.id AS b,
          list_sum([CASE WHEN a.s[i] <> b.s[i] THEN 1 ELSE 0 END for i in range(1, 65)]) AS distance FROM h a JOIN h b ON a.id < b.id)
        SELECT a, b, CAST(distance AS INT) AS distance FROM p WHERE distance <= 8""",
    "contained_sentences": f"""WITH {REVISIONS}, s AS (SELECT case_id, evidence_id AS a, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]?')) AS raw,
          generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), 1) AS n FROM doc_v),
        h AS (SELECT s.case_id, a, b.evidence_id AS b, trim(raw) AS sentence, n FROM s JOIN doc_v b ON s.case_id = b.case_id AND a <> b.evidence_id
          AND length(trim(raw)) >= 80 AND contains(b.text, trim(raw)))
        SELECT case_id, a, b, sha256(arg_min(sentence, n)) AS sentence_sha FROM h GROUP BY case_id, a, b""",
    "evidence_diff": f"""WITH {REVISIONS}, x AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.evidence_id, b.evidence_id) AS evidence_id,
          a.digest AS o, b.digest AS n FROM (SELECT * FROM rev_v WHERE revision = 1) a FULL JOIN (SELECT * FROM rev_v WHERE revision = 2) b
          ON a.case_id = b.case_id AND a.evidence_id = b.evidence_id)
        SELECT case_id, evidence_id, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN CASE WHEN case_id % 2 = 0 THEN 'removed' ELSE 'unconfirmed_removal' END
          ELSE 'changed' END AS change FROM x WHERE o IS DISTINCT FROM n""",
    "current_heads": f"""WITH {REVISIONS} SELECT case_id, evidence_id, max(revision) AS revision, arg_max(digest, revision) AS digest
        FROM rev_v GROUP BY case_id, evidence_id""",
    "revision_gaps": f"WITH {REVISIONS} SELECT evidence_id, revision FROM rev_v WHERE evidence_id % 29 = 0 AND revision = 2",
    "stale_bindings": f"""WITH {REVISIONS}, h AS (SELECT evidence_id, arg_max(digest, revision) AS digest FROM rev_v WHERE evidence_id % 17 <> 0 GROUP BY evidence_id)
        SELECT evidence_id // 3 AS binding_id, NOT bool_and(r.digest IS NOT DISTINCT FROM h.digest) AS stale, bool_or(h.digest IS NULL) AS missing
        FROM rev_v r LEFT JOIN h USING (evidence_id) WHERE revision = 1 GROUP BY evidence_id // 3""",
    "historical_versions": f"""WITH {REVISIONS} SELECT a.evidence_id AS binding_id, a.evidence_id, max(b.revision) AS revision FROM rev_v a JOIN rev_v b
        ON a.evidence_id = b.evidence_id AND a.digest = b.digest WHERE a.revision = 1 GROUP BY a.evidence_id""",
    "upserted_heads": f"""WITH {REVISIONS} SELECT case_id, evidence_id, CASE WHEN evidence_id % 10 = 0 AND evidence_id % 17 <> 0 THEN 2 ELSE 1 END AS revision
        FROM doc_v""",
    "affected_relations": f"""WITH {REVISIONS} SELECT DISTINCT case_id, 'r' || (evidence_id // 194) AS relation_id FROM doc_v
        WHERE (evidence_id % 10 = 0 OR evidence_id % 17 = 0 OR evidence_id % 23 = 0) AND (evidence_id // 194) % 5 <> 0""",
    "sticky_warnings": f"""SELECT doc_id % {CASES} AS case_id, doc_id AS evidence_id, r AS revision,
          r >= 2 AND doc_id % 10 = 0 AND NOT (r = 3 AND doc_id % 20 = 0) AS flagged FROM documents, (VALUES (1), (2), (3)) v(r)""",
    "integrity_violations": """SELECT doc_id AS id, 'label_to_document' AS rule FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT doc_id, 'citation_to_page' FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)
        UNION ALL SELECT page_id, 'page_to_item' FROM pages WHERE page_id NOT IN (SELECT item_id FROM benchmark)""",
    "repeated_items": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "case_violations": """SELECT doc_id AS id, 'text_bounds' AS rule FROM documents WHERE NOT coalesce(length(text) BETWEEN 1 AND 20000, false)
        UNION ALL SELECT doc_id, 'language' FROM documents WHERE NOT coalesce(lang IN ('en', 'fr', 'de'), false)
        UNION ALL SELECT doc_id, 'length_matches' FROM documents WHERE NOT coalesce(n_chars = length(text), false)
        UNION ALL SELECT doc_id, 'source_form' FROM documents WHERE NOT coalesce(regexp_full_match(source, 'src\\d'), false)""",
    "watchlist_matches": r"""WITH l AS (SELECT * FROM (VALUES ('w1', 'src0', 'that the'), ('w1', 'src1', 'that the'), ('w2', 'src5', 'de la'), ('w3', 'src3', 'der die'))
          v(watch_id, host, phrase)), e AS (SELECT doc_id, source, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS hay FROM documents)
        SELECT DISTINCT watch_id, doc_id AS evidence_id FROM e JOIN l ON source = host AND contains(hay, ' ' || phrase || ' ')""",
    "change_notices": r"""WITH l AS (SELECT * FROM (VALUES ('w1', 'src0', 'that the'), ('w1', 'src1', 'that the'), ('w2', 'src5', 'de la'), ('w3', 'src3', 'der die'))
          v(watch_id, host, phrase)), e AS (SELECT doc_id, source, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS hay FROM documents)
        SELECT watch_id, doc_id % 97 AS case_id, count(*) AS n_changes FROM e JOIN l ON source = host AND contains(hay, ' ' || phrase || ' ')
        WHERE doc_id % 10 = 0 OR doc_id % 17 = 0 OR doc_id % 23 = 0 GROUP BY watch_id, doc_id % 97""",
    "word_counts": f"""SELECT doc_id, len(list_distinct(list_filter({_PLAIN}, lambda x: length(x) > 2 AND NOT list_contains({_IN['page']}, x)))) AS page,
          len(list_distinct([left(x, 6) for x in list_filter({_LETTER}, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '\\d+') AND NOT list_contains({_IN['topic']}, x))])) AS topic,
          len(list_distinct(list_filter({_LETTER}, lambda x: NOT list_contains({_IN['passage']}, x) AND (length(x) >= 3 OR regexp_full_match(x, '\\d+'))))) AS passage,
          len(list_distinct(list_filter({_LETTER}, lambda x: length(x) > 3 AND NOT list_contains({_IN['family']}, x)))) AS family,
          len(list_distinct(list_filter({_LETTER}, lambda x: length(x) >= 3 AND NOT list_contains({_IN['dossier']}, x)))) AS dossier,
          CASE WHEN len({_PLAIN}) < 5 THEN 0 ELSE len(list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]
            for i in range(1, len(w) - 3)])) END AS shingles FROM (SELECT *, {_PLAIN} AS w FROM documents)""",
    "claim_disagreements": f"""WITH {RELATIONS} SELECT a.case_id, a.evidence_id AS support_id, b.evidence_id AS challenge_id FROM rel_v a JOIN rel_v b
        ON a.case_id = b.case_id AND a.relation = 'support' AND b.relation = 'challenge'""",
    "claim_accounts": f"""WITH {RELATIONS}, n AS (SELECT case_id, count(*) FILTER (relation = 'support') AS n_support,
          count(*) FILTER (relation = 'challenge') AS n_challenge, count(*) FILTER (read) AS n_read, count(*) FILTER (NOT read) AS n_leads FROM rel_v GROUP BY case_id)
        SELECT *, CASE WHEN n_support > 0 AND n_challenge > 0 THEN 'The retained excerpts disagree.' WHEN n_challenge > 0 THEN 'There is evidence against this claim.'
          WHEN n_support > 0 THEN 'There is evidence supporting this claim.' ELSE 'The claim is still unresolved.' END AS headline FROM n""",
    "claim_reasons": f"WITH {RELATIONS}, r AS (SELECT relation, unnest(reasons) AS reason FROM rel_v) SELECT relation, reason, count(*) AS n FROM r GROUP BY ALL",
    "claim_relations": f"WITH {RELATIONS} SELECT case_id, relation, count(*) AS n FROM rel_v GROUP BY case_id, relation",
}
