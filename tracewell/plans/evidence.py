"""Queries on identities, distributions, anchors and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.watches import distinct_frames
from .views import CANDIDATES, candidates, table


def media_relationships(spark, sf_dir):
    """Identity of each candidate from its kind, with its rank as hash distance and its origin as verification."""
    verified = F.col("origin_status") != "unresolved"
    found = evidence.media_relationship(F.col("kind") == "lens_exact", F.col("position"), verified)
    return candidates(spark, sf_dir).select("inv", "cand_id", found.alias("found"))


def identity_recheck(spark, sf_dir):
    """Relationships after a merge: an exact one needs an exact retrieval, a near one its verification."""
    kept = evidence.recheck_identity(F.col("relationship"), F.array("kind"), F.col("origin_status") != "unresolved")
    return candidates(spark, sf_dir).select("inv", "cand_id", kept.alias("kept"))


def distribution_checks(spark, sf_dir):
    """Discount, tax and their rest as a distribution whose stated winner is the rest or the tax."""
    d, t = F.col("l_discount"), F.col("l_tax")
    p = F.create_map(F.lit("discount"), d, F.lit("tax"), t, F.lit("rest"), 1 - d - t)
    winner = F.when(F.col("l_linenumber") % 2 == 0, "rest").otherwise("tax")
    fine = evidence.valid_distribution(p, winner, ("discount", "tax", "rest"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2 == 0).alias("even"), fine.alias("valid"))
    return rows.groupBy("even", "valid").agg(F.count(F.lit(1)).alias("n"))


def text_anchors(spark, sf_dir):
    """Each text but its first nine characters as a quote, anchored where it is or one place later by turns."""
    start = F.lit(9) + (F.col("doc_id") % 2).cast("int")
    quote = F.substring(F.col("text"), F.lit(10), F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.anchor_holds(F.col("text"), start, quote).alias("holds"))


def read_audit(spark, sf_dir):
    """Items of an order as an audit of read selections, of which a third were not selected."""
    c, fact = F.col, F.round(F.col("l_tax") * 100).cast("int")
    roles = F.array(*[F.lit(r) for r in (*evidence.ROLES, "other")])
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("inv"),
        (c("l_partkey") % 40).alias("evidence_id"),
        F.when(c("l_suppkey") % 3 != 0, F.when(c("l_partkey") % 5 == 0, c("l_linenumber") + 1).otherwise(c("l_linenumber"))).cast("int").alias("place"),
        F.when(c("l_suppkey") % 3 != 0, F.element_at(roles, (c("l_partkey") % 9 + 1).cast("int"))).alias("role"),
        (c("l_quantity") % 5 != 0).alias("judged"), fact.alias("fact_check"), (c("l_partkey") % 6 == 0).alias("winner"), (c("l_orderkey") % 4).alias("withheld"),
    )
    return evidence.read_selection_violations(rows, 5)


def link_frontier(spark, sf_dir):
    """Line items of the sixth line as links on pages of their investigation, the others as its pool."""
    rows, c = candidates(spark, sf_dir), F.col
    links = rows.where("kind = 'source_link'").select(
        "inv", F.when(c("position") % 17 != 0, c("url")).alias("url"), "relevance", F.concat(F.lit("https://p"), c("position") % 5).alias("parent"),
        c("cand_id").alias("at"), (c("position") % 13 == 0).alias("late"),
    )
    pool = rows.where("kind <> 'source_link'").select(
        "inv", "url", "kind", (c("relevance") >= 80).alias("classified"), ((c("kind") == "lens_exact") & (c("position") % 2 == 0)).alias("read")
    )
    return evidence.follow_links(links, pool)


#: A few public suffixes of every kind; users pass the whole list as a table.
SUFFIXES = (
    ("com", "plain"), ("net", "plain"), ("org", "plain"), ("uk", "plain"), ("co.uk", "plain"), ("jp", "plain"),
    ("kawasaki.jp", "wildcard"), ("city.kawasaki.jp", "exception"), ("ck", "wildcard"), ("www.ck", "exception"),
)
ENDINGS = ("example.com", "example.co.uk", "example.kawasaki.jp", "city.kawasaki.jp", "www.ck", "foo.ck", "example.zz")


def registrable_domains(spark, sf_dir):
    """Pages by the registrable domain of their host, whose ending is exchanged by turns for one of another kind."""
    host, ending = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace(host, r"example\.[a-z]+$", ""), ending).alias("host"))
    found = evidence.registrable_domain(rows, F.broadcast(spark.createDataFrame(SUFFIXES, "suffix string, kind string")))
    return rows.join(found, "host").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("hosts"))


def place_spans(spark, sf_dir):
    """Names of two word lists after a preposition, in whole texts."""
    lexicon = spark.createDataFrame([("the",), ("the the",), ("was",), ("of the",)], "place string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.coalesce("text", F.lit("")).alias("text"))
    return evidence.place_spans(docs, lexicon, 2)


def frame_totals(spark, sf_dir):
    """Distinct and repeated contents of each document source, by whole text."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("media_id"), F.sha2("text", 256).alias("hash"))
    return distinct_frames(rows)


QUERIES = {
    f.__name__: f
    for f in (media_relationships, identity_recheck, distribution_checks, text_anchors, read_audit, link_frontier, registrable_domains, place_spans, frame_totals)
}

ORACLE_SQL = {
    "media_relationships": f"""WITH {CANDIDATES} SELECT inv, cand_id, CASE WHEN kind = 'lens_exact' THEN 'EXACT_MATCH'
        WHEN position <= 8 AND origin_status <> 'unresolved' THEN 'NEAR_MATCH' ELSE 'VISUAL_LEAD' END AS found FROM cand_v""",
    "identity_recheck": f"""WITH {CANDIDATES} SELECT inv, cand_id, CASE WHEN relationship = 'EXACT_MATCH' AND kind <> 'lens_exact' THEN 'VISUAL_LEAD'
        WHEN relationship = 'NEAR_MATCH' AND origin_status = 'unresolved' THEN 'VISUAL_LEAD' ELSE relationship END AS kept FROM cand_v""",
    "distribution_checks": """SELECT l_linenumber % 2 = 0 AS even, CASE WHEN l_linenumber % 2 = 0 THEN 1 - l_discount - l_tax ELSE l_tax END
        >= greatest(l_discount, l_tax, 1 - l_discount - l_tax) - 0.001 AS valid, count(*) AS n FROM lineitem GROUP BY ALL""",
    "text_anchors": """SELECT doc_id, coalesce(substr(text, 10 + CAST(doc_id % 2 AS INT), length(substr(text, 10))) = substr(text, 10), false) AS holds
        FROM documents""",
    "read_audit": f"""WITH r AS (SELECT l_orderkey AS inv, l_partkey % 40 AS id, CASE WHEN l_suppkey % 3 <> 0 THEN l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END END AS place,
          {[*evidence.ROLES, "other"]}[l_partkey % 9 + 1] AS role, l_quantity % 5 <> 0 AS judged, CAST(round(l_tax * 100) AS INT) AS fact, l_partkey % 6 = 0 AS winner FROM lineitem)
        SELECT DISTINCT inv, rule FROM (
          SELECT inv, 'ids_repeat' AS rule FROM r GROUP BY inv, id HAVING count(*) > 1
          UNION ALL SELECT inv, 'places_repeat' FROM r WHERE place IS NOT NULL GROUP BY inv, place HAVING count(*) > 1
          UNION ALL SELECT inv, 'place_out_of_range' FROM r WHERE place > 5
          UNION ALL SELECT inv, 'unknown_role' FROM r WHERE place IS NOT NULL AND role = 'other'
          UNION ALL SELECT inv, 'role_without_judgment' FROM r WHERE place IS NOT NULL AND NOT judged AND role NOT IN ('other', 'core_anchor', 'current_reporting')
          UNION ALL SELECT inv, 'places_missing' FROM r GROUP BY inv HAVING max(place) - count(DISTINCT place) > inv % 4
          UNION ALL SELECT inv, 'several_winners' FROM r WHERE winner GROUP BY inv HAVING count(*) > 1
          UNION ALL SELECT inv, 'winner_without_judgment' FROM r WHERE winner AND (NOT judged OR fact <= 0))""",
    "link_frontier": f"""WITH {CANDIDATES},
        links AS (SELECT inv, CASE WHEN position % 17 <> 0 THEN url END AS url, relevance, 'https://p' || (position % 5) AS parent, cand_id AS at_, position % 13 = 0 AS late
          FROM cand_v WHERE kind = 'source_link'),
        pool AS (SELECT inv, url, kind, relevance >= 80 AS classified, kind = 'lens_exact' AND position % 2 = 0 AS read FROM cand_v WHERE kind <> 'source_link'),
        n AS (SELECT inv, count(*) FILTER (classified) AS nc, count(*) FILTER (kind = 'google_search') AS nf FROM pool GROUP BY inv),
        k AS (SELECT inv, url, bool_or(classified) AS classified, bool_or(read) AS read FROM pool GROUP BY inv, url),
        r AS (SELECT l.*, row_number() OVER (PARTITION BY l.inv ORDER BY l.relevance DESC, l.parent, l.at_, l.url) AS place,
            CASE WHEN late THEN 'deadline' WHEN read THEN 'already_read' WHEN NOT coalesce(k.classified, false) AND coalesce(nc, 0) >= 24 THEN 'classification_limit'
                 WHEN l.url IS NULL OR (k.url IS NULL AND coalesce(nf, 0) >= 5) THEN 'retention_limit' ELSE 'open' END AS own
          FROM links l LEFT JOIN n ON l.inv = n.inv LEFT JOIN k ON l.inv = k.inv AND l.url = k.url),
        f AS (SELECT inv, min(place) AS first, arg_min(url, place) AS first_url FROM r WHERE own = 'open' GROUP BY inv)
        SELECT r.inv, url, parent, at_ AS "at", CASE WHEN own IN ('deadline', 'already_read') THEN own WHEN place > first AND url = first_url THEN 'already_read'
          WHEN place > first THEN 'page_limit' WHEN own = 'open' THEN 'selected' ELSE own END AS state
        FROM r LEFT JOIN f ON r.inv = f.inv""",
    "registrable_domains": rf"""WITH sfx(suffix, kind) AS (VALUES {", ".join(str(s) for s in SUFFIXES)}),
        h AS (SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'example\.[a-z]+$', '') || {list(ENDINGS)}[page_id % 7 + 1] AS host FROM pages),
        t AS (SELECT host, l, i, array_to_string(l[i:], '.') AS tail, len(l) - i + 1 AS own FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT DISTINCT host, string_split(host, '.') AS l FROM h))),
        m AS (SELECT host, CASE kind WHEN 'wildcard' THEN own + 1 WHEN 'exception' THEN own - 1 ELSE own END AS length, kind = 'exception' AS ex FROM t JOIN sfx ON tail = suffix),
        b AS (SELECT host, arg_max(length, 1000 * CAST(ex AS INT) + length) AS length FROM m GROUP BY host),
        d AS (SELECT t.host, CASE WHEN len(l) < coalesce(length, 1) + 1 THEN t.host ELSE array_to_string(l[len(l) - coalesce(length, 1):], '.') END AS domain
          FROM t LEFT JOIN b ON t.host = b.host WHERE i = 1)
        SELECT domain, count(*) AS n, count(DISTINCT h.host) AS hosts FROM h JOIN d ON h.host = d.host GROUP BY domain""",
    "place_spans": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}''-]+') AS ws FROM documents),
        t AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        a AS (SELECT doc_id, CAST(i - 1 AS INT) AS at_, ws[i + 1] AS one, CASE WHEN i + 2 <= len(ws) THEN ws[i + 1] || ' ' || ws[i + 2] END AS two FROM t
          WHERE ws[i] IN ('in', 'at', 'near', 'from', 'outside', 'inside', 'around'))
        SELECT doc_id AS claim_id, at_ AS "at", CASE WHEN two IN ('the the', 'of the') THEN two ELSE one END AS place FROM a
        WHERE two IN ('the the', 'of the') OR one IN ('the', 'was')""",
    "frame_totals": "SELECT source AS media_id, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS skipped FROM documents GROUP BY source",
}
