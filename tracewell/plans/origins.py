"""Queries on reporting origins and on dates that texts state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as text_fn
from ..operators import origins, similarity
from ..sources.shared import written
from .views import table

#: Investigations that documents are dealt to, and the outlets that hold them.
INVESTIGATIONS = 5
DOMAINS = ("herald.com", "examiner.com", "post.co.uk", "tribune.org", "wire.net", "globe.com", "coast.org")
#: Lines put to the end of the texts by turns; the eleventh and twelfth have none.
LINES = (
    "The photo was first published by the Herald.",
    "It was originally published on Example Wire, last week.",
    "This image was released by Global Pictures.",
    "Reported by Jane Doe for the Daily Examiner.",
    "Syndicated from Herald; more follows.",
    "The video was published by Tribune.",
    "The photo was not released by Global Pictures.",
    "The image was obtained by Global Pictures. That credit is false.",
    "Courtesy of the Post. The footage was verified by Post.",
    "A photo issued by Coast Agency. A video distributed by Global Pictures.",
)


def _pages(spark, sf_dir) -> DataFrame:
    """Documents as pages of an outlet, with a line of credit; every 13th has a separate origin already."""
    n = F.col("doc_id")
    line = F.try_element_at(F.array(*[F.lit(x) for x in LINES]), (n % 12 + 1).cast("int"))
    line = F.when(n % 24 == 14, F.concat(F.lit("The photo was released by Agency "), n, F.lit("."))).otherwise(line)
    return table(spark, sf_dir, "documents").select(
        (n % INVESTIGATIONS).alias("inv"), n.alias("cand_id"), n.alias("ord"),
        F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (n % len(DOMAINS) + 1).cast("int")).alias("domain"),
        F.concat_ws("\n", "text", line).alias("text"),
        F.when(n % 13 == 0, "separate_origin_evidenced").otherwise("unresolved").alias("status"),
        F.when(n % 13 == 0, F.concat(F.lit("origin:"), n)).alias("group_id"),
    )


def refined_origins(spark, sf_dir):
    """Origins of documents as pages, after duplicates, attributions and credits."""
    pages = _pages(spark, sf_dir)
    sets = pages.where(F.length("text") >= origins.LEAST_TEXT).select(
        F.col("inv").cast("string").alias("scope"), F.col("cand_id").alias("id"), text_fn.shingle_hashes(F.col("text")).alias("tokens")
    )
    classes = similarity.set_classes(sets)
    groups = similarity.groups(classes, similarity.similar_sets(classes, 60))
    duplicates = groups.select((F.col("id") % INVESTIGATIONS).alias("inv"), F.col("id").alias("cand_id"), F.col("group_id").alias("grp"))
    found = origins.refine_origins(pages, duplicates)
    return found.withColumn("spans", F.array_join("spans", "|"))


#: Lines put to the end of the texts by turns, so that every reading and refusal is there; the others have none.
CLAIMS = (
    "It was taken on March 5, 2021.", "It was filmed in 2021.", "It was seen on 2021-03-05, in March 2021.", "It was seen on 03/04/2021.",
    "It happened on March 5–8, 2021.", "It was so between 2019 and 2021.", "It was on February 31, 2021.", "It was on March 5.",
    "It was on 5 March 2021 and on 6 March 2021.", "It was yesterday.", "In 2021 households it was seen.", "Copyright by all, in 2021.", "It was 2 months ago.",
    "It was 31/12/2020, in 2020.",
)


def claim_texts(spark, sf_dir) -> DataFrame:
    """Documents as claims with a line on a date, and the day that they were asked on."""
    n = F.col("doc_id")
    line = F.try_element_at(F.array(*[F.lit(x) for x in CLAIMS]), (n % 16 + 1).cast("int"))
    day = F.date_add(F.lit("2021-03-06").cast("date"), (n % 3).cast("int"))
    return table(spark, sf_dir, "documents").select(n.alias("claim_id"), F.concat_ws("\n", "text", line).alias("text"), day.alias("asked"))


def claim_dates(spark, sf_dir):
    """The date that each whole text states, or why it states none."""
    return claim_texts(spark, sf_dir).select("claim_id", dates.claim_date(F.col("text"), F.col("asked")).alias("d")).select("claim_id", "d.*")


QUERIES = {f.__name__: f for f in (refined_origins, claim_dates)}

_NAME_KEY = "regexp_replace(regexp_replace(lower({0}), '^(?:the|a|an)\\s+', ''), '[^a-z0-9]', '', 'g')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _all(pattern: str) -> str:
    return f"flatten(list_transform(ok, lambda s: regexp_extract_all(s, {_quoted(pattern)}, 1)))"


_STRIP = r"regexp_replace(s, '^\s+|\s+$', '', 'g')"
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(text, {_quoted(p)}) THEN regexp_extract(text, {_quoted(p)}, 1)" for p in text_fn._ATTRIBUTION) + " END"
_SAID = " OR ".join(f"regexp_matches(s, {_quoted(p)})" for p in text_fn._ATTRIBUTION)
_CREDIT = " OR ".join(f"regexp_matches(s, {_quoted(p)})" for p in (text_fn._MEDIA, text_fn._HOSTING, text_fn._BYLINE))

ORACLE_SQL = {
    "refined_origins": rf"""WITH RECURSIVE
        page AS (SELECT doc_id AS id, doc_id % {INVESTIGATIONS} AS inv, {list(DOMAINS)}[doc_id % {len(DOMAINS)} + 1] AS domain,
            concat_ws(chr(10), text, CASE WHEN doc_id % 24 = 14 THEN 'The photo was released by Agency ' || doc_id || '.' ELSE {list(LINES)}[doc_id % 12 + 1] END) AS text,
            doc_id % 13 <> 0 AS was_open FROM documents),
        held AS (SELECT *, regexp_replace(split_part(domain, '.', 1), '[^a-z0-9]', '', 'g') AS own, {_FIRST} AS raw,
            list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS every
          FROM page WHERE length(text) >= 400),
        kept AS (SELECT * EXCLUDE (every, raw), regexp_replace(regexp_replace(raw, '(?i)\b(?:the|a|an)\b', '', 'g'), '^\s+|\s+$', '', 'g') AS name,
            [every[i] for i in range(1, len(every) + 1) if NOT regexp_matches(every[i], {_quoted(text_fn._NEGATION)})
              AND NOT regexp_matches(coalesce(every[i + 1], ''), {_quoted(text_fn._DISCLAIMER)})] AS ok FROM held),
        found AS (SELECT id, inv, domain, was_open, own,
            CASE WHEN length(name) >= 3 AND len(string_split_regex(name, '\s+')) <= 3 THEN 'name:' || lower(name) END AS origin,
            list_transform(list_filter(ok, lambda s: {_SAID}), lambda s: {_STRIP}) AS said, list_transform(list_filter(ok, lambda s: {_CREDIT}), lambda s: {_STRIP}) AS spans,
            {_all(text_fn._MEDIA)} AS media, {_all(text_fn._MEDIA)} || {_all(text_fn._HOSTING)} || {_all(text_fn._BYLINE)} AS names FROM kept),
        words AS (SELECT id, inv, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM page WHERE length(text) >= 400),
        gram AS (SELECT id, inv, list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] for i in range(1, len(w) - 3)]) AS g FROM words WHERE len(w) >= 5),
        one AS (SELECT id, inv, len(g) AS n, unnest(g) AS s FROM gram),
        near AS (SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.inv = b.inv AND a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id
          HAVING count(*) * 100 >= (any_value(a.n) + any_value(b.n) - count(*)) * 60),
        reach AS (SELECT a AS x, a AS y FROM near UNION SELECT r.x, e.b FROM reach r JOIN near e ON r.y = e.a),
        least AS (SELECT x AS id, min(y) AS dup, count(*) AS n_dup FROM reach GROUP BY x),
        r AS (SELECT f.*, dup, n_dup FROM found f LEFT JOIN least l ON f.id = l.id),
        outer_ AS (SELECT id, inv, min(at_) AS at_, k FROM (SELECT id, inv, own, i AS at_, {_NAME_KEY.format("names[i]")} AS k
            FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM r)) WHERE k <> '' AND k <> own GROUP BY id, inv, k),
        asked AS (SELECT o.* FROM outer_ o JOIN r ON o.id = r.id WHERE dup IS NOT NULL OR was_open),
        prov AS (SELECT inv, k, count(*) AS n, min((id, at_)) AS first, min(id) AS first_id FROM asked GROUP BY inv, k HAVING count(*) > 1),
        last AS (SELECT id, arg_max(a.k, first) AS k, arg_max(n, first) AS n, arg_max(first_id, first) AS first_id FROM asked a JOIN prov p ON a.inv = p.inv AND a.k = p.k GROUP BY id),
        b AS (SELECT r.*, l.k, l.n, l.first_id, CASE WHEN l.k IS NOT NULL THEN 'shared_named_provider' WHEN dup IS NOT NULL THEN 'article_text_duplication'
              WHEN was_open AND origin IS NOT NULL AND {_NAME_KEY.format("substr(origin, 6)")} <> own THEN 'explicit_syndication_attribution'
              WHEN was_open AND r.id NOT IN (SELECT id FROM outer_) AND list_contains(list_transform(media, lambda m: {_NAME_KEY.format("m")}), own)
                THEN 'separate_reporting_evidence' END AS basis
          FROM r LEFT JOIN last l ON r.id = l.id)
        SELECT p.inv, p.id AS cand_id, CASE WHEN basis = 'separate_reporting_evidence' OR (basis IS NULL AND NOT p.was_open) THEN 'separate_origin_evidenced'
            WHEN basis IS NULL THEN 'unresolved' ELSE 'shared_origin' END AS status,
          CASE basis WHEN 'shared_named_provider' THEN 'provider:' || k WHEN 'article_text_duplication' THEN 'dup:' || dup
            WHEN 'explicit_syndication_attribution' THEN origin WHEN 'separate_reporting_evidence' THEN 'origin:' || b.domain
            ELSE CASE WHEN NOT p.was_open THEN 'origin:' || p.id END END AS group_id, basis,
          CASE basis WHEN 'shared_named_provider' THEN n WHEN 'article_text_duplication' THEN n_dup ELSE CASE WHEN basis IS NOT NULL THEN 1 END END AS n_supports,
          CASE basis WHEN 'shared_named_provider' THEN first_id WHEN 'article_text_duplication' THEN dup ELSE CASE WHEN basis IS NOT NULL THEN p.id END END AS first_support,
          coalesce(array_to_string(CASE WHEN basis IN ('shared_named_provider', 'separate_reporting_evidence') THEN spans WHEN basis = 'explicit_syndication_attribution' THEN said END, '|'), '') AS spans,
          basis IS NOT NULL AS changed
        FROM page p LEFT JOIN b ON p.id = b.id""",
}
