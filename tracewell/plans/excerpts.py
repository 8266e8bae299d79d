"""Excerpts of pages and of documents, whose lines are paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import excerpts
from ..functions import text as text_fn
from ..operators import pages
from .views import table


def _found(rows: DataFrame, key: str) -> DataFrame:
    """(key, excerpt, quote, passages) of (key, title, snippet, claim, paragraphs)."""
    c = F.col
    return rows.select(
        key,
        excerpts.excerpt(c("title"), c("snippet"), c("claim"), c("paragraphs")).alias("excerpt"),
        excerpts.display_quote(c("title"), c("claim"), c("paragraphs")).alias("quote"),
        excerpts.topic_passages(c("claim"), c("paragraphs")).alias("passages"),
    )


def document_excerpts(spark, sf_dir):
    """Of each document, whose lines are paragraphs; the source is the title and the third line the claim, by turns."""
    n, lines = F.col("doc_id"), F.split("text", "\n")
    return _found(
        table(spark, sf_dir, "documents").select(
            "doc_id", F.when(n % 5 != 0, F.col("source")).alias("title"), F.when(n % 2 == 0, F.concat(F.lit("in "), "lang")).alias("snippet"),
            F.when(n % 4 != 0, F.left(F.try_element_at(lines, F.lit(3)), F.lit(200))).alias("claim"), lines.alias("paragraphs"),
        ),
        "doc_id",
    )


def page_view(spark, sf_dir) -> DataFrame:
    """(page_id, title, snippet, claim, paragraphs) of each extracted page: the last paragraph is the claim, by turns."""
    n = F.col("page_id")
    return pages.pages(table(spark, sf_dir, "pages")).select(
        "page_id", F.when(n % 5 != 0, F.col("title")).alias("title"), F.when(n % 2 == 0, F.col("og_title")).alias("snippet"),
        F.when(n % 4 != 0, F.left(F.try_element_at("paragraphs", F.lit(-1)), F.lit(200))).alias("claim"), "paragraphs",
    )


def page_excerpts(spark, sf_dir):
    """Of each page, from its whole html."""
    return _found(page_view(spark, sf_dir), "page_id")


QUERIES = {f.__name__: f for f in (document_excerpts, page_excerpts)}


def _words(text: str, pattern: str, stop: list[str], rule: str) -> str:
    held = "[" + ", ".join(f"'{w}'" for w in stop) + "]"
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '{pattern}'), lambda x: ({rule}) AND NOT list_contains({held}, x)))"


def _page(text: str) -> str:
    return _words(text, "[a-z0-9]+", text_fn.PAGE_STOP, "length(x) > 2")


def _passage(text: str) -> str:
    return _words(text, r"[\p{L}\p{N}]+", text_fn.PASSAGE_STOP, r"length(x) >= 3 OR regexp_matches(x, '^[0-9]+$')")


ORACLE_SQL = {
    "document_excerpts": rf"""WITH
        d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'in ' || lang END AS snippet,
            string_split(text, chr(10)) AS lines FROM documents),
        c AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN lines[3][:200] END AS claim FROM d),
        q AS (SELECT *, {_page("concat_ws(' ', title, claim)")} AS both_, coalesce(nullif(trim(claim), ''), nullif(trim(title), '')) AS asked FROM c),
        a AS (SELECT *, {_page("asked")} AS own, {_passage("claim")} AS topic FROM q),
        p AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS p, both_, own, topic FROM a),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth, len(list_intersect({_page("p")}, both_)) AS o1,
            len(list_intersect({_page("p[:8000]")}, own)) AS o2, len(list_intersect({_passage("p")}, topic)) AS o3,
            regexp_replace(p, '^\s+|\s+$', '', 'g') AS t FROM p WHERE p <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS copy FROM s),
        x AS (SELECT doc_id, list(p ORDER BY nth > 2, CASE WHEN nth > 2 THEN -o1 END, nth) FILTER (nth <= 2 OR o1 > 0) AS parts,
            list(p[:8000] ORDER BY o2 DESC, i) FILTER (o2 > 0) AS best, list(p[:8000] ORDER BY i) FILTER (t <> '') AS every,
            list(t[:2400] ORDER BY o3 DESC, i) FILTER (o3 > 0 AND copy = 1) AS topics FROM r GROUP BY doc_id)
        SELECT a.doc_id, nullif(array_to_string(list_filter(['Title: ' || nullif(title, ''), 'Snippet: ' || nullif(snippet, '')], lambda z: z IS NOT NULL) || coalesce(parts, []), chr(10) || chr(10))[:8000], '') AS excerpt,
          CASE WHEN asked IS NULL THEN every[1] ELSE best[1] END AS quote, nullif(array_to_string(topics[:3], chr(10) || chr(10)), '') AS passages
        FROM a LEFT JOIN x ON a.doc_id = x.doc_id""",
}
