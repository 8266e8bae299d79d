"""Places that whole texts state, by a lexicon drawn from the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import places
from .views import table

#: Lines put to the end of the texts by turns, so that every kind of place and refusal is there.
LINES = (
    "It was seen at 12 High Street, London.", "It stood in front of the old city hall.", "Filmed on 5 and 6 May.", "She left from 221B Baker Street near the river bank.",
    "It fell in northern nowhere.", "It lay next to the harbor. Road works followed.", "Shown in the north 12 Mill Lane park area.", "Above all, under it.",
    "Taken in Città’s square, within 7 or 8 Park Row.",
)


def lexicon(spark, sf_dir) -> DataFrame:
    """Long words of the benchmark's texts, and runs of two to four words there, as names."""
    words = F.transform(F.split(F.lower("text"), "[ \\t\\n\\r\\f\\x0b]+"), lambda w: F.regexp_replace(w, "^[^a-z]+|[^a-z]+$", ""))
    rows = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    each = rows.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    each = each.select("w", "i", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("n"))
    names = each.where("i + n - 1 <= size(w)").select("n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("place"))
    return names.where("place rlike '^[a-z]{2,}( [a-z]{2,})*$' AND (n > 1 OR length(place) >= 4)").select("place").distinct()


def stated_places(spark, sf_dir):
    """The place that each object of a locative preposition names, in whole documents with a line more."""
    n = F.col("doc_id")
    line = F.try_element_at(F.array(*[F.lit(x) for x in LINES]), (n % 12 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(n.alias("claim_id"), F.concat_ws("\n", "text", line).alias("text"))
    return places.stated_places(docs, lexicon(spark, sf_dir))


QUERIES = {"stated_places": stated_places}

_BLANK = r"[ \t\n\r\f\x0b]+"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _ahead(value: str, start: str = "1 FOLLOWING", end: str = "UNBOUNDED FOLLOWING") -> str:
    return f"min({value}) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN {start} AND {end})"


def _before(condition: str) -> str:
    return f"coalesce(max(CASE WHEN {condition} THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


ORACLE_SQL = {
    "stated_places": rf"""WITH
        b AS (SELECT list_transform(regexp_split_to_array(lower(text), '{_BLANK}'), lambda w: regexp_replace(w, '^[^a-z]+|[^a-z]+$', '', 'g')) AS w FROM benchmark),
        lex AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS place, n FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b))
          WHERE i + n - 1 <= len(w) AND regexp_matches(array_to_string(w[i:i + n - 1], ' '), '^[a-z]{{2,}}( [a-z]{{2,}})*$')
            AND (n > 1 OR length(array_to_string(w[i:i + n - 1], ' ')) >= 4)),
        d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(concat_ws(chr(10), text, {list(LINES)}[doc_id % 12 + 1]), '{_BLANK}'), lambda x: x <> '') AS raws FROM documents),
        d2 AS (SELECT *, list_transform(raws, lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS bares FROM d),
        t AS (SELECT id, len(raws) AS size, unnest(range(1, len(raws) + 1)) AS i, unnest(raws) AS raw, unnest(bares) AS bare FROM d2),
        f AS (SELECT *, regexp_replace(lower(strip_accents(bare)), '[''’]s$', '') AS w, regexp_matches(raw, '{places.NUMBER.replace("'", "''")}') AS num,
            regexp_matches(raw, '{places.HOUSE_NUMBER}') AS house, regexp_matches(raw, '[.!?;:,—–)\]]$') AS closed FROM t),
        g AS (SELECT f.*, w IN {_list(places.LOCATIVE)} AS loc, w IN {_list(places.BETWEEN)} AS btw, w = '' OR w IN {_list(places.STOP)} AS stop, w IN {_list(places.MODIFIERS)} AS modifier,
            w IN {_list(places.NOUNS)} AS noun, w IN {_list(places.NOUNS)} AND w NOT IN (SELECT place FROM lex) AS goes_on, w IN {_list(places.SUFFIXES)} AND NOT num AS street,
            lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(closed, 1) OVER o AS c2, lead(closed, 2) OVER o AS c3 FROM f WINDOW o AS (PARTITION BY id ORDER BY i)),
        h AS (SELECT *, lead(stop, 1) OVER o AS s2, lead(stop, 2) OVER o AS s3, lead(stop, 3) OVER o AS s4,
            NOT btw AND {_before("loc")} > {_before("NOT loc AND NOT btw")} AS obj,
            CASE WHEN house AND {_ahead("CASE WHEN street THEN i END")} < coalesce({_ahead("CASE WHEN stop OR num THEN i END")}, size + 1) THEN {_ahead("CASE WHEN street THEN i END")} END AS address,
            coalesce({_ahead("CASE WHEN NOT goes_on THEN i END")}, size + 1) - 1 AS run_end,
            coalesce({_ahead("CASE WHEN NOT modifier THEN i END", "CURRENT ROW")}, size) AS last_step FROM g WINDOW o AS (PARTITION BY id ORDER BY i)),
        k AS (SELECT h.*, CASE WHEN l4.place IS NOT NULL THEN 4 WHEN l3.place IS NOT NULL THEN 3 WHEN l2.place IS NOT NULL THEN 2 WHEN l1.place IS NOT NULL THEN 1 ELSE 0 END AS name
          FROM h LEFT JOIN lex l1 ON l1.place = w LEFT JOIN lex l2 ON l2.place = w || ' ' || w2 AND NOT s2
            LEFT JOIN lex l3 ON l3.place = w || ' ' || w2 || ' ' || w3 AND NOT s2 AND NOT s3 AND NOT c2
            LEFT JOIN lex l4 ON l4.place = w || ' ' || w2 || ' ' || w3 || ' ' || w4 AND NOT s2 AND NOT s3 AND NOT s4 AND NOT c2 AND NOT c3),
        s AS (SELECT *, CASE WHEN name > 0 THEN 'gazetteer' WHEN address IS NOT NULL THEN 'street_address' ELSE 'place_type_noun' END AS evidence,
            CASE WHEN name > 0 THEN i + name - 1 WHEN address IS NOT NULL THEN address ELSE i END AS to_ FROM k WHERE name > 0 OR address IS NOT NULL OR noun),
        o AS (SELECT id, i AS at_, num OR house AS number, last_step FROM h WHERE obj AND NOT stop),
        m AS (SELECT o.id, at_, number, min(s.i) AS i FROM o JOIN s ON o.id = s.id AND (CASE WHEN number THEN s.i = at_ AND s.address IS NOT NULL ELSE s.i BETWEEN at_ AND o.last_step END) GROUP BY ALL),
        e AS (SELECT m.*, CASE WHEN number THEN 'street_address' ELSE s.evidence END AS evidence, CASE WHEN number THEN s.address ELSE s.to_ END AS to_ FROM m JOIN s ON m.id = s.id AND m.i = s.i),
        z AS (SELECT e.id, at_, evidence, CASE WHEN number THEN e.to_ ELSE h.run_end END AS end_ FROM e JOIN h ON e.id = h.id AND e.to_ = h.i)
        SELECT z.id AS claim_id, CAST(at_ - 1 AS INT) AS "at", CAST(end_ - at_ + 1 AS INT) AS length, array_to_string(list_filter(bares[at_:end_], lambda x: x <> ''), ' ') AS place, evidence
        FROM z JOIN d2 ON z.id = d2.id""",
}
