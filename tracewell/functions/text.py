"""Text functions: tokenizers, shingles, sentences, attribution phrases, digests."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop lists of the tokenizers, which differ on purpose.
PAGE_STOP = (
    "a an and are as at be been but by for from has have he her his i in is it its of on or she that the their they "
    "this to was we were will with you your"
).split()
TOPIC_STOP = (
    "a an and are as at be being by can change changed changes did do does for from has have how in is it of on or research should "
    "that the their this to use uses used was were what when where which who why will with would january february march april may "
    "june july august september october november december"
).split()
PASSAGE_STOP = (
    "a an and are as at be being by can claim did do does for from has have how in is it its of on or so that the their this to was "
    "were what when where which who why will with would evidence shows show quickly more than"
).split()
FAMILY_STOP = "that this with from have were been their they more than which when also according".split()
DOSSIER_STOP = (
    "the and for that this with from have were been their they more than which when also why how what did does can could would "
    "should will claim question evidence explanation explanations distinguish distinguishes quickly according"
).split()


def _plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def page_words(text: Column) -> Column:
    return F.array_distinct(F.filter(_plain_words(text), lambda w: (F.length(w) > 2) & ~w.isin(PAGE_STOP)))


def topic_words(text: Column) -> Column:
    kept = F.filter(_letter_words(text), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~w.isin(TOPIC_STOP))
    return F.array_distinct(F.transform(kept, lambda w: F.left(w, F.lit(6))))


def passage_words(text: Column) -> Column:
    return F.array_distinct(
        F.filter(_letter_words(text), lambda w: ~w.isin(PASSAGE_STOP) & ((F.length(w) >= 3) | w.rlike(r"^\d+$")))
    )


def family_words(text: Column) -> Column:
    return F.array_distinct(F.filter(_letter_words(text), lambda w: (F.length(w) > 3) & ~w.isin(FAMILY_STOP)))


def dossier_words(text: Column) -> Column:
    return F.array_distinct(F.filter(_letter_words(text), lambda w: (F.length(w) >= 3) & ~w.isin(DOSSIER_STOP)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; inside a lambda a plain expression is computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs(words: Column, n: int, first: int = 1, short: int = 0) -> Column:
    """Runs of n words, space-joined, that begin at place ``first`` or later and end ``short`` before the last or earlier."""

    def of(w: Column) -> Column:
        last = F.size(w) - n + 1 - short
        starts = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return let(words, of)


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """Hashes of shingles() with repeats: a run's words are hashed one after another and never joined."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    return let(_plain_words(text), of)


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct word n-grams of a text in lower case; letters with accents split words."""
    return F.array_distinct(runs(_plain_words(text), n))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 where either is empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / union)


def sentences(text: Column) -> Column:
    """Sentences of a text, split after . ! ? before white space, and at line ends."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(parts, lambda s: F.trim(s) != "")


_ABBREVIATION = r"(?i)\b(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Mr|Mrs|Ms|Dr|Prof|St)\.$"


def joined_sentences(text: Column) -> Column:
    """Sentences as sentences(), where one that ends with an abbreviation goes on in the next."""
    start = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        goes_on = F.coalesce(last.rlike(_ABBREVIATION), F.lit(False))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(goes_on, F.concat(head, F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(sentences(text), start, step)


# Phrases that name another outlet as the origin, the first that matches decides.
_ATTRIBUTION = (
    r"(?i)originally (?:published|appeared|reported) (?:on|by|in|at)\s+([^,.;\n]{2,80})",
    r"(?i)first (?:published|reported) (?:on|by|in|at)\s+([^,.;\n]{2,80})",
    r"(?i)republished (?:from|by|on)\s+([^,.;\n]{2,80})",
    r"(?i)syndicated (?:from|by)\s+([^,.;\n]{2,80})",
    r"(?i)courtesy of\s+([^,.;\n]{2,80})",
    r"(?i)reprinted (?:from|with permission of)\s+([^,.;\n]{2,80})",
)
_NEGATION = (
    r"(?i)\b(?:not|no|never|neither|nor|without|denied|denies|uninvolved|unrelated|didn'?t|did not|wasn'?t|was not|weren'?t|were not"
    r"|don'?t|do not|doesn'?t|does not)\b"
)
_DISCLAIMER = (
    r"(?i)\b(?:attribution|credit|byline|claim)\s+is\s+(?:false|incorrect|wrong|mistaken)|incorrectly attributed|falsely attributed"
    r"|misattributed"
)
_NAME = r"([A-Z][A-Za-z0-9.'-]*(?:(?:\s+(?:of|the|and)\s+|\s*&\s*|\s+)[A-Z][A-Za-z0-9.'-]*){0,4})"
_MEDIA = (
    r"(?:image|photo|photograph|footage|video)\s+(?:was\s+|were\s+)?(?:(?:first|originally)\s+published|(?:first\s+|originally\s+)?"
    r"(?:released|obtained|acquired|distributed|issued|verified|documented))\s+by\s+(?:the\s+)?" + _NAME
)
_HOSTING = r"(?:image|photo|photograph|footage|video)\s+(?:was\s+|were\s+)?published\s+by\s+(?:the\s+)?" + _NAME
_BYLINE = (
    r"(?:[Rr]eported|[Ii]nvestigated|[Ww]ritten|[Pp]hotographed|[Dd]ocumented|[Ff]iled) by\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}"
    r"\s+for\s+(?:the\s+)?" + _NAME
)


# A text without these words, in lower case, has no match of the pattern at the same place.
_ATTRIBUTION_WORDS = (("originally ",), ("first published ", "first reported "), ("republished ",), ("syndicated ",), ("courtesy of",), ("reprinted ",))
_MEDIA_WORDS = ("image", "photo", "footage", "video")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def origin_key(text: Column) -> Column:
    """The origin that a text attributes itself to: "name:" and what the first phrase that matches is followed by, or null.

    A capture ends at a comma, full stop, semicolon or line end, so that a domain gives its first label; one of more than three words, or
    of under three characters without its articles, is none, and later phrases are not tried.
    """

    def first(low: Column) -> Column:
        found = [F.when(_has(low, w), F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p, w in zip(_ATTRIBUTION, _ATTRIBUTION_WORDS)]
        return F.coalesce(*found)

    name = F.regexp_replace(F.regexp_replace(let(F.lower(text), first), r"(?i)\b(?:the|a|an)\b", ""), r"^\s+|\s+$", "")
    few = lambda name: (F.length(name) >= 3) & (F.size(F.split(name, r"\s+")) <= 3)
    return let(name, lambda name: F.when(few(name), F.concat(F.lit("name:"), F.lower(name))))


def named_credits(text: Column) -> Column:
    """Distinct names that valid sentences credit with acquiring or reporting the media; hosting alone is no credit."""
    return let(credits(text), lambda c: F.array_distinct(F.concat(c["media"], c["bylines"])))


def credits(text: Column) -> Column:
    """struct(media, hosting, bylines, spans, said) of a text's valid sentences, in their order.

    ``media`` are names that acquired or first published the media, ``hosting`` those
    that only published it, ``bylines`` outlets of a named person; ``spans`` are the
    sentences that have any, and ``said`` those with an attribution phrase.
    """
    of = lambda s, pattern: F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
    each = lambda sentences_, pattern: F.flatten(F.transform(sentences_, lambda s: of(s, pattern)))
    credited = lambda s: F.contains(s, F.lit(" by")) & s.rlike(_BYLINE) | _has(s, _MEDIA_WORDS) & (s.rlike(_MEDIA) | s.rlike(_HOSTING))

    def attributed(s: Column) -> Column:
        def any_of(low: Column) -> Column:
            found = F.lit(False)
            for p, w in zip(_ATTRIBUTION, _ATTRIBUTION_WORDS):
                found = found | _has(low, w) & s.rlike(p)
            return found

        return let(F.lower(s), any_of)

    # Few sentences credit anybody, so that only these are looked at for a negation, and the next ones for a disclaimer.
    valid = lambda all_, s, i: ~s.rlike(_NEGATION) & ~F.coalesce(F.get(all_, i + 1), F.lit("")).rlike(_DISCLAIMER)
    told = lambda all_: F.filter(all_, lambda s, i: (credited(s) | attributed(s)) & valid(all_, s, i))
    named = lambda ss: F.struct(each(ss, _MEDIA).alias("media"), each(ss, _HOSTING).alias("hosting"), each(ss, _BYLINE).alias("bylines"), F.transform(ss, _stripped).alias("spans"))
    both = lambda ss: F.struct(F.filter(ss, credited).alias("ss"), F.transform(F.filter(ss, attributed), _stripped).alias("said"))
    return let(let(let(sentences(text), told), both), lambda b: let(named(b["ss"]), lambda n: n.withField("said", b["said"])))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def name_key(name: Column) -> Column:
    """Comparison key of an outlet's name: lower case, no leading article, letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^(?:the|a|an)\s+", ""), "[^a-z0-9]", "")


def own_outlet_key(domain: Column) -> Column:
    return name_key(F.split_part(domain, F.lit("."), F.lit(1)))


def historical_media_cue(text: Column) -> Column:
    """Whether a short text has both a media word and a word of time."""
    media = text.rlike(r"(?i)\b(?:image|photo|photograph|picture|video|footage|clip|screenshot)s?\b")
    time = text.rlike(r"(?i)\b(?:old|older|earlier|original|originally|archive|archived|previous|previously|years? ago|dates? (?:back )?(?:from|to)|from (?:19|20)\d{2})\b")
    return F.coalesce((F.length(text) <= 1200) & media & time, F.lit(False))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def phrase(text: Column) -> Column:
    """A phrase for comparison: NFKC, lower case, runs of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(_nfkc(text)), r"[^\p{L}\p{N}]+", " "))


def stable_id(kind: str, *parts: Column) -> Column:
    """kind: and the SHA-256 of a JSON list of the parts."""
    listed = F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(kind + ":"), F.sha2(listed, 256))


def digest(*columns: Column) -> Column:
    """sha256: and the digest of the named columns as one JSON object, nulls kept."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


# Bounds of what is kept of a page's descriptive attributes.
LONGEST_VALUE, MOST_NAMES = 400, 8


def capped(value: Column) -> Column:
    """An attribute's text, trimmed, its first 400 characters; null if nothing is left."""
    return let(F.trim(value), lambda v: F.when(v != "", F.left(v, F.lit(LONGEST_VALUE))))


def capped_names(values: Column) -> Column:
    """The first eight of an attribute's names that are not empty, each capped."""
    return F.slice(F.array_compact(F.transform(values, capped)), 1, MOST_NAMES)


def recognition(tokens: Column) -> Column:
    """unreviewed if the mean probability of a segment's tokens is 0.6 or more, else low_confidence.

    ``tokens`` are structs (text, p); marks that begin with "[_" and what is no
    probability don't count, and a segment without any has none.
    """
    good = F.filter(tokens, lambda t: t["text"].isNotNull() & ~t["text"].startswith("[_") & t["p"].between(0, 1))
    total = lambda ts: F.aggregate(ts, F.lit(0.0), lambda s, t: s + t["p"].cast("double"))
    return let(good, lambda ts: F.when(F.coalesce(total(ts) / F.nullif(F.size(ts), F.lit(0)), F.lit(0.0)) >= 0.6, "unreviewed").otherwise("low_confidence"))
