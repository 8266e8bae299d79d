"""Places that texts state: a name of a lexicon, a street address or a geographic noun after a locative preposition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prepositions that assert a place, words that may stand between one and its object, words that end a
# name, words that belong to a name on its left, nouns that are places by themselves, and endings of street names.
LOCATIVE = (
    "in at on near inside within outside across around throughout beside along into onto upon amid amidst next close opposite adjacent "
    "beneath underneath above below behind under over topside from"
).split()
BETWEEN = (
    "to of front top next close nearest opposite adjacent back behind above below under underneath over beneath outside out inside beside "
    "beyond around across along throughout the a an side way part this that these those its their his her our your my"
).split()
STOP = (
    "in at on from near of and or but is was were are be been being to for with as by that which who while after before during since until "
    "where when what why how this these those a an the not no so then than there has have had will would can could should may might must do "
    "does did made makes"
).split()
MODIFIERS = (
    "northern southern eastern western central greater upper lower inner outer new old north south east west far little big large great port "
    "st saint san santa de del la le el al bin abu"
).split()
NOUNS = (
    "airport altar arena airstrip aqueduct atrium barracks basement bathroom bedroom beach belfry bridge building campus canal canyon chapel "
    "church cinema city cliff coast courtyard dam desert dock downtown dungeon embassy factory farm field forest fortress foundry garden "
    "glacier gym hall harbour harbor highway hill hospital hotel house intersection island junction lake library lighthouse mall market mine "
    "monastery mosque mountain museum office orchard palace park parking pier port prison railway reservoir restaurant river road rooftop "
    "room runway school sea shore skyline square stadium station street studio suburb subway temple terminal theatre theater town tunnel "
    "university village volcano warehouse waterfront yard roofs hangar quay lagoon reef delta estuary plateau summit foothills meadow nursery "
    "cemetery courthouse capitol skyway overpass underpass roundabout highstreet esplanade boardwalk plaza alcove cellar attic loft corridor "
    "stairwell walkway path lane avenue boulevard"
).split()
SUFFIXES = (
    "street road avenue lane drive way place square crescent row close court gardens park circle terrace highway boulevard parade walk green "
    "mews rise vale"
).split()
NUMBER, HOUSE_NUMBER = r"^[0-9.,/'’-]+$", r"^[0-9]+[A-Za-z]?([-/][0-9A-Za-z]+)*$"
CLOSING = ".!?;:,—–)]"
_NUMBER, _HOUSE_NUMBER = re.compile(NUMBER).match, re.compile(HOUSE_NUMBER).match

#: Words of the longest name; readings, and characters in them, that a task hands on at once.
MOST_WORDS, ROWS, CHARACTERS = 4, 16_384, 2**23
BLANK = r"[ \t\n\r\f\x0b]+"

_LOCATIVE, _BETWEEN, _STOP = frozenset(LOCATIVE), frozenset(BETWEEN), frozenset([*STOP, ""])
_MODIFIERS, _SUFFIXES = frozenset(MODIFIERS), frozenset(SUFFIXES)
_ROWS = "claim_id long, at int, step int, kind int, n int, length int, key string, place string, before string"
_SCHEMA = pa.schema([
    ("claim_id", pa.int64()), ("at", pa.int32()), ("step", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("length", pa.int32()),
    ("key", pa.string()), ("place", pa.string()), ("before", pa.string()),
])
_EVIDENCE = ("gazetteer", "street_address", "place_type_noun")


def bare(raw: str) -> str:
    """A word without what is neither a letter nor a number at its ends."""
    start, end = 0, len(raw)
    if raw and raw[0].isalnum() and raw[-1].isalnum():
        return raw
    while start < end and not raw[start].isalnum():
        start += 1
    while end > start and not raw[end - 1].isalnum():
        end -= 1
    return raw[start:end]


def fold(raw: str) -> str:
    """A word in lower case without accents, marks at its ends and a possessive."""
    word = bare(raw)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c <= "ͯ")
    word = word.lower()
    return word[:-2] if word.endswith(("'s", "’s")) else word


@lru_cache(2**16)
def _token(raw: str) -> tuple[str, bool, bool, bool]:
    """The folded word, whether it is a number and a house number, and whether a sign at its end closes a part of a sentence."""
    may_be = not raw[0].isalpha()
    return fold(raw), may_be and _NUMBER(raw) is not None, may_be and _HOUSE_NUMBER(raw) is not None, raw[-1] in CLOSING


def objects(words: list[str]) -> Iterator[int]:
    """The place of each object of a locative preposition, past the words that may stand between them."""
    open_ = False
    for i, word in enumerate(words):
        if open_ and word not in _BETWEEN:
            yield i
        open_ = word in _LOCATIVE or (open_ and word in _BETWEEN)


def readings(text: str, nouns: frozenset[str], names: frozenset[str]) -> Iterator[tuple]:
    """(at, step, kind, n, length, key, place, before): all that an object may be, by one pass over the whole text.

    ``nouns`` are those that a place may go on with, ``names`` those that are names
    too. A reading of kind 0 counts only if ``key`` is a name. ``place`` begins after
    ``step`` modifiers; a row of kind -1 holds all of them, so that no text is
    written once for each step.
    """
    raw = [t for t in re.split(BLANK, text) if t]
    tokens = [_token(t) for t in raw]
    words = [t[0] for t in tokens]
    size = len(words)
    # The end of an address whose number is just before: the first ending of a street with no stop word or number before it.
    street = [-1] * (size + 1)
    for i in range(size - 1, -1, -1) if any(t[2] for t in tokens) else ():
        if words[i] not in _STOP and not tokens[i][1]:
            street[i] = i if words[i] in _SUFFIXES else street[i + 1]

    def address(i: int) -> int:
        return street[i + 1] if tokens[i][2] else -1

    def reading(at: int, step: int, kind: int, to: int, key: str | None) -> tuple:
        n, end = to - at - step + 1, to
        while (kind != 1 or step) and end + 1 < size and words[end + 1] in nouns:
            end += 1
        place = " ".join(filter(None, map(bare, raw[at + step : end + 1])))
        return at, step, kind, n, end - at + 1, f"\n{at} {place[:40]}" if key is None else key, place, None

    for at in objects(words):
        if words[at] in _STOP:
            continue
        if tokens[at][1] or tokens[at][2]:
            if address(at) >= 0:
                yield reading(at, 0, 1, address(at), None)
            continue
        for i in range(at, size):
            for n in range(1, min(MOST_WORDS, size - i) + 1):
                last = i + n - 1
                if n > 1 and (words[last] in _STOP or (n > 2 and tokens[last - 1][3])):
                    break
                yield reading(at, i - at, 0, last, " ".join(words[i : last + 1]))
            if address(i) >= 0:
                yield reading(at, i - at, 1, address(i), None)
            elif words[i] in nouns or words[i] in names:
                yield reading(at, i - at, 2, i, None)
            elif words[i] in _MODIFIERS:
                continue
            break
        if i > at:
            yield at, 0, -1, 0, 0, f"\n{at}", None, " ".join(map(bare, raw[at:i]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def stated_places(claims: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(claim_id, at, length, place, evidence): the place that each object of a locative preposition names, if it names one.

    ``claims`` is (claim_id, text), ``lexicon`` (place): names of up to four words
    in lower case, without accents. ``at`` counts words from 0. A name wins over an
    address, and that over a geographic noun; of names the longest wins. Modifiers
    before, and geographic nouns after, belong to the place. A null text or name
    counts as empty; repeated names count once, repeated claims give repeated rows
    once.

    Tasks read each whole text once and give a few readings for each object; the
    lexicon is joined to these, so that it may be of any size. Only the readings
    are shuffled, and of these one is kept for each object by a partial minimum.
    """
    lexicon = lexicon.select(F.col("place").alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
    # At most as many rows as there are nouns.
    names = frozenset(r["key"] for r in lexicon.where(F.col("key").isin(NOUNS)).collect())
    nouns = frozenset(NOUNS) - names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for claim, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for r in readings(text.as_py() or "", nouns, names):
                    rows.append((claim, *r))
                    held += len(r[6] or r[7] or "")
                    if len(rows) == ROWS or held > CHARACTERS:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    found = claims.select(F.col("claim_id").cast("long"), "text").mapInArrow(read, _ROWS)
    known = found.join(lexicon.withColumn("known", F.lit(True)), "key", "left").where("known OR kind <> 0")
    evidence = F.element_at(F.array(*map(F.lit, _EVIDENCE)), F.col("kind") + 1)
    best = F.min_by(F.when(F.col("kind") >= 0, F.struct("length", "step", "place", evidence.alias("evidence"))), F.when(F.col("kind") >= 0, F.struct("step", "kind", -F.col("n"))))
    rows = known.groupBy("claim_id", "at").agg(best.alias("b"), F.max("before").alias("before")).where("b IS NOT NULL")
    before = F.when(F.col("b.step") > 0, F.expr("substring_index(before, ' ', b.step)"))
    return rows.select("claim_id", "at", "b.length", F.concat_ws(" ", before, "b.place").alias("place"), "b.evidence")
