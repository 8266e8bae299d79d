"""Excerpts, display quotes and passages of a page, as expressions over its paragraphs: a page is one row, and none is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as text_fn

#: Code points of an excerpt or quote, passages of a page, and code points of each.
MOST, PASSAGES, LONGEST = 8_000, 3, 2_400


def _trim(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _said(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _ranked(paragraphs: Column, asked: Column, words: Callable[[Column], Column], first: int = 0) -> Column:
    """Paragraphs by the words that they share with ``asked``, most first, then in their order; of those after ``first`` none that shares no word."""

    def of(query: Column) -> Column:
        def rank(p: Column, i: Column) -> Column:
            shared = F.size(F.array_intersect(words(p), query))
            return F.struct(F.when(i < first, -(2**31)).otherwise(-shared).alias("less"), i.alias("i"), p.alias("p"))

        return F.array_sort(F.filter(F.transform(paragraphs, rank), lambda x: x["less"] < 0))

    return F.transform(text_fn.let(asked, of), lambda x: x["p"])


def _kept(paragraphs: Column, change: Callable[[Column], Column] = lambda p: p, holds: Callable[[Column], Column] = lambda p: p != "") -> Column:
    return F.filter(F.transform(F.coalesce(paragraphs, F.array().cast("array<string>")), change), holds)


def excerpt(title: Column, snippet: Column, claim: Column, paragraphs: Column, most: int = MOST) -> Column:
    """Title, snippet, the first two paragraphs and all others that share a word with title or claim, cut at ``most``.

    Parts that are null or empty are left out; with none the excerpt is null.
    """
    asked = text_fn.page_words(F.concat_ws(" ", title, claim))
    heads = F.array_compact(F.array(F.concat(F.lit("Title: "), _said(title)), F.concat(F.lit("Snippet: "), _said(snippet))))
    parts = F.concat(heads, _ranked(_kept(paragraphs), asked, text_fn.page_words, 2))
    return _said(F.left(F.array_join(parts, "\n\n"), F.lit(most)))


def display_quote(title: Column, claim: Column, paragraphs: Column, most: int = MOST) -> Column:
    """The paragraph that shares most words with the claim, or without one the title; the first one without either.

    A paragraph counts to ``most``, blank ones not at all. Null if none shares a word.
    """
    asked = F.coalesce(_said(_trim(claim)), _said(_trim(title)))
    kept = _kept(paragraphs, lambda p: F.left(p, F.lit(most)), lambda p: _trim(p) != "")
    best = F.try_element_at(_ranked(kept, text_fn.page_words(asked), text_fn.page_words), F.lit(1))
    return F.when(asked.isNull(), F.try_element_at(kept, F.lit(1))).otherwise(best)


def topic_passages(question: Column, paragraphs: Column, most: int = PASSAGES, longest: int = LONGEST) -> Column:
    """The ``most`` different paragraphs that share most words with a question, each cut at ``longest``, with a blank line between.

    Paragraphs are trimmed; equal ones count once. Null if none shares a word.
    """
    ranked = _ranked(F.array_distinct(_kept(paragraphs, _trim)), text_fn.passage_words(question), text_fn.passage_words)
    return _said(F.left(F.array_join(F.transform(F.slice(ranked, 1, most), lambda p: F.left(p, F.lit(longest))), "\n\n"), F.lit(MOST)))
