"""Excerpts, quotes and passages against a plain loop, over every extracted page and over odd rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracewell.functions import excerpts
from tracewell.functions import text as text_fn
from tracewell.plans import excerpts as plan


def _page(text):
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in text_fn.PAGE_STOP}


def _passage(text):
    return {w for w in re.findall(r"[^\W_]+", text.lower()) if (len(w) > 2 or re.fullmatch(r"\d+", w)) and w not in text_fn.PASSAGE_STOP}


def plain(title, snippet, claim, paragraphs):
    parts = [f"Title: {title}"] if title else []
    parts += [f"Snippet: {snippet}"] if snippet else []
    kept = [p for p in paragraphs or [] if p]
    query = _page(f"{title or ''} {claim or ''}")
    ranked = sorted(((-len(_page(p) & query), i, p) for i, p in enumerate(kept[2:])))
    parts += kept[:2] + [p for less, _, p in ranked if less < 0]
    excerpt = "\n\n".join(parts)[:8000] or None

    asked = (claim or "").strip() or (title or "").strip()
    quotes = [p[:8000] for p in kept if p[:8000].strip()]
    fit = sorted((-len(_page(p) & _page(asked)), i, p) for i, p in enumerate(quotes) if _page(p) & _page(asked))
    quote = next(iter(quotes), None) if not asked else fit[0][2] if fit else None

    wanted, seen = _passage(claim or ""), []
    for less, _, p in sorted((-len(_passage(p) & wanted), i, p.strip()) for i, p in enumerate(kept) if p.strip()):
        if less < 0 and p not in seen:
            seen.append(p)
    return excerpt, quote, "\n\n".join(p[:2400] for p in seen[:3])[:8000] or None


def _check(rows, key):
    held = {r[key]: (r["title"], r["snippet"], r["claim"], r["paragraphs"]) for r in rows.collect()}
    got = {r[0]: tuple(r)[1:] for r in plan._found(rows, key).collect()}
    assert got == {k: plain(*v) for k, v in held.items()}
    return got


def test_every_page(spark, small):
    got = _check(plan.page_view(spark, small), "page_id")
    assert {tuple(x is None for x in r) for r in got.values()} >= {(False, False, False), (False, False, True), (False, True, True)}


def test_odd_rows(spark):
    long = "alpha beta " * 2_000
    rows = [
        (1, None, None, None, None), (2, "", "", "", []), (3, "Bridge", None, "fire", ["first", "second", "nothing", "the bridge", "bridge fire"]),
        (4, None, "said", None, ["", " ", "one", "one"]), (5, None, None, "alpha", [long, " alpha", "alpha ", long, "beta", "alpha 12"]), (6, "  ", None, " \n", ["x"]),
        (7, None, None, "12 of 34", ["no 1", "in 12", "34 and 12", "12"]), (8, "the of", None, None, ["the of"]), (9, None, None, "alpha", [" " * 8_000 + "alpha", "zzz"]),
        (10, "t" * 9_000, None, None, ["x"]),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id int, title string, snippet string, claim string, paragraphs array<string>, p string")
    _check(frame, "id")
    assert plan._found(frame.where("false"), "id").collect() == []


def test_no_page_is_shuffled(spark, small):
    assert "Exchange" not in plan.page_excerpts(spark, small)._jdf.queryExecution().toString()


def test_nulls_in_paragraphs(spark):
    rows = spark.createDataFrame([(["a fire", None, "fire"],)], "p array<string>")
    assert rows.select(excerpts.topic_passages(F.lit("fire"), F.col("p"))).first()[0] == "a fire\n\nfire"
