from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from tracewell.functions import dates, text, urls


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_canonical_url(spark):
    cases = {
        "HTTPS://www.Example.com:443/a/b/?utm_source=x&b=2&a=1&gclid=3#top": "https://example.com/a/b?a=1&b=2",
        "http://example.com": "http://example.com/",
        "http://example.com/?ref=x": "http://example.com/?ref=x",
        "http://example.com:8080/a//": "http://example.com:8080/a",
        "ftp://example.com/a": None,
        "not a url": None,
        None: None,
    }
    assert column(spark, list(cases), urls.canonical) == list(cases.values())


def test_safe_reference(spark):
    cases = {
        "https://example.com/a": True,
        "https://user@example.com/a": False,
        "https://example.com/?access_token=1": False,
        "http://localhost/a": False,
        "http://printer.local/a": False,
        "http://10.1.2.3/a": False,
        "http://8.8.8.8/a": True,
        "http://192.168.0.1/": False,
        "http://nodots/": False,
        None: False,
    }
    assert column(spark, list(cases), urls.safe_reference) == list(cases.values())


def test_partial_dates(spark):
    cases = {
        "2024-02-29": ("2024-02-29", "day"),
        "2023-02-29": None,
        "2023-02": ("2023-02", "month"),
        "2023-13": None,
        "1999": ("1999", "year"),
        "2020-01-05T10:00:00Z": ("2020-01-05", "day"),
        "soon": None,
        None: None,
    }
    got = column(spark, list(cases), dates.parse)
    assert [None if r is None else (r["value"], r["precision"]) for r in got] == list(cases.values())


def test_relative_dates_stay_coarse(spark):
    day = F.lit(datetime.date(2024, 3, 31))
    got = column(spark, ["3 days ago", "1 month ago", "2 years ago", "2 weeks ago", "later"], lambda v: dates.parse_relative(v, day))
    assert [None if r is None else tuple(r) for r in got] == [
        ("2024-03-28", "day"), ("2024-02", "month"), ("2022", "year"), ("2024-03-17", "day"), None,
    ]


def test_month_must_wholly_predate(spark):
    claim = F.lit(datetime.date(2020, 5, 20))
    rows = spark.createDataFrame([("2020-05", "month"), ("2020-04", "month"), ("2020-05-18", "day"), ("2020-05-19", "day")], "v string, p string")
    assert [r[0] for r in rows.select(dates.predates(F.col("v"), F.col("p"), claim)).collect()] == [False, True, True, False]


def test_attribution(spark):
    cases = {
        "This was originally published by the Daily Herald, and more": "name:daily herald",
        "Syndicated from news.example.com. More": "name:news",  # a capture ends at a full stop
        "Syndicated from xy. Courtesy of the Herald": None,  # the first phrase decides
        "courtesy of one two three four five": None,
        "nothing here": None,
    }
    assert column(spark, list(cases), text.origin_key) == list(cases.values())


def test_credits_are_voided(spark):
    cases = {
        "The photo was released by Reuters. It shows a bridge.": ["reuters"],
        "The photo was not released by Reuters.": [],
        "Reported by Jane Doe for the Herald. This attribution is false.": [],
        "Reported by Jane Doe for the Herald. It rained.": ["herald"],
        "The photo was published by Reuters.": [],
    }
    # Names compare by their keys, as a capture may end with the sentence's full stop.
    keys = column(spark, list(cases), lambda v: F.transform(text.named_credits(v), text.name_key))
    assert keys == list(cases.values())


def test_sentences_join_abbreviations(spark):
    got = column(spark, ["Dr. Who came. He left.", "", None], text.joined_sentences)
    assert got == [["Dr. Who came.", "He left."], [], None]


def test_shingles_and_phrases(spark):
    assert column(spark, ["One two, three four FIVE six", "a b c d", ""], text.shingles) == [
        ["one two three four five", "two three four five six"], [], [],
    ]
    assert column(spark, ["Ｆｕｌｌ  Width—x", None], text.phrase) == ["full width x", None]


def test_cues(spark):
    got = column(spark, ["an old photo of it", "a photo", "an old house", None], text.historical_media_cue)
    assert got == [True, False, False, False]


def test_credits_look_for_words_before_patterns(spark):
    """Patterns run only in texts and sentences with a word of theirs, whatever its case, and give what they gave on every sentence."""
    said = [
        "ORIGINALLY PUBLISHED BY Wire News, today.", "Courtesy OF the Post.", "It was first seen. First Reported in Herald; more.", "A photo was released by Agency One.",
        "Nobody said that the photo was released by Agency One.", "A video issued by Coast Agency. That credit is false. Filed by Jane Doe for the Globe.",
        "Image was published\nby Tribune.", "Nothing at all. By and by!", "", "\u212aeep: syndicated from Herald.", "Not so. Photo published by Post.",
    ]
    texts = said + [" ".join(pair) for pair in zip(said, said[1:])] + [None]

    def plain(value):
        if value is None:
            return None
        every = [s for s in re.split(r"(?<=[.!?])\s+|\n+", value) if s.strip(" ")]
        ok = [s for s, after in zip(every, [*every[1:], ""]) if not re.search(text._NEGATION, s) and not re.search(text._DISCLAIMER, after)]
        found = lambda p: [m for s in ok for m in re.findall(p, s)]
        return found(text._MEDIA), found(text._HOSTING), found(text._BYLINE), [s.strip() for s in ok if any(re.search(p, s) for p in text._ATTRIBUTION)]

    got = column(spark, texts, lambda v: F.struct(text.credits(v), text.origin_key(v).alias("origin")))
    assert [r[0] and (r[0]["media"], r[0]["hosting"], r[0]["bylines"], r[0]["said"]) for r in got[:-1]] == [plain(t) for t in texts[:-1]]
    firsts = [next((m[1] for p in text._ATTRIBUTION if (m := re.search(p, t))), None) for t in texts[:-1]]
    assert [(r["origin"] is None) for r in got[:-1]] == [f is None for f in firsts] and got[-1]["origin"] is None
    plan = spark.createDataFrame([("x",)], "v string").select(text.origin_key(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan
