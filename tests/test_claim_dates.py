"""Dates that texts state, against the cases one by one and a plain walk over each whole text."""

from __future__ import annotations

import calendar
import datetime
import re

from pyspark.sql import functions as F

from tracewell.functions import dates
from tracewell.plans import origins

CASES = {
    "seen on 2020-05-04, in 2020": ("2020-05-04", "day", None),
    "between 2019 and 2021": (None, None, "year_range"),
    "from 2019-2021": (None, None, "year_range"),
    "on 03/04/2020": (None, None, "ambiguous_number"),
    "on 13/04/2020": ("2020-04-13", "day", None),
    "on 04/13/2020": ("2020-04-13", "day", None),
    "on 2020.03.04 it was": (None, None, None),
    "nothing": (None, None, None),
    "": (None, None, None),
    "in 2020-05": (None, None, "year_range"),  # as it may end in 2005
    "seen 2020-05": ("2020-05", "month", None),
    "in 2020 households": (None, None, None),
    "in the year 2020 households": ("2020", "year", None),
    "in 2020, 30 households": ("2020", "year", None),
    "in 2020, 2021.": (None, None, "year_range"),
    "Copyright Someone, in 2020. Seen in 2021.": ("2021", "year", None),
    "Feb 29th, 2020": ("2020-02-29", "day", None),
    "Feb 29th, 2021": (None, None, "impossible_day"),
    "2021-13": (None, None, "impossible_day"),
    "the 3rd of Sept. 2020, and in September 2020": ("2020-09-03", "day", None),
    "March 5 through 8, 2020": (None, None, "day_range"),
    "March 5 to March 8, 2020": (None, None, "day_without_year"),
    "May 5 and then May 2020": (None, None, "day_without_year"),
    "May 2020 and June 2020": (None, None, "several_dates"),
    "today, as in 1999 times": (None, None, "year_lost"),
    "yesterday": ("2021-03-05", "day", None),
    "3 weeks ago": ("2021-02-13", "day", None),
    "1 month ago": ("2021-02", "month", None),
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMES = "january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|september|sept|sep|october|oct|november|nov|december|dec"


def test_cases(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", dates.claim_date(F.col("t"), F.lit(datetime.date(2021, 3, 6))).alias("d"))
    assert {r["t"]: tuple(r["d"]) for r in rows.collect()} == CASES
    assert spark.createDataFrame([(None,)], "t string").select(dates.claim_date(F.col("t")).alias("d")).first()["d"] is None


def _ends(text: str) -> bool:
    return re.match(r"\s*(?:\Z|[.,;:!?)\]]|(?:and|or|but)\b)", text, re.I | re.A) is not None


def walk(text: str, asked: datetime.date):
    """(value, precision, refusal) by one scan for each rule, with the text before and after each match at hand."""
    dash = r"\-–—‑‒―−"
    for m in re.finditer(rf"\b(\d\d?)\s*([/.{dash}])\s*(\d\d?)(\s*[/.{dash}]\s*\d{{2,4}})?\b", text, re.A):
        if (m[2] in "/." or m[4]) and not re.search(r"\d{4}\s*[/.-]\s*$", text[: m.start()][-30:], re.A) and int(m[1]) <= 12 and int(m[3]) <= 12:
            return None, None, "ambiguous_number"
    if re.search(rf"\b(?:{NAMES})\.?\s+\d\d?(?:st|nd|rd|th)?\s*(?:[{dash}]|to|through|thru|and)\s*\d\d?(?:st|nd|rd|th)?\b", text, re.I | re.A):
        return None, None, "day_range"
    years = rf"\b(?:in|during|throughout|from|between)\s+(?:the\s+years?\s+)?\d{{4}}\s*([{dash}/,]|to|through|thru|and|or)\s*(?:in\s+)?(?:\d{{4}}|\d\d)\b(?!\s*[-/.]\s*\d)"
    if any(m[1] != "," or _ends(text[m.end() :]) for m in re.finditer(years, text, re.I | re.A)):
        return None, None, "year_range"
    values, rest, last = [], "", 0
    for m in re.finditer(rf"\b(?:in|during|throughout)\s+(the\s+year\s+)?(\d{{4}})\b(?!\s*[/.{dash}]\s*\d)", text, re.I | re.A):
        clause = re.split(r"[.!?\n]", text[: m.start()])[-1]
        if not re.search(r"\bcopyright|©|\(c\)", clause, re.I | re.A) and (m[1] or _ends(text[m.end() :])):
            values.append(m[2])
        rest, last = rest + text[last : m.start()] + " ", m.end()
    rest += text[last:]
    nth, month = "(?:st|nd|rd|th)?", f"({NAMES})"
    for pattern, order in (
        (r"\b(\d{4})-(\d\d)-(\d\d)(?:(?=[T ])|(?!\w))", "ymd"), (r"\b(\d{4})-(\d\d)\b(?!-)", "ym"),
        (rf"\b{month}\.?\s+(\d\d?){nth},?\s+(\d{{4}})\b", "mdy"), (rf"\b(\d\d?){nth}\s+(?:of\s+)?{month}\.?,?\s+(\d{{4}})\b", "dmy"), (rf"\b{month}\.?,?\s+(\d{{4}})\b", "my"),
        (r"\b(1[3-9]|[23]\d)[/.-](0?[1-9]|1[0-2])[/.-](\d{4})\b", "dmy"), (r"\b(0?[1-9]|1[0-2])[/.-](1[3-9]|[23]\d)[/.-](\d{4})\b", "mdy"),
    ):
        for m in re.finditer(pattern, rest, re.I | re.A):
            part = dict(zip(order, m.groups(), strict=True))
            n = int(part["m"]) if part["m"].isdigit() else MONTHS.index(part["m"][:3].lower()) + 1
            values.append(f"{part['y']}-{n:02}" + (f"-{int(part['d']):02}" if "d" in part else ""))
        rest = re.sub(pattern, " ", rest, flags=re.I | re.A)
    for m in re.finditer(r"\b(?:today|yesterday|(\d{1,3})\s+(minute|hour|day|week|month|year)s?\s+ago)\b", rest, re.I | re.A):
        unit, k = (m[2] or "").lower(), int(m[1] or (m[0].lower() == "yesterday"))
        if unit in ("month", "year"):
            at = asked.year * 12 + asked.month - 1 - k * (12 if unit == "year" else 1)
            values.append(f"{at // 12:04}-{at % 12 + 1:02}" if unit == "month" else f"{at // 12:04}")
        else:
            values.append(str(asked - datetime.timedelta(days=k * {"week": 7, "minute": 0, "hour": 0}.get(unit, 1))))
    for v in values:
        y, m, d = (*map(int, v.split("-")), 1, 1)[:3]
        if not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(max(y, 1), m)[1]:
            return None, None, "impossible_day"
    if re.search(rf"\b(?:(?:{NAMES})\.?\s+\d\d?{nth}\b|\d\d?{nth}\s+(?:of\s+)?(?:{NAMES})\b)", rest, re.I | re.A):
        return None, None, "day_without_year"
    if not values:
        return None, None, None
    best = max(values, key=len)
    if any(not best.startswith(v) for v in values):
        return None, None, "several_dates"
    stated = re.findall(r"\b\d{4}\b", text, re.A)
    if stated and best[:4] not in stated:
        return None, None, "year_lost"
    return best, {4: "year", 7: "month", 10: "day"}[len(best)], None


def test_whole_texts_equal_a_plain_walk(spark, small):
    texts = {r["claim_id"]: r for r in origins.claim_texts(spark, small).collect()}
    got = {r["claim_id"]: (r["value"], r["precision"], r["refusal"]) for r in origins.claim_dates(spark, small).collect()}
    assert got == {i: walk(r["text"], r["asked"]) for i, r in texts.items()}
    assert len({v[2] for v in got.values()}) >= 7 and len({v[1] for v in got.values()}) == 4


def test_far_from_digits_nothing_is_read(spark):
    """What is far from every digit isn't looked at, but for copyright marks, words for days and wide white space, which count over any distance."""
    far = "plain words of no date and the like, " * 30
    cases = {
        f"{far}It was taken on March 5, 2021. {far}": ("2021-03-05", None),
        f"{far}taken in March{' ' * 200}2021. {far}": ("2021-03", None),
        f"Copyright {far}in 2021.": (None, None),
        f"{far}yesterday, {far}": ("2021-03-05", None),
        f"{far}in 2020. {far} It was seen in 2021. {far}": (None, "several_dates"),
        f"{far}It was in 2021{' ' * 100}": ("2021", None),
        f"{far}throughout the years 2019 and 2021 {far}": (None, "year_range"),
        far: (None, None),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    day = F.lit("2021-03-06").cast("date")
    got = rows.select("i", dates.claim_date(F.col("t"), day).alias("d"), F.length(dates._readable(F.col("t"))["text"]).alias("n")).orderBy("i").collect()
    assert [(r["d"]["value"], r["d"]["refusal"]) for r in got] == list(cases.values())
    assert got[0]["n"] < 600 and got[1]["n"] > 2 * len(far) and got[3]["n"] > 2 * len(far) and got[7]["n"] < 300
