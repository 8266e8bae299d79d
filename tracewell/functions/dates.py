"""Partial dates: YYYY, YYYY-MM or YYYY-MM-DD with a stated precision.

A coarse date is never promoted to a finer one; comparisons use the whole
interval that it covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Finest first.
PRECISIONS = ("day", "month", "year")


def day_start(value: Column, precision: Column) -> Column:
    """First day that a partial date covers, as YYYY-MM-DD."""
    return (
        F.when((precision == "month") & value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01")))
        .when((precision == "year") & value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01")))
        .otherwise(value)
    )


def day_end(value: Column, precision: Column) -> Column:
    """Last day that a partial date covers, itself included, as YYYY-MM-DD."""
    month_end = F.date_format(F.last_day(F.try_to_date(F.concat(value, F.lit("-01")), "yyyy-MM-dd")), "yyyy-MM-dd")
    return (
        F.when((precision == "month") & value.rlike(r"^\d{4}-\d{2}$"), month_end)
        .when((precision == "year") & value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-12-31")))
        .otherwise(value)
    )


def end_exclusive(value: Column, precision: Column) -> Column:
    """The day after the last one that a partial date covers, as a date."""
    return F.date_add(F.try_to_date(day_end(value, precision), "yyyy-MM-dd"), 1)


def parse(raw: Column) -> Column:
    """struct(value, precision) of an ISO text; null where it is none or no real day.

    Takes YYYY, YYYY-MM, YYYY-MM-DD and instants that start with a day.
    """
    text = F.trim(raw)
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    month = F.regexp_extract(text, r"^(\d{4}-(?:0[1-9]|1[0-2]))$", 1)
    year = F.regexp_extract(text, r"^(\d{4})$", 1)
    pair = lambda v, p: F.struct(v.alias("value"), F.lit(p).alias("precision"))
    return (
        F.when((day != "") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), pair(day, "day"))
        .when(month != "", pair(month, "month"))
        .when(year != "", pair(year, "year"))
    )


def parse_relative(raw: Column, reference: Column) -> Column:
    """struct(value, precision) of "n units ago" against a reference date; months and years stay coarse."""
    n = F.regexp_extract(F.lower(raw), r"^\s*(\d{1,3})\s+(?:minute|hour|day|week|month|year)s?\s+ago\s*$", 1)
    unit = F.regexp_extract(F.lower(raw), r"^\s*\d{1,3}\s+(minute|hour|day|week|month|year)s?\s+ago\s*$", 1)
    k = F.when(n != "", n.cast("int"))
    days = F.when(unit == "day", k).when(unit == "week", k * 7).when(unit.isin("minute", "hour"), F.lit(0))
    day, month = F.date_sub(reference, days), F.add_months(reference, -k)
    return (
        F.when(days.isNotNull(), F.struct(F.date_format(day, "yyyy-MM-dd").alias("value"), F.lit("day").alias("precision")))
        .when(unit == "month", F.struct(F.date_format(month, "yyyy-MM").alias("value"), F.lit("month").alias("precision")))
        .when(
            unit == "year",
            F.struct(F.date_format(F.add_months(reference, -12 * k), "yyyy").alias("value"), F.lit("year").alias("precision")),
        )
    )


# Word ends as in ASCII, whatever the letters beside them.
_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# What joins the ends of a range, and the phrases that state a year.
_DASH = r"[\-–—‑‒―−]"
_MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?"
    r"|dec(?:ember)?)"
)
_NTH = r"(?:st|nd|rd|th)?"
_NUMBERS = _START + r"(?=\d)(?:(?<=(\d{4})\s{0,8}[/.-]\s{0,8}))?(\d{1,2})\s*([/.]|" + _DASH + r")\s*(\d{1,2})(\s*(?:[/.]|" + _DASH + r")\s*\d{2,4})?" + _END
_DAY_RANGE = r"(?i)" + _START + _MONTH + r"\.?\s+\d{1,2}" + _NTH + r"\s*(?:" + _DASH + r"|to|through|thru|and)\s*\d{1,2}" + _NTH + _END
_CLAUSE_END = r"\s*(?:\z|[.,;:!?)\]]|(?:and|or|but)" + _END + ")"
_YEAR_RANGE = (
    r"(?i)" + _START + r"(?:in|during|throughout|from|between)\s+(?:the\s+years?\s+)?\d{4}\s*(" + _DASH + r"|/|to|through|thru|and|or|,)\s*"
    r"(?:in\s+)?(?:\d{4}|\d{2})" + _END + r"(?!\s*[-/.]\s*\d)(?:(?=" + _CLAUSE_END + r")(?<=(\d)))?"
)
_IN_YEAR = r"(?i)" + _START + r"(?:in|during|throughout)\s+(the\s+year\s+)?(\d{4})" + _END + r"(?!\s*(?:" + _DASH + r"|[/.])\s*\d)(?:(?=" + _CLAUSE_END + r")(?<=(\d)))?"
_COPYRIGHT = r"(?i)(?:" + _START + r"copyright|©|\(c\))[^.!?\n]*"
# Forms of dates in a text, each taken out before the next is looked for: (pattern, year, month, day by group).
_FORMS = (
    (_START + r"(\d{4})-(\d{2})-(\d{2})(?=[T ]|" + _END + ")", 1, 2, 3),
    (_START + r"(\d{4})-(\d{2})" + _END + r"(?!-)", 1, 2, None),
    (r"(?i)" + _START + "(" + _MONTH + r")\.?\s+(\d{1,2})" + _NTH + r",?\s+(\d{4})" + _END, 3, 1, 2),
    (r"(?i)" + _START + r"(\d{1,2})" + _NTH + r"\s+(?:of\s+)?(" + _MONTH + r")\.?,?\s+(\d{4})" + _END, 3, 2, 1),
    (r"(?i)" + _START + "(" + _MONTH + r")\.?,?\s+(\d{4})" + _END, 2, 1, None),
    (_START + r"(1[3-9]|[23]\d)[/.-](0?[1-9]|1[0-2])[/.-](\d{4})" + _END, 3, 2, 1),
    (_START + r"(0?[1-9]|1[0-2])[/.-](1[3-9]|[23]\d)[/.-](\d{4})" + _END, 3, 1, 2),
)
_NO_YEAR = r"(?i)" + _START + "(?:" + _MONTH + r"\.?\s+\d{1,2}" + _NTH + _END + r"|\d{1,2}" + _NTH + r"\s+(?:of\s+)?" + _MONTH + _END + ")"
_RELATIVE = r"(?i)" + _START + r"(?:today|yesterday|\d{1,3}\s+(?:minute|hour|day|week|month|year)s?\s+ago)" + _END


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern as structs (m, g): the match, and a group that needs what is around it, empty if missing."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))


def _month_number(name: Column) -> Column:
    at = F.position(F.left(F.lower(name), F.lit(3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.when(name.rlike(r"^\d+$"), F.lpad(name, 2, "0")).otherwise(F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"))


def _iso(pattern: str, year: int, month: int, day: int | None) -> Callable[[Column], Column]:
    """A match's YYYY-MM or YYYY-MM-DD from its groups."""
    of = lambda m, g: F.regexp_extract(m, pattern, g)
    return lambda m: F.concat_ws("-", of(m, year), _month_number(of(m, month)), *([F.lpad(of(m, day), 2, "0")] if day else []))


def _taken(pattern: str, iso: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step that takes the dates of one form out of struct(rest, values), with one scan where there are none."""

    def step(s: Column) -> Column:
        more = lambda found: F.struct(F.regexp_replace(s["rest"], pattern, " ").alias("rest"), F.concat(s["values"], F.transform(found, iso)).alias("values"))
        return let(F.regexp_extract_all(s["rest"], F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, more(found)).otherwise(s))

    return step


def _read(rest: Column, values: Column) -> Column:
    """struct(rest, values): the dates of every form added to the values, and the text without them."""
    state = F.struct(rest.alias("rest"), values.alias("values"))
    for pattern, year, month, day in _FORMS:
        state = let(state, _taken(pattern, _iso(pattern, year, month, day)))
    return state


#: Characters kept on either side of a digit: no pattern reaches further, unless a run of white space has SPACES or more.
NEAR, SPACES = 120, 24


def _near_digits(text: Column) -> Column:
    """The text without what is far from every digit; a mark that no pattern matches stands for each part."""
    return F.regexp_replace(text, rf"(?<![^0-9])([^0-9]{{{NEAR}}})[^0-9]*([^0-9]{{{NEAR}}})", "$1\u0002$2")


def _readable(text: Column) -> Column:
    """struct(text, owned): what the patterns for dates need of a text, and of one without its copyright lines.

    Every pattern but those of "today" and "yesterday" has a digit.
    """

    def of(low: Column) -> Column:
        whole = low.contains("today") | low.contains("yesterday") | text.rlike(rf"\s{{{SPACES}}}")
        near = lambda t: F.when(whole, t).otherwise(_near_digits(t))
        marked = low.contains("copyright") | low.contains("©") | low.contains("(c)")
        owned = lambda t: F.when(marked, near(F.regexp_replace(text, _COPYRIGHT, "\u0001"))).otherwise(t)
        return let(near(text), lambda t: F.struct(t.alias("text"), owned(t).alias("owned")))

    return let(F.lower(text), of)


def claim_date(text: Column, reference: Column | None = None) -> Column:
    """struct(value, precision, refusal) of the one date that a text states; null where the text is.

    A year counts in a phrase ("in 2020", before a connector or a clause's end, or "in the
    year 2020"), not after a copyright mark. Beside ISO days and months count days and months
    with the month's English name and a year, numeric days of which one number is over 12, and
    against a ``reference`` date "today", "yesterday" and "n units ago". All readings must
    agree with the finest one ("2020", "2020-05"), else there is no date. The refusals:
    ambiguous_number (day and month could be swapped), day_range, year_range, impossible_day,
    day_without_year, several_dates, year_lost (the text states other years only); without any
    reading value and refusal are both null.
    """
    reference = F.lit(None).cast("date") if reference is None else reference
    return F.when(text.isNotNull(), let(_readable(text), lambda t: _claim_date(t["text"], t["owned"], reference)))


def _claim_date(text: Column, owned: Column, reference: Column) -> Column:
    number = r"^(\d{1,2})\s*(\D)\s*(\d{1,2})(.*)$"
    part = lambda m, g: F.regexp_extract(m["m"], number, g)
    small = lambda m, g: part(m, g).cast("int") <= 12
    swapped = lambda m: (m["g"] == "") & (part(m, 2).isin("/", ".") | (part(m, 4) != "")) & small(m, 1) & small(m, 3)
    ambiguous = F.exists(_matches(text, _NUMBERS, 1), swapped)
    year_range = F.exists(_matches(text, _YEAR_RANGE, 2), lambda m: (m["g"] != "") | ~m["m"].contains(","))
    phrases = _matches(owned, _IN_YEAR, 3)
    years = F.transform(F.filter(phrases, lambda p: (p["g"] != "") | p["m"].rlike(r"(?i)\syear\s")), lambda p: F.right(p["m"], F.lit(4)))

    def relative(rest: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(rest, F.lit(_RELATIVE), F.lit(0)),
            lambda r: F.when(F.lower(r) == "today", F.date_format(reference, "yyyy-MM-dd"))
            .when(F.lower(r) == "yesterday", F.date_format(F.date_sub(reference, 1), "yyyy-MM-dd"))
            .otherwise(parse_relative(r, reference)["value"]),
        )

    stated = F.regexp_extract_all(text, F.lit(_START + r"(\d{4})" + _END), F.lit(1))
    real = lambda v: F.when(F.length(v) == 10, F.try_to_date(v, "yyyy-MM-dd").isNotNull()).when(F.length(v) == 7, F.right(v, F.lit(2)).between("01", "12")).otherwise(F.lit(True))

    def settled(values: Column, bare: Column) -> Column:
        finest = F.try_element_at(F.array_sort(values, lambda x, y: F.length(y) - F.length(x)), F.lit(1))
        reason = (
            F.when(ambiguous, "ambiguous_number")
            .when(text.rlike(_DAY_RANGE), "day_range")
            .when(year_range, "year_range")
            .when(F.exists(values, lambda v: ~real(v)), "impossible_day")
            .when(bare, "day_without_year")
            .when(~F.forall(values, lambda v: F.startswith(finest, v)), "several_dates")
            .when((F.size(values) > 0) & (F.size(stated) > 0) & ~F.array_contains(stated, F.left(finest, F.lit(4))), "year_lost")
        )
        precision = F.when(F.length(finest) == 10, "day").when(F.length(finest) == 7, "month").when(finest.isNotNull(), "year")
        return let(reason, lambda r: F.struct(F.when(r.isNull(), finest).alias("value"), F.when(r.isNull(), precision).alias("precision"), r.alias("refusal")))

    def judged(s: Column) -> Column:
        values = F.array_distinct(F.array_compact(F.concat(s["values"], relative(s["rest"]))))
        return let(values, lambda v: settled(v, s["rest"].rlike(_NO_YEAR)))

    return let(_read(F.regexp_replace(text, _IN_YEAR, " "), years), judged)


def disagree(a_value: Column, a_precision: Column, b_value: Column, b_precision: Column) -> Column:
    """Whether two partial dates contradict each other: two days by more than one day, others on their common prefix."""
    both_days = (a_precision == "day") & (b_precision == "day")
    apart = F.abs(F.datediff(F.try_to_date(a_value, "yyyy-MM-dd"), F.try_to_date(b_value, "yyyy-MM-dd"))) > 1
    common = F.least(F.length(a_value), F.length(b_value))
    return F.when(both_days, apart).otherwise(F.left(a_value, common) != F.left(b_value, common))


def predates(value: Column, precision: Column, claim_day: Column) -> Column:
    """Whether a date lies before a claim by over a day: a day by its start, a coarser one by its end."""
    last = F.when(precision == "day", day_start(value, precision)).otherwise(day_end(value, precision))
    return F.try_to_date(last, "yyyy-MM-dd") < F.date_sub(claim_day, 1)
