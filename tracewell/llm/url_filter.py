"""URL filters: host and path rules, and a logistic regression for the rest.

DataFrame functions only. The regression reads hashed character n-grams of host
and path and is fitted by pyspark.ml on a small labelled URL table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER

BUCKETS = 2_048
SIZES = (3, 4, 5)

#: The labelled URL table: invented addresses; the words in them carry the label.
BLOCKED = """
https://casino-royal.example.com/en/12            http://www.online-casino.example.net/play/roulette
https://bet365win.example.org/bets/live           http://free-bets.example.net/fr/77
https://free-spins.example.com/slots/88           http://m.jackpot-win.example.org/de/casino
https://poker-win.example.net/en/tables           https://www.lucky-slots.example.com/win/9
http://cheap-pills.example.org/en/4               https://blog.cheap-meds.example.com/pills/blue
https://pharmacy-pills.example.net/buy/cheap      http://www.diet-pills.example.com/es/31
https://cheap-viagra.example.net/order            http://spam-site.example.com/fr/10
https://www.spam-farm.example.org/en/61           http://link-farm.example.net/links/1
https://seo-spam.example.com/backlinks            http://m.content-farm.example.org/de/8
https://adult-video.example.com/en/5              http://adult-x.example.net/watch/18
https://www.xxx-adult.example.org/cams            http://m.adult-chat.example.com/es/3
https://ads-track.example.com/pixel/1             http://adserver.example.net/track/click
https://www.track-ads.example.org/banner          http://click-track.example.com/ads/99
https://popup-ads.example.net/en/7                http://m.ads-farm.example.org/fr/15
https://free-money.example.com/win/cash           http://www.win-prize.example.net/free/iphone
https://casino-bonus.example.org/en/free          http://blog.bets-tips.example.com/casino
"""
ALLOWED = """
https://news.example.com/en/12                    http://www.library.example.net/catalogue/9
https://blog.garden.example.org/en/7              http://m.weather.example.com/fr/77
https://university.example.org/courses/88         http://www.museum.example.net/de/visit
https://m.kitchen.example.com/recipes/4           http://history.example.net/en/tables
https://blog.travel.example.org/es/31             http://www.science.example.com/papers/10
https://gallery.example.com/exhibitions/5         http://canoe-club.example.net/fr/members
https://www.stationery.example.org/pens           http://blog.orchard.example.com/apples/8
https://m.botany.example.net/herbarium            http://seminar.example.org/en/18
https://docs.example.com/guide/1                  http://forum.example.net/thread/99
https://www.city.example.org/council              http://m.hospital.example.com/wards
https://school.example.net/fr/15                  http://blog.music.example.com/albums/2
https://www.wiki.example.org/page/cash            http://archive.example.net/2020/05
https://theatre.example.com/plays                 http://www.farmers.example.org/market
https://observatory.example.net/telescopes.html   http://blog.marathon.example.com/results/2019/
https://www.reading.example.org/books             http://fencing.example.net/lessons
https://m.station.example.com/departures          http://m.nation.example.net/politics
https://tax-office.example.net/forms/177          http://motion.example.net/physics/498/
https://m.soap-maker.example.org/lavender         http://m.opinion.example.com/letters/760
https://charity.example.net/es/donate             http://lighthouse.example.net/tours
https://m.brother-printers.example.net/drivers    http://m.climate.example.org/de/372/
https://portions.example.net/soup.html            http://fashion.example.net/autumn
https://m.gardening.example.com/plants/roses/     http://m.bakery.example.net/bread.html
https://www.painting.example.com/oil/landscape    http://blog.sailing.example.net/harbour
https://fishing.example.net/rivers/trout.html     http://parliament.example.net/debates/350/
https://m.other-stories.example.org/essays        http://mother-and-child.example.net/advice
https://m.train-times.example.com/fr/571          http://relations.example.net/terms
https://www.teaching.example.org/es/804/          http://bishop.example.net/diocese
"""


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Rules make one expression; longer lists belong in a table that is joined.
MOST_RULES = 1_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without "://"."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)


def grams(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, each kept apart by its borders."""

    def of(text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        # A sequence runs backwards when its end is below its start.
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    sides = [F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("/^"), path, F.lit("$"))]
    found = F.concat(*[of(side, n) for side in sides for n in SIZES])
    return F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(url, 1.0) for url in BLOCKED.split()] + [(url, 0.0) for url in ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """(weight of each bucket, intercept) from a small table (url, label)."""
    host, path = host_and_path(F.col("url"))
    counts = F.array_sort(grams(F.col("host"), F.col("path")))
    x = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.when(F.array_contains(F.col("buckets"), b), 1.0).otherwise(0.0),
    )
    rows = (
        labelled.select("url", F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path"))
        .select("url", "label", counts.alias("buckets"))
        .orderBy("url", "label")
        .select("label", array_to_vector(x).alias("features"))
    )
    model = LogisticRegression(regParam=0.01, elasticNetParam=0.0, maxIter=60, standardization=False).fit(rows)
    return [round(float(w), 5) for w in model.coefficients], round(float(model.intercept), 5)


def probability(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """Probability that a URL is one to block. A bucket that occurs more than once counts once."""
    table = F.lit(weights)
    total = F.aggregate(
        F.array_distinct(grams(host, path)), F.lit(float(intercept)), lambda sum_, b: sum_ + F.element_at(table, b + 1)
    )
    return 1 / (1 + F.exp(-total))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; the first given wins among equally long ones."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule string, verdict string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, block_at: float = 0.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every page.

    A null URL, or one without "://", has empty host and path and is judged by
    the regression like any other that no rule fits; very long URLs are read
    whole. Repeated rows each get their row, an empty table none; further
    columns, whatever their names, are left out.
    """
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    weights, intercept = train(labelled)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    score = probability(F.col("host"), F.col("path"), weights, intercept)
    return parts.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(score >= block_at, "block").otherwise("allow")).alias("verdict"),
        F.round(score, 6).alias("block_score"),
    )
