"""Places that texts state, against cases one by one; the query is held against window SQL in test_queries."""

from __future__ import annotations

from tracewell.operators import places

NAMES = ("london", "new york", "new york city", "york", "sao tome", "north station", "mine", "west", "bar le duc sur", "in")
CASES = {
    "A fire in London.": [(3, "London", "gazetteer")],
    "It fell in New York City.": [(3, "New York City", "gazetteer")],
    "It fell in New. York City": [(3, "New York City", "gazetteer")],  # an end after the first word does not part a name
    "It fell in New York. City lights": [(3, "New York City", "gazetteer")],  # "city" is a noun that goes on with any place
    "in Bar le, duc sur": [],
    "London": [],
    "London is near": [],
    "in front of the White House": [],
    "next to the river": [(3, "river", "place_type_noun")],
    "in northern London": [(1, "northern London", "gazetteer")],
    "in northern northern hill road": [(1, "northern northern hill road", "place_type_noun")],
    "in North Station": [(1, "North Station", "gazetteer")],
    "in the São Tomé's market": [(2, "São Tomé's market", "gazetteer")],
    "at 12 High Street market": [(1, "12 High Street", "street_address")],
    "at north 12 High Street market": [(1, "north 12 High Street market", "street_address")],
    "at 221B Baker Street": [(1, "221B Baker Street", "street_address")],
    "at 12 High and Street": [],
    "at 12 High 13 Street": [],
    "at 12": [],
    "by the coal mine in mine mine": [(5, "mine", "gazetteer")],  # a noun that is a name does not go on
    "in the in London": [(3, "London", "gazetteer")],
    "in ... London": [],
    "in old - London": [],
    "in old North Station": [(1, "old North Station", "gazetteer")],
    "in old York": [(1, "old York", "gazetteer")],
    "in old big west": [(1, "old big west", "gazetteer")],
    "in old old nowhere": [],
    "from London to the beach, near York": [(1, "London", "gazetteer"), (6, "York", "gazetteer")],
    "in in in": [],
    "": [],
    " \n ": [],
}


def _found(spark, texts, names=NAMES):
    claims = spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")
    rows = places.stated_places(claims, spark.createDataFrame([(n,) for n in names], "place string")).collect()
    return {i: sorted((r["at"], r["place"], r["evidence"]) for r in rows if r["claim_id"] == i) for i in range(len(texts))}


def test_cases(spark):
    got = _found(spark, list(CASES))
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES


def test_odd_tables(spark):
    assert _found(spark, [None, "in London"], (None, "", "london", "london")) == {0: [], 1: [(1, "London", "gazetteer")]}
    empty = spark.createDataFrame([], "claim_id long, text string, place string, key string")
    names = spark.createDataFrame([("london", 1)], "place string, claim_id int")
    assert places.stated_places(empty, names).collect() == []
    rows = spark.createDataFrame([(1, "in London", "x", "y"), (1, "in London", "x", "y")], "claim_id long, text string, place string, key string")
    assert [tuple(r) for r in places.stated_places(rows, names).collect()] == [(1, 1, 1, "London", "gazetteer")]
    assert places.stated_places(rows, names.where("false")).collect() == []


def test_work_grows_with_the_text():
    """Texts of prepositions, modifiers and numbers alone give readings in proportion to their length."""
    nouns = frozenset(places.NOUNS)

    def characters(word: str, n: int) -> int:
        found = places.readings("in " + f"{word} " * n + "street", nouns, frozenset())
        return sum(len(r[5]) + len(r[6] or r[7] or "") for r in found)

    for word in ("within", "north", "12A", "over", "port", "in 12A"):
        assert characters(word, 20_000) <= 2.2 * characters(word, 10_000) + 100
