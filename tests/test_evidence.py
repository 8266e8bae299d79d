from __future__ import annotations

import random
import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import citations, evidence


def test_distributions_are_rejected_not_repaired(spark):
    cases = [
        ({"a": 0.6, "b": 0.4}, "a", True), ({"a": 0.6, "b": 0.4}, "b", False), ({"a": 0.6, "b": 0.5}, "a", False),
        ({"a": 1.0}, "a", False), ({"a": 0.5, "b": 0.5}, "b", True), ({"a": 0.6, "b": 0.3, "c": 0.1}, "a", False), (None, "a", False),
    ]
    rows = spark.createDataFrame(cases, "p map<string,double>, w string, want boolean")
    got = rows.withColumn("got", evidence.valid_distribution(F.col("p"), F.col("w"), ("a", "b"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_composite_excerpts(spark):
    rows = spark.createDataFrame([("Title: T\n\nSnippet: S\n\nbody\n\nmore",), ("Snippet: S\n\nbody",), ("body",), (None,)], "raw string")
    got = [tuple(r[0]) for r in rows.select(evidence.split_composite(F.col("raw"))).collect()]
    assert got == [("T", "S", "body\n\nmore"), (None, "S", "body"), (None, None, "body"), (None, None, None)]


def test_anchors(spark):
    rows = spark.createDataFrame([("abcdef", 2, "cd"), ("abcdef", 3, "cd"), ("abcdef", -1, "a"), (None, 0, "a")], "t string, s int, q string")
    got = [r[0] for r in rows.select(evidence.anchor_holds(F.col("t"), F.col("s"), F.col("q"))).collect()]
    assert got == [True, False, False, False]


def test_excerpt_order(spark):
    paragraphs = spark.createDataFrame([(1, 0, "first"), (1, 1, "second"), (1, 2, "nothing"), (1, 3, "the bridge"), (1, 4, "bridge fire")], "page_id int, ord int, paragraph string")
    heads = spark.createDataFrame([(1, "Bridge", None, "fire"), (2, None, None, None)], "page_id int, title string, snippet string, claim string")
    got = {r[0]: r[1] for r in evidence.excerpt(paragraphs, heads).collect()}
    assert got == {1: "Title: Bridge\n\nfirst\n\nsecond\n\nbridge fire\n\nthe bridge", 2: None}


def test_places(spark):
    claims = spark.createDataFrame([(1, "A fire in New York City near Boston, not Paris")], "claim_id int, text string")
    lexicon = spark.createDataFrame([("new york",), ("new york city",), ("boston",), ("paris",)], "place string")
    assert sorted(r["place"] for r in evidence.place_spans(claims, lexicon).collect()) == ["boston", "new york city"]


def test_registrable_domains(spark):
    rules = spark.createDataFrame([("com", "plain"), ("co.uk", "plain"), ("uk", "plain"), ("ck", "wildcard"), ("www.ck", "exception")], "suffix string, kind string")
    cases = {"a.b.com": "b.com", "x.y.co.uk": "y.co.uk", "a.b.c.ck": "b.c.ck", "www.ck": "www.ck", "q.zz": "q.zz", "10.0.0.1": "10.0.0.1", "com": "com"}
    got = evidence.registrable_domain(spark.createDataFrame([(h,) for h in cases], "host string"), rules)
    assert {r["host"]: r["domain"] for r in got.collect()} == cases


def test_frame_scores(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(30, 200, (24, 24)).astype(np.uint8)
    other, flat = rng.integers(30, 200, (24, 24)).astype(np.uint8), np.full((24, 24), 9, np.uint8)
    pairs = [(1, a, a), (2, a, a + 20), (3, a, other), (4, flat, flat)]
    rows = spark.createDataFrame([(i, bytearray(x.tobytes()), bytearray(y.tobytes())) for i, x, y in pairs], "pair_id long, left binary, right binary")
    got = {r["pair_id"]: r["score"] for r in evidence.score_frames(rows).collect()}
    assert got[1] == 1 and got[2] == 1 and got[3] < 0.5 and got[4] == 0


def test_luminance_cut(spark):
    rows = [(1, t, [v, v], 6000) for t, v in ((0, 0.1), (1500, 0.1), (3000, 0.5), (4500, 0.5))] + [(2, t, [0.1], 4000) for t in (0, 2000, 3900)]
    got = evidence.luminance_cut(spark.createDataFrame(rows, "media_id int, ts_ms int, luma array<double>, duration_ms int"))
    assert {r["media_id"]: r["ts_ms"] for r in got.collect()} == {1: 3000, 2: 2000}


def walked(links, pool):
    """Follow-up one link at a time, as a reader of the pages would go through them."""
    out = []
    for inv in {x[0] for x in links}:
        own = [p for p in pool if p[0] == inv]
        classified, found = sum(p[3] for p in own), sum(p[2] in ("google_search", "source_link") for p in own)
        known = {u: (any(p[3] for p in own if p[1] == u), any(p[4] for p in own if p[1] == u)) for u in {p[1] for p in own}}
        chosen = False
        for link in sorted((x for x in links if x[0] == inv), key=lambda x: (-x[2], x[3], x[4], x[1] or "")):
            url, late = link[1], link[5]
            if late:
                state = "deadline"
            elif url in known and known[url][1]:
                state = "already_read"
            elif chosen:
                state = "page_limit"
            elif not (url in known and known[url][0]) and classified >= 24:
                state = "classification_limit"
            elif url is None or (url not in known and found >= 5):
                state = "retention_limit"
            else:
                state, chosen = "selected", True
                known[url] = (True, True)
            out.append((inv, url, link[3], link[4], state))
    return sorted(out, key=str)


def test_links_are_followed_as_by_a_walk(spark):
    rng = random.Random(2)
    url = lambda: f"u{rng.randrange(40)}"
    kinds = ("google_search", "source_link", "lens_exact", "google_news")
    pool = [(i, url(), rng.choice(kinds[i % 3 :]), rng.random() < 0.7, rng.random() < 0.1) for i in range(60) for _ in range(rng.randrange(50))]
    links = [(i, url() if rng.random() < 0.9 else None, rng.randrange(3) * 30, f"p{rng.randrange(3)}", n, rng.random() < 0.1) for i in range(61) for n in range(rng.randrange(12))]
    got = evidence.follow_links(
        spark.createDataFrame(links, "inv int, url string, relevance int, parent string, at int, late boolean"),
        spark.createDataFrame(pool, "inv int, url string, kind string, classified boolean, read boolean"),
    ).collect()
    assert sorted((tuple(r) for r in got), key=str) == walked(links, pool)
    assert len({r["state"] for r in got}) == 6


def test_read_audits(spark):
    fine = [("a", 1, "core_anchor", False, 0, False), ("b", 2, "fact_check", True, 80, True), ("c", 4, "filler", True, 0, False), ("d", None, None, False, 0, False)]
    cases = {
        1: (fine, 1, set()),
        2: (fine, 0, {"places_missing"}),
        3: ([*fine, ("e", 4, "support", True, 0, False)], 1, {"places_repeat"}),
        4: ([*fine, ("a", 3, "support", False, 0, True)], 0, {"ids_repeat", "role_without_judgment", "several_winners", "winner_without_judgment"}),
        5: ([("a", 9, "guess", True, 0, False)], 8, {"place_out_of_range", "unknown_role"}),
        6: ([("a", None, None, False, 0, False)], 0, set()),
    }
    rows = [(inv, *row, withheld) for inv, (found, withheld, _) in cases.items() for row in found]
    frame = spark.createDataFrame(rows, "inv int, evidence_id string, place int, role string, judged boolean, fact_check int, winner boolean, withheld int")
    got = evidence.read_selection_violations(frame, 5).collect()
    assert {inv: {r["rule"] for r in got if r["inv"] == inv} for inv in cases} == {inv: want for inv, (_, _, want) in cases.items()}


def test_relations_need_a_quote_and_a_verified_model(spark):
    base = {"relevance": 90, "supports": 90, "challenges": 5, "context": 5, "entity_property": 90, "time": 90, "variant": 90, "attribution": "page_quote", "quote": "q", "claim": "c", "verified": True}
    cases = [
        ({}, "support", ["no_verdict"]),
        ({"quote": None}, "insufficient", ["not_page_quote", "no_verdict"]),
        ({"verified": False}, "insufficient", ["unassessed", "scope_withheld", "no_verdict"]),
        ({"supports": None}, "insufficient", ["unassessed", "no_verdict"]),
        ({"time": 50}, "context", ["scope_withheld", "no_verdict"]),
        ({"claim": None}, "context", ["no_claim", "no_verdict"]),
        ({"claim": " q "}, "context", ["no_verdict"]),
        ({"attribution": "search_snippet"}, "context", ["not_page_quote", "no_verdict"]),
        ({"supports": 5, "challenges": 90}, "challenge", ["no_verdict"]),
        ({"relevance": 40}, "insufficient", ["low_relevance", "no_verdict"]),
        ({"supports": 50}, "insufficient", ["no_verdict"]),
    ]
    schema = "n int, " + ", ".join(f"{k} {'boolean' if k == 'verified' else 'string' if k in ('attribution', 'quote', 'claim') else 'int'}" for k in base)
    frame = spark.createDataFrame([(n, *(base | over).values()) for n, (over, _, _) in enumerate(cases)], schema)
    got = {r["n"]: (r["relation"], r["reasons"]) for r in citations.claim_relation(frame).collect()}
    assert got == {n: (relation, reasons) for n, (_, relation, reasons) in enumerate(cases)}
