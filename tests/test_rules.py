"""Rules of policy, selection, sources, pages and validation on small fixtures, and against plain versions."""

from __future__ import annotations

import json
import random
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tracewell.functions import questions, text, urls
from tracewell.operators import cases, citations, evidence, merge, pages, policy, research, selection, similarity, validation, watches
from tracewell.sources import files

POOL = (
    "inv int, cand_id string, kind string, relationship string, domain string, grp string, origin_status string, published_at string, "
    "precision string, date_status string, relevance int, same int, different int, supports int, contradicts int, loc_different int, "
    "historical int, fact_check int, reporting int, position int, url string, cue boolean"
)


def row(cand_id, **over):
    base = {
        "inv": 1, "cand_id": cand_id, "kind": "lens_exact", "relationship": "EXACT_MATCH", "domain": f"{cand_id}.org", "grp": f"g{cand_id}",
        "origin_status": "separate_origin_evidenced", "published_at": None, "precision": "unknown", "date_status": "unknown", "relevance": 90,
        "same": 0, "different": 0, "supports": 0, "contradicts": 0, "loc_different": 0, "historical": 0, "fact_check": 0, "reporting": 0,
        "position": 1, "url": f"https://{cand_id}.org/a", "cue": False,
    }
    return base | over


def pool(spark, *rows):
    names = [c.split()[0] for c in POOL.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], POOL)


def day(value):
    return {"published_at": value, "precision": "day", "date_status": "usable"}


def claim_day():
    return F.lit("2024-05-10").cast("date")


def test_takeaways(spark):
    def said(*rows):
        return [(r["takeaway"], r["n_evidence"]) for r in policy.takeaways(pool(spark, *rows), claim_day()).orderBy("place").collect()]

    assert said(row("a", **day("2024-05-01"))) == [("temporal_conflict", 1)]
    assert said(row("a", **day("2024-05-09"))) == []
    assert said(row("a", **(day("2024-05-01") | {"date_status": "disputed"}))) == []
    assert said(row("a", relevance=60, **day("2024-05-01"))) == []
    assert said(row("a", published_at="2024", precision="year", date_status="usable"), row("b", loc_different=80)) == [("location_conflict", 1)]
    assert said(row("a", historical=80)) == []
    every = (row("a", historical=80, loc_different=75, **day("2020-01-01")), row("b", kind="google_news", relationship="VISUAL_LEAD"))
    assert [t for t, _ in said(*every)] == ["temporal_conflict", "location_conflict", "historical_reuse"]
    assert said(row("b", kind="google_news", relationship="VISUAL_LEAD")) == [("no_current_media_corroboration", 0)]
    assert said(row("b", kind="google_news")) == []


RUN = "inv int, exact_state string, search_failed boolean, news_failed boolean, page_failures int, deadline boolean, claim_mode boolean, claim_day date, attempted int, succeeded int, eligible int, selected int, orderable int, compared int"


def test_limitation_codes(spark):
    def codes(run, *rows):
        runs = spark.createDataFrame([run], RUN)
        return {r["code"] for r in policy.limitations(pool(spark, *rows), runs).collect()}

    import datetime

    fine = (1, "success", False, False, 0, False, True, datetime.date(2024, 1, 1), 2, 2, 2, 2, 1, 1)
    two = (row("a", **day("2024-01-01")), row("b", **day("2024-01-02")))
    assert codes(fine, *two) == {"about_this_image_unavailable"}
    bad = (1, "empty", True, True, 1, True, True, None, 2, 0, 9, 8, 7, 6)
    got = codes(bad, row("a", origin_status="unresolved"), row("v", relationship="VISUAL_LEAD", date_status="disputed"))
    assert got == {
        "about_this_image_unavailable", "no_exact_occurrences_returned", "web_context_unavailable", "news_unavailable",
        "semantic_classification_unavailable", "reporting_origins_unresolved", "unverified_visual_leads_present", "near_match_verifier_disabled",
        "page_fetch_partial_failure", "analysis_time_limit_reached", "insufficient_dated_occurrences", "comparison_coverage_incomplete",
        "claim_date_unresolved", "disputed_dates_present", "unknown_dates_present",
    }
    partial = (1, "malformed", False, False, 0, False, False, None, 3, 1, 2, 2, 1, 1)
    assert codes(partial, *two) == {"about_this_image_unavailable", "exact_match_retrieval_unavailable", "semantic_classification_partial"}


def test_expansion(spark):
    def reason(*rows):
        r = policy.claim_expansion(pool(spark, *rows)).first()
        return r["expand"], r["reason"]

    assert reason(row("a")) == (True, "insufficient_evidence")
    assert reason(row("a", different=80)) == (True, "corroboration_limited")
    assert reason(row("a", different=80), row("b", contradicts=80)) == (False, "already_conclusive")
    assert reason(row("a", different=80), row("b", contradicts=80, domain="a.org")) == (True, "corroboration_limited")
    assert reason(row("a", different=80), row("b", different=80, origin_status="unresolved")) == (True, "corroboration_limited")

    def trace(grounded, *rows):
        r = policy.trace_expansion(pool(spark, *rows), F.lit(grounded)).first()
        return r["expand"], r["reason"]

    two = row("a", **day("2024-01-01")), row("b", **day("2024-01-02"))
    assert trace(True, *two) == (False, "already_conclusive")
    assert trace(True, two[0], row("b", published_at="2024-01", precision="month", date_status="usable")) == (True, "trace_coverage_unmet")
    assert trace(False, two[0]) == (False, "no_grounded_query")


def plain_plan(rows, most=5):
    """The deep-read plan, row by row."""
    taken = []

    def take(r, role):
        if r and len(taken) < most and r["cand_id"] not in [t["cand_id"] for t, _ in taken]:
            taken.append((r, role))

    def best(some, check=False):
        key = lambda r: ((-r["fact_check"],) if check else ()) + (-(r["relevance"] or 0), r["position"] if r["position"] is not None else 10**9, r["cand_id"])
        return sorted(some, key=key)

    core = [r for r in rows if r["relationship"] in ("EXACT_MATCH", "NEAR_MATCH")]
    relevant = lambda r: (r["relevance"] or 0) >= 70
    strong = lambda r, *names: any((r[n] or 0) >= 75 for n in names)
    dated = sorted((r for r in core if r["date_status"] == "usable" and r["published_at"]), key=lambda r: (r["published_at"], r["cand_id"]))
    judged = [r for r in rows if r["relevance"] is not None]
    anchor = (dated or best([r for r in core if r["relevance"] is not None]) or [None])[0]
    take(anchor, "core_anchor")
    against = [r for r in core if relevant(r) and strong(r, "different", "contradicts", "loc_different") and r["origin_status"] == "unresolved"]
    take(next(iter(best([r for r in against if not anchor or r["domain"] != anchor["domain"]])), None), "conflict")
    take(next(iter(best([r for r in core if relevant(r) and strong(r, "same", "supports")])), None), "support")
    take(next(iter(best([r for r in rows if (r["fact_check"] or 0) > 0], True)), None), "fact_check")
    take(next(iter(best([r for r in rows if r["kind"] == "google_news" or (r["reporting"] or 0) >= 75])), None), "current_reporting")
    if not dated:
        rest = [r for r in best([r for r in core if r["relevance"] is not None]) if r["cand_id"] not in [t["cand_id"] for t, _ in taken]]
        domains = {t["domain"] for t, _ in taken}
        for r in rest:
            if r["domain"] not in domains:
                take(r, "core_recovery")
                domains.add(r["domain"])
        for r in rest:
            take(r, "core_recovery")
        lead = lambda r: relevant(r) and r["cue"]
        if not any(lead(t) for t, _ in taken):
            take(next((r for r in best(judged) if lead(r) and r["cand_id"] not in [t["cand_id"] for t, _ in taken]), None), "historical_lead")
    for r in best(judged):
        take(r, "filler")
    return [(r["cand_id"], role) for r, role in taken]


def test_deep_reads_match_the_plain_plan(spark):
    rng, rows, want = random.Random(8), [], {}
    for inv in range(60):
        own = []
        for i in range(rng.randint(0, 14)):
            judged = rng.random() < 0.8
            some = lambda *v: rng.choice(v) if judged else None  # noqa: B023, E731
            when = day(f"2024-01-{rng.randint(1, 28):02d}") if inv % 3 == 0 and rng.random() < 0.4 else {}
            own.append(row(
                f"c{i:02d}", inv=inv, kind=rng.choice(["lens_exact", "google_news", "google_search"]), relationship=rng.choice(["EXACT_MATCH", "NEAR_MATCH", "VISUAL_LEAD"]),
                domain=rng.choice(["a.org", "b.org", "c.org"]), origin_status=rng.choice(["unresolved", "separate_origin_evidenced"]), relevance=some(50, 70, 80, 90),
                same=some(0, 80), different=some(0, 80), supports=some(0, 0, 80), contradicts=some(0, 0, 80), loc_different=some(0), historical=some(0),
                fact_check=some(0, 10, 60), reporting=some(0, 80), position=rng.choice([None, 1, 2, 3]), cue=rng.random() < 0.3, **when,
            ))
        rows += own
        want[inv] = plain_plan(own)
    got = {}
    for r in selection.deep_reads(pool(spark, *rows)).orderBy("inv", "place").collect():
        got.setdefault(r["inv"], []).append((r["cand_id"], r["role"]))
    assert {k: v for k, v in want.items() if v} == got


def test_merge_keeps_first_known_values_and_the_strongest_identity(spark):
    rows = [
        (1, "u", "b", "lens_visual", "s1", "VISUAL_LEAD", None, None, None, "unknown", "unknown", 1),
        (1, "u", "c", "google_search", "s2", "NEAR_MATCH", "hash c", "t2", None, "2024-01", "month", 2),
        (1, "u", "d", "google_search", "s2", "NEAR_MATCH", "hash d", "t3", "x", "2024-01-05", "day", 3),
    ]
    frame = spark.createDataFrame(rows, "inv int, url string, cand_id string, kind string, search_id string, relationship string, identity string, title string, snippet string, published_at string, precision string, ord int")
    frame = frame.withColumn("date_status", F.when(F.col("precision") == "unknown", "unknown").otherwise("usable"))
    r = merge.by_canonical_url(frame).first()
    assert (r["base_id"], r["title"], r["snippet"], r["relationship"], r["identity"]) == ("b", "t2", "x", "NEAR_MATCH", "hash c")
    assert (r["date_status"], r["precision"], r["n_merged"]) == ("usable", "month", 3)
    assert [(x["kind"], x["search_id"], x["place"]) for x in merge.retrievals(frame).orderBy("place").collect()] == [("lens_visual", "s1", 1), ("google_search", "s2", 2)]


def test_accounts(spark):
    kind = "case_id int, relation string, relevance int, quote string, attribution string"

    def headline(*rows, mode="claim"):
        r = citations.account(spark.createDataFrame([(1, *x) for x in rows], kind), mode).first()
        return r["headline"], r["n_read"], r["n_leads"]

    yes, no = ("support", 90, "q", "page_quote"), ("challenge", 50, "q", "search_snippet")
    assert headline(yes, no) == ("The retained excerpts disagree.", 1, 1)
    assert headline(no)[0] == "There is evidence against this claim."
    assert headline(yes)[0] == "There is evidence supporting this claim."
    assert headline(("support", 40, "q", "page_quote"), ("challenge", 90, None, "page_quote")) == ("The claim is still unresolved.", 2, 0)
    assert headline(yes, mode="source_assertions")[0] == "What the sources say."


def test_bindings(spark):
    pairs = {
        ("https://a.org/p", "https://a.org/p"): "same_resource",
        ("http://a.org/p", "https://a.org/p/"): "normalized_resource",
        ("https://a.org/p", "http://a.org/p"): "different_resource",
        ("https://a.org/p?id=1", "https://a.org/p?id=2"): "different_resource",
        ("https://a.org/p", "https://a.org/p?utm_source=x"): "normalized_resource",
        ("https://a.org/p", "https://a.org/Sign-In/x"): "blocked_destination",
        ("https://a.org/p", "https://a.org/auth"): "blocked_destination",
        ("https://a.org/p", "https://a.org/browser-support/"): "blocked_destination",
        ("https://a.org/p", "https://a.org/consent"): "different_resource",
        ("https://a.org/p", "https://a.org/not-found"): "different_resource",
        ("https://user:x@a.org/p", "https://a.org/p"): "not_established",
        ("https://a.org/p", "https://127.0.0.1/p"): "not_established",
    }
    rows = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, want string")
    for r in rows.withColumn("got", urls.binding(F.col("a"), F.col("b"))).collect():
        assert r["got"] == r["want"], r


def test_explicit_claims(spark):
    said = {
        "Claim: the bridge fell": "the bridge fell", " check this claim : x y": "x y", "The bridge was closed": "The bridge was closed", "Was the bridge closed": None,
        "bridge closures": None, "The bridge was closed?": None, "evidence the bridge was closed": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", questions.explicit_claim(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in rows.collect()} == said


# --- sources ------------------------------------------------------------------

LINES = [
    '{"type": "investigation.started", "investigationId": "i1"}',
    '{"type": "stage.completed", "stage": "CHRONOLOGY", "detail": "2 dated core occurrences"}',
    '{"type": "search.batch", "engine": "google", "count": 7}',
    '{"type": "evidence.discovered", "evidence": {"id": "e1", "title": "t"}}',
    '{"type": "evidence.classified", "id": "e1", "publicJudgment": {"relevance": 0.8}}',
    '{"type": "investigation.error", "code": "INTERNAL_ERROR", "message": "m"}',
]


def test_event_files(spark, tmp_path):
    odd = ['{"type": "stage.skipped"}', '{"type": 5}', '{"stage": "x"}', "not json", '[{"type": "stage.started"}]', "", '{"type": "stage.started", "stage": "LAST"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text("\n".join(LINES + odd))  # no line end after the last line
    strict, rejects = files.read_events(spark, str(tmp_path / "in"), strict=True)
    assert strict.count() == len(LINES) + 1 and {r[0] for r in rejects.collect()} == set(odd[:5])
    tolerant, skipped = files.read_events(spark, str(tmp_path / "in"))
    assert tolerant.count() == len(LINES) + 2 and skipped.count() == 4
    got = {r["type"]: r for r in strict.collect()}
    assert got["investigation.started"]["investigation_id"] == "i1" and got["search.batch"]["n"] == 7
    assert got["evidence.discovered"]["evidence_id"] == got["evidence.classified"]["evidence_id"] == "e1"
    assert json.loads(got["evidence.classified"]["judgment"]) == {"relevance": 0.8}
    lines = spark.createDataFrame([(x,) for x in LINES], "payload string")
    files.write_events(lines, str(tmp_path / "out"))
    files.write_events(lines, str(tmp_path / "out"))
    assert files.read_events(spark, str(tmp_path / "out"), strict=True)[0].count() == 2 * len(LINES)


def test_case_files(spark, tmp_path):
    (tmp_path / "cases").mkdir()
    whole = {"version": files.CASE_VERSION, "case_id": "c1", "revision": 2, "created_at": "2024-01-01T00:00:00Z", "evidence": [{"id": "e", "source_url": "https://a.org"}]}
    (tmp_path / "cases" / "a.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / "cases" / "b.json").write_text(json.dumps(whole | {"version": "other"}))
    (tmp_path / "cases" / "c.json").write_text(json.dumps({k: v for k, v in whole.items() if k != "revision"}))
    good, bad = files.read_cases(spark, str(tmp_path / "cases"))
    assert [(r["case_id"], r["revision"], r["evidence"][0]["id"]) for r in good.collect()] == [("c1", 2, "e")] and bad.count() == 2


def test_revisions_are_appended(spark, tmp_path):
    path = str(tmp_path / "revisions")
    rows = lambda *r: spark.createDataFrame(r, "case_id string, revision int, digest string")
    files.append_revisions(rows(("a", 1, "x"), ("b", 1, "y")), path, 4)
    files.append_revisions(rows(("a", 2, "z")), path, 4)
    kept = spark.read.parquet(path)
    assert kept.count() == 3
    heads = cases.heads(kept, ["case_id"]).collect()
    assert {(r["case_id"], r["revision"], r["digest"]) for r in heads} == {("a", 2, "z"), ("b", 1, "y")}


def test_ledger_files(spark, tmp_path):
    (tmp_path / "ledger").mkdir()
    lines = [
        '{"header": true, "version": 1}', '{"period": "2024-01", "seq": 1, "kind": "grant", "amount": 5}', '{"period": "2024-01", "seq": 2, "kind": "reserve", "amount": 9}',
        '{"period": "2024-01", "seq": 3, "kind": "reserve", "amount": -1}', '{"period": "2024-01", "seq": 4, "kind": "gift", "amount": 1}', "broken",
        '{"period": "header", "seq": 5, "kind": "reserve", "amount": 1}',
    ]
    (tmp_path / "ledger" / "a.ndjson").write_text("\n".join(lines))
    good, bad = files.read_ledger(spark, str(tmp_path / "ledger"))
    assert sorted(r["seq"] for r in good.collect()) == [1, 2, 5] and bad.count() == 3
    totals = {r["seq"]: r for r in watches.ledger(good, 3).collect()}
    assert (totals[2]["spent"], totals[2]["allowed"], totals[2]["overdrawn"]) == (9, 8, True)


# --- pages --------------------------------------------------------------------

URL = "https://www.news.org/story?id=1&utm_source=x"


def dates_of(*parts):
    found = pages.extract(URL, "<html>" + "".join(parts) + "</html>")["dates"]
    return [(d["source"], d["raw"], d["binding"], d["refused"]) for d in found]


def ld(value):
    return f'<script type="application/ld+json">{json.dumps(value)}</script>'


def test_json_ld_binding_tiers():
    article = lambda date, **more: {"@type": "NewsArticle", "datePublished": date} | more
    page = "https://news.org/story?id=1"
    assert dates_of(ld(article("d", url=page))) == [("json_ld", "d", "page_url", None)]
    assert dates_of(ld({"@type": "WebPage", "mainEntity": article("d")})) == [("json_ld", "d", "main_entity", None)]
    assert dates_of(ld(article("d"))) == [("json_ld", "d", "root_entity", None)]
    assert dates_of(ld(article("d", url="https://news.org/story?id=2"))) == [("json_ld", "d", None, "contradictory_entity_binding")]
    nested = {"@type": "WebPage", "hasPart": [article("d")]}
    assert dates_of(ld(nested)) == [("json_ld", "d", None, "unbound_nested_entity")]
    both = dates_of(ld(article("root")), ld({"@type": "WebPage", "mainEntity": article("main")}), ld(article("own", **{"@id": page})), ld(nested))
    assert [d[1:3] for d in both] == [("own", "page_url"), ("main", "main_entity"), ("root", "root_entity"), ("d", None)]
    assert dates_of(ld({"@type": "WebPage", "datePublished": "w"})) == [("json_ld", "w", "root_entity", None)]
    assert dates_of(ld({"@type": "WebPage", "url": "https://other.org/", "datePublished": "w"})) == []
    assert dates_of(ld({"@type": "WebPage", "dateCreated": "w"}), '<script type="application/ld+json">{broken</script>') == []
    other = {"@type": "WebPage", "url": "https://other.org/", "mainEntity": article("d")}
    assert dates_of(ld(other)) == [("json_ld", "d", None, "unbound_nested_entity")]


def test_meta_and_time_dates():
    assert dates_of('<meta property="article:published_time" content=" 2024 "><meta name="date" content="x"><meta name="sailthru.date" content="2023">') == [
        ("meta", "2024", None, None), ("meta", "2023", None, None),
    ]
    time = '<time datetime="2024-01-01" itemprop="datePublished">x</time>'
    own = '<div itemscope itemid="https://news.org/story?id=1">'
    assert dates_of(own, time, "</div>") == [("time", "2024-01-01", "page_url", None)]
    assert dates_of(own, "<p>a<br>b</p></div>", time) == [("time", "2024-01-01", None, "unbound_time_owner")]
    assert dates_of(own, "<blockquote>", time, "</blockquote></div>")[0][3] == "quoted_time_owner"
    assert dates_of('<div itemscope itemid="/other">', time, "</div>")[0][3] == "contradictory_time_owner"
    assert dates_of('<time datetime="2024-01-01">x</time>') == []


def test_attributes_are_bounded():
    entity = {"@type": ["Report"] * 20, "headline": "h" * 500, "author": [{"name": f"a{i}"} for i in range(20)], "publisher": {"name": "P", "secret": "s"}}
    metas = "".join(f'<meta property="og:x{i}" content="{"v" * 500}">' for i in range(50))
    found = pages.extract(URL, ld([entity] * 20) + metas)
    assert len(found["open_graph"]) == 32 and all(len(x["value"]) == 400 for x in found["open_graph"])
    assert len(found["entities"]) == 8 and len(found["entities"][0]["headline"]) == 400 and found["entities"][0]["author"] == [f"a{i}" for i in range(8)]
    assert found["entities"][0]["publisher"] == "P" and len(found["entities"][0]["types"]) == 8


def test_canonical_forms_agree(spark):
    odd = ["HTTPS://WWW.A.org:443/p//?b=2&a=1&utm_x=1#f", "http://a.org", "http://a.org:8080/x/?fbclid=1", "ftp://a.org/x", "no url", "https://www./x", "http://a.org/?a=&a"]
    rows = spark.createDataFrame([(u,) for u in odd], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()
    for r in rows:
        assert pages.canonical(r["u"]) == (r["c"] or r["u"]), r


# --- validation ---------------------------------------------------------------

EVIDENCE = (
    "case_id int, id string, source_url string, title string, content string, text string, attribution string, asset_id string, span_kind string, "
    "start_ms long, duration_ms long, date_status string, date_value string, date_precision string, date_source string, date_url string, "
    "date_rationale string, method string, rights string, retention string, content_hash string, retrieved_at string"
)


def case_tables(spark, **over):
    sound = {
        "case_id": 1, "id": "e1", "source_url": "https://a.org/x", "title": None, "content": "text", "text": "said", "attribution": "page_quote", "asset_id": None,
        "span_kind": None, "start_ms": None, "duration_ms": None, "date_status": "observed", "date_value": "2024-02-29", "date_precision": "day",
        "date_source": "page_meta", "date_url": "https://a.org/x", "date_rationale": None, "method": "retrieval", "rights": "unknown", "retention": "reference_only",
        "content_hash": None, "retrieved_at": "2024-03-01T10:00:00Z",
    }
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    names = [c.split()[0] for c in EVIDENCE.split(", ")]
    evidence_rows = [sound | over.get("evidence", {}), sound | {"id": "e2", "content": "media", "asset_id": "m1", "span_kind": "time", "start_ms": 0, "duration_ms": 10} | over.get("media", {})]
    return {
        "claims": frame(over.get("claims", [(1, "c1", "a claim", "en"), (1, "c2", "another", None)]), "case_id int, id string, text string, language string"),
        "assets": frame(over.get("assets", [(1, "m1", "video", "https://a.org/v", 10)]), "case_id int, id string, kind string, url string, duration_ms long"),
        "evidence": frame([tuple(r[n] for n in names) for r in evidence_rows], EVIDENCE),
        "occurrences": frame(
            over.get("occurrences", [(1, "o1", "m1", "e2", "whole", None, None, "observed", ["e1"], None), (1, "o2", "m1", "e1", "whole", None, None, "unknown", None, None)]),
            "case_id int, id string, asset_id string, evidence_id string, span_kind string, start_ms long, duration_ms long, assessed string, evidence_ids array<string>, rationale string",
        ),
        "relations": frame(
            over.get("relations", [(1, "r1", "evidence_claim", "e1", "c1", "supports", "observed", ["e1"], None), (1, "r2", "occurrence_occurrence", "o1", "o2", "similar_media", "inferred", ["e2"], "alike")]),
            "case_id int, id string, kind string, left_id string, right_id string, relationship string, assessed string, evidence_ids array<string>, rationale string",
        ),
        "reads": frame(
            over.get("reads", [(1, "e1", "https://a.org/x", "https://a.org/x", "same_resource", "page_quote", None, None)]),
            "case_id int, id string, requested_url string, final_url string, binding string, outcome string, reference_text string, reference_support string",
        ),
    }


READ = (1, "e1", "https://a.org/x")
BROKEN = [
    ({}, set()),
    ({"evidence": {"date_value": "2023-02-29"}}, {"date_form"}),
    ({"evidence": {"date_precision": "month"}}, {"date_form"}),
    ({"evidence": {"date_precision": "instant", "date_value": "2024-01-01T25:00:00Z"}}, {"date_form"}),
    ({"evidence": {"date_url": None}}, {"date_source_has_a_url"}),
    ({"evidence": {"date_status": "inferred"}}, {"inferred_date_has_a_rationale"}),
    ({"evidence": {"source_url": "https://u:p@a.org/"}}, {"source_url"}),
    ({"evidence": {"text": " "}}, {"text"}),
    ({"evidence": {"text": "x" * 20_001}}, {"text"}),
    ({"evidence": {"content_hash": "sha256:x"}}, {"content_hash"}),
    ({"evidence": {"rights": "mine", "method": None}}, {"rights", "method"}),
    ({"media": {"duration_ms": 11}}, {"span_beyond_media"}),
    ({"media": {"start_ms": -1}}, {"span_bounds"}),
    ({"media": {"asset_id": "gone"}}, {"evidence_asset"}),
    ({"media": {"id": "e1"}}, {"duplicate_id", "occurrence_evidence", "assessment_evidence"}),
    ({"relations": [(1, "r1", "claim_claim", "c1", "c1", "paraphrase", "unknown", None, None)]}, {"no_self_relation"}),
    ({"relations": [(1, "r1", "occurrence_occurrence", "o1", "o2", "similar_media", "observed", ["e1"], None)]}, {"similarity_is_inferred"}),
    ({"relations": [(1, "r1", "claim_claim", "c1", "e9", "supports", "observed", [], None)]}, {"relation_claims", "relationship", "assessment_has_evidence"}),
    ({"relations": [(1, "r1", "evidence_claim", "e1", "c1", "supports", "inferred", ["e9"], None)]}, {"assessment_evidence", "inference_has_a_rationale"}),
    ({"reads": [(*READ, None, "same_resource", "page_quote", None, None)]}, {"bound_read_has_a_final_url"}),
    ({"reads": [(*READ, "https://a.org/x", "different_resource", "page_quote", None, None)]}, {"extracted_read_is_bound"}),
    ({"reads": [(*READ, "https://a.org/x", "same_resource", "binding_rejected", None, None)]}, {"rejected_read_is_not_bound"}),
    ({"reads": [(*READ, "https://a.org/x", "not_established", "not_attempted", None, None)]}, {"unattempted_read_binds_nothing"}),
    ({"reads": [(*READ, "https://a.org/y", "reference_destination", "page_quote", None, None)]}, {"reference_destination_has_a_reference", "extracted_read_is_bound"}),
    ({"reads": [(1, "e1", "https://a.org/x?token=1", "https://a.org/y", "reference_destination", "page_quote", "r" * 401, "s")]}, {"requested_url", "reference_length"}),
]


@pytest.mark.parametrize("n", range(len(BROKEN)))
def test_validation(spark, n):
    over, want = BROKEN[n]
    assert {r["rule"] for r in validation.validate(case_tables(spark, **over)).collect()} == want


# --- similarity ----------------------------------------------------------------


def test_near_hashes_match_brute_force(spark):
    rng = random.Random(5)
    hashes = {rng.getrandbits(64) for _ in range(60)}
    for h in list(hashes)[:40]:
        for _ in range(3):
            h ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9)))
            hashes.add(h)
    hashes = sorted(hashes)
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    got = {(r["a"], r["b"], r["distance"]) for r in similarity.near_hashes(spark.createDataFrame(rows, "id int, hash long")).collect()}
    want = {(i, j, bin(a ^ b).count("1")) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and bin(a ^ b).count("1") <= 8}
    assert got == want and len(want) > 40


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_near_hashes_in_blocks(spark, monkeypatch, agree):
    """Of few hashes few keys are dealt, and any number of parts and blocks gives the same pairs, each once."""
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = random.Random(6)
    hashes = sorted({rng.getrandbits(64) & ~0xFFFF for _ in range(20)} | {rng.getrandbits(16) << 20 for _ in range(60)})
    rows = spark.createDataFrame([(1000 - i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "id long, hash long")
    got = [tuple(r) for r in similarity.near_hashes(rows, agree=agree).select("a", "b", "distance").collect()]
    near = lambda a, b: bin(a ^ b).count("1") <= 8
    want = {(1000 - j, 1000 - i, bin(a ^ b).count("1")) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert [similarity._agree(n, 8, 64) for n in (10, 600_000, 10**7)] == [1, 1, 2]


def test_contained_sentences_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    long_ = [" ".join(rng.choices(words, k=rng.randint(25, 40))) + "." for _ in range(12)]
    glued = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(90)) + "."
    texts = [" ".join(rng.sample([*long_, glued], rng.randint(1, 4))) for _ in range(30)] + ["x" + long_[0][1:] + "tail", "pre" + glued + "post"]
    rows = [(i % 2, i, t) for i, t in enumerate(texts)]
    got = {(r["case_id"], r["a"], r["b"]) for r in similarity.contained_sentences(spark.createDataFrame(rows, "case_id int, id int, text string")).collect()}
    import re

    said = {i: [x.strip() for x in re.findall(r"[^.!?\n]+[.!?]?", t) if len(x.strip()) >= 80] for _, i, t in rows}
    want = {(c, a, b) for c, a, _ in rows for d, b, t in rows if a != b and c == d and any(x in t for x in said[a])}
    assert got == want and len(want) > 20


def test_contained_sentences_meet_few_passages(spark, monkeypatch):
    """Sentences of few words share all their runs of three with most passages; those of any length are found, by runs that few passages have."""
    rng = random.Random(8)
    words = [f"term{i}" for i in range(6)]
    long_ = [" ".join(rng.choices(words, k=k)) + "." for k in (14, 15, 16, 18, 40) for _ in range(20)]
    wide = [" ".join(f"{w * 6}x{i}" for w in rng.sample(words, k)) + "." for i, k in enumerate((3, 4, 5, 5))]
    texts = [f"{a} {b}" for a, b in zip(long_, reversed(long_))] + [f"{s} {t}" for s in wide for t in rng.sample(long_, 2)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "case_id int, id int, text string")
    kept = []
    monkeypatch.setattr(similarity, "written", lambda df, name: kept.append((name, df)) or df)
    got = {(r["a"], r["b"]) for r in similarity.contained_sentences(rows).collect()}
    said = [[x for x in re.findall(r"[^.!?\n]+[.!?]?", t)] for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and any(len(x.strip()) >= 80 and x.strip() in texts[b] for x in said[a])}
    assert got == want and len(want) > 40
    keys = dict(kept)["keys"]
    passages = rows.select("case_id", "id", F.explode(similarity._grams(similarity._words(F.col("text")), similarity.LONG)).alias("run"))
    assert keys.join(passages, ["case_id", "run"]).count() < 4 * keys.count()


SAID = "id int, case_id int, evidence_id int, url string, text string"


def test_families_and_connections(spark):
    wording = "the harbour bridge closed yesterday because engineers found cracks"
    rows = [
        (1, 1, 1, "u1", wording), (2, 2, 2, "u2", wording), (3, 3, 3, "u3", wording + " somewhere"), (4, 4, 4, "u1", wording + " again"),
        (5, 1, 5, "u1", wording + " twice"), (6, 6, 6, "u6", "something else entirely"), (7, 7, 7, "u2", wording),
    ]
    got = {(r["a"], r["b"]): r["status"] for r in research.families(spark.createDataFrame(rows, SAID)).collect()}
    assert got[1, 2] == "same_retained_wording" and got[1, 3] == "plausible_connection" and got[1, 4] == "same_source_variant"
    assert (1, 5) not in got and not any(6 in p or 7 in p for p in got)
    seen = {r["id"]: (r["n"], r["case_ids"]) for r in research.appearances(spark.createDataFrame(rows, SAID)).collect()}
    assert seen[2] == (2, [2, 7]) and seen[1] == (1, [1])
    inside = [(i, 1, e, u, t) for i, e, u, t in [(1, 1, "a", "one two"), (2, 2, "b", "one two"), (3, 3, "b", wording), (4, 4, "a", wording + " again"), (5, 4, "c", wording), (6, 6, "b", wording + " more")]]
    found = {(r["a"], r["b"]): r["status"] for r in research.connections(spark.createDataFrame(inside, SAID)).collect()}
    assert found == {(1, 2): "same_retained_wording", (3, 4): "plausible_connection", (3, 5): "same_retained_wording", (4, 6): "plausible_connection", (5, 6): "plausible_connection"}
    many = [(i, 1, i, f"u{i % 2}", wording) for i in range(60)]
    shown = research.connections(spark.createDataFrame(many, SAID)).orderBy("place").collect()
    assert [(r["a"], r["b"]) for r in shown] == [(0, b) for b in range(1, 25, 2)]


def test_recognition(spark):
    kind = "n int, tokens array<struct<text string, p double>>"
    rows = [(1, [("a", 0.5), ("b", 0.75)]), (2, [("a", 0.5), ("[_TT_5]", 1.0)]), (3, []), (4, [("a", 1.5), ("b", 0.7)]), (5, None)]
    got = {r["n"]: r["r"] for r in spark.createDataFrame(rows, kind).select("n", text.recognition(F.col("tokens")).alias("r")).collect()}
    assert got == {1: "unreviewed", 2: "low_confidence", 3: "low_confidence", 4: "unreviewed", 5: "low_confidence"}


def test_roles_frames_and_measures(spark):
    roles = {r["cand_id"]: (r["role_basis"], r["event_role"]) for r in policy.source_roles(pool(spark, row("a"), row("b", relevance=None, relationship="VISUAL_LEAD"))).collect()}
    assert roles == {"a": ("model_assessed", "media_occurrence"), "b": ("unresolved", "unresolved")}
    frames = [(1, 2000, ["s3"], 2, ["b", "a"]), (1, 1000, ["s1", "s2"], 1, ["a"])]
    r = cases.union_of_frames(spark.createDataFrame(frames, "video_id int, ms int, searches array<string>, omitted int, limitations array<string>")).first()
    assert (r["first_ms"], r["searches"], r["omitted"], r["limitations"]) == (1000, ["s1", "s2", "s3"], 3, ["a", "b"])
    kept = spark.createDataFrame([(1, "page_quote"), (1, "search_snippet")], "run_id int, attribution string")
    reads = spark.createDataFrame([(1, "page_quote"), (1, "fetch_failed"), (2, "binding_rejected")], "run_id int, outcome string")
    got = {r["run_id"]: tuple(r)[1:] for r in cases.coverage_measures(kept, reads).select("run_id", "n_sources", "n_quotes", "n_reads", "n_failures").collect()}
    assert got == {1: (2, 1, 2, 1), 2: (0, 0, 1, 1)}


# --- without the training-data operators ---------------------------------------


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_llm(tmp_path, also):
    root = __file__.rsplit("/tests/", 1)[0]
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for name in also:
        (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'claim_status' in q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'] and set(o) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_case_projection_takes_the_first_bucket_and_counts_what_it_leaves_out(spark):
    rows = [
        (1, "a", "dated_lead", "https://a.org/lead", True),
        (1, "a", "undated", "https://a.org/undated", True),
        (1, "b", "dated_core", "http://10.0.0.1/", False),
        (1, "b", "undated", "https://b.org/", True),
        (1, "c", "dated_contextual", "https://c.org/" + "x" * 4096, True),
        (1, "d", "dated_core", None, None),
        (2, "a", "dated_contextual", "https://a.org/context", True),
    ]
    timeline = spark.createDataFrame(rows, "inv int, cand_id string, bucket string, url string, safe boolean")
    got = sorted(map(tuple, cases.case_projection(timeline).collect()))
    assert got == [(1, "a", "undated", "https://a.org/undated"), (2, "a", "dated_contextual", "https://a.org/context")]
    assert sorted(map(tuple, cases.case_omissions(timeline).collect())) == [(1, 3), (2, 0)]


def test_topic_passages_are_distinct_and_cut(spark):
    long = "river bridge " + "x" * 3000
    texts = ["the river", " flood river bridge\u00a0", "flood river bridge", "", long, "nothing shared", "bridge"]
    rows = [(7, i, text, text.split()) for i, text in enumerate(texts)]
    paragraphs = spark.createDataFrame(rows, "page_id int, ord int, text string, words array<string>")
    claims = spark.createDataFrame([(1, ["flood", "river", "bridge"]), (2, ["absent"])], "claim_id int, words array<string>")
    got = [tuple(r) for r in selection.topic_passages(paragraphs, claims).collect()]
    assert got == [(1, 7, "\n\n".join(["flood river bridge", long[:2400], "the river"]))]
