from __future__ import annotations

import datetime
import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import cases, chronology, citations, merge, pages, similarity, watches
from tracewell.operators.components import connected
from tracewell.sources import files
from tracewell.streaming import jobs

DATED = "inv int, cand_id string, relationship string, domain string, grp string, origin_status string, published_at string, precision string, date_status string, relevance int, same int, different int, supports int, contradicts int, loc_different int"


def dated_rows(spark, rows):
    """rows: (id, published, domain, grp)."""
    full = [(1, i, "EXACT_MATCH", d, g, "separate_origin_evidenced", p, "day", "usable", 90, 0, 0, 0, 0, 0) for i, p, d, g in rows]
    return chronology.dated_core(spark.createDataFrame(full, DATED))


def walk(kinds):
    """Segments and first divergence of a sequence of connectors, one row after another."""
    segment, index, out, first, open_ = 0, 0, [0], None, False
    for i, kind in enumerate(kinds, 1):
        if kind == "different":
            index += 1
            segment = index
            first = first or (i, open_)
        elif kind != "same":
            segment, open_ = None, True
        out.append(segment)
    return out, first


def test_segments_follow_the_walk(spark):
    percent = {"same": (90, 0), "different": (0, 90), "unclear": (40, 40)}
    for kinds in itertools.islice(itertools.product(["same", "different", "unclear", "missing"], repeat=4), 0, 256, 17):
        rows = dated_rows(spark, [(f"r{i}", f"2020-01-{i + 1:02d}", "d", "g") for i in range(5)])
        judged = [(1, f"r{i}", f"r{i + 1}", *percent[k]) for i, k in enumerate(kinds) if k != "missing"]
        judgments = spark.createDataFrame(judged, "inv int, from_id string, to_id string, same int, different int")
        segmented = chronology.segments(chronology.connect(rows, judgments))
        want, first = walk(kinds)
        assert [r["segment"] for r in segmented.orderBy("pos").collect()] == want
        found = chronology.divergences(segmented).where("first_observed").collect()
        assert [(r["to_id"], r["earlier_unresolved"]) for r in found] == ([] if first is None else [(f"r{first[0]}", first[1])])


def test_same_day_rows_are_unexamined(spark):
    rows = dated_rows(spark, [("a", "2020-01-01", "d", "g"), ("b", "2020-01-01", "d", "g")])
    judgments = spark.createDataFrame([(1, "a", "b", 0, 90)], "inv int, from_id string, to_id string, same int, different int")
    assert [r["connector"] for r in chronology.connect(rows, judgments).orderBy("pos").collect()] == ["start", "unexamined"]


def test_selection_is_the_greedy_one(spark):
    rng = random.Random(4)
    for n in (3, 9, 30):
        rows = [(f"r{i:02d}", f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", rng.choice("abc"), rng.choice("xyz")) for i in range(n)]
        picked = [0, n - 1] if n > 8 else list(range(n))
        while len(picked) < min(8, n):
            domains, groups = {rows[i][2] for i in picked}, {rows[i][3] for i in picked}
            novelty = {i: (rows[i][2] not in domains) + (rows[i][3] not in groups) for i in range(1, n - 1) if i not in picked}
            picked.append(min(novelty, key=lambda i: (-novelty[i], i)))
        got = chronology.select_occurrences(dated_rows(spark, rows)).collect()
        assert sorted(r["cand_id"] for r in got) == sorted(rows[i][0] for i in picked)


def test_dates_disagree(spark):
    rows = [
        (1, "u", "json_ld", "2020-01-01", "day", 1), (1, "u", "meta", "2020-01-02", "day", 2),
        (1, "v", "json_ld", "2020-01-01", "day", 1), (1, "v", "meta", "2020-01-05", "day", 2),
        (1, "w", "meta", "2020-01-01", "day", 1), (1, "w", "provider", "2019", "year", 2),
        (1, "x", "provider", "2019", "year", 1), (1, "x", "provider", "2020", "year", 2),
        (1, "y", "meta", None, None, 1),
    ]
    got = merge.resolve_dates(spark.createDataFrame(rows, "inv int, url string, source string, value string, precision string, ord int"))
    assert {r["url"]: (r["value"], r["status"], r["n_rejected"]) for r in got.collect()} == {
        "u": ("2020-01-01", "usable", 0), "v": (None, "disputed", 1), "w": ("2020-01-01", "usable", 1), "x": (None, "disputed", 1),
        "y": (None, "unknown", 1),
    }


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(400, 450)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_similar_sets_match_brute_force(spark):
    rng = random.Random(8)
    sets = [(("s", "t")[i % 2], i, rng.sample("abcdefghijkl", rng.randint(0, 8))) for i in range(80)]
    classes = similarity.set_classes(spark.createDataFrame(sets, "scope string, id long, tokens array<string>"))
    got = {(r["a"], r["b"]) for r in similarity.similar_sets(classes, 60, 2).collect()}
    reps = {}
    for scope, i, tokens in sets:
        if tokens:
            reps.setdefault((scope, frozenset(tokens)), i)
    want = {
        (i, j) for (s, x), i in reps.items() for (t, y), j in reps.items()
        if s == t and i < j and len(x & y) >= 2 and 100 * len(x & y) >= 60 * len(x | y)
    }
    assert got == want and want


def test_near_hashes(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(8)]
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    got = {(r["a"], r["b"], r["distance"]) for r in similarity.near_hashes(spark.createDataFrame(signed, "id long, hash long")).collect()}
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(i, j, bin(v ^ w).count("1")) for v, i in first.items() for w, j in first.items() if i < j and bin(v ^ w).count("1") <= 8}
    assert got == want and want


def test_contained_sentences(spark):
    long_ = "word " * 20 + "with an end that is long enough to be taken as a sentence."
    rows = [(1, 1, f"Start. {long_}"), (1, 2, f"xx{long_} More."), (1, 3, "Other."), (2, 4, long_)]
    got = similarity.contained_sentences(spark.createDataFrame(rows, "case_id int, id int, text string"))
    assert {(r["a"], r["b"]) for r in got.collect()} == {(1, 2)}


def test_quote_checks(spark):
    cited = [(1, "a", 9, "http://E.com/x#f", "quick", None), (1, "b", 9, "http://e.com/x", "quick", 3), (1, "c", 9, "http://e.com/y", "q", None), (1, "d", 9, "http://e.com/x", None, None)]
    held = [(1, 5, "http://e.com/x", "the quick fox")]
    got = citations.targets(
        spark.createDataFrame(cited, "case_id int, citation_id string, from_id int, target_url string, quote string, start int"),
        spark.createDataFrame(held, "case_id int, evidence_id int, url string, text string"),
    )
    assert {r["citation_id"]: (r["result"], r["matched_start"]) for r in got.collect()} == {
        "a": ("exact_match", 4), "b": ("offset_mismatch", None), "c": ("unknown", None), "d": ("unknown", None),
    }


def test_sticky_flag_survives_a_revert(spark):
    rows = [(1, 1, 1, False, False), (1, 1, 2, True, False), (1, 1, 3, False, False), (1, 1, 4, False, True), (1, 1, 5, False, False)]
    got = cases.sticky(spark.createDataFrame(rows, "case_id int, evidence_id int, revision int, changed boolean, revised boolean"))
    assert [r["flagged"] for r in got.orderBy("revision").collect()] == [False, True, True, False, False]


def test_revision_outcomes(spark):
    current = spark.createDataFrame([(1, 3, "a")], "case_id int, revision int, digest string")
    rows = [(1, 3, "a"), (1, 3, "b"), (1, 2, "z"), (1, 4, "n"), (2, 1, "m"), (3, 1, "p"), (3, 1, "q"), (1, 4, None)]
    got = jobs.apply_revisions(spark.createDataFrame(rows, "case_id int, revision int, digest string"), current)
    assert sorted((r["case_id"], r["revision"], r["digest"] or "", r["outcome"]) for r in got.collect()) == [
        (1, 2, "z", "stale"), (1, 3, "a", "no_op"), (1, 3, "b", "conflict"), (1, 4, "", "failed"), (1, 4, "n", "accepted"),
        (2, 1, "m", "accepted"), (3, 1, "p", "conflict"), (3, 1, "q", "conflict"),
    ]


def test_operations_are_idempotent(spark):
    done = spark.createDataFrame([("x", "1")], "operation_id string, digest string")
    rows = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("y", "1"), ("z", "1"), ("z", "2")], "operation_id string, digest string")
    assert sorted(tuple(r) for r in jobs.apply_operations(rows, done).collect()) == [
        ("x", "1", "no_op"), ("x", "2", "conflict"), ("y", "1", "applied"), ("z", "1", "conflict"), ("z", "2", "conflict"),
    ]


def test_search_responses(spark):
    raw = {
        '{"search_metadata":{"status":"Success","id":"s"},"organic_results":[{"link":"http://a.b/c","title":"t"},{"link":"x"}]}': "success",
        '{"search_metadata":{"status":"Success"},"error":"Google hasn\'t returned any results for this query."}': "empty",
        '{"search_metadata":{"status":"Success"}}': "malformed",
        '{"error":"quota"}': "provider_error",
        "nonsense": "malformed",
    }
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "inv int, raw string")
    got = rows.select("inv", files.response_state("search", F.col("raw")).alias("s")).orderBy("inv").collect()
    assert [r["s"] for r in got] == list(raw.values())
    assert [(r["inv"], r["n"], r["link"]) for r in files.leads(rows, "search").collect()] == [(0, 0, "http://a.b/c")]


def test_page_extraction(spark):
    para = "This paragraph is long enough to be kept as a paragraph of the page."
    html = f"""<html><head><title>T &amp; U</title><meta property="article:published_time" content="2020-01-01">
      <script type="application/ld+json">{{"@type":"Article","url":"http://e.com/x","datePublished":"2020-01-02"}}</script>
      <script type="application/ld+json">{{"@type":"Article","url":"http://e.com/other","datePublished":"1999"}}</script></head>
      <body><nav><p>{para} nav</p><a href="/no">n</a></nav><article><p>{para}<br>short</p><a href="/yes">y</a><time datetime="2020">x</time></article></body>"""
    got = pages.pages(spark.createDataFrame([(1, "http://e.com/x", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert got[0]["title"] == "T & U" and got[0]["paragraphs"] == [para] and got[0]["links"] == ["http://e.com/yes"]
    dated = [(d["source"], d["raw"], d["refused"]) for d in got[0]["dates"]]
    assert dated == [("json_ld", "2020-01-02", None), ("json_ld", "1999", "contradictory_entity_binding"), ("meta", "2020-01-01", None)]
    assert got[1]["paragraphs"] == [] and got[1]["title"] is None


def test_watch_rows_follow_each_other(spark):
    checks = [(1, "u", 1, "a", "page_quote"), (1, "u", 2, "b", "page_quote"), (1, "u", 3, "b", "page_quote"), (1, "v", 4, "z", "x"), (1, "w", 5, "k", "x")]
    seen = spark.createDataFrame([(1, "v", "z"), (1, "gone", "q")], "watch_id int, url string, seen_digest string")
    got = watches.watch_changes(spark.createDataFrame(checks, "watch_id int, url string, seq int, digest string, attribution string"), seen)
    assert sorted((r["seq"], r["change"]) for r in got.collect()) == [(1, "new_passage"), (2, "changed_sample"), (5, "new_lead")]


def test_due_watches(spark):
    now = datetime.datetime(2024, 1, 2)
    rows = spark.createDataFrame(
        [(1, True, datetime.datetime(2024, 1, 1), 24), (2, False, datetime.datetime(2024, 1, 1), 1), (3, True, datetime.datetime(2024, 1, 3), 1)],
        "id int, active boolean, next_check timestamp, every_hours int",
    )
    due = watches.due(rows, F.lit(now))
    assert [r["id"] for r in due.collect()] == [1]
    after = watches.after_check(due, F.lit(True)).first()
    assert after["next_check"] == datetime.datetime(2024, 1, 2) and after["active"]


def test_speech_lead_is_cut_at_its_last_space(spark):
    """Of a line end at the cut only that goes, and not the word before it as well."""
    rows = [(1, 0, "one two\nthree"), (2, 0, "one two three"), (3, 0, "one two\n")]
    got = watches.speech_lead(spark.createDataFrame(rows, "media_id int, seq int, text string"), most_chars=8)
    assert {r["media_id"]: r["lead"] for r in got.collect()} == {1: "one two", 2: "one two", 3: "one two\n"}


def test_similar_sets_join_few_pairs(spark):
    """Sets that share common words only leave the join by their bits and the places of these, and no similar pair does."""
    rng = random.Random(11)
    rows = [("s", i, [f"w{rng.randrange(90)}" for _ in range(20 + i % 7)]) for i in range(250)]
    rows += [("s", 1000 + i, [*rows[i][2][2:], "x"]) for i in range(0, 250, 10)]
    classes = similarity.set_classes(spark.createDataFrame(rows, "scope string, id long, tokens array<string>"))
    found = similarity.similar_sets(classes, 40, 6)
    sets = {i: set(words) for _, i, words in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * 40 and len(sets[a] & sets[b]) >= 6}
    assert {(r["a"], r["b"]) for r in found.collect()} == want and len(want) >= 25
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan


def test_similar_sets_count_tokens_without_a_sort(spark, monkeypatch):
    """Tokens are counted by scope without a window's sort, in several partitions, and of many sets only paired ones move for the exact test."""
    rng = random.Random(12)
    sets = [(("s", "t")[i % 2], i, rng.sample(range(40), 8)) for i in range(300)]
    sets += [(s, i + 1000, [*t[1:], 99]) for s, i, t in sets[:40]]
    rows = spark.createDataFrame(sets, "scope string, id long, tokens array<int>")
    monkeypatch.setattr(similarity, "TOKENS", 100)
    classes = similarity.set_classes(rows)
    every = classes.where("id = rep").select("scope", "id", "n", F.explode("hashes").alias("token"))
    got = {(r["scope"], r["id"], r["token"]): r["df"] for r in similarity._several(every, 2700).collect()}
    held = [(r["scope"], r["id"], r["token"]) for r in every.collect()]
    df = Counter((scope, token) for scope, _, token in held)
    assert got == {x: df[x[0], x[2]] for x in held if df[x[0], x[2]] > 1}
    found = similarity.similar_sets(classes, 60)
    reps = {}
    for scope, i, tokens in sets:
        reps.setdefault((scope, frozenset(tokens)), i)
    want = {(i, j) for (s, x), i in reps.items() for (t, y), j in reps.items() if s == t and i < j and 100 * len(x & y) >= 60 * len(x | y)}
    assert {(r["a"], r["b"]) for r in found.collect()} == want and len(want) >= 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftSemi" in plan


def near_copies(seed: int) -> list[tuple[str, int, list[str]]]:
    """Sets of two scopes: large groups of near copies, sets of their own, and some that share a run of common tokens."""
    rng = random.Random(seed)
    rows, of = [], itertools.count()
    for scope, size in (("s", 70), ("t", 40), ("s", 3)):
        base = [f"{scope}{size}b{k}" for k in range(rng.randint(50, 70))]
        for _ in range(size):
            own = rng.sample(range(len(base)), rng.randint(0, len(base) // 5))
            rows.append((scope, next(of), [f"o{next(of)}" if k in own else w for k, w in enumerate(base)][: rng.randint(len(base) - 10, len(base))]))
    common = [f"c{k}" for k in range(12)]
    for k in range(150):
        rows.append(("st"[k % 2], next(of), [f"u{next(of)}" for _ in range(rng.randint(1, 60))] + common * (k % 3 == 0)))
    rng.shuffle(rows)
    return rows


def similar_pairs(rows, percent: int) -> dict[tuple[int, int], tuple[int, int]]:
    reps = {}
    for scope, i, tokens in sorted(rows, key=lambda r: r[1]):
        reps.setdefault((scope, frozenset(tokens)), i)
    sets = [(i, s, x) for (s, x), i in reps.items()]
    pairs = {(i, j): (len(x & y), len(x | y)) for (i, s, x), (j, t, y) in itertools.permutations(sets, 2) if s == t and i < j}
    return {k: (c, u) for k, (c, u) in pairs.items() if 100 * c >= percent * u}


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    """Of a large group of near copies there are few links, between blocks as well, and sets that can have no partner leave first."""
    monkeypatch.setattr(similarity, "TOKENS", 500)
    monkeypatch.setattr(similarity, "PART", 1000)
    rows = near_copies(1)
    want = similar_pairs(rows, 60)
    classes = similarity.set_classes(spark.createDataFrame(rows, "scope string, id long, tokens array<string>"))
    reps = classes.where("id = rep").select("scope", "id", "hashes", "n")
    total = sum(len(set(tokens)) for _, _, tokens in rows)
    possible = {r["id"] for r in similarity._possible(reps, total, 0.55, 60, 1)[0].select("id").collect()}
    assert {i for pair in want for i in pair} <= possible and len(possible) < 0.7 * len(rows)
    links = [(r["a"], r["b"], r["common"], r["union"]) for r in similarity.similar_links(classes, 60).collect()]
    assert all(want[a, b] == (c, u) for a, b, c, u in links)
    assert len(want) > 1500 and len(links) < 600
    group = lambda pairs: {(r["id"], r["group_id"]) for r in similarity.groups(classes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert group([link[:2] for link in links]) == group(list(want)) and len(group(list(want))) > 100


def test_similar_sets_compare_components(spark, monkeypatch):
    """Near copies are compared as a component, by blocks, and not joined under each common token; what is large and has little alike goes by token."""
    rows = near_copies(2)
    monkeypatch.setattr(similarity, "TOKENS", 500)
    classes = similarity.set_classes(spark.createDataFrame(rows, "scope string, id long, tokens array<string>"))
    joined = []
    by_token = similarity._by_token
    monkeypatch.setattr(similarity, "_by_token", lambda reps, total, *rest: joined.append(total) or by_token(reps, total, *rest))
    for percent, least, part, sure, steps in ((60, 1, 1 << 19, 2048, 128), (60, 30, 700, 2048, 128), (40, 6, 1000, 2048, 128), (60, 1, 1000, 50, 0)):
        monkeypatch.setattr(similarity, "PART", part)
        monkeypatch.setattr(similarity, "SURE", sure)
        monkeypatch.setattr(similarity, "STEPS", steps)
        want = {(a, b, c, u) for (a, b), (c, u) in similar_pairs(rows, percent).items() if c >= least}
        got = [(r["a"], r["b"], r["common"], r["union"]) for r in similarity.similar_sets(classes, percent, least).collect()]
        assert sorted(got) == sorted(want) and len(want) > 1500
        # Only sets with little in common, and the last's components, go by token.
        assert (joined.pop() > 0) == (percent == 40 or sure == 50)
