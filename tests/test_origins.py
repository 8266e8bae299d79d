"""Reporting origins against a plain walk over the pages of an investigation."""

from __future__ import annotations

import random
import re

from tracewell.operators import origins

KIND = "inv int, cand_id string, ord int, domain string, text string, status string, group_id string"
REST = " This goes on." * 40
SAID = (
    "The photo was released by Reuters.", "The photo was released by the Coast Agency.", "The photo was first published by Herald.", "Syndicated from Herald; more.",
    "Courtesy of Post, and more.", "The video was published by Post.", "Reported by Jane Doe for the Examiner.", "The photo was not released by Reuters.",
    "The photo was released by Reuters. The credit is wrong.", "Reprinted from one two three four, and more.", "",
)
NAMES = {"The photo was released by Reuters.": "reuters", "The photo was released by the Coast Agency.": "coastagency", "The photo was first published by Herald.": "herald"}
MORE = {"The video was published by Post.": "post", "Reported by Jane Doe for the Examiner.": "examiner"}
TO = {"The photo was first published by Herald.": "name:herald", "Syndicated from Herald; more.": "name:herald", "Courtesy of Post, and more.": "name:post"}
FIRST = (r"first published by", r"Syndicated from", r"Courtesy of", r"Reprinted from")


def _walk(pages, groups):
    """Status and group of each page by going through all of them, one pass after the other."""
    state = {p["id"]: [p["status"], p["group"]] for p in pages}
    held = [p for p in pages if len(p["text"]) >= 400]
    for members in groups:
        found = [p for p in held if p["id"] in members]
        if len(found) > 1:
            for p in found:
                state[p["id"]] = ["shared_origin", "dup:" + found[0]["id"]]
    for p in held:
        phrase = next((x for x in FIRST if re.search(x, p["text"])), None)
        to = next((TO.get(s) for s in p["said"] if phrase and re.search(phrase, s)), None)
        if to and to[5:] != p["domain"].split(".")[0] and state[p["id"]][0] == "unresolved":
            state[p["id"]] = ["shared_origin", to]
    providers, separate = {}, []
    for p in held:
        if state[p["id"]][0] == "separate_origin_evidenced":
            continue
        media, own = [NAMES[s] for s in p["said"] if s in NAMES], p["domain"].split(".")[0]
        hosts = [MORE[s] for s in p["said"] if MORE.get(s) == "post"]
        lines = [MORE[s] for s in p["said"] if MORE.get(s) == "examiner"]
        outside = [k for k in dict.fromkeys(media + hosts + lines) if k != own]
        for k in outside:
            providers.setdefault(k, []).append(p["id"])
        if not outside and own in media:
            separate.append(p)
    for p in separate:
        if state[p["id"]][0] == "unresolved":
            state[p["id"]] = ["separate_origin_evidenced", "origin:" + p["domain"]]
    for k, ids in providers.items():
        if len(ids) > 1:
            for i in ids:
                state[i] = ["shared_origin", "provider:" + k]
    return {i: tuple(v) for i, v in state.items()}


def test_passes_equal_a_plain_walk(spark):
    rng, rows, groups, want = random.Random(5), [], [], {}
    for inv in range(60):
        pages = []
        for n in range(rng.randint(1, 7)):
            said = rng.sample(SAID, rng.randint(0, 3))
            separate = rng.random() < 0.25
            pages.append({
                "id": f"{inv}-{n}", "domain": rng.choice(("herald.com", "post.co.uk", "examiner.org", "reuters.com", "x.net")), "said": said,
                "text": "\n".join([*said, *([REST] if rng.random() < 0.85 else [])]),
                "status": "separate_origin_evidenced" if separate else "unresolved", "group": "origin:was" if separate else None,
            })
        near = [rng.sample([p["id"] for p in pages], min(len(pages), 3))] if rng.random() < 0.4 else []
        groups += [(inv, i, "g") for g in near for i in g]
        rows += [(inv, p["id"], n, p["domain"], p["text"], p["status"], p["group"]) for n, p in enumerate(pages)]
        want |= _walk(pages, near)
    got = origins.refine_origins(spark.createDataFrame(rows, KIND), spark.createDataFrame(groups, "inv int, cand_id string, grp string")).collect()
    assert {r["cand_id"]: (r["status"], r["group_id"]) for r in got} == want
    assert {r["basis"] for r in got} >= {None, "shared_named_provider", "article_text_duplication", "explicit_syndication_attribution", "separate_reporting_evidence"}


def test_what_cannot_be_judged_keeps_its_origin(spark):
    rows = [(1, "a", 0, "x.com", None, "unresolved", None), (1, "b", 1, None, "Syndicated from Herald; more." + REST, "unresolved", None), (1, "c", 2, "x.com", "", None, "g")]
    none = spark.createDataFrame([], "inv int, cand_id string, grp string")
    got = {r["cand_id"]: (r["status"], r["group_id"], r["changed"]) for r in origins.refine_origins(spark.createDataFrame(rows, KIND), none).collect()}
    assert got["a"] == ("unresolved", None, False) and got["c"] == ("unresolved", "g", False)
    assert got["b"] == ("shared_origin", "name:herald", True)
    assert origins.refine_origins(spark.createDataFrame([], KIND), none).count() == 0
