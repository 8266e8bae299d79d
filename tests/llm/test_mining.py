"""Main text, phrases and spelling variants: odd rows, and against plain versions."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import main_text, phrases, spelling

# --- main text ---------------------------------------------------------------


def text_of(html, template=None, container=None, host_pages=1):
    return main_text.page_text(main_text.Pages(), html, main_text.Template(template), container, host_pages)


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href='/'>Home</a></nav><article><h1>One</h1><p>two <b>th</b>ree<br>four<p>five</article><footer>six</footer>", "One two three four five"),
        ("<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;c</p></article>", "a <b> &amp; é c"),
        ("<article><p>x<script>var a='</p>no';</script>y<style>p{}</style></p></article>", "xy"),
        ("<article><p title='a > b'>in</p><!-- <p>out</p> --></article>", "in"),
        ("<article><p>kept</p><div class='ad'>bought</div><form><p>fill in</p></form><div id='user-comments'><p>said</p></div></article>", "kept"),
        ("<div class='cookie-notice'>We use cookies, all of them, as ever</div><div id=content><h1>T</h1><div class=body><p>The story is long enough.</p><p>More.</p></div></div>", "T The story is long enough. More."),
        ("<main><div class='intro'>Teaser</div><article><p>Told</p></article></main>", "Told"),
        ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Text</p></article></body>", "Title Text"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one two a b c"),
        ("<article><p>open <a href='x>never closed</p></article>", "open never closed"),
        ("plain words, no markup at all", "plain words, no markup at all"),
        ("<div>" * 5000 + "deep words here" + "</div>" * 5000, "deep words here"),
        ("<article><p>" + "word " * 100_000 + "</p></article>", ("word " * 100_000).strip()),
    ],
)
def test_main_text_of_a_page(html, want):
    assert text_of(html) == want


def site(i, words):
    return (
        f"<html><head><title>{i}</title></head><body><div class='top'><ul>{'<li><a href=/>go</a></li>' * (i % 4 + 1)}</ul></div>"
        f"<div class='c1'><h1>Story {words[0]}</h1><p>{' '.join(words)}</p>{'<p>again ' + words[1] + '</p>' if i % 2 else ''}"
        f"<p>Read our terms before quoting</p></div><div class='c2'><p>Seen by {i} readers of this place</p></div></body></html>"
    )


def test_templates_of_a_host(spark):
    rng, rows, want = random.Random(3), [], {}
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((i, "https://a.example/x", site(i, words), "clash"))
        want[i] = f"Story {words[0]} {' '.join(words)}" + (f" again {words[1]}" if i % 2 else "")
    rows += [(100, None, None, "clash"), (101, "https://b.example/", "<article>alone</article>", "clash"), (101, "https://b.example/", "<article>alone</article>", "clash")]
    rows += [(102, "https://a.example/y", "", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string").repartition(3)
    got = main_text.main_text(pages, F.regexp_extract("url", "://([^/]*)", 1)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 44 and {i: texts[i] for i in want} == want
    assert (texts[100], texts[101], texts[102]) == ("", "alone", "")
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text.main_text(pages.limit(0), F.lit("h")).count() == 0


def test_occurrence_vectors_group_tokens(spark):
    """Classes equal those of a plain count of tokens a page."""
    pages = [site(i, [f"w{i}{k}" for k in range(5)]) for i in range(12)]
    reader, counts = main_text.Pages(), defaultdict(dict)
    for i, page in enumerate(pages):
        own = Counter()
        for node, text, _, roles in reader.blocks(page):
            own.update(roles)
            own.update(node.word(w) for w in text.split())
        for role, n in own.items():
            counts[role][i] = n
    words = {node.word(w) for p in pages for node, text, _, _ in reader.blocks(p) for w in text.split()}
    often = {r: tuple(sorted(c.items())) for r, c in counts.items() if len(c) >= 3 and (r not in words or len(c) == 12)}
    want = defaultdict(set)
    for role, vector in often.items():
        want[vector].add(role)
    frame = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(4)
    got = defaultdict(set)
    for r in main_text.classes_of(frame).collect():
        got[r["class"]].add(r.role)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_valid_classes_are_ordered_and_nested():
    def page(*roles):
        return [(main_text.Node(None, "", "", False, False), "", 0, list(roles))]

    template = main_text.Template([{"role": r, "class": c, "at": None} for r, c in ((1, 7), (2, 7), (3, 8), (4, 8))])
    nested, crossed, mixed = template.nesting(page(1, 3, 4, 3, 4, 2)), template.nesting(page(1, 3, 2, 4)), template.nesting(page(1, 4, 3, 3, 4, 2))
    assert nested[7][0] and nested[8][0] and nested[7][1] and nested[8][1] and nested[7][1] != nested[8][1]
    assert crossed[8][1] == 0 and mixed[8] == (0, 0)


# --- phrases -----------------------------------------------------------------


def plain_grams(rows):
    """Counts of runs of one to three words, and of those with a word before and after."""
    counts, before, after, total = Counter(), Counter(), Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = lang or "und", tuple(w[i : i + k])
                    counts[key] += 1
                    before[key] += i > 0
                    after[key] += i + k < len(w)
    return counts, before, after, total


def plain_phrases(rows):
    counts, _, _, total = plain_grams(rows)
    out = defaultdict(list)
    often = {key: a for key, a in counts.items() if a >= 10 and len(key[1]) > 1}
    around = Counter()
    for (lang, p), a in often.items():
        for part in (p[:2], p[1:]) if len(p) == 3 else ():
            around[lang, part] = max(around[lang, part], a)
    for (lang, p), a in often.items():
        if 100 * around[lang, p] >= 50 * a:
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return [
        (lang, rank, p.decode(), -a, l, r, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:2000], 1)
    ]


SOME = st.lists(st.tuples(st.sampled_from(["en", "de", None]), st.text("abAB é.,\t\n", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(SOME)
def test_index_counts_patterns(rows):
    counts, before, after, _ = plain_grams(rows)
    batch = pa.RecordBatch.from_pylist([{"lang": lang or "und", "text": text} for lang, text in rows], pa.schema([("lang", pa.string()), ("text", pa.string())]))
    seen = 0
    for shard, words, index in phrases._indexed(phrases._shards([batch])):
        words = words.to_pylist()
        found = index.singles()
        for k in (1, 2, 3):
            left, right = index.going_on(found)
            for ids, n, lo, hi in zip(found.words, found.size, left, right):
                key = shard["lang"], tuple(words[i - 1] for i in ids)
                assert (counts[key], before[key], after[key]) == (n, lo, hi)
                seen += 1
            if k < 3:
                found = index.to_the_right(found)
    assert seen == len(counts)


def test_phrases_match_a_plain_count(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "of", "new", "york", "city", "los", "angeles", "état", "a1"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t.title() if i % 3 else t, [None, "en", "fr"][i % 3], "x") for i, t in enumerate(texts)]
    rows += [(None, None, "en", "x"), (1, "", None, "x"), (2, "new york " * 40_000, "xx", "x"), (2, " \t \n", "yy", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string").repartition(5)
    got = [tuple(r) for r in phrases.mine(docs).drop("n_left", "n_right").collect()]
    assert sorted(got) == sorted(plain_phrases([(lang, t) for _, t, lang, _ in rows]))
    assert phrases.mine(docs.limit(0)).count() == 0


def test_shards_are_cut(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 50)
    monkeypatch.setattr(phrases, "SLICE", 40)
    rng = random.Random(6)
    rows = [("en", " ".join(rng.choice("abcde") + rng.choice([" ", ". "]) for _ in range(200))) for _ in range(5)]
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "text": text} for lang, text in rows])
    shards, total = list(phrases._indexed(phrases._shards([batch]))), Counter()
    assert len(shards) > 10
    for _, words, index in shards:
        found = index.to_the_right(index.to_the_right(index.singles()))
        total.update({tuple(words[int(i) - 1].as_py() for i in ids): int(n) for ids, n in zip(found.words, found.size)})
    assert total == Counter({p: n for (_, p), n in plain_grams(rows)[0].items() if len(p) == 3})


# --- spelling variants -------------------------------------------------------


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_match_brute_force(spark):
    rng, rows = random.Random(8), []
    base = ["".join(rng.choice("abcéÿ") for _ in range(rng.randrange(6, 9))) for _ in range(150)]
    for i in range(400):
        words = [rng.choice(base[: 1 + int(rng.expovariate(0.05)) % 150]) for _ in range(80)]
        words = [w.upper().replace("É", "é").replace("Ÿ", "ÿ") if rng.random() < 0.2 else w for w in words]
        rows.append((i if i % 7 else None, "×" * (i % 2) + " ".join(words) + "'s 12x", "x", "y"))
    rows += [(5, None, "x", "y"), (5, "", "x", "y"), (6, "q" * 300 + " " + " ".join(["z" * 299 + "a"] * 9), "x", "y"), (6, " ".join(["z" * 300] * 50), "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, form string").repartition(4)
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    want = plain_variants([r[:2] for r in rows])
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] for r in want)
    assert spelling.variants(docs.limit(0)).count() == 0


def pairs_of(words):
    return {(a, b) for a, b in itertools.combinations(sorted(words), 2) if is_near(a, b)}


@pytest.mark.parametrize("cell, hot", [(1024, 8192), (8, 1 << 30), (4, 6)])
def test_near_pairs_by_cells(spark, monkeypatch, cell, hot):
    """Few and many cells, and cells dealt to parts; words with the same letters fill cells that no tree can split."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(9)
    words = {"".join(p) for p in itertools.permutations("abcdef")} | {"".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 0, 5040, 9)}
    words |= {"".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 9))) for _ in range(600)}
    frame = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long").repartition(3)
    found = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs_of(words)


@pytest.mark.parametrize("many", [0, 1 << 16])
def test_near_rows(monkeypatch, many):
    monkeypatch.setattr(spelling, "MANY", many)
    rng = random.Random(10)
    own = ["".join(rng.choice("abÿ") for _ in range(7)) for _ in range(200)]
    for length in (6, 7):
        other = ["".join(rng.choice("abÿ") for _ in range(length)) for _ in range(150)]
        a, b = spelling.near_rows(spelling.codes_of(own), spelling.codes_of(other))
        got = sorted(zip(a.tolist(), b.tolist()))
        assert got == [(i, j) for i, w in enumerate(own) for j, v in enumerate(other) if is_near(w, v)]


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)] + [("x", "y")], "word string, form string")
    got = dict(spelling.roots(chain).collect())
    assert got == {f"w{i:02}": "w37" for i in range(37)} | {"x": "y"}


def test_letter_vectors():
    codes = spelling.codes_of(["aabzÀÿ"])
    assert np.flatnonzero(spelling.vectors_of(codes)[0]).tolist() == [0, 1, 25, 26, 89]
