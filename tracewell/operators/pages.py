"""Page extraction: title, paragraphs, dates and links of fetched pages.

The one parser of the library, and Python because no column function parses
HTML; it runs Arrow-batched, a page at a time, and its output is joined and
ranked by Spark. Paragraphs are those inside article or main, else all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LONGEST_VALUE, MOST_NAMES
from ..functions.urls import TRACKING

LEAST_PARAGRAPH, MOST_LINKS = 40, 12
# Elements that end a paragraph, that hold no text of the page, that have no end, and that quote another page's dates.
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 blockquote td pre section article main br tr ul ol table".split())
SILENT = frozenset("script style noscript template nav footer aside header form svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
QUOTING = frozenset("blockquote figure aside nav header footer".split())
# Meta names of publication dates, keys of JSON-LD dates and page identities, kinds of publications, and bounds.
META_DATES = (
    "article:published_time", "og:published_time", "datepublished", "dc.date.issued", "parsely-pub-date", "sailthru.date", "publish-date", "pubdate",
)
JSON_DATES, IDENTITIES = ("datePublished", "datePosted"), ("url", "@id", "mainEntityOfPage")
PUBLICATION = re.compile("article|posting|report", re.I)
TIERS = ("page_url", "main_entity", "root_entity")
DEEPEST, MOST_OPEN_GRAPH, MOST_ENTITIES = 8, 32, 8


def canonical(url: str) -> str:
    """As functions.urls.canonical; a text that is no http(s) URL stays as it is."""
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return url
    host = re.sub(r"^www\.(?=.)", "", parts.hostname or "")
    if parts.scheme not in ("http", "https") or not host:
        return url
    kept = [x.partition("=") for x in parts.query.split("&") if x]
    kept = sorted((n, v) for n, _, v in kept if not n.lower().startswith("utm_") and n.lower() not in TRACKING)
    query = "&".join(f"{n}={v}" for n, v in kept)
    shown = "" if port in (None, {"http": 80, "https": 443}[parts.scheme]) else f":{port}"
    return f"{parts.scheme}://{host}{shown}{parts.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.blocks, self.links, self.dates, self.scripts = url, None, [], [], [], []
        self.silent = self.inside = 0
        self.text, self.in_title, self.in_json, self.og = [], False, False, {}
        self.open: list[tuple[str, bool, str]] = []

    def _time(self, value: str) -> tuple[str, str, str | None, str | None]:
        """A <time> of publication, by whose element it is."""
        if any(tag in QUOTING for tag, _, _ in self.open):
            return "time", value, None, "quoted_time_owner"
        owner = next((item for _, scoped, item in reversed(self.open) if scoped), "")
        if not owner or not self.url:
            return "time", value, None, "unbound_time_owner"
        if canonical(urljoin(self.url, owner)) != canonical(self.url):
            return "time", value, None, "contradictory_time_owner"
        return "time", value, "page_url", None

    def _end_block(self) -> None:
        said = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if said:
            self.blocks.append((self.inside > 0, said))
        self.text = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "script" and "ld+json" in a.get("type", ""):
            self.in_json = True
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS:
            self._end_block()
        if tag in ("article", "main"):
            self.inside += 1
        if tag == "title":
            self.in_title = True
        if tag == "meta":
            name, content = (a.get("property") or a.get("name") or "").lower(), a.get("content", "").strip()
            if name in META_DATES and content:
                self.dates.append(("meta", content, None, None))
            if name.startswith(("og:", "article:")) and content and len(self.og) < MOST_OPEN_GRAPH:
                self.og.setdefault(name, content[:LONGEST_VALUE])
        if tag == "time" and a.get("datetime", "").strip() and {"datePublished", "datePosted"} & set(a.get("itemprop", "").split()):
            self.dates.append(self._time(a["datetime"].strip()))
        if tag not in VOID:
            self.open.append((tag, "itemscope" in a, a.get("itemid", "")))
        if tag == "a" and self.inside and not self.silent and a.get("href"):
            link = urljoin(self.url, a["href"]) if self.url else a["href"]
            if link.startswith("http") and link not in self.links and len(self.links) < MOST_LINKS:
                self.links.append(link)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_block()
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)
        if tag == "title":
            self.in_title = False
        if tag == "script":
            self.in_json = False
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.in_json:
            self.scripts.append(data)
        elif self.in_title:
            self.title = (self.title or "") + data
        elif not self.silent:
            self.text.append(data)


def _name(value) -> str | None:
    """A text, or what a person or organisation is called; never what else it holds."""
    if isinstance(value, dict):
        value = value.get("name") or value.get("@id")
    return value.strip()[:LONGEST_VALUE] if isinstance(value, str) and value.strip() else None


def _names(value) -> list[str]:
    found = [_name(x) for x in (value if isinstance(value, list) else [value])]
    return [x for x in found if x][:MOST_NAMES]


def _identities(node: dict) -> list[str]:
    """Canonical forms of the absolute URLs that an entity says it is."""
    named = [v.get("@id") if isinstance(v, dict) else v for v in map(node.get, IDENTITIES)]
    return [canonical(v) for v in named if isinstance(v, str) and re.match("https?:", v.strip(), re.I)]


def _is_publication(node: dict) -> bool:
    kinds = node.get("@type")
    return any(isinstance(k, str) and PUBLICATION.search(k) for k in (kinds if isinstance(kinds, list) else [kinds]))


def _entities(node, url: str, tier: str | None, depth: int) -> Iterator[tuple[dict, str | None, bool]]:
    """(publication, tier, contradicted) of a JSON-LD value and all below it.

    An entity is this page by its URL, or as the main entity of what is this page
    or the document's root, or as a publication at the root. One that says it is
    another page is none of these, nor is what merely lies within.
    """
    if depth > DEEPEST or not isinstance(node, (dict, list)):
        return
    if isinstance(node, list):
        for x in node:
            yield from _entities(x, url, tier, depth)
        return
    own = _identities(node) if url else []
    contradicted = bool(own) and url not in own
    if own:
        tier = None if contradicted else "page_url"
    if tier is None and not contradicted and depth == 0 and _is_publication(node):
        tier = "root_entity"
    if _is_publication(node):
        yield node, tier, contradicted
    for key, value in node.items():
        below = key == "mainEntity" and not contradicted and (tier is not None or depth == 0)
        yield from _entities(value, url, "main_entity" if below else None, depth + 1)


def _json_ld(scripts: list[str], url: str | None) -> tuple[list[tuple], list[dict]]:
    """(dates, entities): dates with their tier, strongest first, or the reason they were refused; what bound entities say of themselves."""
    parsed = []
    for script in scripts:
        try:
            parsed.append(json.loads(script))
        except (ValueError, RecursionError):
            continue
    page = canonical(url) if url else ""
    accepted, refused, entities = [], [], []
    for node, tier, contradicted in (e for value in parsed for e in _entities(value, page, None, 0)):
        said = [node[k].strip() for k in JSON_DATES if isinstance(node.get(k), str) and node[k].strip()]
        if tier is None:
            refused += [("json_ld", d, None, "contradictory_entity_binding" if contradicted else "unbound_nested_entity") for d in said]
            continue
        accepted += [("json_ld", d, tier, None) for d in said]
        kinds = node.get("@type")
        entities.append({
            "binding": tier,
            "types": [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)][:MOST_NAMES],
            "headline": _name(node.get("headline") or node.get("name")),
            "author": _names(node.get("author") or node.get("creator")),
            "publisher": (_names(node.get("publisher")) or [None])[0],
            "description": _name(node.get("description")),
        })
    accepted.sort(key=lambda d: TIERS.index(d[2]))
    if not accepted:
        # The document's root may state the date without being a publication, unless it is another page.
        for root in (r for value in parsed for r in (value if isinstance(value, list) else [value])):
            if isinstance(root, dict) and isinstance(root.get("datePublished"), str) and root["datePublished"].strip():
                own = _identities(root) if page else []
                if not own or page in own:
                    accepted.append(("json_ld", root["datePublished"].strip(), "root_entity", None))
    return accepted + refused, entities[:MOST_ENTITIES]


def extract(url: str | None, html: str | None) -> dict:
    """What one page says; empty for a null page."""
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    page._end_block()
    inside = [s for own, s in page.blocks if own] or [s for _, s in page.blocks]
    dates, entities = _json_ld(page.scripts, url)
    return {
        "title": (page.title or "").strip() or None,
        "og_title": page.og.get("og:title"),
        "paragraphs": [s for s in inside if len(s) >= LEAST_PARAGRAPH],
        "dates": [dict(zip(("source", "raw", "binding", "refused"), d)) for d in dates + page.dates],
        "links": page.links,
        "open_graph": [{"name": n, "value": v} for n, v in page.og.items()],
        "entities": entities,
    }


_STRINGS = pa.list_(pa.string())
_SCHEMA = pa.schema([
    ("page_id", pa.int64()),
    ("title", pa.string()),
    ("og_title", pa.string()),
    ("paragraphs", _STRINGS),
    ("dates", pa.list_(pa.struct([(n, pa.string()) for n in ("source", "raw", "binding", "refused")]))),
    ("links", _STRINGS),
    ("open_graph", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ("entities", pa.list_(pa.struct([
        ("binding", pa.string()), ("types", _STRINGS), ("headline", pa.string()), ("author", _STRINGS), ("publisher", pa.string()), ("description", pa.string()),
    ]))),
])
_KIND = (
    "page_id long, title string, og_title string, paragraphs array<string>, "
    "dates array<struct<source string, raw string, binding string, refused string>>, links array<string>, "
    "open_graph array<struct<name string, value string>>, "
    "entities array<struct<binding string, types array<string>, headline string, author array<string>, publisher string, description string>>"
)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages = (batch.column(i) for i in range(3))
        rows = [{"page_id": i.as_py()} | extract(u.as_py(), h.as_py()) for i, u, h in zip(ids, urls, pages)]
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def pages(rows: DataFrame) -> DataFrame:
    """(page_id, title, og_title, paragraphs, dates, links, open_graph, entities) of (page_id, url, html).

    Dates come with the tier by which a JSON-LD entity is this page, strongest
    first, or with the reason why they are not the page's: those are in
    refused_dates() and in no other result.
    """
    return rows.select("page_id", "url", "html").mapInArrow(_extract_batches, _KIND)


def paragraphs(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", F.posexplode("paragraphs").alias("ord", "paragraph"))


def page_dates(extracted: DataFrame) -> DataFrame:
    """(page_id, ord, source, raw, binding) of the dates that are the page's own."""
    rows = extracted.select("page_id", F.posexplode("dates").alias("ord", "d")).where("d.refused IS NULL")
    return rows.select("page_id", "ord", "d.source", "d.raw", "d.binding")


def refused_dates(extracted: DataFrame) -> DataFrame:
    """(page_id, ord, source, raw, reason)."""
    rows = extracted.select("page_id", F.posexplode("dates").alias("ord", "d")).where("d.refused IS NOT NULL")
    return rows.select("page_id", "ord", "d.source", "d.raw", F.col("d.refused").alias("reason"))
