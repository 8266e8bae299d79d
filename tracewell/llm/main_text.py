"""Main text of web pages, by templates that pages of one host share.

A page is a row of tokens: tags, and words, each by the path of block elements
around it. Tokens of a host with one occurrence vector (how often each page has
them) are an equivalence class; the vector is kept as sums over pages of hashes of
page and count, so that no host's pages are gathered. A class is valid if every
page has its tokens in one order, over and over, and always within the same gap
of the class around it: valid classes nest into the host's template.

Words of the template are no content. What remains between its tokens are slots.
Slots vote, by the words that they hold, for the container of the host's
main text: an element of the template. Its blocks make up a page's text, without
those that by name are menus, forms, comments and the like, and without blocks
that are all template. Hosts of one page, and pages without their host's
container, vote alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, written

#: A class is on so many pages at least, and on one of so many of its host's.
LEAST_PAGES, ONE_IN = 2, 4
#: Votes of a word in a main element, and squared in an article, for one of a word elsewhere.
FIRST_CALL = 1000
#: Pages of a host from which on a block that is all template is no content.
SURE_PAGES = 10
#: Words and tags that a task holds before it hands them on; nodes and tags that it remembers.
HELD, REMEMBERED = 500_000, 50_000
#: Roles of all templates together that go to the pages by broadcast, 16 bytes each; more go by shuffle.
FEW = 1_000_000

#: Elements that begin and end a block of text. All others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text for readers; what they hold is skipped up to their end tag.
SKIPPED = frozenset("script style title textarea noscript template iframe object svg math audio video canvas xmp noembed noframes".split())
#: What an element closes where it begins, up to the nearest of the elements named after it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements nested deeper than this make no path of their own; their text counts as that of the last that does.
DEPTH = 512
IN_PARAGRAPHS = frozenset({"button", "option", "optgroup", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head"})

#: Elements that are no main text, and words that say so in a class, id or role.
ASIDE = frozenset("nav footer aside form button select fieldset menu dialog search head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies copyright dialog disqus footer form gdpr legal login menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Only outside an article or main element.
HEADER_WORDS = frozenset("header masthead topbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Words of a name, and single digits; longer numbers tell pages apart, not places.
_NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*|(?<![0-9])[0-9](?![0-9])")
_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in SKIPPED}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace"), 11)
    return h - (1 << 64) if h >> 63 else h


class Node:
    """A path of block elements; nodes are shared by all pages that a task reads."""

    __slots__ = ("name", "parent", "depth", "children", "opened", "closed", "aside", "article", "inline", "container")

    def __init__(self, parent: Node | None, name: str, label: str, aside: bool, header: bool):
        self.parent, self.name, self.children, self.inline = parent, name, {}, {}
        self.depth = parent.depth + 1 if parent else 0
        self.opened = _hash(str(parent.opened if parent else ""), label)
        self.closed = _hash(str(self.opened), ">")
        # 2 within an article element, 1 within main.
        self.article = max(2 if name == "article" else 1 if name == "main" else 0, parent.article if parent else 0)
        aside = (aside and name not in ("html", "body", "main")) or (header and not self.article)
        self.aside = aside or bool(parent and parent.aside)
        # Where texts right below this element count: the outermost article, or main, else the element around a block of text.
        if parent is None:
            self.container = self
        elif self.article:
            self.container = parent.container if parent.article == self.article else self
        else:
            self.container = parent if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th") else self

    def tag(self, name: str) -> int:
        if name not in self.inline:
            self.inline[name] = _hash(str(self.opened), "=", name)
        return self.inline[name]

    def word(self, word: str) -> int:
        return _hash(str(self.opened), "w", word)


class Pages:
    """Reads pages into tokens; what it has seen of paths and tags is remembered, up to a bound."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.root, self.labels, self.nodes = Node(None, "", "", False, False), {}, 0

    def _label(self, tag: str, name: str, attributes: str) -> tuple[str, bool, bool]:
        if tag in self.labels:
            return self.labels[tag]
        found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
        names = [w.lower() for k in ("class", "id", "role") for w in _NAMES.findall(found.get(k, ""))]
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
        aside = hidden or name in ASIDE or not ASIDE_WORDS.isdisjoint(names)
        header = name == "header" or not HEADER_WORDS.isdisjoint(names)
        label = name + "".join(f".{w}" for w in names) + "!" * hidden
        self.labels[tag] = label, aside, header
        return self.labels[tag]

    def _child(self, node: Node, tag: str, name: str, attributes: str) -> Node:
        label, aside, header = self._label(tag, name, attributes)
        if label not in node.children:
            node.children[label] = Node(node, name, label, aside, header)
            self.nodes += 1
        return node.children[label]

    def tokens(self, html: str | None) -> Iterator[tuple[int, Node, str, bool]]:
        """(role, node, text, whether within a link): a tag has a role and no text, a stretch of text no role."""
        if self.nodes + len(self.labels) > REMEMBERED:
            self.forget()
        html, at, node, links = html or "", 0, self.root, 0
        while True:
            m = _TAG.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                yield 0, node, text, links > 0
            if not m:
                break
            at, name = m.end(), (m[2] or m[5] or "").lower()
            if not name:
                continue
            end, attributes = m[1] or m[4], m[3] or m[6] or ""
            if name in SKIPPED:
                if not end and not attributes.endswith("/"):
                    close = _ENDS[name].search(html, at)
                    at = close.start() if close else len(html)
                yield node.tag(name), node, "", links > 0
            elif name not in BLOCKS:
                links += (1 if not end else -1 if links else 0) if name == "a" else 0
                if name in ("br", "hr", "wbr"):
                    yield 0, node, " " if name != "wbr" else "", links > 0
                yield node.tag(f"/{name}" if end else name), node, "", links > 0
            elif end:
                up = node
                while up.parent and up.name != name:
                    up = up.parent
                if up.parent:
                    while node is not up:
                        yield node.closed, node, "", False
                        node = node.parent
                    yield node.closed, node, "", False
                    node, links = node.parent, 0
            else:
                if node.name == "p" and name not in IN_PARAGRAPHS:
                    yield node.closed, node, "", False
                    node = node.parent
                closes, within = CLOSES.get(name, (set(), set()))
                up, last = node, None
                while closes and up.parent and up.name not in within:
                    last = up if up.name in closes else last
                    up = up.parent
                while last is not None and node is not last.parent:
                    yield node.closed, node, "", False
                    node = node.parent
                # A second html or body adds nothing.
                if node.depth >= DEPTH or (name in ("html", "body") and any(n.name == name for n in _up(node))):
                    continue
                node, links = self._child(node, m[0] if attributes else name, name, attributes), 0
                yield node.opened, node, "", False
        while node.parent:
            yield node.closed, node, "", False
            node = node.parent

    def blocks(self, html: str | None) -> Iterator[tuple[Node, str, int, list[int]]]:
        """(node, text, words within links, roles before it) of each block of text, in page order."""
        node, parts, linked, roles = self.root, [], 0, []
        for role, at, text, link in self.tokens(html):
            if role and (role == at.opened or role == at.closed):
                if parts and (whole := " ".join("".join(parts).split())):
                    yield node, whole, linked, roles
                    roles = []
                parts, linked = [], 0
                roles.append(role)
            elif role:
                roles.append(role)
            else:
                text = entities.unescape(text) if "&" in text else text
                node = at
                parts.append(text)
                linked += len(text.split()) if link else 0
        if parts and (whole := " ".join("".join(parts).split())):
            yield node, whole, linked, roles
            roles = []
        if roles:
            yield self.root, "", 0, roles


def _up(node: Node) -> Iterator[Node]:
    while node.parent:
        yield node
        node = node.parent


# --- occurrence vectors ------------------------------------------------------

#: ``at`` is the element of a word, null for tags.
VECTORS = "host string, role long, at long, n_pages long, total long, v1 long, v2 long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over pages, by host and role; role 0 counts the host's pages that are not empty.

    Of words only those on every page count: on every page of the host means on
    every one that this task has of it.
    """
    reader, tags, words, pages = Pages(), defaultdict(dict), {}, Counter()
    held = 0

    def added(sums: dict, role, n: int, key: int) -> None:
        h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), key)
        old = sums.get(role, (0, 0, 0, 0))
        sums[role] = old[0] + 1, old[1] + n, old[2] + (h >> 32), old[3] + (h & 0xFFFFFFFF)

    def handed() -> pa.RecordBatch:
        rows = [(host, 0, None, n, 0, 0, 0) for host, n in pages.items()]
        rows += [(host, role, None, *sums) for host, found in tags.items() for role, sums in found.items()]
        rows += [(host, node.word(w), node.opened, *sums) for host, found in words.items() for node, sums_of in found.items() for w, sums in sums_of.items()]
        kinds = [pa.string(), *[pa.int64()] * 6]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays(columns, ["host", "role", "at", "n_pages", "total", "v1", "v2"])

    for batch in batches:
        for host, html in zip(batch["host"].to_pylist(), batch["html"]):
            html = html.as_py() or ""
            own, said = Counter(), defaultdict(Counter)
            known = words.get(host)
            for node, text, _, roles in reader.blocks(html):
                own.update(roles)
                if known is None:
                    said[node].update(text.split())
                elif node in known:
                    said[node].update(w for w in text.split() if w in known[node])
            if not own:
                continue
            key = xxhash.xxh64_intdigest(html.encode("utf-8", "replace"), 3)
            pages[host] += 1
            for role, n in own.items():
                added(tags[host], role, n, key)
            held -= sum(map(len, (known or {}).values()))
            # Of the words known so far, those that this page has too.
            words[host] = {node: {w: known[node][w] for w in found} if known else {} for node, found in said.items() if found}
            for node, sums in words[host].items():
                for w, n in said[node].items():
                    added(sums, w, n, key)
                held += len(sums)
            if held >= HELD or len(pages) >= HELD // 100:
                yield handed()
                tags.clear(), words.clear(), pages.clear()
                held = 0
    yield handed()


def classes_of(pages: DataFrame) -> DataFrame:
    """(host, class, role): the large and frequent equivalence classes of each host, from (host, html)."""
    parts = pages.mapInArrow(_vectors, VECTORS)
    sums = parts.groupBy("host", "role").agg(F.max("at").alias("at"), *[F.sum(c).alias(c) for c in ("n_pages", "total", "v1", "v2")])
    sums = written(sums, "vectors")
    hosts = sums.where("role = 0").select("host", F.col("n_pages").alias("host_pages"))
    often = sums.where("role <> 0").join(hosts, "host").where(
        (F.col("n_pages") >= LEAST_PAGES) & (F.col("n_pages") * ONE_IN >= F.col("host_pages")) & (F.col("at").isNull() | (F.col("n_pages") == F.col("host_pages")))
    )
    every = often.select("host", "host_pages", F.xxhash64("n_pages", "total", "v1", "v2").alias("class"), "role", "at")
    size = every.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    return written(every.join(size, ["host", "class"]), "classes")


# --- templates ---------------------------------------------------------------


def _with(pages: DataFrame, templates: DataFrame, size: int) -> DataFrame:
    """Each page with its host's row; pages are not moved where the rows are proven few."""
    return pages.join(F.broadcast(templates) if size <= FEW else templates, "host", "left")


def _by_host(roles: DataFrame) -> DataFrame:
    """One row a host: a template has as many roles as a page, not as the host's pages."""
    return roles.groupBy("host").agg(F.collect_list(F.struct("role", "class", "at")).alias("template"), F.max("host_pages").alias("host_pages"))


class Template:
    """Classes of a host, as they nest on one page at a time."""

    def __init__(self, rows: list[dict] | None):
        rows = rows or []
        self.of = {r["role"]: r["class"] for r in rows}
        # Roles of words by their element: words elsewhere need not be looked at.
        self.words: dict[int, set[int]] = defaultdict(set)
        for r in rows:
            if r["at"] is not None:
                self.words[r["at"]].add(r["role"])
        self.size = Counter(self.of.values())

    def nesting(self, blocks: list[tuple[Node, str, int, list[int]]]) -> dict[int, tuple[int, int]]:
        """(order, gap) of each class on a page, as hashes; 0 where its tokens are in no order or cross another's."""
        places = defaultdict(list)
        row: list[int] = []
        for node, text, _, roles in blocks:
            row += [r for r in roles if r in self.of]
            if text and (known := self.words.get(node.opened)):
                row += [r for r in map(node.word, text.split()) if r in known]
        for role in row:
            places[self.of[role]].append(role)
        orders, step = {}, {}
        for c, found in places.items():
            k = self.size[c]
            first = found[:k]
            repeats = len(found) % k == 0 and len(set(first)) == k and found == first * (len(found) // k)
            orders[c] = _hash(*map(str, first)) | 1 if repeats else 0
            step |= {role: i for i, role in enumerate(first)} if repeats else {}
        gaps: dict[int, int] = {}
        opened: list[list[int]] = [[0, 0]]
        for role in row:
            c = self.of[role]
            if not orders[c]:
                continue
            if step[role] == 0:
                gap = _hash(str(opened[-1][0]), str(opened[-1][1])) | 1
                gaps[c] = gap if gaps.get(c, gap) == gap else 0
                opened.append([c, role])
            else:
                if all(c != each for each, _ in opened):
                    gaps[c] = 0
                    continue
                # What is open within this class's repetition crosses it.
                while opened[-1][0] != c:
                    gaps[opened.pop()[0]] = 0
                opened[-1][1] = role
            if step[role] == self.size[c] - 1:
                opened.pop()
        return {c: (order, gaps.get(c, 0) if order else 0) for c, order in orders.items()}

    def is_template(self, node: Node, text: str) -> bool:
        known = self.words.get(node.opened)
        return bool(known) and all(node.word(w) in known for w in text.split())


def _votes(blocks: list[tuple[Node, str, int, list[int]]], template: Template) -> Counter:
    """Words that blocks outside the template give to their containers."""
    votes: Counter = Counter()
    for node, text, linked, _ in blocks:
        if text and not node.aside and not template.is_template(node, text):
            words = len(text.split())
            # An article element has the first call, main the second; elsewhere lists of links do not count.
            if node.article or words > 2 * linked:
                votes[node.container] += words * FIRST_CALL**node.article
    return votes


JUDGED = "host string, kind int, id long, low long, high long, gap_low long, gap_high long, votes long"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host: order and gap of each class (kind 0), their least and largest, and votes for containers (kind 1)."""
    reader, found, votes = Pages(), {}, Counter()

    def handed() -> pa.RecordBatch:
        rows = [(host, 0, c, *seen, 0) for (host, c), seen in found.items()]
        rows += [(host, 1, container, 0, 0, 0, 0, n) for (host, container), n in votes.items()]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays(columns, ["host", "kind", "id", "low", "high", "gap_low", "gap_high", "votes"])

    for batch in batches:
        last, template = object(), None
        for host, html, rows in zip(batch["host"].to_pylist(), batch["html"], batch["template"]):
            if host != last:
                last, template = host, Template(rows.as_py())
            blocks = list(reader.blocks(html.as_py()))
            for c, (order, gap) in template.nesting(blocks).items():
                low, high, gap_low, gap_high = found.get((host, c), (order, order, gap, gap))
                found[host, c] = min(low, order), max(high, order), min(gap_low, gap), max(gap_high, gap)
            for container, n in _votes(blocks, template).items():
                votes[host, container.opened] += n
            if len(found) + len(votes) >= HELD:
                yield handed()
                found.clear(), votes.clear()
    yield handed()


def templates_of(pages: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid classes of each host, as ``classes``, and (host, container): where its main text is."""
    rows = _with(pages, _by_host(classes), classes.count()).mapInArrow(_judged, JUDGED)
    rows = rows.groupBy("host", "kind", "id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("gap_low").alias("gap_low"), F.max("gap_high").alias("gap_high"), F.sum("votes").alias("votes")
    )
    rows = written(rows, "judged")
    valid = rows.where("kind = 0 AND low = high AND low <> 0 AND gap_low = gap_high AND gap_low <> 0").select("host", F.col("id").alias("class"))
    valid = written(classes.join(valid, ["host", "class"]), "valid")
    # A container that the template has goes before one that some page has by itself.
    has = valid.select("host", F.col("role").alias("id"), F.lit(1).alias("known"))
    chosen = rows.where("kind = 1").join(has, ["host", "id"], "left")
    best = F.max_by("id", F.struct(F.coalesce("known", F.lit(0)), "votes", "id")).alias("container")
    return valid, chosen.groupBy("host").agg(best)


def page_text(reader: Pages, html: str | None, template: Template, container: int | None, host_pages: int) -> str:
    """The blocks of the container that are content, joined by a space."""
    blocks = [b for b in reader.blocks(html) if b[1] and not b[0].aside]

    def under(wanted: int | None) -> list[tuple[Node, str]]:
        """What is below the container, with a first heading right below an element around it."""
        found = [(node, text, next((n for n in _up(node) if n.opened == wanted), None)) for node, text, _, _ in blocks] if wanted else []
        around = {id(n) for _, _, at in found if at for n in _up(at)}
        head = any(node.name == "h1" for node, _, at in found if at)
        return [(node, text) for node, text, at in found if at or (not head and node.name == "h1" and id(node.parent) in around)]

    kept = under(container)
    if not kept:
        votes = _votes(blocks, template) or _votes(blocks, Template(None))
        if votes:
            best = max(votes, key=lambda n: (votes[n], n.opened))
            kept = under(best.opened) or [(node, text) for node, text, _, _ in blocks if node is best]
    if host_pages >= SURE_PAGES:
        kept = [(node, text) for node, text in kept if not template.is_template(node, text)]
    return " ".join(text for _, text in kept)


def main_text(pages: DataFrame, host: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, by the templates of ``host``.

    A null or empty page has an empty text; a null host is a host of its own; pages
    that repeat have the same text; an empty table gives no rows; further columns,
    whatever their names, are left out. Pages are read whole, however long.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_col).alias("html")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Pages()
        for batch in batches:
            texts, last, template = [], object(), None
            for where, html, found, container, n in zip(*[batch[c] for c in ("host", "html", "template", "container", "host_pages")]):
                where = where.as_py()
                if where != last:
                    last, template = where, Template(found.as_py())
                texts.append(page_text(reader, html.as_py(), template, container.as_py(), n.as_py() or 0))
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    with scratch(spark) as keep, small_batches(spark):
        classes = classes_of(rows.select("host", "html"))
        valid, containers = templates_of(rows.select("host", "html"), classes)
        known = written(containers.join(_by_host(valid), "host", "left"), "templates")
        ready = _with(rows, known, valid.count() + known.count())
        return keep(written(ready.mapInArrow(extract, "page_id long, url string, text string, n_chars long"), "texts"))


#: On the given tables the main text of a page is its article element.
ORACLE_SQL = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM article),
decoded AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '&amp([^;]|$)', '&amp;\1', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded
"""
