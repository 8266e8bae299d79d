"""Personal data in text: base patterns, and spans added by weak supervision.

Base spans come from fixed patterns. Wider patterns propose further candidates;
labelers (regular expressions, gazetteers, context) vote on each, base spans
included. A vote pattern with the candidate's shape is one of a bounded number
of codes. Spark counts the codes over all documents; expectation-maximisation
on those counts estimates each labeler's reliability without any label, and a
logistic regression on the codes, trained on the estimated labels, decides.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, written

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive repeats and look-behinds that
# find the same spans in linear time.
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wider patterns, for candidates.
SPELT_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]{2,63}){1,4}",
    re.I,
)
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
FULL_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{3,4}){2}(?![0-9-])")
CARD_GROUPS = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{13,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z-])")
# Within a run of digits and separators, at every group of it; the overlapping ones too.
CARD_IN_RUN = re.compile(r"(?<![0-9])(?=([0-9]{13,16}(?![0-9])|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?![0-9])|[0-9]{4}([ -])[0-9]{6}\3[0-9]{4,5}(?![0-9])))")
IP6 = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")

# Gazetteers and cue words.
CARD_PREFIX = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68]")
TOP_LEVEL = frozenset("com net org edu gov mil info biz io co de fr es it uk eu ch at nl be pl se no dk fi pt br in jp cn ru us ca au".split())
COUNTRY_CODE = re.compile(r"\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1-6]|9[0-5]|98)")
CUES = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell|anruf|tél", re.I),
}
AGAINST = re.compile(r"version|release|section|isbn|issn|serial|token|passw|secret|key|hash|sha|uuid|[=:/#]\s*\"?$", re.I)
NEAR = 24

LABELERS = ("form", "check", "gazetteer", "cue", "edge", "against")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kept, failed): (start, kind, end) of the base patterns' matches, by whether their check holds."""
    kept, failed = [], []
    end = 0
    if "@" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                kept.append((start, 0, m.end()))
                end = m.end()
    for m in IP.finditer(text):
        (kept if all(map(_small, m.group().split("."))) else failed).append((m.start(), 1, m.end()))
    for m in DIGITS.finditer(text):
        n = sum(c not in " -" for c in m.group()) if m.end() - m.start() <= 40 else 0
        if 12 <= n <= 19:
            (kept if luhn(_digits(m.group())) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum("0" <= c <= "9" for c in m.group())
            (kept if 9 <= n <= 15 else failed).append((m.start(), 3, m.end()))
    return sorted(kept), failed


def candidates(text: str, kept: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of further candidates, none of which touches a base span or an earlier candidate.

    Valid card numbers within any longer run of digits go before the others, and
    may overlap each other.
    """
    cards = valid_cards(text)
    # A match that failed its check may hold a narrower span; the narrower goes first.
    found = []
    for start, kind, end in failed:
        if kind >= 2:
            found += [(start + m.start(), 2, start + m.end()) for m in CARD_GROUPS.finditer(text[start:end])]
            found += [(start + m.start(), 3, start + m.end()) for m in FULL_PHONE.finditer(text[start:end])]
    found += [(s, k, e) for s, k, e in failed if e - s <= 64 and (k != 3 or _enough(text[s:e]))]
    if re.search(r"[\[({]at[\])}]", text, re.I):
        found += [(m.start(), 0, m.end()) for m in SPELT_EMAIL.finditer(text)]
    found += [(m.start(), 3, m.end()) for m in LOCAL_PHONE.finditer(text)]
    if text.count(":") >= 7:
        found += [(m.start(), 1, m.end()) for m in IP6.finditer(text)]
    cards = _free(cards, kept)
    out = []
    for s, k, e in _free(found, sorted(kept + cards)):
        if not out or s >= out[-1][2]:
            out.append((s, k, e))
    return sorted(out + cards)


def valid_cards(text: str) -> list[tuple[int, int, int]]:
    """Card numbers whose checksum and prefix hold, wherever a run of digits has them."""
    found = []
    for run in DIGITS.finditer(text):
        if run.end() - run.start() < 13:
            continue
        for m in CARD_IN_RUN.finditer(run.group()):
            digits = _digits(m.group(1))
            if CARD_PREFIX.match(digits) and luhn(digits):
                found.append((run.start() + m.start(1), 2, run.start() + m.end(1)))
    return found


def _free(found: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``found`` that touch none of the sorted ``spans``, by start, then end."""
    taken: list[list[int]] = []
    for s, _, e in spans:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, ends, at = [], [e for _, e in taken], 0
    for s, k, e in sorted(found, key=lambda x: (x[0], x[2])):
        at = bisect.bisect_right(ends, s, at)
        if not (at < len(taken) and taken[at][0] < e):
            out.append((s, k, e))
    return out


def _enough(s: str) -> bool:
    return sum("0" <= c <= "9" for c in s) >= 7


def votes(text: str, start: int, kind: int, end: int) -> str:
    """Kind, one vote (+, - or 0) of each labeler, and the span's shape, as one short code."""
    span, name = text[start:end], KINDS[kind]
    before, digits = text[max(0, start - NEAR) : start], _digits(text[start:end])
    left, right = text[start - 1 : start], text[end : end + 1]
    if name == "email":
        form = "@" in span
        check = bool(re.search(r"[A-Za-z]", span.split("@")[0][:1] or span[:1]))
        tail = re.split(r"[.\])} ]", span)[-1].lower()
        known = tail in TOP_LEVEL
        shape = "a" if form else "w"
    elif name == "ip":
        form = span.count(".") == 3 or span.count(":") == 7
        check = ":" in span or all(map(_small, span.split(".")))
        known = ":" in span or not span.startswith(("0.", "00"))
        shape = "6" if ":" in span else "4"
    elif name == "card":
        form = len(span) == len(digits) or bool(re.fullmatch(r"[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4})+(?:\1[0-9]{1,3})?", span))
        check, known = luhn(digits), bool(CARD_PREFIX.match(digits)) and len(digits) in (13, 14, 15, 16)
        shape = "s" if len(digits) == 16 else "o"
    else:
        form = bool(re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}", span))
        check, known = 9 <= len(digits) <= 15, bool(COUNTRY_CODE.match(span))
        shape = "p" if span[0] == "+" else "l"
    cue = bool(CUES[name].search(before))
    edge = not (left.isalnum() or left in "_-/" and left or right.isalnum() or right in "_/" and right)
    against = bool(AGAINST.search(before))
    marks = ["+" if form else "-", "+" if check else "-", "+" if known else "-", "+" if cue else "0"]
    return f"{kind}{''.join(marks)}{'+' if edge else '-'}{'-' if against else '0'}{shape}"


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, bool]]]:
    """Base spans (start, kind, end), and everything votable (start, kind, end, code, is base)."""
    if not text or not re.search("[0-9@]|[aA][tT][\\])}]", text):
        return [], []
    kept, failed = base_spans(text)
    more = candidates(text, kept, failed)
    rows = [(s, k, e, votes(text, s, k, e), True) for s, k, e in kept]
    return kept, rows + [(s, k, e, votes(text, s, k, e), False) for s, k, e in more]


@dataclass(frozen=True)
class Weak:
    """What was learned: reliability of each labeler's vote by class, and the decision on each code."""

    accepted: frozenset[str]
    probability: dict[str, float]
    reliability: dict[str, tuple[float, float]]


def _table(codes: list[str]) -> np.ndarray:
    value = {"+": 1, "-": -1, "0": 0}
    return np.array([[value[c] for c in code[1 : 1 + len(LABELERS)]] for code in codes]).reshape(len(codes), len(LABELERS))


def learn(counts: dict[tuple[str, bool], int], rounds: int = 100, decide_at: float = 0.5) -> Weak:
    """EM over vote counts, then the span classifier. ``counts`` is by (code, whether a base span).

    Base spans are known positives, which fixes the meaning of the two classes.
    """
    if not counts:
        return Weak(frozenset(), {}, {})
    keys = sorted(counts)
    codes, base = [c for c, _ in keys], np.array([b for _, b in keys])
    n, v = np.array([counts[k] for k in keys], float), _table(codes)
    # Start from the majority vote.
    q = np.where(base, 1.0, 1 / (1 + np.exp(-1.5 * v.sum(axis=1))))
    on = np.stack([v == x for x in (-1, 0, 1)], axis=2)
    for _ in range(rounds):
        prior = ((n * q).sum() + 1) / (n.sum() + 2)
        like = []
        for w, share in ((n * q, prior), (n * (1 - q), 1 - prior)):
            # Smoothed, so that a vote never seen in a class is unlikely and not impossible.
            seen = np.einsum("i,ijk->jk", w, on) + 0.5
            rate = np.log(seen / seen.sum(axis=1, keepdims=True))
            like.append(np.log(share) + np.einsum("ijk,jk->i", on, rate))
        new = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50))))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    right = {}
    for j, name in enumerate(LABELERS):
        yes, no = on[:, j, 2], on[:, j, 0]
        right[name] = (float((n * q * yes).sum() / max((n * q).sum(), 1e-9)), float((n * (1 - q) * no).sum() / max((n * (1 - q)).sum(), 1e-9)))
    x = np.array([features(c) for c in codes])
    # Codes count by the root of their number, so that frequent ones don't drown the rest.
    w = _logistic(x, q, np.sqrt(n))
    p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
    probability = {c: float(y) for c, y in zip(codes, p)}
    return Weak(frozenset(c for c, y in probability.items() if y >= decide_at), probability, right)


def features(code: str) -> list[float]:
    """The final classifier's inputs: votes, kind, shape, and votes that count for a kind."""
    kind, marks, shape = int(code[0]), code[1:7], code[7]
    out = [1.0] + [1.0 if m == "+" else 0.0 for m in marks] + [1.0 if m == "-" else 0.0 for m in marks]
    out += [1.0 if kind == k else 0.0 for k in range(len(KINDS))]
    return out + [1.0 if shape == s else 0.0 for s in "aw64sopl"]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_SPAN = "struct<start:long,kind:int,end:long,code:string,base:boolean>"


def scan_column(text: Column) -> Column:
    """Every votable span of a text column."""

    @F.arrow_udf(f"array<{_SPAN}>")
    def pii_scan(texts: pa.Array) -> pa.Array:
        fields = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.string()), ("base", pa.bool_())]
        kind = pa.list_(pa.struct(fields))
        names = [f for f, _ in fields]
        return pa.array([[dict(zip(names, r)) for r in scan(t.as_py())[1]] for t in texts], kind)

    return pii_scan(text)


def learn_from(scanned: DataFrame) -> Weak:
    """Learn from all documents; the driver gets one row per code, of which there are some hundreds at most."""
    spans = scanned.select(F.explode("found").alias("s")).select("s.code", "s.base")
    return learn({(r["code"], r["base"]): r["count"] for r in spans.groupBy("code", "base").count().collect()})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every document; spans are structs (start, kind, end, base) by start, then kind.

    A null or empty text has none; very long ones are scanned whole. Repeated
    rows each get their row, null ids too; an empty table gives none; further
    columns, whatever their names, are left out.
    """
    spans = docs.select(F.col(id_col).alias("doc_id"), scan_column(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))
    with scratch(docs.sparkSession) as keep:
        scanned = keep(written(spans, "spans"))
    accepted = sorted(learn_from(scanned).accepted)
    keep = F.filter("found", lambda s: s["base"] | s["code"].isin(accepted) if accepted else s["base"])
    plain = F.transform(
        keep, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))
    )
    return scanned.select("doc_id", F.array_sort(plain).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def report(found: DataFrame) -> DataFrame:
    """The query's columns: base counts, the digest of base spans, and all spans."""
    base = F.filter("spans", lambda s: s["base"])
    def count_of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets.

    Two passes over the texts: one to learn, one to replace. Overlapping spans
    are replaced as one, under the kind of the first. Null texts stay null, empty
    ones empty; repeated rows and all columns stay, whatever their names; an
    empty table stays empty.
    """
    with small_batches(docs.sparkSession):
        accepted = learn_from(docs.select(scan_column(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))).accepted

    @F.arrow_udf("string")
    def pii_redact(texts: pa.Array) -> pa.Array:
        return pa.array([_replaced(t.as_py(), accepted) for t in texts], pa.string())

    return docs.withColumn(text_col, pii_redact(F.col(text_col)))


def _replaced(text: str | None, accepted: frozenset[str]) -> str | None:
    spans = sorted((s, k, e) for s, k, e, code, base in scan(text)[1] if base or code in accepted)
    if not spans:
        return text
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def brute_base(text: str) -> Iterator[tuple[int, int, int]]:
    """The base spans by the plain patterns; quadratic on long runs, for tests."""
    plain = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for kind, pattern in enumerate(plain):
        for m in re.finditer(pattern, text):
            n, s = sum("0" <= c <= "9" for c in m.group()), m.group()
            if kind == 0 or kind == 1 and all(_small(p) for p in s.split(".")):
                yield m.start(), kind, m.end()
            elif kind == 2 and 12 <= n <= 19 and luhn(_digits(s)) or kind == 3 and 9 <= n <= 15:
                yield m.start(), kind, m.end()
