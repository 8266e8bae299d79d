"""URL functions, all as column expressions.

The parts are cut out with regular expressions: the URL parser of the SQL
functions keeps the host's case and decides nothing about tracking parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Parameters that never tell pages apart, and names that carry credentials.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid")
CREDENTIAL = r"(?i)^(?:.*[_-])?(?:token|key|apikey|api_key|secret|password|passwd|pwd|auth|signature|sig|session|sid|credential|code)$"
# IPv4 blocks that are not public, as (address, prefix length).
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)

_URL = r"^(?i:(https?))://(?:([^/?#@]*)@)?([^/?#:@]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def userinfo(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without one leading "www."; empty where the text is no http(s) URL."""
    return F.regexp_replace(F.lower(_part(url, 3)), r"^www\.(?=.)", "")


def path(url: Column) -> Column:
    return _part(url, 5)


def parameters(url: Column) -> Column:
    """The query's non-empty name=value texts, in order."""
    return F.filter(F.split(_part(url, 6), "&"), lambda p: p != "")


def _name(parameter: Column) -> Column:
    return F.substring_index(parameter, "=", 1)


def _parts(url: Column) -> Column:
    return F.struct(*[_part(url, i).alias(n) for i, n in ((1, "scheme"), (3, "host"), (4, "port"), (5, "path"), (6, "query"))])


def canonical(url: Column) -> Column:
    """Canonical form of an http(s) URL, null for others.

    Lower-case host without "www.", no default port, fragment or tracking
    parameter; other parameters sorted by name, then value; no trailing slashes
    but the root's.
    """
    return let(_parts(url), _joined)


def _joined(u: Column) -> Column:
    scheme_, host_ = F.lower(u["scheme"]), F.regexp_replace(F.lower(u["host"]), r"^www\.(?=.)", "")
    default = ((scheme_ == "http") & (u["port"] == "80")) | ((scheme_ == "https") & (u["port"] == "443"))
    kept = F.filter(
        F.split(u["query"], "&"), lambda p: (p != "") & ~(F.lower(_name(p)).startswith("utm_") | F.lower(_name(p)).isin(*TRACKING))
    )
    pairs = F.transform(
        kept, lambda p: F.struct(_name(p).alias("name"), F.substring(p, F.length(_name(p)) + F.lit(2), F.length(p)).alias("value"))
    )
    query = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    return F.when(
        host_ != "",
        F.concat(
            scheme_,
            F.lit("://"),
            host_,
            F.when((u["port"] == "") | default, "").otherwise(F.concat(F.lit(":"), u["port"])),
            let(F.regexp_replace(u["path"], "/+$", ""), lambda x: F.when(x == "", "/").otherwise(x)),
            let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))),
        ),
    )


def source_key(url: Column) -> Column:
    """Conservative key: lower-case scheme and host, no fragment; the query stays."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + F.lit(1), F.length(bare)))


def audit(url: Column) -> Column:
    """Scheme, host and path alone; null for other texts."""
    return F.when(host(url) != "", F.concat(scheme(url), F.lit("://"), F.lower(_part(url, 3)), path(url)))


def ipv4(host_: Column) -> Column:
    """A dotted-quad host as a number, null for others."""
    quad = F.split(host_, r"\.")
    parts = [F.try_element_at(quad, F.lit(i)).try_cast("long") for i in range(1, 5)]
    ok = host_.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*parts) <= 255)
    return F.when(ok, parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * (1 << 8) + parts[3])


def _number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return a << 24 | b << 16 | c << 8 | d


def public_host(host_: Column) -> Column:
    """Whether a host is a public name or address: it has a dot, is not local, and is no blocked IPv4 or IPv6 literal."""

    def told(h: Column) -> Column:
        name = h.contains(".") & ~h.rlike(r"(^|\.)(localhost|local|internal|intranet|lan|home|corp)$") & ~h.contains("[")
        return let(ipv4(h), lambda n: F.when(n.isNotNull(), ~_blocked(n)).otherwise(name & ~h.rlike(r"^[\d.]+$")))

    return let(host_, told)


def _blocked(number: Column) -> Column:
    found = F.lit(False)
    for address, length in BLOCKED_V4:
        found = found | (F.shiftright(number, 32 - length) == _number(address) >> (32 - length))
    return found


def safe_reference(url: Column) -> Column:
    """Whether a URL may be kept as a reference: short, http(s), no user, no credential-like parameter, public host."""

    def told(u: Column) -> Column:
        secret = F.exists(F.filter(F.split(u["query"], "&"), lambda p: p != ""), lambda p: _name(p).rlike(CREDENTIAL))
        bare = F.regexp_replace(F.lower(u["host"]), r"^www\.(?=.)", "")
        return (bare != "") & (u["user"] == "") & ~secret & public_host(bare)

    parts = F.struct(*[_part(url, i).alias(n) for i, n in ((2, "user"), (3, "host"), (6, "query"))])
    return F.coalesce((F.length(url) <= 4096) & let(parts, told), F.lit(False))


# Fixed value: paths of pages that stand in for the one asked for.
STAND_IN = r"(?i)(?:^|/)(?:login|log-in|signin|sign-in|auth|unsupportedbrowser|unsupported-browser|browser-support|error|404)(?:/|$)"


def binding(requested: Column, final: Column) -> Column:
    """How a fetched URL relates to the requested one.

    same_resource, normalized_resource (equal in canonical form; http may become
    https and not the other way round), different_resource, blocked_destination
    (log-in, error and browser pages), or not_established where either may not be
    kept as a reference.
    """
    sides = F.struct(
        F.trim(requested).alias("asked"), F.trim(final).alias("got"), safe_reference(requested).alias("asked_safe"), safe_reference(final).alias("got_safe"),
        canonical(requested).alias("from"), canonical(final).alias("to"), path(final).alias("path"),
    )

    def decide(u: Column) -> Column:
        upgraded = u["to"].startswith("https:") & (F.regexp_replace(u["from"], "^http:", "https:") == u["to"])
        return (
            F.when(~u["asked_safe"] | ~u["got_safe"], "not_established")
            .when(u["path"].rlike(STAND_IN), "blocked_destination")
            .when(u["asked"] == u["got"], "same_resource")
            .when(u["from"].isNull() | u["to"].isNull(), "not_established")
            .when((u["from"] == u["to"]) | upgraded, "normalized_resource")
            .otherwise("different_resource")
        )

    return let(sides, decide)
