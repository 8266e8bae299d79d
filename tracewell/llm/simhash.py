"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints of 64 bits link at RADIUS or fewer differing bits. Every bit
position gets a vector over GF(2) of RADIUS+1 digits; the mask of a non-zero
vector v keeps the positions whose vector is not orthogonal to v. Any RADIUS
positions leave some v orthogonal to them all, so each linked pair agrees on all
bits of at least one of the 2^(RADIUS+1)-1 masks: no link is lost.

Copies first collapse to one row per fingerprint. A bucket is compared in blocks,
each pair of blocks in its own group, and gives a spanning forest of its links
and not the links, so that groups of copies stay linear in what they emit.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import scratch, written

if TYPE_CHECKING:
    import pandas as pd

RADIUS = 3
#: Fingerprints in a block of a large bucket, on average: BLOCK while that gives
#: at most BLOCKS blocks, then as many as BLOCKS give, up to LARGE_BLOCK.
BLOCK, BLOCKS, LARGE_BLOCK = 256, 64, 16_384

_xxh = xxhash.xxh64_intdigest


def fingerprint(text: str | None) -> int:
    """SimHash of a text's 3-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    n, ones, bits = max(len(words) - 2, 1), np.zeros(64, np.int64), np.empty((0,), np.uint64)
    hashes = np.fromiter((_xxh(s, 42) for s in shingles), np.uint64, n)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())

    return simhash(text)


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 11) -> list[int]:
    """Masks of which every set of ``radius`` positions leaves one untouched, as signed longs."""
    rng = np.random.default_rng(seed)
    size = 1 << (radius + 1)
    # Each vector but zero in turn, shuffled: all masks then keep about half of the bits.
    spread = np.resize(np.arange(1, size), bits)
    vectors = rng.permutation(spread)
    masks = []
    for v in range(1, size):
        kept = sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2 == 1)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The edges that first join two components, in the given order."""
    root, kept = list(range(n)), []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = a, b
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _links_within(fp: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one (side 2)."""
    first, second, kept = np.flatnonzero(side != 1), np.flatnonzero(side != 0), []
    for start in range(0, len(first), 256):
        rows = first[start : start + 256]
        a, b = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[second][None, :]) <= RADIUS)
        a, b = rows[a], second[b]
        ahead = (a < b) | (side[a] != 2)
        kept += _forest(len(fp), a[ahead], b[ahead])
    return _forest(len(fp), *np.array(kept).T) if len(first) > 256 and kept else kept


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within each group of frames sorted by group; a group may go on in the next frame."""
    import pandas as pd

    key, rest = ["tab", "key", "i", "j"], None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        keys = frame[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
        last = int(starts[-1]) if len(starts) else 0
        yield _links_of(frame, starts)
        rest = frame.iloc[last:]
    if rest is not None and len(rest):
        yield _links_of(rest.reset_index(drop=True), np.array([0, len(rest)]))


def _links_of(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Links of the groups that begin at ``starts``, but for the last."""
    import pandas as pd

    fp, side = frame["fp"].to_numpy(np.int64), frame["side"].to_numpy()
    a, b = [], []
    for lo, hi in zip(starts[:-1], starts[1:]):
        for p, q in _links_within(fp[lo:hi].view(np.uint64), side[lo:hi]):
            a.append(fp[lo + p])
            b.append(fp[lo + q])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all those within RADIUS, from distinct ``fp``.

    A bucket of at most BLOCK rows is one group. A larger one is dealt to blocks
    by a hash, and each pair of blocks is a group of its own. No bucket is capped.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks()])
    keyed = prints.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("tab", "key"))
    sizes = written(keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    n, zero = F.col("n"), F.lit(0).cast("long")
    blocks = F.greatest(F.least(F.ceil(n / BLOCK), F.lit(BLOCKS)), F.ceil(n / LARGE_BLOCK)).cast("long")
    own, other = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("blocks")), F.col("other")
    dealt = (
        keyed.join(sizes.select("tab", "key", blocks.alias("blocks")), ["tab", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .select(
            "tab",
            "key",
            F.least("own", other).alias("i"),
            F.greatest("own", other).alias("j"),
            F.when(F.col("own") == other, 2).otherwise((F.col("own") > other).cast("int")).alias("side"),
            "fp",
        )
    )
    by = ["tab", "key", "i", "j"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInPandas(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, component, row) of every document.

    component_id is the smallest doc_id of the component and ``component`` a key
    of it that is never null; ``row`` is the column of unique values if one is
    named, and else null.

    Null, empty and wordless texts have fingerprint zero and link like any
    other. Rows that repeat a doc_id each get their row; null ids take part in
    links and have component_id null only if their whole component has null
    ids. Further columns are left out; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep:
        prints = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            fingerprint_column(F.col(text_col)).alias("fp"),
            (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("row"),
        )
        prints = keep(written(prints, "fingerprints"))
        # One row a fingerprint, which is its own node: equal ones need no link.
        nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        found = connected(links(nodes.select("fp")))
        groups = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        )
        smallest = groups.groupBy("component").agg(F.min("least").alias("component_id"))
        labels = keep(written(groups.join(smallest, "component").select("fp", "component", "component_id"), "labels"))
        hot = keep(written(hot_labels(prints, labels), "hot"))
    return with_labels(prints, labels, hot).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", "row"
    )


def keepers(found: DataFrame) -> DataFrame:
    """(row): of each component the row with the smallest doc_id, null ids last; of rows that repeat it, one.

    ``found`` is (doc_id, component, row), none of them null but doc_id; an empty table has none.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
    return found.groupBy("component").agg(least).select("least.row")


def hot_labels(prints: DataFrame, labels: DataFrame, share: int = 1000) -> DataFrame:
    """The labels of fingerprints that over 1/share of the rows hold; there are at most ``share``."""
    sizes = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(sizes.where(F.col("n") > max(prints.count() // share, 1)), "fp", "left_semi")


def with_labels(prints: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """Join component ids onto fingerprints; those of ``hot``, as hot_labels() gives them, by broadcast."""
    by_hot = prints.join(F.broadcast(hot), "fp")
    by_rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(labels, "fp")
    return by_hot.unionByName(by_rest)
