"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash bands, exact check of candidates.

Two texts link if the sets of their 5-word shingles have a Jaccard similarity of
0.8 or more. Candidates are the components that the SimHash operator's covering
masks find, and what is too far apart for those and agrees on all ROWS minima of
one of BANDS bands: a pair at 0.8 is missed with a probability of
(1 - 0.8^5)^24 at most, some 7 in 100,000, and a nearer pair with less. The
shingle sets themselves decide on every candidate.

Equal sets first collapse to one node. Nodes that buckets connect, directly or
not, are a crowd: no link leaves it. A crowd of at most CROWD shingles whose
comparison reads each of them in at most WORK steps all together is one group, in
which all pairs count as candidates, so that each set moves once. In larger crowds
each bucket's nodes are compared with its least one; a bucket that
this leaves in several components is compared in full, in blocks. Either way a
spanning forest of the links comes out, and no bucket or crowd is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import scratch, small_batches, written
from .simhash import BLOCK, BLOCKS, LARGE_BLOCK, fingerprint, hot_labels, links, with_labels

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 24, 5
#: Shingles of a crowd that is compared as one group, 8 bytes each; larger ones go by bucket.
CROWD = 1 << 20
#: Steps of such a group, sets times shingles, some half a nanosecond each.
WORK = 1 << 31
#: Rows whose shingle sets are needed are joined to the texts by broadcast up to this many, else by shuffle.
FEW = 1_000_000

_xxh = xxhash.xxh64_intdigest
_rng = np.random.default_rng(17)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct 5-word shingles; of fewer words all are one, of none there is none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*[words[i:] for i in range(SHINGLE)]) if len(words) >= SHINGLE else [words]
    return np.unique(np.fromiter((_xxh(b" ".join(r), 42) for r in runs), np.uint64, max(len(words) - SHINGLE + 1, 1)))


def sketch(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """(node, size, keys): a hash of the whole set, 0 without shingles, their number, and a hash of each band's minima."""
    if not len(hashes):
        return 0, 0, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    keys = np.array([_xxh(band.tobytes(), 7) for band in least.reshape(BANDS, ROWS)], np.uint64)
    return int(np.uint64(_xxh(hashes.tobytes(), 3)).view(np.int64)), len(hashes), keys.view(np.int64).tolist()


def sketch_column(text: Column) -> Column:
    @F.arrow_udf("struct<node:long,size:long,keys:array<long>,fp:long>")
    def minhash(texts: pa.Array) -> pa.Array:
        nodes, sizes, keys = zip(*[sketch(shingles(t.as_py())) for t in texts]) if len(texts) else ((), (), ())
        prints = pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())
        parts = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), prints]
        return pa.StructArray.from_arrays(parts, ["node", "size", "keys", "fp"])

    return minhash(text)


def shingles_column(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def shingle_set(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return shingle_set(text)


def _links_of(node: np.ndarray, side: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join components of two blocks, or within one (side 2); ``root`` names the known component of each row."""
    sizes = np.array([len(s) for s in sets])
    # A token's place among the group's tokens, so that a set is a mask over them.
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mask, out = np.r_[0, np.cumsum(sizes)[:-1]], np.zeros(len(tokens), np.int32), []
    _, root = np.unique(root, return_inverse=True)
    second = np.flatnonzero(side != 0)
    # The second block's sets in a row: one pass over them gives what each has in common with a mask.
    row = np.concatenate([place[starts[b] : starts[b] + sizes[b]] for b in second.tolist()]) if len(second) else place[:0]
    lengths = sizes[second]
    ahead = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    for a in np.flatnonzero(side != 1):
        least, most = np.minimum(lengths, sizes[a]), np.maximum(lengths, sizes[a])
        fits = (root[second] != root[a]) & (least * 100 >= most * PERCENT)
        if side[a] == 2:
            fits &= second > a
        if not fits.any():
            continue
        own = place[starts[a] : starts[a] + sizes[a]]
        mask[own] = 1
        common = np.add.reduceat(mask[row], ahead)
        mask[own] = 0
        for b in second[fits & (common * 100 >= (lengths + sizes[a] - common) * PERCENT)].tolist():
            if root[b] != root[a]:
                out.append((int(node[a]), int(node[b])))
                root[root == root[b]] = root[a]
    return out


_BY = ["tab", "key", "i", "j"]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of batches sorted by group; a group may go on in the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        keys = np.stack([table[c].to_numpy() for c in _BY], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.array([0])
        yield _groups(table, starts)
        rest = table.slice(int(starts[-1]))
    if rest is not None and len(rest):
        yield _groups(rest, np.array([0, len(rest)]))


def _groups(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Links of the groups that begin at ``starts``, but for the last."""
    found = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        part = table.slice(lo, hi - lo).combine_chunks()
        node, side, component = (part[c].to_numpy() for c in ("node", "side", "component"))
        hashes = pa.concat_arrays(part["hashes"].chunks)
        ends = np.cumsum(hashes.value_lengths().to_numpy())
        found += _links_of(node, side, component, np.split(hashes.flatten().to_numpy(), ends[:-1]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(node, tab, key): nodes whose fingerprints the SimHash operator connects, as a band of their own; equal ones too."""
    prints = nodes.where("size > 0").select("node", "fp")
    found = written(connected(links(prints.select("fp").distinct())).withColumnRenamed("node", "fp"), "prints")
    key = F.coalesce("component", "fp").alias("key")
    return prints.join(found, "fp", "left").select("node", F.lit(BANDS).alias("tab"), key)


def _stars(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with the least node of one of their buckets."""
    buckets = written(keyed.groupBy("tab", "key").agg(F.min("node").alias("least")), "buckets")
    stars = keyed.join(buckets, ["tab", "key"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return written(stars.distinct(), "stars")


def _starred(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs that are similar."""
    # Written one by one, so that a hot node's side of each join can be split.
    left = written(stars.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a"), "left")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.withColumn("common", common).where(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * PERCENT)
    return written(both.select("a", "b"), "starred")


def links_in_crowds(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all similar ones of a crowd, from (crowd, node, hashes)."""
    one, zero = F.lit(2), F.lit(0).cast("long")
    rows = sets.select(
        zero.alias("tab"), F.col("crowd").alias("key"), zero.alias("i"), zero.alias("j"),
        one.alias("side"), "node", F.col("node").alias("component"), "hashes",
    )
    return rows.repartition("key").sortWithinPartitions(*_BY).mapInArrow(_compared, "a long, b long")


def links_in_buckets(keyed: DataFrame, stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all candidates that are similar.

    ``keyed`` is (tab, key, node) of buckets of two or more, ``stars`` their pairs
    with the least node, ``sets`` (node, hashes) of their nodes.
    """
    starred = _starred(stars, sets)
    known = connected(starred)
    placed = keyed.join(known, "node", "left").select("tab", "key", "node", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    # Two nodes are decided by now; of buckets with the same nodes one is compared.
    open_ = placed.groupBy("tab", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("component").alias("first"),
        F.max("component").alias("last"),
        F.expr("bit_xor(xxhash64(node))").alias("members"),
        F.expr("bit_xor(xxhash64(node, 5))").alias("again"),
    )
    open_ = open_.where("n > 2 AND first <> last").groupBy("n", "members", "again").agg(F.min(F.struct("tab", "key")).alias("k"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    blocks = F.greatest(F.least(F.ceil(n / BLOCK), F.lit(BLOCKS)), F.ceil(n / LARGE_BLOCK)).cast("long")
    open_ = written(open_.select("k.tab", "k.key", blocks.alias("blocks")), "open")
    own, other = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")), F.col("other")
    dealt = (
        placed.join(open_, ["tab", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .select(
            "tab",
            "key",
            F.least("own", other).alias("i"),
            F.greatest("own", other).alias("j"),
            F.when(F.col("own") == other, 2).otherwise((F.col("own") > other).cast("int")).alias("side"),
            "node",
            "component",
        )
    )
    by = _BY
    grouped = written(dealt, "dealt").join(sets, "node").repartition(*by).sortWithinPartitions(*by)
    return starred.unionByName(grouped.mapInArrow(_compared, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component, row) of every document; ``row_col`` names a column of unique values that can be ordered.

    Null, empty and wordless texts have the same, empty set and are one
    component. Rows that repeat a doc_id each get their row, null ids too; very
    long texts are read whole; an empty table gives an empty result; further
    columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        made = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(row_col).alias("row"), sketch_column(F.col(text_col)).alias("s")
        )
        with small_batches(spark):
            made = keep(written(made.select("doc_id", "row", "s.*"), "sketches"))
        least = F.min_by(F.struct("row", "size", "keys", "fp"), "row").alias("least")
        nodes = written(made.groupBy("node").agg(least).select("node", "least.*"), "nodes")
        every = nodes.select("node", F.posexplode("keys").alias("tab", "key")).unionByName(_near_prints(nodes))
        several = every.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tab", "key")
        keyed = written(every.join(written(several, "several"), ["tab", "key"]), "keyed")
        stars = _stars(keyed)
        crowds = written(connected(stars).withColumnRenamed("component", "crowd"), "crowds")
        needed = nodes.select("node", "row", "size").join(crowds, "node")
        large = needed.groupBy("crowd").agg(F.sum("size").alias("shingles"), F.count(F.lit(1)).alias("n"))
        large = large.where((F.col("shingles") > CROWD) | (F.col("shingles") * F.col("n") > WORK)).select("crowd", F.lit(True).alias("large"))
        needed = needed.join(written(large, "large"), "crowd", "left").select("node", "row", "crowd", F.coalesce("large", F.lit(False)).alias("large"))
        needed = written(needed, "needed")
        rows = F.broadcast(needed) if needed.count() <= FEW else needed
        texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).join(rows, "row")
        with small_batches(spark):
            sets = written(texts.select("node", "crowd", "large", shingles_column(F.col("text")).alias("hashes")), "sets")
            found = written(links_in_crowds(sets.where("NOT large")), "links")
            apart = needed.where("large").select("node")
            if not apart.isEmpty():
                keyed = written(keyed.join(apart, "node", "left_semi").select("tab", "key", "node"), "keyed")
                stars = written(stars.join(apart.withColumnRenamed("node", "a"), "a", "left_semi"), "stars")
                found = found.unionByName(links_in_buckets(keyed, stars, sets.where("large").select("node", "hashes")))
            found = written(connected(found), "found")
        # Nodes are joined as with_labels joins fingerprints.
        labels = nodes.select("node").join(found, "node", "left").select(F.col("node").alias("fp"), F.coalesce("component", "node").alias("component"))
        labels, prints = keep(written(labels, "labels")), made.select("doc_id", "row", F.col("node").alias("fp"))
        hot = keep(written(hot_labels(prints, labels), "hot"))
    return with_labels(prints, labels, hot).select("doc_id", "component", "row")
