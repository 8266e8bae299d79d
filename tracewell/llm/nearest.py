"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are extended by one component so that all have one length; the order by
inner product is then the order by distance. A random rotation makes partial
distances over the first columns comparable with whole ones. Lists are k-means
cells fitted on a bounded sample; every vector is indexed. Within a probed list
the columns are scanned in blocks; after each block a candidate is abandoned if
its partial distance is too large, by a hypothesis test, for a place among the
nearest so far.

Equal vectors have equal scores, so of each vector only the k + 1 smallest ids
can ever be found, and queries with equal vectors are searched once. Candidates
within rounding of the last place are kept, however many, until exact scores and
ids decide.

Work is dealt by (bundle of lists, share of the queries that probe it); each
such cell holds a bounded number of vectors and queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

#: Vectors that k-means reads at most, and rounds it makes.
SAMPLE, ROUNDS = 20_000, 6
MOST_LISTS = 4_096
#: Vectors and queries in a cell, on average at most; queries scanned together.
BUNDLE, CELL_QUERIES, TOGETHER = 4_096, 2_048, 512
COLUMNS = 16
#: The share of the sample's own neighbours that lie in the probed lists; it sets
#: how many lists a query probes. The sample is sparser than the table, so its
#: neighbours lie further out and the estimate errs to the careful side.
RECALL, TRIAL_QUERIES, LEAST_PROBES = 0.96, 256, 8
#: Width of the hypothesis test; 2.1 rejects a true neighbour in well under 1 of 100 cases.
EPSILON = 2.1
#: Rotated distances are within this share of the squared lengths of the true ones.
ROUNDING = 1e-11


@dataclass(frozen=True)
class Index:
    """Rotation of extended vectors, centroids (rotated) and the common squared length."""

    rotation: np.ndarray
    centroids: np.ndarray
    square: float

    def extend(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Extended and rotated vectors."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]]) @ self.rotation

    def order(self, y: np.ndarray, most: int) -> np.ndarray:
        """Numbers of the ``most`` nearest lists of each row, nearest first."""
        blocks = [self._order(y[i : i + 1024], most) for i in range(0, len(y), 1024)]
        return np.concatenate(blocks) if blocks else np.zeros((0, most), np.int64)

    def _order(self, y: np.ndarray, most: int) -> np.ndarray:
        c = self.centroids
        d = (c * c).sum(axis=1) - 2 * (y @ c.T)
        if most >= len(c):
            return np.argsort(d, axis=1, kind="stable")
        if most == 1:
            return d.argmin(axis=1)[:, None]
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def fit(sample: np.ndarray, square: float, lists: int, seed: int = 5) -> Index:
    """k-means on the sample, and a random rotation."""
    rng, d = np.random.default_rng(seed), sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
    index = Index(rotation, np.zeros((0, d)), square)
    y = index.extend(sample)
    lists = min(lists, len(y))
    centroids = y[rng.choice(len(y), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        cell = Index(rotation, centroids, square).order(y, 1)[:, 0]
        sums, sizes = np.zeros_like(centroids), np.bincount(cell, minlength=lists)
        np.add.at(sums, cell, y)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return Index(rotation, centroids, square)


def probes_for(index: Index, sample: np.ndarray, k: int, recall: float) -> int:
    """The number of nearest lists that hold a share ``recall`` of the k nearest of some of the sample's vectors."""
    lists, asked = len(index.centroids), np.unique(np.linspace(0, len(sample) - 1, min(TRIAL_QUERIES, len(sample))).astype(int))
    k = min(k, len(sample) - 1)
    if recall >= 1 or k < 1:
        return lists
    own = index.order(index.extend(sample), 1)[:, 0]
    place = np.argsort(index.order(index.extend(sample[asked], query=True), lists), axis=1)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return min(lists, max(LEAST_PROBES, 1 + int(needed[int(np.ceil(recall * len(needed))) - 1])))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id whose vector is not null or zero and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), fine.alias("fine"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.col("fine") & F.exists("v", lambda x: x != 0))
    return rows.select("vec_id", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _scan(x: np.ndarray, y: np.ndarray, lists: list[np.ndarray], probed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y): for each row of x the k nearest among the lists it probes, and all within rounding of the last.

    lists holds the rows of each list and probed says who probes which.
    """
    m, d = x.shape
    best, pool = np.full((m, k), np.inf), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    xx = np.cumsum(x * x, axis=1)
    margin = ROUNDING * (xx[:, -1] + ((y * y).sum(axis=1).max() if len(y) else 0))
    for j in np.argsort([-len(r) for r in lists], kind="stable"):
        rows, asks = lists[j], np.flatnonzero(probed[:, j])
        if not len(rows) or not len(asks):
            continue
        part, yy, slack = y[rows], np.cumsum(y[rows] ** 2, axis=1), margin[asks]
        # A block over all pairs while most are open, then over the open ones alone.
        dots, open_pairs, worst = np.zeros((len(asks), len(rows))), None, best[asks].max(axis=1)
        for lo in range(0, d, COLUMNS):
            hi = min(lo + COLUMNS, d)
            wide = worst * (hi / d) * (1 + EPSILON / np.sqrt(hi)) ** 2 if hi < d else worst
            if open_pairs is None:
                dots += x[asks, lo:hi] @ part[:, lo:hi].T
                near = xx[asks, hi - 1][:, None] + yy[:, hi - 1][None, :] - 2 * dots
                if hi == d and len(rows) > k:
                    wide = np.minimum(wide, np.partition(near, k - 1, axis=1)[:, k - 1])
                keep = near <= (wide + slack)[:, None]
                if hi == d or keep.mean() < 0.25:
                    open_pairs = a, b = np.nonzero(keep)
                    value, far = dots[a, b], near[a, b]
            else:
                a, b = open_pairs
                value = value + np.einsum("ij,ij->i", x[asks[a], lo:hi], part[b, lo:hi])
                far = xx[asks[a], hi - 1] + yy[b, hi - 1] - 2 * value
                keep = far <= wide[a] + slack[a]
                open_pairs, value, far = (a[keep], b[keep]), value[keep], far[keep]
        a, b = open_pairs
        pool.append((asks[a], rows[b], far))
        _lower(best, asks[a], far, k)
        who, row, far = map(np.concatenate, zip(*pool))
        near = far <= best[who].max(axis=1) + margin[who]
        pool = [(who[near], row[near], far[near])]
    return pool[0][:2]


def _lower(best: np.ndarray, who: np.ndarray, far: np.ndarray, k: int) -> None:
    """Put new (query, distance) pairs among each query's k least distances."""
    if not len(who):
        return
    order = np.lexsort((far, who))
    who, far = who[order], far[order]
    asks, place = _places(who)
    few = place < k
    fresh = np.full((len(asks), k), np.inf)
    fresh[np.searchsorted(asks, who[few]), place[few]] = far[few]
    best[asks] = np.sort(np.hstack([best[asks], fresh]), axis=1)[:, :k]


def _places(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, the place of each row within its value's run) of a sorted array."""
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
    return who[starts], np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))


def _found(index: Index, queries: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The k best candidates that a cell holds for each of its queries, by exact score, then id."""
    out = pa.schema([("rep", pa.int64()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("score", pa.float64())])
    if not len(queries) or not len(held):
        return out.empty_table()
    q, v = (_matrix(t.column("v").combine_chunks()) for t in (queries, held))
    q_ids, v_ids = queries.column("rep").to_numpy(), held.column("vec_id").to_numpy()
    numbers, of = np.unique(held.column("list").to_numpy(), return_inverse=True)
    members = [np.flatnonzero(of == j) for j in range(len(numbers))]
    probed, flat = np.zeros((len(q), len(numbers)), bool), queries.column("probed").combine_chunks()
    who, named = np.repeat(np.arange(len(q)), flat.value_lengths().to_numpy()), flat.flatten().to_numpy()
    there = np.isin(named, numbers)
    probed[who[there], np.searchsorted(numbers, named[there])] = True
    y, parts = index.extend(v), []
    for i in range(0, len(q), TOGETHER):
        some = slice(i, i + TOGETHER)
        a, b = _scan(index.extend(q[some], query=True), y, members, probed[some], k)
        score = np.einsum("ij,ij->i", q[some][a], v[b])
        order = np.lexsort((v_ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        top = _places(a)[1] < k
        parts.append((a[top] + i, b[top], score[top]))
    a, b, score = map(np.concatenate, zip(*parts))
    copies = held.column("copies").to_numpy()
    return pa.Table.from_arrays([pa.array(q_ids[a]), pa.array(v_ids[b]), pa.array(copies[b]), pa.array(score)], schema=out)


def _bundles(count: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bundle, number of bundles) of each list: lists go to bundles in order; one larger than BUNDLE is dealt over several."""
    first, parts, at, room = np.zeros(lists, int), np.ones(lists, int), 0, BUNDLE
    for j in range(lists):
        size = count.get(j, 0)
        parts[j] = max(1, -(-size // BUNDLE))
        if size > room:
            at, room = at + 1, BUNDLE
        first[j] = at
        if parts[j] > 1:
            at, room = at + parts[j], BUNDLE
        else:
            room -= size
    return first, parts


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row.

    ``is_query`` picks queries by ``vec_id``. Every row with another id is a
    candidate. Rows without an id, and vectors that are null, zero or hold null
    or non-finite components, take no part, nor do vectors of another length
    than the most frequent one (the longest of those equally frequent). Rows
    that repeat an id are all candidates; a repeated query id is searched once,
    with the least of its vectors. Ties go to the smaller id, however many
    there are. An empty table gives an empty result; further columns, whatever
    their names, are left out. ``recall`` 1 probes all lists.
    """
    with scratch(vectors.sparkSession) as keep:
        return _search(usable(vectors, id_col, vector_col), is_query, k, recall, keep)


def _search(rows: DataFrame, is_query: Column, k: int, recall: float, keep) -> DataFrame:
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square"),
    )
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, square = most
    rows = rows.where(F.size("v") == d)
    lists = max(1, min(MOST_LISTS, round(np.sqrt(n))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = _matrix(sample.column("v").combine_chunks())
    index = fit(sample, square * (1 + 1e-9), lists)
    lists, probe = len(index.centroids), probes_for(index, sample, k, recall)

    @F.arrow_udf("int")
    def nearest_list(v: pa.Array) -> pa.Array:
        return pa.array(index.order(index.extend(_matrix(v)), 1)[:, 0] if len(v) else [], pa.int32())

    # Rows of one id and vector become one with its number of copies, then of each vector the k + 1 smallest ids stay.
    unique = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = unique.withColumn("place", place).where(F.col("place") <= k + 1)
    listed = written(held.select("vec_id", F.least("copies", F.lit(k)).alias("copies"), "v", nearest_list("v").alias("list")), "listed")
    first, parts = _bundles({r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}, lists)

    @F.arrow_udf("array<struct<bundle int, probed array<int>>>")
    def bundles_of(v: pa.Array) -> pa.Array:
        out = []
        near = np.sort(index.order(index.extend(_matrix(v), query=True), probe), axis=1) if len(v) else []
        for own in near:
            by: dict[int, list[int]] = {}
            for j in own.tolist():
                for b in range(first[j], first[j] + parts[j]):
                    by.setdefault(b, []).append(j)
            out.append([{"bundle": b, "probed": x} for b, x in by.items()])
        return pa.array(out, pa.list_(pa.struct([("bundle", pa.int32()), ("probed", pa.list_(pa.int32()))])))

    # Queries of one vector are searched once, under the least of their ids.
    queries = written(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    reps = written(queries.groupBy("v").agg(F.min("vec_id").alias("rep")), "reps")
    members = keep(written(queries.join(reps, "v").select("rep", F.col("vec_id").alias("query_id")), "members"))
    asked = reps.select("rep", "v", F.explode(bundles_of("v")).alias("to")).select("rep", "v", "to.*")
    asked = written(asked, "asked")
    shares = asked.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / CELL_QUERIES).cast("int").alias("shares"))
    places = spark.createDataFrame([(j, int(first[j]), int(parts[j])) for j in range(lists)], "list int, first int, parts int")
    stored = listed.join(F.broadcast(places), "list").withColumn(
        "bundle", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    )
    stored = stored.join(shares, "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "vec_id", "copies", "v", "list"
    )
    asked = asked.join(shares, "bundle").select(
        "bundle", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int").alias("share"), "rep", "v", "probed"
    )

    def cell(queries: pa.Table, held: pa.Table) -> pa.Table:
        return _found(index, queries, held, k + 1)

    found = asked.groupBy("bundle", "share").cogroup(stored.groupBy("bundle", "share"))
    found = found.applyInArrow(cell, "rep long, vec_id long, copies long, score double")
    nearest = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))
    best = keep(written(found.withColumn("place", nearest).where(F.col("place") <= k + 1).drop("place"), "best"))
    # A query's own id goes; k others are left, or all there are.
    each = members.join(best, "rep").where("query_id <> vec_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
