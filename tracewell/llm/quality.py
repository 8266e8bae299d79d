"""Document quality by Bradley-Terry pairwise ranking.

Every text becomes a short vector of surface statistics. Every labelled document
is paired with some of the other class (a good one over a bad one); weights are
learned by logistic loss on the feature differences, so that P(a preferred over b)
is sigmoid(s(a) - s(b)). The cut is the quantile of training scores at the share
of bad labels; scores are shifted so that this cut is CUT.

The labelled rows lie in blocks, one row of a table each. A step of the fit is a
pass over all blocks, of which each gives the driver a sum of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, scratch, small_batches, written

CUT = 0.3
#: Partners drawn for each labelled row.
PARTNERS = 4
#: Labelled rows of a block, and blocks at most; beyond that, blocks grow.
BLOCK, BLOCKS = 4_096, 1_024
#: Rows of either class that a block has on average; if a class has fewer, its rows are partners in several blocks.
OTHERS = 64
#: Labels that are joined to the texts by broadcast; of more, the vectors of all texts are joined by shuffle.
FEW = 1_000_000
#: Scores around the cut that the driver orders, and the intervals that scores are counted in before.
NEAR, BINS = 4_096, 256

FEATURES = (
    "log_bytes", "upper", "digits", "marks", "bars", "bangs", "stops", "lines", "high",
    "word_length", "distinct_words", "repeated_words", "marked_words", "distinct_lines", "control",
)

_MARKS = np.frombuffer(b"#%&*$@=<>{}[]\\^~_+", np.uint8)


def features(text: str | None) -> np.ndarray:
    """The statistics of one whole text; zeros for null and empty ones."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    nw, marks = max(len(words), 1), seen[_MARKS].sum()
    out[:] = (
        np.log(n + 1) / 10,
        seen[65:91].sum() / max(letters, 1),
        seen[48:58].sum() / n,
        marks / n,
        seen[124] / nw,
        seen[33] / nw,
        (seen[46] + seen[44]) / nw,
        len(lines) / nw,
        seen[128:].sum() / n,
        min(n / nw, 40) / 10,
        len(set(words)) / nw,
        sum(map(eq, words, words[1:])) / nw,
        min(marks / nw, 3) / 3,
        len(set(lines)) / max(len(lines), 1),
        (seen[:9].sum() + seen[14:32].sum()) / n,
    )
    out[[1, 2, 3, 4, 5, 11, 12]] = np.sqrt(out[[1, 2, 3, 4, 5, 11, 12]])
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features; score() is in 0..1 and CUT is the quantile cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _constant(good: bool) -> Ranking:
    """Every score is the same: 1, or 0 if there are bad labels only."""
    d = len(FEATURES)
    return Ranking(np.zeros(d), np.ones(d), np.zeros(d), -60.0 if good else 60.0)


def _pairs(good: np.ndarray, seed: int | list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(better, worse, row): places of pairs of either class, PARTNERS for each row, and the row that each pair is drawn for."""
    up, down, rng = np.flatnonzero(good), np.flatnonzero(~good), np.random.default_rng(seed)
    ups, downs = np.repeat(up, PARTNERS), np.repeat(down, PARTNERS)
    better = np.concatenate([ups, rng.choice(up, len(downs))])
    return better, np.concatenate([rng.choice(down, len(ups)), downs]), np.concatenate([ups, downs])


def _slope(diff: np.ndarray, share: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient and the curvature of the pairs' loss at ``w``; a pair counts as its share."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))
    return diff.T @ (p * share), (diff * (p * (1 - p) * share)[:, None]).T @ diff


def _newton(slope: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], ridge: float) -> np.ndarray:
    w = np.zeros(len(FEATURES))
    for _ in range(25):
        gradient, curvature = slope(w)
        step = np.linalg.solve(curvature + ridge * np.eye(len(w)), gradient - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, bad_share: float, seed: int = 7, ridge: float = 1.0) -> Ranking:
    """Learn from one block of feature rows and their labels. With one class only every score is the same: 1, or 0 if all are bad."""
    if not len(x) or good.all() or not good.any():
        return _constant(not len(x) or bool(good.any()))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse, _ = _pairs(good, seed)
    diff, one = z[better] - z[worse], np.ones(len(better))
    w = _newton(lambda w: _slope(diff, one, w), ridge)
    raw = z @ w
    # Rows may not have the labels' shares; weigh them back to those.
    weight = np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())
    order = np.argsort(raw, kind="stable")
    below = np.searchsorted(np.cumsum(weight[order]), bad_share * (1 + 1e-9))
    low, high = order[max(below - 1, 0)], order[min(below, len(order) - 1)]
    return Ranking(mean, scale, w, float((raw[low] + raw[high]) / 2))


def _blocked(vectors: DataFrame, up: int, down: int) -> tuple[DataFrame, int]:
    """(block, x, good, own): all rows of (label_id, label, x), some BLOCK in each row; and the copies that a row of the smaller class has.

    Copies are partners in other blocks, and ``own`` is false for them.
    """
    blocks = min(max(-(-(up + down) // BLOCK), 1), BLOCKS)
    copies = min(blocks, -(-OTHERS * blocks // min(up, down)))
    block, at = F.pmod(F.xxhash64("label_id", "x"), F.lit(blocks)), F.col("at")
    several = F.when(F.col("label") == int(up < down), F.lit(copies)).otherwise(1)
    dealt = vectors.select("label_id", "label", "x", block.alias("block"), F.explode(F.sequence(F.lit(0), several - 1)).alias("at"))
    row = F.struct(F.xxhash64("label_id").alias("h"), "label_id", "label", (at == 0).alias("own"), "x")
    rows = dealt.groupBy(((F.col("block") + at) % blocks).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    x, good, own = F.flatten("rows.x"), F.transform("rows.label", lambda v: v == 1), F.col("rows.own")
    return written(rows.select("block", x.alias("x"), good.alias("good"), own.alias("own")), "blocks"), copies


def _of_blocks(blocks: DataFrame, of: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``of`` (block, x, good, own) gives for each block, of the same length for all, in the blocks' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch["block"].to_pylist(), []
            for i, name in enumerate(names):
                x, good, own = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("x", "good", "own"))
                found.append(of(name, x.reshape(-1, len(FEATURES)), good, own).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["block", "found"])

    rows = blocks.mapInArrow(run, "block long, found array<double>").collect()
    return np.array([r["found"] for r in sorted(rows, key=lambda r: r["block"])])


def _fit_blocks(blocks: DataFrame, copies: int, up: int, down: int, bad_share: float, seed: int = 7, ridge: float = 1.0) -> Ranking:
    """fit() over all blocks."""
    d, fewer = len(FEATURES), up < down
    mean = _of_blocks(blocks, lambda _, x, good, own: x[own].sum(0)).sum(0) / (up + down)
    scale = _of_blocks(blocks, lambda _, x, good, own: ((x[own] - mean) ** 2).sum(0)).sum(0) / (up + down)
    scale = np.maximum(np.sqrt(scale), 1e-6)

    def slope(w):
        def of(block, x, good, own):
            if good.all() or not good.any():
                return np.zeros(d + d * d)
            better, worse, row = _pairs(good, [seed, block])
            z = np.clip((x - mean) / scale, -8, 8)
            return np.concatenate([part.ravel() for part in _slope(z[better] - z[worse], np.where(good[row] == fewer, 1 / copies, 1.0), w)])

        total = _of_blocks(blocks, of).sum(0)
        return total[:d], total[d:].reshape(d, d)

    ranking = Ranking(mean, scale, _newton(slope, ridge), 0.0)
    return Ranking(mean, scale, ranking.weights, _cut(blocks, ranking, bad_share, np.array([bad_share / down, (1 - bad_share) / up])))


def _cut(blocks: DataFrame, ranking: Ranking, share: float, weight: np.ndarray) -> float:
    """The middle of the two scores between which the rows' weights, by label, reach ``share``.

    Scores are counted in ever smaller intervals (low, high], until few are in that of the cut, or all of those are equal.
    """
    high = 8 * float(np.abs(ranking.weights).sum()) + 1
    low, below, target = -high, np.zeros(2), share * (1 + 1e-9)
    while True:
        edges = np.linspace(low, high, BINS + 1)

        def counts(_, x, good, own):
            raw, good = ranking.raw(x)[own], good[own]
            inside = (raw > edges[0]) & (raw <= edges[-1])
            place = np.searchsorted(edges, raw[inside]) - 1 + BINS * good[inside]
            return np.bincount(place, minlength=2 * BINS)

        found = _of_blocks(blocks, counts).sum(0).reshape(2, BINS)
        reached = np.flatnonzero(weight @ (below[:, None] + found.cumsum(1)) >= target)
        at = int(reached[0]) if len(reached) else int(np.flatnonzero(found.sum(0))[-1])
        below += found[:, :at].sum(1)
        low, high = float(edges[at]), float(edges[at + 1])
        if found[:, at].sum() <= NEAR or np.nextafter(low, high) >= high:
            break

    def values(batches):
        for batch in batches:
            for i in range(len(batch)):
                x, good, own = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("x", "good", "own"))
                raw, good = ranking.raw(x.reshape(-1, len(FEATURES)))[own], good[own]
                near = (raw > low) & (raw <= high)
                yield pa.RecordBatch.from_arrays([pa.array(raw[near]), pa.array(good[near].astype(np.int64))], ["raw", "good"])

    near = blocks.mapInArrow(values, "raw double, good long").groupBy("raw", "good").count().orderBy("raw", "good").collect()
    before = _of_blocks(blocks, lambda _, x, good, own: np.array([max(ranking.raw(x)[own].tolist(), key=lambda v: (v <= low, v))]))
    before = before[before <= low]
    last = float(before.max()) if len(before) else None
    for raw, good, n in near:
        start = weight @ below
        below[good] += n
        if weight @ below >= target:
            first = start + weight[good] >= target and last is not None
            return float(((last if first else raw) + raw) / 2)
        last = raw
    return float(last)


def train(docs: DataFrame, labels: DataFrame, trainable: Column | None = None) -> Ranking:
    """Fit on every labelled row.

    Label rows with a null id or another label than 0 and 1 are left out. The
    share of bad labels is counted over all label rows that may be used.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if trainable is not None:
        rows = rows.where(trainable)
    rows = rows.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return _constant(True)
    spark, texts = docs.sparkSession, docs.select(F.col("doc_id").alias("label_id"), "text")
    with scratch(spark), small_batches(spark):
        x = feature_column(F.col("text")).alias("x")
        if n <= FEW:
            vectors = texts.join(F.broadcast(rows), "label_id").select("label_id", "label", x)
        else:
            vectors = texts.select("label_id", x).join(rows, "label_id")
        vectors = written(vectors, "vectors")
        held, up = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        if up in (0, held):
            return _constant(not held or up > 0)
        blocks, copies = _blocked(vectors, up, held - up)
        with small_batches(spark, 16):
            return _fit_blocks(blocks, copies, up, held - up, (n - good) / n)


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def quality_features(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).tolist() for t in texts], pa.list_(pa.float64()))

    return quality_features(text)


def score_column(text: Column, ranking: Ranking) -> Column:
    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(ranking.score(np.stack([features(t.as_py()) for t in texts])), pa.float64())

    return quality_score(text)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Documents whose crc32(doc_id as text) modulo ``fold`` is ``held`` are held
    out of the fit. Null and empty texts are scored like any other; a null
    doc_id is held out; repeated rows each get their row; other columns are
    left out. Without usable labels of both classes all scores are the same.
    """
    ranking = train(docs, labels, crc_mod(F.col("doc_id"), fold) != held)
    scored = docs.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), fold) == held, F.lit(True)).alias("held_out"),
        score_column(F.col("text"), ranking).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0) -> DataFrame:
    """The documents that classify() predicts to be good, with all their columns, whatever their names.

    Null and empty texts are judged like any other; repeated rows stay or go
    together; an empty table stays empty. Without usable labels of both classes
    all documents stay, unless every label is bad.
    """
    ranking = train(docs, labels, crc_mod(F.col("doc_id"), fold) != held)
    return docs.where(score_column(F.col("text"), ranking) >= CUT)


def rejected(docs: DataFrame, labels: DataFrame, row_col: str, fold: int = 5, held: int = 0) -> DataFrame:
    """(row) of the documents that keep_good() leaves out; ``row_col`` names a column of unique values."""
    ranking = train(docs, labels, crc_mod(F.col("doc_id"), fold) != held)
    return docs.select(F.col(row_col).alias("row"), "text").where(score_column(F.col("text"), ranking) < CUT).select("row")
