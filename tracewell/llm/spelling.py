"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One replaced letter moves a word's vector of letter counts by +1 and -1 in two
letters, one inserted letter by +1 in one. So a word's near words lie in a small
box around its vector: those of its own length within one step up and one down,
those with one letter more within one step up. A tree for each length, grown on a
bounded sample, deals all words to cells; a word also visits every cell that its
box meets. Within a cell a second tree with the true bounds of its nodes prunes
further, and the letters, in order, decide on what is left.

A pair is met once: a word visits cells of its own length behind its own only,
and cells of the next length. Words with the same letters are never near, but may
be many: a cell of more than HOT words is dealt to parts, and visitors go to each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, written

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has so many times the word's own occurrences.
FORM_TIMES = 5
#: One run of so many loses a letter, by its hash.
LOSES_ONE_IN = 199
#: Words that the trees of cells are grown on, and words that a cell is meant for.
SAMPLE, CELL = 65_536, 1_024
HOT = 8 * CELL
#: Distinct words that a task counts before it hands them on, and words of a leaf within a cell.
HELD, LEAF = 200_000, 16
#: Pairs of a leaf above which their letters are compared by hashing.
MANY = 1 << 16

_RUN = re.compile(b"(?:[a-z]|\xc3[\x80-\xbf])+")
#: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


def run_counts(doc_id: int | None, text: str | None) -> Counter:
    """Occurrences of each word of a text (UTF-8), after the hashed loss of letters; short words are left out."""
    found = Counter(_RUN.findall((text or "").encode("utf-8", "replace").lower()))
    base, out = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())), Counter()
    for run, n in found.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run, base)
        if h % LOSES_ONE_IN == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        if len(run) - run.count(b"\xc3") >= LEAST_LENGTH:
            out[run] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def handed() -> pa.RecordBatch:
        words = pa.array(list(total), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            for word, n in run_counts(doc_id.as_py(), text.as_py()).items():
                total[word] += n
            if len(total) >= HELD:
                yield handed()
                total.clear()
    yield handed()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with at least LEAST_COUNT occurrences in all documents together."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = texts.mapInArrow(_counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def codes_of(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """Counts of each letter in each row of code points."""
    slot = np.where(codes < 128, codes - 97, codes.astype(np.int64) - 0xC0 + 26).astype(np.int64)
    flat = (np.arange(len(codes))[:, None] * LETTERS + slot).ravel()
    return np.bincount(flat, minlength=len(codes) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


class Cells:
    """A tree for each length, of nodes (letter, most on the left, left, right); a leaf is its cell's number."""

    def __init__(self, sample: list[str], share: float):
        """``share``: words that each word of the sample stands for."""
        by_length, self.trees, self.cells = defaultdict(list), {}, 0
        for word in sample:
            by_length[len(word)].append(word)
        for length, words in sorted(by_length.items()):
            self.trees[length] = self._grow(vectors_of(codes_of(words)), len(words) * share / CELL)

    def _grow(self, vectors: np.ndarray, leaves: float):
        best = (0, 0, 0)
        if leaves > 1 and len(vectors) >= LEAF:
            for letter in np.flatnonzero(vectors.min(0) != vectors.max(0)).tolist():
                counts = np.cumsum(np.bincount(vectors[:, letter]))[:-1]
                even = np.minimum(counts, len(vectors) - counts)
                best = max(best, (int(even.max()), letter, int(even.argmax())))
        if not best[0]:
            self.cells += 1
            return self.cells
        _, letter, most = best
        left = vectors[:, letter] <= most
        share = leaves * left.mean()
        return letter, most, self._grow(vectors[left], share), self._grow(vectors[~left], leaves - share)

    def home(self, length: int, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector; a length that the sample lacks is one cell, numbered below zero."""
        out = np.full(len(vectors), -length, np.int64)
        for rows, cell in self._reached(length, vectors, 0, 0):
            out[rows] = cell
        return out

    def reached(self, length: int, vectors: np.ndarray, down: int) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, cell): the vectors that one letter more and ``down`` fewer can bring into a cell."""
        return self._reached(length, vectors, 1, down)

    def _reached(self, length: int, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, int]]:
        """Cells whose box lies within ``up`` steps up and ``down`` steps down, summed over letters."""
        none = np.zeros(len(vectors), np.int32)
        stack = [(self.trees.get(length, -length), np.arange(len(vectors)), none, none, {})]
        while stack:
            node, rows, plus, less, box = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield rows, node
                continue
            letter, most, left, right = node
            low, high = box.get(letter, (-1, 1 << 30))
            here = vectors[rows, letter]
            before = np.maximum(low - here, 0), np.maximum(here - high, 0)
            for child, lo, hi in ((left, low, most), (right, most + 1, high)):
                p = plus + np.maximum(lo - here, 0) - before[0]
                m = less + np.maximum(here - hi, 0) - before[1]
                ok = (p <= up) & (m <= down)
                stack.append((child, rows[ok], p[ok], m[ok], box | {letter: (lo, hi)}))


#: Kinds of a row in a cell: a word of the cell, a visitor of its length, a visitor with one letter fewer.
OWN, SAME, SHORTER = 0, 1, 2


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    places = defaultdict(list)
    for i, word in enumerate(words):
        places[len(word)].append(i)
    for length, at in sorted(places.items()):
        yield length, np.array(at), [words[i] for i in at]


def routed(words: DataFrame, cells: Cells) -> DataFrame:
    """(word, n, kind, cell): each word in its own cell, and in every cell that it has to visit."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, cell = [], [], []
            for length, places, found in _by_length(batch["word"].to_pylist()):
                vectors = vectors_of(codes_of(found))
                home = cells.home(length, vectors)
                parts = [(np.arange(len(found)), home, OWN)]
                parts += [(r[home[r] < c], np.full((home[r] < c).sum(), c), SAME) for r, c in cells.reached(length, vectors, 1)]
                parts += [(r, np.full(len(r), c), SHORTER) for r, c in cells.reached(length + 1, vectors, 0)]
                for rows, numbers, kind in parts:
                    at.append(places[rows])
                    cell.append(numbers)
                    kinds.append(np.full(len(rows), kind))
            if at:
                taken = batch.take(pa.array(np.concatenate(at)))
                columns = [taken["word"], taken["n"], pa.array(np.concatenate(kinds)), pa.array(np.concatenate(cell))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "kind", "cell"])

    return words.select("word", "n").mapInArrow(route, "word string, n long, kind long, cell long")


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` becomes that of ``b`` by one replaced letter, or by one inserted if ``b`` is longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= a.shape[1]


def _hashed(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Rows (own, other) that differ in one edit, found by what is left when a letter goes."""
    shapes, longer = defaultdict(list), own.shape[1] > other.shape[1]
    for i, row in enumerate(own):
        for at in range(len(row)):
            rest = row[:at].tobytes() + row[at + 1 :].tobytes()
            shapes[rest if longer else (at, rest)].append(i)
    pairs = set()
    for j, row in enumerate(other):
        if longer:
            pairs |= {(i, j) for i in shapes.get(row.tobytes(), ())}
        else:
            keys = ((at, row[:at].tobytes() + row[at + 1 :].tobytes()) for at in range(len(row)))
            pairs |= {(i, j) for key in keys for i in shapes.get(key, ()) if (own[i] != row).any()}
    return sorted(pairs)


def near_rows(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``own`` and ``other`` (of that length or one less) that differ in one edit, by a box-pruned tree over ``own``."""
    down = 1 if own.shape[1] == other.shape[1] else 0
    vectors, visiting, found = vectors_of(own), vectors_of(other), [(np.empty(0, np.int64),) * 2]
    stack = [(np.arange(len(own)), np.arange(len(other)))]
    while stack:
        h, q = stack.pop()
        low, high = vectors[h].min(0), vectors[h].max(0)
        up = np.maximum(low - visiting[q], 0).sum(1)
        less = np.maximum(visiting[q] - high, 0).sum(1)
        q = q[(up <= 1) & (less <= down)]
        if not len(q):
            continue
        spread = vectors[h].var(0)
        letter = int(spread.argmax())
        if len(h) > LEAF and spread[letter]:
            left = vectors[h, letter] <= vectors[h, letter].mean()
            stack += [(h[left], q), (h[~left], q)]
        elif len(h) * len(q) > MANY:
            pairs = np.array(_hashed(own[h], other[q]), np.int64).reshape(-1, 2)
            found.append((h[pairs[:, 0]], q[pairs[:, 1]]))
        else:
            a, b = np.repeat(h, len(q)), np.tile(q, len(h))
            ok = one_edit(other[b], own[a])
            found.append((a[ok], b[ok]))
    return tuple(np.concatenate(side) for side in zip(*found))


def _near(group: pa.Table) -> pa.Table:
    """Pairs of near words of one part of a cell."""
    words, kinds = group["word"].to_pylist(), group["kind"].to_numpy()
    places = [np.flatnonzero(kinds == kind) for kind in (OWN, SAME, SHORTER)]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(places[OWN]):
        own = codes_of([words[i] for i in places[OWN]])
        for kind, at in enumerate(places):
            if len(at):
                a, b = near_rows(own, own if kind == OWN else codes_of([words[i] for i in at]))
                once = a < b if kind == OWN else slice(None)
                left.append(places[OWN][a[once]])
                right.append(at[b[once]])
    a, b = (group.take(pa.array(np.concatenate(side))) for side in (left, right))
    return pa.table([a["word"], a["n"], b["word"], b["n"]], ["a", "a_n", "b", "b_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words of (word, n), once, in either order."""
    total = words.count()
    rows = words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()
    cells = Cells([r[0] for r in rows], total / max(len(rows), 1))
    placed = written(routed(words, cells), "routed")
    # Cells, and so hot ones, are bounded by the sample and by the number of lengths.
    hot = placed.where(F.col("kind") == OWN).groupBy("cell").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HOT)
    hot = hot.select("cell", F.ceil(F.col("held") / CELL).cast("long").alias("parts"))
    placed = placed.join(F.broadcast(hot), "cell", "left")
    zero, last = F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1
    own = F.when(F.col("kind") == OWN, F.pmod(F.xxhash64("word"), last + 1)).otherwise(zero)
    dealt = placed.withColumn("own", own).withColumn("part", F.explode(F.sequence("own", last)))
    kind = F.when((F.col("kind") == OWN) & (F.col("part") > F.col("own")), SAME).otherwise(F.col("kind"))
    dealt = dealt.select("cell", "part", "word", "n", kind.cast("long").alias("kind"))
    return dealt.groupBy("cell", "part").applyInArrow(_near, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Each round doubles the steps taken."""
    spark = forms.sparkSession
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = written(stepped, "roots")
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents.

    Null and empty texts have no words; a null id counts as an empty one in the
    hash; rows that repeat are counted each; ties between forms go to the least
    word in code-point order; an empty table gives no rows; further columns,
    whatever their names, are left out. Very long texts are read whole.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep, small_batches(spark):
        words = keep(written(word_counts(docs, id_col, text_col), "words"))
        pairs = written(near_pairs(words), "pairs")
        sides = pairs.select("a", "b", "b_n").union(pairs.select("b", "a", "a_n")).toDF("word", "other", "other_n")
        best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
        near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
        found = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
        has = F.col("best_n") >= FORM_TIMES * F.col("n")
        columns = F.when(has, F.col("best.other")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")
        found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *columns)
        found = keep(written(found, "forms"))
        last = keep(written(roots(found.where("form IS NOT NULL")), "last"))
    out = found.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The SQL computes CRC-32 bit by bit, and finds near words by the keys that one missing letter leaves.
ORACLE_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\\x{C0}-\\x{FF}]+')) AS run, row_number() OVER () AS r FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(8 * len(b)), lambda j: CAST((b[j // 8 + 1] >> CAST(j % 8 AS INT)) & 1 AS BIGINT))),
      lambda c, x: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, x) & 1))), CAST(4294967295 AS BIGINT)) AS h FROM bytes),
kept AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k
  FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gaps AS (SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail
         FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.head || g.tail = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.head || g.tail = w.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form,
    CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
chain AS (
  SELECT word, word AS reached, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON c.reached = f.word WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(reached, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""
