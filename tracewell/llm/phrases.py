"""Phrase collocations, counted by an FM-index per shard over word ids.

Texts are dealt to shards of one language and at most SHARD words, as tasks read
them. A shard keeps two Burrows-Wheeler transforms, of its words and of its words
in reverse, sorted as deep as the longest phrase. A pattern is an interval in
both; taking in a word on the right narrows the backward one by ranks and moves
the forward one past the smaller words, so that one step over all patterns of a
length gives all of the next, with their counts and how many of their occurrences
go on to the left and to the right.

Counts are summed across shards. A phrase is no more frequent than its parts, so
three-word patterns are only taken from two-word ones that all shards together
hold often enough. Which ones those are is settled by a hash of the words: a
collision lets a rare one through, and the exact counts drop it.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, scratch, shuffles_removed, small_batches, written

LEAST, TOP = 10, 2000
#: A phrase goes if a longer one around it has so many percent of its occurrences.
COVERED = 50
SCALE = 1_000_000
#: Words of a shard, and bytes of a text that are cut into words at once.
SHARD, SLICE = 1 << 20, 1 << 20
#: Rows handed to Spark at once.
ROWS = 1 << 16

#: Marks between pieces become one mark; letters A-Z become small.
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r" + ASCII_UPPER.encode(), b"." * 10 + ASCII_LOWER.encode())

SHARD_SCHEMA = "shard long, lang string, words array<string>, counts array<int>, forward binary, backward binary"


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, with ``.`` after each piece, in lists cut between pieces."""
    data = (text or "").encode("utf-8", "replace").translate(_MARKS)
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > SLICE:
            cut = data.rfind(b".", start, start + SLICE)
            cut = cut if cut >= 0 else data.find(b".", start + SLICE)
            end = cut + 1 if cut >= 0 else end
        yield [*data[start:end].replace(b".", b" . ").split(), b"."]
        start = end


def packed(ids: np.ndarray) -> bytes:
    """Word ids, compressed byte by byte of their value: the higher ones are alike, and neighbours in a transform too."""
    return zstandard.ZstdCompressor(1).compress(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def transforms(ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The transforms of the words and of the reversed words, sorted by three words; 0 separates and ends pieces."""

    def sorted_by_three(s: np.ndarray) -> np.ndarray:
        second = np.where(s == 0, 0, np.r_[s[1:], 0])
        third = np.where(second == 0, 0, np.r_[s[2:], 0, 0])
        if n_words < 1 << 21:
            order = np.argsort(s << 42 | second << 21 | third)
        else:
            order = np.lexsort((third, second, s))
        return s[order - 1]

    return sorted_by_three(ids), sorted_by_three(ids[::-1])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the texts that a task reads."""
    held: dict[str, tuple[defaultdict, array]] = {}
    number, in_hand = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0, 0

    def shard(lang: str) -> pa.RecordBatch:
        nonlocal number, in_hand
        ids, row = held.pop(lang)
        number, in_hand = number + 1, in_hand - len(row)
        words = np.array(sorted(w for w in ids if w != b"."), object)
        place = np.zeros(len(ids), np.int64)
        place[[ids[w] for w in words]] = np.arange(1, len(words) + 1)
        seq = place[np.frombuffer(row, np.int32)]
        counts = np.bincount(seq, minlength=len(words) + 1)[1:]
        forward, backward = map(packed, transforms(seq, len(words)))
        texts = pa.array(words.tolist(), pa.binary()).cast(pa.string())
        columns = [
            pa.array([number], pa.int64()), pa.array([lang]), pa.ListArray.from_arrays([0, len(texts)], texts),
            pa.array([counts], pa.list_(pa.int32())), pa.array([forward], pa.binary()), pa.array([backward], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "words", "counts", "forward", "backward"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            for part in tokens(text.as_py()):
                if lang not in held:
                    ids = defaultdict()
                    ids.default_factory = ids.__len__
                    ids[b"."]
                    held[lang] = ids, array("i")
                ids, row = held[lang]
                row.extend(map(ids.__getitem__, part))
                in_hand += len(part)
                if len(row) >= SHARD:
                    yield shard(lang)
            if in_hand >= 2 * SHARD:
                yield from [shard(each) for each in list(held)]
    yield from (shard(each) for each in list(held))


@dataclass
class Patterns:
    """Patterns of one length, by rows: their word ids, and their intervals in both transforms."""

    words: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray

    def __getitem__(self, rows) -> Patterns:
        return Patterns(self.words[rows], self.forward[rows], self.backward[rows], self.size[rows])


class FmIndex:
    """A bidirectional index of one shard. Word ids count from 1; 0 is the mark after a piece."""

    def __init__(self, forward: bytes | None, backward: bytes, counts: np.ndarray):
        self.backward = unpacked(backward).astype(np.int64)
        self.forward = None if forward is None else unpacked(forward)
        self.n, self.counts = len(self.backward), counts
        self.starts = np.r_[0, self.n - counts.sum(), self.n - counts.sum() + np.cumsum(counts)][:-1].astype(np.int64)
        # All places of the backward transform by word, to rank in by binary search.
        self.ranked = np.sort(self.backward * self.n + np.arange(self.n))

    def singles(self) -> Patterns:
        start = self.starts[1:]
        return Patterns(np.arange(1, len(start) + 1)[:, None], start, start, self.counts)

    def to_the_right(self, patterns: Patterns) -> Patterns:
        """The patterns with one more word, in order of pattern and word."""
        size = patterns.size
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(total) + np.repeat(patterns.backward - (ends - size), size)
        n_symbols = len(self.counts) + 1
        keys, found = np.unique(owner * n_symbols + self.backward[at], return_counts=True)
        owner, word = keys // n_symbols, keys % n_symbols
        smaller = np.cumsum(found) - found - (ends - size)[owner]
        rank = np.searchsorted(self.ranked, word * self.n + patterns.backward[owner]) - self.starts[word]
        made = Patterns(
            np.column_stack([patterns.words[owner], word]), patterns.forward[owner] + smaller, self.starts[word] + rank, found
        )
        return made[word != 0]

    def going_on(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
        """How many occurrences of each pattern have a word before them, and after them, in their piece."""
        out = []
        for transform, low in ((self.forward, patterns.forward), (self.backward, patterns.backward)):
            so_far = np.r_[0, np.cumsum(transform != 0)]
            out.append(so_far[low + patterns.size] - so_far[low])
        return tuple(out)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array, FmIndex]]:
    """(row, words, index) of each shard; the row is without what the index and the words hold."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch[name][i] for name in batch.schema.names}
            forward = row.pop("forward").as_py() if "forward" in row else None
            index = FmIndex(forward, row.pop("backward").as_py(), row.pop("counts").values.to_numpy().astype(np.int64))
            words = row.pop("words").values
            yield {name: value.as_py() for name, value in row.items()}, words, index


def _in_slices(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    yield from (whole.slice(lo, ROWS) for lo in range(0, len(whole), ROWS))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair_hashes(lang: str, words: list[str], pairs: np.ndarray) -> np.ndarray:
    own = np.array([xxhash.xxh64_intdigest(w.encode(), 5) for w in words], np.uint64)
    h = (own[pairs[:, 0] - 1] * _MIX + own[pairs[:, 1] - 1]) * _MIX + np.uint64(xxhash.xxh64_intdigest(lang.encode(), 6))
    return ((h ^ (h >> np.uint64(29))) * _MIX).view(np.int64)


def _hashed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, shard, place, c): the two-word patterns of each shard, by hash, with their place in its order."""
    for row, words, index in _indexed(batches):
        pairs = index.to_the_right(index.singles())
        shard = np.full(len(pairs.size), row["shard"])
        columns = [_pair_hashes(row["lang"], words.to_pylist(), pairs.words), shard, np.arange(len(shard), dtype=np.int32), pairs.size]
        yield from _in_slices([pa.array(c) for c in columns], ["h", "shard", "place", "c"])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each shard: the two-word ones named by their places, and the three-word ones whose parts are named."""
    for row, words, index in _indexed(batches):
        pairs = index.to_the_right(index.singles())[np.sort(np.array(row["places"], np.int64))]
        n_symbols = len(index.counts) + 1
        named = pairs.words[:, 0] * n_symbols + pairs.words[:, 1]
        triples = index.to_the_right(pairs)
        triples = triples[np.isin(triples.words[:, 1] * n_symbols + triples.words[:, 2], named)]
        for made in (pairs, triples):
            each = [words.take(pa.array(made.words[:, i] - 1)) for i in range(made.words.shape[1])]
            phrase, (left, right) = pc.binary_join_element_wise(*each, " "), index.going_on(made)
            n = len(phrase)
            columns = [pa.array([row["lang"]] * n), pa.array(np.full(n, len(each))), phrase, pa.array(made.size), pa.array(left), pa.array(right)]
            yield from _in_slices(columns, ["lang", "size", "phrase", "a", "n_left", "n_right"])


def shards_of(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The index of every shard of the documents, as SHARD_SCHEMA."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_shards, SHARD_SCHEMA)


def phrase_counts(shards: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, a, n_left, n_right) of the phrases of two or three words with ``least`` occurrences in all.

    ``n_left`` and ``n_right`` are how many of the occurrences go on to the left and to the right.
    """
    pairs = shards.select("shard", "lang", "words", "counts", "backward").mapInArrow(_hashed_pairs, "h long, shard long, place int, c long")
    often = pairs.withColumn("total", F.sum("c").over(Window.partitionBy("h"))).where(F.col("total") >= least)
    # A shard has at most SHARD patterns, and so has the group of its row.
    places = written(often.groupBy("shard").agg(F.collect_list("place").alias("places")), "places")
    named = shards.join(places.hint("shuffle_hash"), "shard")
    found = named.mapInArrow(_phrases, "lang string, size long, phrase string, a long, n_left long, n_right long")
    sums = [F.sum(c).alias(c) for c in ("a", "n_left", "n_right")]
    return found.groupBy("lang", "size", "phrase").agg(*sums).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """The phrases with l, r and score of the cut that scores least; ``words`` is (lang, word, f).

    Decimals of 38 digits hold 10^6 * a^2 for counts below 10^16.
    """
    c = F.col
    parts = words.select("lang", c("word").alias("part"), "f").union(phrases.where("size = 2").select("lang", "phrase", "a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), c("size") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', int(k))")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    # Written one by one, so that the side of a hot word can be split in each join.
    left = written(cuts.join(parts.select("lang", c("part").alias("first"), c("f").alias("l")), ["lang", "first"]), "left")
    both = left.join(parts.select("lang", c("part").alias("rest"), c("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"CAST(CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0)) * {SCALE} AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    both = written(both.withColumn("score", score.cast("long")), "cuts")
    least = both.groupBy("lang", "size", "phrase", "a", "n_left", "n_right").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "size", "phrase", "a", "n_left", "n_right", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame) -> DataFrame:
    """The phrases that no longer one around them covers."""
    longer = phrases.where("size = 3").select("lang", "a", F.split("phrase", " ").alias("w"))
    inside = F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2])))
    around = longer.select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    known = phrases.join(around, ["lang", "phrase"], "left")
    covered = (F.col("size") == 2) & (100 * F.coalesce("around", F.lit(0)) >= COVERED * F.col("a"))
    return known.where(~covered).drop("around")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score, n_left, n_right).

    Null texts count as empty, a null language as ``und``; rows that repeat are
    counted each; ties go to the more frequent phrase, then to the lesser in byte
    order; an empty table gives no rows; further columns are left out. Texts are
    read whole, however long; a piece longer than a shard makes its shard longer.
    """
    with scratch(docs.sparkSession) as keep, shuffles_removed(docs.sparkSession):
        with small_batches(docs.sparkSession):
            shards = written(shards_of(docs, lang_col, text_col), "shards")
        every = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        every = written(every.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")), "words")
        with small_batches(docs.sparkSession, 1):
            phrases = written(phrase_counts(shards), "phrases")
        found = written(scored(phrases, every.where(F.col("f") >= LEAST)), "scored")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = uncovered(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
        out = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "n_left", "n_right")
        return keep(written(out, "mined"))


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k)
  GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE a >= 10),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1)),
scores AS (
  SELECT c.*, h.a AS l, t.a AS r, CAST(CAST(c.a AS HUGEINT) * c.a * 1000000 // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM cuts c JOIN often h ON c.lang = h.lang AND c.head = h.phrase JOIN often t ON c.lang = t.lang AND c.tail = t.phrase),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a
  FROM often WHERE size = 3),
around AS (SELECT lang, phrase, max(a) AS around FROM inside GROUP BY ALL),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
  FROM least l LEFT JOIN around o ON l.lang = o.lang AND l.phrase = o.phrase
  WHERE l.size = 3 OR o.around IS NULL OR 100 * o.around < 50 * l.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
