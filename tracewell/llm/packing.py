"""Packing of token streams into sequences.

A document is cut at multiples of the sequence length. Its last, shorter piece
joins a group drawn by a hash of the row; in each group first-fit decreasing
fills bins, and a tournament tree over the bins' free room finds the first that
fits. The tokenising pass also gives CRC-32s of every piece and of the powers of
two that make up the last one, so that neither texts nor ids are shuffled.

Sequences whose length is a power of two are not padded. A bin that stays emptier
than DISSOLVE is cut along the powers of two of its pieces, largest first, into
sequences that are powers of two.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import UNUSUAL, PieceCache, byte_alphabet
from .common import small_batches, written

LENGTH = 4096
#: Documents in a group, on average.
GROUP = 4_096
#: Words that each of a cache's two generations holds, some 200 bytes each; an
#: executor's workers have what other operators left in memory as well.
CACHE_WORDS = 60_000
#: Bins filled below this share are dissolved.
DISSOLVE = 0.75


#: The pieces that the vocabulary's splitter makes of a lower-case word of Latin
#: letters, digits and signs: endings, letters, single digits, other signs.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+")


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, a white-space word at a time.

    The vocabulary drops white space, so words are independent; those met before
    are looked up. A new word is cut into pieces, and only a new piece goes to
    the library's merges. Texts with unusual characters, or with special tokens'
    strings, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merges, self.letters = self.whole.model, byte_alphabet()
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special_re = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = PieceCache(self._word, CACHE_WORDS)
        self.splits_on_space = self._splits_on_space()

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        pieces = PIECE.findall(word)
        if len(pieces) > 1:
            return b"".join(map(self.words.__getitem__, pieces))
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()

    def _splits_on_space(self) -> bool:
        """Whether the vocabulary drops white space, lower-cases and splits as the word-wise way needs."""
        odd = "The  a\n(b) it's x_12é ²½ÀSS--Ǆ'LL"
        return self._library(odd) == b"".join(map(self._word, odd.lower().split()))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.splits_on_space or UNUSUAL.search(text) or self.special_re and self.special_re.search(text):
            return self._library(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_loaded: dict[str, WordIds] = {}


def load(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def powers(n: int) -> list[int]:
    """The powers of two that sum up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def measure(ids: bytes, length: int = LENGTH) -> tuple[int, list[int], int, list[int]]:
    """(tokens, CRC-32 of each full piece, of the last piece, of that piece's powers of two)."""
    n, view = len(ids) // 4, memoryview(ids)
    full = n // length
    whole = [zlib.crc32(view[4 * length * i : 4 * length * (i + 1)]) for i in range(full)]
    parts, at = [], full * length
    for size in powers(n - at):
        parts.append(zlib.crc32(view[4 * at : 4 * (at + size)]))
        at += size
    return n, whole, zlib.crc32(view[4 * length * full :]), parts


def document_ids(text: Column, path: str, end_id: int) -> Column:
    """Ids of whole texts with ``end_id`` after each, as BINARY of little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def pack_ids(texts: pa.Array) -> pa.Array:
        coder, end = load(path), array("I", [end_id]).tobytes()
        return pa.array([coder.encode(t.as_py()) + end for t in texts], pa.binary())

    return pack_ids(text)


def measured(text: Column, path: str, end_id: int, length: int = LENGTH) -> Column:
    kind = "struct<tokens long, whole array<long>, last long, parts array<long>>"

    @F.arrow_udf(kind)
    def pack_measure(texts: pa.Array) -> pa.Array:
        coder, end = load(path), array("I", [end_id]).tobytes()
        rows = [measure(coder.encode(t.as_py()) + end, length) for t in texts]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
        return pa.StructArray.from_arrays(arrays, ["tokens", "whole", "last", "parts"])

    return pack_measure(text)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each size, and how many bins there are; larger sizes first, ties in the given order.

    The tree's leaves are bins and a node holds the most free room below it; the
    walk down goes left wherever the left side has room enough.
    """
    n = len(sizes)
    bins, used = np.zeros(n, np.int64), 0
    leaves = 1 << max(n - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], used = at - leaves, max(used, at - leaves + 1)
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, used


_SCHEMA = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_group(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """Pieces of one group's documents (doc_id, tokens, whole, last, parts), with sequence numbers from 0."""
    table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending"), ("last", "ascending")])
    # Python integers: a null beside them must not turn ids into floats.
    ids, last, tokens = table["doc_id"].to_pylist(), table["last"].to_pylist(), table["tokens"].to_numpy().astype(np.int64)
    rows, sequence = [], 0
    for i, whole in enumerate(table["whole"].to_pylist()):
        for k, crc in enumerate(whole):
            rows.append((ids[i], k * length, length, crc, int(tokens[i]), sequence, 0))
            sequence += 1
    tails = np.flatnonzero(tokens % length)
    sizes = tokens[tails] % length
    bins, used = first_fit_decreasing(sizes, length)
    fill = np.bincount(bins, sizes, used).astype(np.int64) if used else np.zeros(0, np.int64)
    spare = (fill < DISSOLVE * length) & ((fill & (fill - 1)) != 0)
    number = sequence + np.cumsum(~spare) - 1
    at, loose, parts = np.zeros(used, np.int64), [], table["parts"]
    for i, b, size in zip(tails.tolist(), bins.tolist(), sizes.tolist()):
        start = int(tokens[i]) - size
        if spare[b]:
            for part, crc in zip(powers(size), parts[i].as_py()):
                loose.append((ids[i], start, part, crc, int(tokens[i])))
                start += part
        else:
            rows.append((ids[i], start, size, last[i], int(tokens[i]), int(number[b]), int(at[b])))
            at[b] += size
    sequence += int((~spare).sum())
    # Powers of two in falling order fill the powers of two of their sum without a gap.
    loose.sort(key=lambda x: -x[2])
    left, goal, offset = sum(x[2] for x in loose), 0, 0
    for piece in loose:
        if not goal:
            goal, offset = min(length, 1 << (left.bit_length() - 1)), 0
        rows.append((*piece, sequence, offset))
        offset += piece[2]
        left -= piece[2]
        if offset == goal:
            sequence, goal = sequence + 1, 0
    columns = list(zip(*rows)) or [()] * len(_SCHEMA)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, group: int = GROUP, seed: int = 42
) -> DataFrame:
    """Pieces of all documents, each with its sequence and its offset there.

    ``length`` must be a power of two. A null or empty text is its end id alone;
    a very long one is cut at multiples of ``length``. Rows that repeat a doc_id,
    or have none, are documents of their own; ids are exact over the whole range
    of a long; other columns, whatever their names, are left out; an empty table
    gives no pieces. sequence_id is unique over all groups.

    The token counts and CRCs are written to the shared folder, as the groups
    would otherwise tokenise again whenever a part of them is lost.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    # Ids alone would put all repeats of one id, or all nulls, into one group.
    salt = F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id(), F.lit(seed))
    drawn = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), salt.alias("salt"), measured(F.col("text"), path, end_id, length).alias("m")
    )
    with small_batches(docs.sparkSession):
        drawn = written(drawn.select("doc_id", "salt", "m.*"), "measured")
    groups = max(1, math.ceil(drawn.count() / group))

    def of_group(key, table):
        pieces = pack_group(table, length)
        number = pa.array(pieces["sequence_id"].to_numpy() * groups + key[0].as_py(), pa.int64())
        return pieces.set_column(pieces.schema.get_field_index("sequence_id"), "sequence_id", number)

    return drawn.withColumn("grp", F.pmod("salt", F.lit(groups))).groupBy("grp").applyInArrow(of_group, PIECES)


def sequences(pieces: DataFrame, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(sequence_id, length, ids): the token ids of every sequence, unpadded, from pieces of documents with unique ids."""
    coded = docs.select("doc_id", document_ids(F.col("text"), path, end_id).alias("ids"))
    cut = pieces.join(coded, "doc_id").select(
        "sequence_id",
        "offset",
        "length",
        F.substring(F.col("ids"), F.col("start") * 4 + 1, F.col("length") * 4).alias("part"),
    )
    whole = cut.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts")
    )
    return whole.select("sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.part))").alias("ids"))
