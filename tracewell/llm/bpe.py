"""Byte-level BPE encoding and decoding.

A piece is encoded by a priority queue of merge ranks over a doubly linked list
of symbols; a queue entry whose pair is no longer there is stale and skipped.
Decoding concatenates the vocabulary's byte strings.

Token ids travel as BINARY: little-endian unsigned 32-bit, four bytes a token.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on whose class the split pattern's engines agree: ASCII but the
#: four separators, and Latin letters and signs. Other texts are split by the
#: vocabulary file's own splitter.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")

#: Pieces that each generation of a cache holds, some 200 bytes each.
CACHE_PIECES = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


class Bpe:
    """An encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.id_of_letter = {c: vocab[c] for c in letters}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.rank[vocab[left], vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
        strings |= {i: s.encode() for s, i in self.specials.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.split = regex.compile(SPLIT)
        self.words = PieceCache(self._word)
        self.spaced = PieceCache(self._spaced)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        return self._pack(self.merge([self.byte_ids[b] for b in word.encode()]))

    def _words(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split.findall(piece)))

    def _spaced(self, piece: str) -> bytes:
        """Ids of a piece of text with a space before it."""
        first, *rest = self.split.findall(" " + piece)
        if not rest:
            return self._word(first)
        return self.spaced[first[1:]] + b"".join(map(self.words.__getitem__, rest))

    def merge(self, ids: list[int]) -> list[int]:
        """Merge a piece's symbols, best rank first, leftmost first among equals.

        rank_at[i] is the rank of the pair that starts at symbol i just now; a
        queue entry that differs from it is stale.
        """
        n, rank_of, merged = len(ids), self.rank.get, self.merged
        rank_at = [*map(rank_of, zip(ids, ids[1:])), None]
        bits = 8 if n < 256 else 40
        queue = [r << bits | i for i, r in enumerate(rank_at) if r is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push, mask = heapq.heappop, heapq.heappush, (1 << bits) - 1
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            at, rank = entry & mask, entry >> bits
            if rank_at[at] != rank:
                continue
            right = nxt[at]
            new = ids[at] = merged[rank]
            ids[right], rank_at[right] = -1, None
            nxt[at] = after = nxt[right]
            if after < n:
                prv[after] = at
                rank_at[at] = r = rank_of((new, ids[after]))
                if r is not None:
                    push(queue, r << bits | at)
            else:
                rank_at[at] = None
            before = prv[at]
            if before >= 0:
                rank_at[before] = r = rank_of((ids[before], new))
                if r is not None:
                    push(queue, r << bits | before)
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii() and UNUSUAL.search(text) or text.isascii() and re.search("[\x1c-\x1f]", text):
            from tokenizers.pre_tokenizers import ByteLevel

            of = self.id_of_letter
            found = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
            return b"".join(self._pack(self.merge([of[c] for c in piece])) for piece, _ in found)
        if "  " in text:
            return self._words(text)
        # A single space before a non-space always starts a new piece.
        first, *rest = text.split(" ")
        return self._words(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        parts = self.special_re.split(text)
        return b"".join(self._pack([self.specials[p]]) if i % 2 else self._plain(p) for i, p in enumerate(parts) if p)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in array("I", ids)]).decode("utf-8", "replace")


class PieceCache(dict):
    """Encoded pieces by text: two generations, of which the older is let go when the younger is full."""

    def __init__(self, make, most: int = CACHE_PIECES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary, read once a Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(text: Column, path: str) -> Column:
    """Ids of a text column, as BINARY. Null and empty texts give no ids; special tokens' strings give their ids."""

    @F.arrow_udf("binary")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.encode(t.as_py()) for t in texts], pa.binary())

    return bpe_encode(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an id column, as UTF-8 with malformed sequences replaced. Null ids give null."""

    @F.arrow_udf("string")
    def bpe_decode(rows: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([None if r is None else bpe.decode(r) for r in rows.to_pylist()], pa.string())

    return bpe_decode(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct(ids, decoded): encode() and decode() of it in one pass, as chained functions would encode twice."""

    @F.arrow_udf("struct<ids binary, decoded string>")
    def bpe_round_trip(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        ids = [bpe.encode(t.as_py()) for t in texts]
        decoded = pa.array(map(bpe.decode, ids), pa.string(), size=len(ids))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

    return bpe_round_trip(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row.

    A null text counts as empty and has no ids; very long texts are encoded
    whole. Repeated rows stay, null ids too; an empty table gives an empty
    result; further columns, whatever their names, are left out.
    """
    coded = docs.select(F.col(id_col).alias("doc_id"), round_trip(F.col(text_col), path).alias("coded"))
    return coded.select("doc_id", "coded.ids", "coded.decoded")


def digest_columns(coded: DataFrame) -> DataFrame:
    """The query's columns: counts and SHA-256 of what encode_documents gave."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
