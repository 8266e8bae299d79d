"""Language identification of whole, possibly mixed-language texts.

Words are runs of letters. The script of a word (by code-point ranges) narrows
the languages to those that training texts write in that script. Each word gets
a score per language, the log-probability of its hashed character trigrams and
of the word itself. Viterbi with a penalty for switching labels every word, and
so spans of the text; the language of the most letters is the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod

#: Hash buckets for trigrams and words together.
BUCKETS = 1 << 16
#: Labelled texts the fit reads at most, for each language: the first by a hash of their id.
SAMPLE_PER_LANGUAGE = 2_000
SWITCH = 6.0
#: Runs of letters and their marks. Among Latin letters and signs the plain pattern finds the same faster.
WORD, LATIN_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+")
NOT_LATIN = re.compile("[^\x00-\u024f]")

#: First and last code points of scripts; letters elsewhere are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = [*SCRIPTS, "other"]


def words_of(text: str) -> list[str]:
    return (WORD if NOT_LATIN.search(text) else LATIN_WORD).findall(text.lower())


def script(word: str) -> int:
    """Number of the script of a word's first letter."""
    c = ord(word[0])
    for i, ranges in enumerate(SCRIPTS.values()):
        if any(lo <= c <= hi for lo, hi in ranges):
            return i
    return len(SCRIPTS)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owner): the trigrams of each word, with its borders, and the word as a whole."""
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    begins = code == 2
    of = np.cumsum(begins) - 1
    same = of[2:] == of[:-2]
    tri = (code[:-2] * 0x9E3779B1 + code[1:-1] * 0x85EBCA77 + code[2:] * 0xC2B2AE3D)[same]
    lengths = np.bincount(of, minlength=len(words))
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        mixed = code * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
        whole = np.add.reduceat(mixed, np.flatnonzero(begins))
        tri, whole = tri ^ (tri >> np.uint64(15)), whole ^ (whole >> np.uint64(29))
    buckets = np.concatenate([tri, whole]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([of[2:][same], np.arange(len(words))])


@dataclass
class Model:
    """Learned languages, bucket log-probabilities (languages x BUCKETS) and the scripts of each language."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    @property
    def most(self) -> int:
        """Words whose scores a worker keeps: some 64 MB of them."""
        return max(10_000, min(300_000, (64 << 20) // (4 * max(len(self.langs), 1))))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "logp": self.logp, "allowed": self.allowed, "cache": {}, "rows": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word, relative to the word's best language."""
        x = np.full((len(words), len(self.langs)), -30.0, np.float32)
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            buckets, owner = hashed(some)
            order = np.argsort(owner, kind="stable")
            at = np.flatnonzero(np.diff(owner[order], prepend=-1))
            sums = np.add.reduceat(self.logp[:, buckets[order]], at, axis=1).T
            open_to = self.allowed[[script(w) for w in some]]
            open_to = open_to | ~open_to.any(axis=1, keepdims=True)
            best = np.where(open_to, sums, -np.inf).max(axis=1, keepdims=True)
            x[lo : lo + len(some)] = np.where(open_to, np.maximum(sums - best, -30), -30)
        return x

    def scored(self, words: list[str]) -> np.ndarray:
        """Emissions of a text batch's words in order, from the cache where they are there."""
        if self.rows is None or len(self.cache) > self.most:
            self.cache, self.rows = {}, np.zeros((0, len(self.langs)), np.float32)
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if new:
            at = len(self.cache)
            self.cache.update(zip(new, range(at, at + len(new))))
            if len(self.rows) < len(self.cache):
                grown = np.zeros((max(2 * len(self.rows), len(self.cache)), len(self.langs)), np.float32)
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at : at + len(new)] = self.emissions(new)
        return self.rows[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]


def viterbi(emit: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language number of every word of several texts, laid end to end.

    All texts advance together, a word at a time; a language is kept, or
    switched to from the best one at a cost.
    """
    n, k = emit.shape
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    score = emit[starts[lengths > 0]].copy()
    number = np.uint8 if k <= 256 else np.uint16 if k <= 65_536 else np.uint32
    came = np.zeros((n, k), number)
    keep, steps = np.arange(k, dtype=number), int(lengths.max(initial=0))
    running = np.searchsorted(-lengths, -np.arange(steps + 1), side="left")
    for t in range(1, steps):
        live = running[t]
        s = score[:live]
        top = s.argmax(axis=1)
        best = s[np.arange(live), top][:, None] - switch
        at = starts[:live] + t
        came[at] = np.where(best > s, top[:, None].astype(number), keep)
        score[:live] = np.maximum(s, best) + emit[at]
    labels = np.zeros(n, number)
    state = score.argmax(axis=1).astype(number)
    for t in range(steps - 1, -1, -1):
        live = running[t]
        at = starts[:live] + t
        labels[at] = state[:live]
        if t:
            state[:live] = came[at, state[:live]]
    return labels


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, score) of each whole text; ("und", 0.0) without a letter or a learned language.

    The score is the language's share of the letters. Ties go to the language
    that sorts first.
    """
    found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    # A word takes several numbers a language while its batch is labelled.
    for lo, hi in _batches(texts, max(100_000, 20_000_000 // max(len(model.langs), 10))):
        words, counts = [], []
        for text in texts[lo:hi]:
            own = words_of(text) if text else []
            words += own
            counts.append(len(own))
        if not words or not model.langs:
            continue
        lengths = np.array(counts)
        labels = viterbi(model.scored(words), lengths)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        of = np.repeat(np.arange(hi - lo), lengths)
        shares = np.zeros((hi - lo, len(model.langs)))
        np.add.at(shares, (of, labels), letters)
        total, best = shares.sum(axis=1), shares.argmax(axis=1)
        for i in np.flatnonzero(total):
            found[lo + i] = (model.langs[best[i]], float(shares[i, best[i]] / total[i]))
    return found


def spans(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of the stretches of a text, in code points; empty without letters."""
    places = [m.span() for m in WORD.finditer(text or "")]
    if not places or not model.langs:
        return []
    labels = viterbi(model.scored([text[a:b].lower() for a, b in places]), np.array([len(places)]))
    out: list[tuple[int, int, str]] = []
    for (a, b), k in zip(places, labels):
        if out and out[-1][2] == model.langs[k]:
            out[-1] = (out[-1][0], b, model.langs[k])
        else:
            out.append((a, b, model.langs[k]))
    return out


def _batches(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts with some ``most`` characters; a longer text is a run of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _counts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket counts and scripts of the frames' texts, by language."""
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            words = words_of(text)
            if not words:
                continue
            sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
            sums[lang][:BUCKETS] += np.bincount(hashed(words)[0], minlength=BUCKETS)
            sums[lang][BUCKETS:] += np.bincount([script(w) for w in words], minlength=len(NAMES))
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})


_BLOCK = 1 << 12
#: Languages of a model, 4 * BUCKETS bytes each on the driver and in every worker; more are refused.
MOST_LANGUAGES = 2_000


def train(docs: DataFrame, trainable: Column) -> Model:
    """Learn from a bounded sample of texts of each language, of which there may be MOST_LANGUAGES; whole texts are counted.

    Spark sums the counts and lays a language's out as rows of at most _BLOCK
    pairs. The driver gets at most BUCKETS counts a language, in blocks, and
    keeps the model's 4 * BUCKETS bytes a language.
    """
    usable = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{len(sizes)} values of lang to learn, where a model holds {MOST_LANGUAGES}: clean the column, or name those to learn")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(NAMES), 0), bool))
    # A hash below this share keeps some SAMPLE_PER_LANGUAGE texts of each language, evenly over the table.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, SAMPLE_PER_LANGUAGE / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.select("lang", "text", draw.alias("draw")).join(F.broadcast(shares), "lang").where("draw < share").select("lang", "text")
    counts = sample.mapInPandas(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    blocks = counts.groupBy("lang", F.floor(F.col("bucket") / _BLOCK).alias("block")).agg(F.collect_list(F.struct("bucket", "n")).alias("pairs"))
    sums: dict[str, np.ndarray] = {}
    for row in blocks.toLocalIterator():
        at, n = np.array(row["pairs"], np.int64).T
        sums.setdefault(row["lang"], np.zeros(BUCKETS + len(NAMES), np.int64))[at] = n
    langs = sorted(sums)
    logp, scripts = np.zeros((len(langs), BUCKETS), np.float32), np.zeros((len(langs), len(NAMES)))
    for i, lang in enumerate(langs):
        seen = sums[lang][:BUCKETS] + 0.5
        logp[i], scripts[i] = np.log(seen / seen.sum()), sums[lang][BUCKETS:]
    # A script counts for a language that writes at least one word in 1,000 with it.
    allowed = (scripts >= np.maximum(1, scripts.sum(axis=1, keepdims=True) / 1000)).T
    return Model(langs, logp, allowed)


def language_column(text: Column, model: Model, spark: SparkSession) -> Column:
    """struct(lang_pred, score) of a text column; the model is broadcast, 4 * BUCKETS bytes a language."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def identify(texts: pa.Array) -> pa.Array:
        found = predict(texts.to_pylist(), sent.value)
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
            ["lang_pred", "score"],
        )

    return identify(text)


def identify(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Documents whose crc32(doc_id as text) modulo ``fold`` is ``held``, or whose
    doc_id is null, are held out of the fit. Null, empty and letterless texts
    are "und" with score 0, as are all texts if nothing could be learned. Very
    long texts are labelled whole. Repeated rows each get their row, an empty
    table none; other columns, whatever their names, are left out.
    """
    learn = F.coalesce(crc_mod(F.col("doc_id"), fold) != held, F.lit(False))
    model = train(docs, learn)
    found = docs.select("doc_id", (~learn).alias("held_out"), language_column(F.col("text"), model, docs.sparkSession).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
