"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import minhash, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def kept(texts):
    """The least index of each component of similar texts."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(sets[i] & sets[j])
        if common * 100 >= (len(sets[i]) + len(sets[j]) - common) * 80:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(sets))}


def texts_of(rng):
    """Texts alone, chains of copies with more and more words changed, and a crowd around one text."""
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    made = [text(rng.randint(1, 300)) for _ in range(60)]
    for start in [text(rng.randint(60, 400)) for _ in range(25)]:
        for _ in range(4):
            made.append(list(start))
            for _ in range(max(len(start) // rng.choice([40, 60, 100]), 1)):
                start[rng.randrange(len(start))] = f"new{rng.randrange(10**6)}"
    centre = text(200)
    for _ in range(600):
        copy = list(centre)
        for _ in range(rng.randint(1, 8)):
            copy[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        made.append(copy)
    rng.shuffle(made)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("crowd", [minhash.CROWD, 20_000, 1])
def test_stage_matches_brute_force_jaccard(spark, small, monkeypatch, crowd):
    """All crowds as groups, the crowd around one text by bucket, and all by bucket."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    texts = texts_of(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = corpus_pipeline.near_copies(spark, docs, small)
    assert {r[0] for r in near.select("doc_id").collect()} == kept(texts)


def test_stage_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    near = corpus_pipeline.near_copies(spark, docs, small)
    assert {r[0] for r in near.select("doc_id").collect()} == {rows[i]["doc_id"] for i in kept([r["text"] for r in rows])}


def test_rows_of_files_keep_their_keys(spark, small, tmp_path):
    """Copies in several files, with repeated and null ids and columns named as the keys' are, after a filter."""
    rows = [(i % 3 or None, f"text {i % 4} " + "word " * 20, "keep") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _corpus_row string")
    frame.repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").where("text NOT LIKE 'text 3%'")
    keyed, row = corpus_pipeline._keyed(docs, None)
    assert keyed.select(row).distinct().count() == docs.count() == 30
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
        left = stage(spark, docs, small).collect()
        assert len({r["text"] for r in left}) == len(left) and {r["_corpus_row"] for r in left} == {"keep"}
    clash = docs.withColumnRenamed("_corpus_row", "_metadata")
    left = corpus_pipeline.exact_copies(spark, clash, small).collect()
    assert len(left) == 3 and {r["_metadata"] for r in left} == {"keep"}


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_copies, corpus_pipeline.near_copies])
def test_rows_that_repeat_a_file_are_told_apart(spark, small, tmp_path, stage):
    """However a plan repeats the rows of a file, one of each text stays."""
    words = [" ".join(f"w{i * 31 + k}" for k in range(20)) for i in range(50)]
    frame = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    frame.repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    repeats = [
        docs.withColumn("k", twice).drop("k"), docs.crossJoin(spark.range(2)).drop("id"), spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs"),
        docs.union(docs), docs.select("*", twice.alias("k")).where("k > 0").drop("k"), docs,
    ]
    for repeated in repeats if stage is corpus_pipeline.exact_copies else repeats[:2]:
        assert stage(spark, repeated, small).count() == 50


def test_a_crowd_of_one_template(spark, monkeypatch):
    """Thousands of texts that share a template and no link are many comparisons, dealt to blocks; a cut of them links as brute force says."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(40)]

    def text(i):
        words = list(template)
        words[5] = words[20] = words[33] = i
        return " ".join(words)

    texts = [text(f"p{i // 50}" if i % 50 < 2 else f"n{i}") + (f" end{i}" if i % 50 == 1 else "") for i in range(4000)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for work in (1, minhash.WORK):
        monkeypatch.setattr(minhash, "WORK", work)
        found = minhash.near_duplicates(docs.withColumn("row", F.col("doc_id")), "row")
        assert found.select("component").distinct().count() == 4000 - 80
    cut = docs.where("doc_id < 400")
    found = minhash.near_duplicates(cut.withColumn("row", F.col("doc_id")), "row").groupBy("component").agg(F.min("doc_id")).collect()
    assert {r[1] for r in found} == kept(texts[:400])


def test_fingerprints_give_candidates(spark, monkeypatch):
    """Without any band, similar texts within three bits of the SimHash operator link; texts with near prints and other words don't."""
    monkeypatch.setattr(minhash, "sketch_column", _unbanded(minhash.sketch_column))
    words = [f"w{i}" for i in range(2000)]
    near = list(words)
    near[1999] = "other"
    texts = [" ".join(words), " ".join(near), "a b c", "a b c d e f g"]
    assert bin(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).count("1") <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component"] for r in minhash.near_duplicates(docs.withColumn("row", F.col("doc_id")), "row").collect()}
    assert found[0] == found[1] and len(set(found.values())) == 3


def _unbanded(column):
    def of(text):
        s = column(text)
        return F.struct(s["node"].alias("node"), s["size"].alias("size"), F.array().cast("array<long>").alias("keys"), s["fp"].alias("fp"))

    return of


def test_odd_rows(spark, small, documents, no_documents):
    assert corpus_pipeline.near_copies(spark, documents, small).count() == 6
    assert corpus_pipeline.near_copies(spark, no_documents, small).count() == 0


def test_blocks_of_a_bucket():
    sets = [np.arange(i, i + 100, dtype=np.int64) for i in (0, 5, 10, 400)]
    node, component = np.arange(4), np.arange(4)
    assert minhash._links_of(node, np.full(4, 2), component, sets) == [(0, 1), (0, 2)]
    assert minhash._links_of(node, np.array([0, 1, 0, 1]), component, sets) == [(0, 1), (2, 1)]
    assert minhash._links_of(node, np.full(4, 2), np.array([7, 7, 7, 3]), sets) == []
