"""Snapshots of investigations: against a fold of one event after another, in batches and as a stream with a timer."""

from __future__ import annotations

import json
import random
import time

from tracewell.operators import snapshots
from tracewell.plans.events import TYPES
from tracewell.streaming import snapshots as stream

RAW = "inv long, seq long, type string, key string, count long, text string, fields map<string,string>, items array<string>"


def events(rng, n):
    some = lambda value: value if rng.random() < 0.8 else None
    return [
        (
            rng.randrange(6), seq, rng.choice(TYPES[:9] * 4 + TYPES[9:]), some(rng.choice(["COMPLETE", "NORMALIZE", "x", "y"])), some(rng.randrange(9)),
            some(rng.choice(["", "said"])), some({rng.choice("abc"): some(str(rng.randrange(9))) for _ in range(rng.randrange(3))}), some(["i", None, "j"]),
        )
        for seq in range(n)
    ]


def folded(rows):
    """Entries of each investigation, by one event after another."""
    out = {}
    for inv, seq, kind, key, count, text, fields, items in sorted(rows, key=lambda r: r[1]):
        own = out.setdefault(inv, {("phase", "", ""): "streaming"})
        put = lambda part, name, field, value: own.__setitem__((part, name, field), value)  # noqa: E731, B023
        record = None if fields is None else json.dumps({k: v for k, v in sorted(fields.items())}, separators=(",", ":"))
        if kind == "investigation.started" and key is not None:
            own.setdefault(("id", "", "id"), key)
        elif kind == "stage.started" and key is not None:
            put("stage", key, "status", "running")
        elif kind == "stage.completed" and key is not None:
            put("stage", key, "status", "completed")
            put("stage", key, "detail", text)
        elif kind == "search.batch" and key is not None and count is not None:
            put("search", key, "count", str(count))
        elif kind == "evidence.discovered" and fields is not None:
            for field, value in {"": "discovered", **fields}.items():
                put("evidence", key or f"#{seq}", field, value)
        elif kind == "evidence.classified" and key is not None and fields is not None:
            put("classification", key, "", record)
        elif kind == "provenance.partial" and items is not None:
            put("timeline", "", "items", "2")
        elif kind == "verdict.preliminary" and text is not None:
            put("verdict", "", "preliminary", text)
        elif kind == "divergence.detected" and fields is not None:
            put("divergence", "", "", record)
        elif kind == "investigation.completed" and fields is not None:
            put("phase", "", "", "completed")
            put("result", "", "", record)
        elif kind == "investigation.error":
            put("phase", "", "", "failed")
            put("error", "", "code", key or snapshots.NO_CODE)
            put("error", "", "message", text or snapshots.NO_MESSAGE)
            put("error", "", "partial", str(any(p == "evidence" for p, _, _ in own)).lower())
    return out


def entries(rows):
    out = {}
    for r in rows:
        out.setdefault(r["inv"], {})[r["part"], r["key"], r["field"]] = r["value"]
    return out


def test_snapshots_match_a_fold(spark):
    rows = events(random.Random(1), 700)
    frame = spark.createDataFrame(rows, RAW).repartition(5)
    found = snapshots.snapshots(frame)
    assert entries(found.collect()) == folded(rows)
    assert snapshots.snapshots(frame.limit(0)).count() == 0
    for inv in (0, 1):
        places = [(r["stage"], r["place"]) for r in snapshots.stages(found).where(f"inv = {inv}").orderBy("place").collect()]
        assert [s for s, _ in places][:2] == ["NORMALIZE", "COMPLETE"] and [p for _, p in places] == [1, 2, 3, 4]


def started(spark, folder, name, stall_ms):
    read = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.snapshots(read, stall_ms).writeStream.format("memory").queryName(name).outputMode("append")


def test_stream_in_several_batches(spark, tmp_path):
    """Events that come in any order over batches give the same entries in the end."""
    rows = events(random.Random(2), 300)
    shuffled = random.Random(3).sample(rows, len(rows))
    for i in range(3):
        spark.createDataFrame(shuffled[i::3], RAW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = started(spark, f"{tmp_path}/in", "batches", None).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last = {}
    for r in spark.table("batches").collect():
        order = -1 if r["seq"] is None else -r["seq"] if r["part"] == "id" else r["seq"]
        place = (r["inv"], r["part"], r["key"], r["field"])
        # Of rows of one event the later one stands: whether an error came with evidence may change.
        if place not in last or order >= last[place][0]:
            last[place] = order, r["value"]
    partial = ("error", "", "partial")
    got = {inv: {k[1:]: v for k, (_, v) in last.items() if k[0] == inv and k[1:] != partial} for inv in {k[0] for k in last}}
    assert got == {inv: {k: v for k, v in own.items() if k != partial} for inv, own in folded(rows).items()}


def test_a_stalled_investigation_fails(spark, tmp_path):
    rows = [
        (1, 1, "investigation.started", "a", None, None, None, None), (1, 2, "evidence.discovered", "e", None, None, {"k": "v"}, None),
        (2, 3, "investigation.started", "b", None, None, None, None), (2, 4, "investigation.completed", None, None, None, {"k": "v"}, None),
    ]
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = started(spark, f"{tmp_path}/in", "stalls", 2000).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and not spark.table("stalls").where("value = 'failed'").count():
            time.sleep(1)
    finally:
        query.stop()
    failed = {(r["inv"], r["part"], r["field"]): r["value"] for r in spark.table("stalls").where("seq IS NULL").collect()}
    assert failed == {(1, "phase", ""): "failed", (1, "error", "code"): snapshots.STALLED, (1, "error", "partial"): "true"}
