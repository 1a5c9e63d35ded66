"""Pending work, in batches and as a stream, and stretches of text, against plain versions."""

import random
import time

import pytest
from tessera.functions.lexer import Lexer
from tessera.operators.snippets import offsets, snippets
from tessera.operators.work import ADD, REMOVE, pending, work_order
from tessera.streaming.work import STATE_STORE, pending_stream

SCHEMA = "seq long, key string, op string, size long"


def log(n, keys, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), rng.choice([ADD, ADD, REMOVE, "Other"]), rng.choice([None, rng.randrange(9)])) for i in range(n)]


def plain(rows):
    queued = {}
    for seq, key, op, size in sorted(rows):
        if key is None or op not in (ADD, REMOVE):
            continue
        there = queued.get(key)
        queued[key] = (op, there[1], size) if there and there[0] == op else (op, seq, size)
    return {(k, *v) for k, v in queued.items()}


def test_pending_and_its_order(spark):
    rows = log(900, ["a", "b", "c", None, *map(str, range(60))]) + [(1000 + i, "a", ADD, 5) for i in range(400)]
    work = pending(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want = plain(rows)
    # max_by leaves out no nulls: the last request counts.
    assert {(r.key, r.op, r.seq, r.size) for r in work.collect()} == want
    placed = sorted(work_order(work).collect(), key=lambda r: r.place)
    order = sorted(want, key=lambda w: (w[1] == ADD, (w[3] is not None, w[3] or 0) if w[1] == ADD else (), w[2]))
    assert [(r.key, r.op, r.seq, r.size) for r in placed] == order and [r.place for r in placed] == list(range(1, len(order) + 1))
    assert pending(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    """Also across a restart from the checkpoint, with work that was queued before it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = log(60, ["a", "b", "c", None])
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(source)

    def start(quiet):
        stream = pending_stream(spark.readStream.schema(SCHEMA).parquet(source), quiet)
        return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    try:
        query = start(3_600_000)
        spark.createDataFrame(rows[:30], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for _ in range(150):
            if any(p["numInputRows"] for p in query.recentProgress):
                break
            time.sleep(0.2)
        query.stop()
        assert spark.read.schema("key string").parquet(sink).count() == 0
        query = start(500)
        spark.createDataFrame(rows[30:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for _ in range(150):
            if spark.read.schema("key string").parquet(sink).count() >= 3:
                break
            time.sleep(0.2)
        query.stop()
        got = {(r.key, r.op, r.seq, r.size) for r in spark.read.parquet(sink).collect()}
        assert got == plain(rows)
    finally:
        spark.conf.set(key, before)


TEXTS = {1: "the quick the that brown", 2: "that  x the", 3: None, 4: "", 5: "THE, That!", 6: "only the", 7: "that 漢the字 that the\n\nthat", 8: "the " * 500 + "that", 9: "𝒳 the 😀 that"}


def test_offsets_and_snippets(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS.items()], "content_id long, content string, pos int")
    found = offsets(docs).collect()
    for i, text in TEXTS.items():
        mine = sorted((r.pos, r.term, r.start) for r in found if r.content_id == i)
        assert [(t, s) for _, t, s in mine] == Lexer().offsets(text or "") and [p for p, _, _ in mine] == list(range(len(mine)))
        assert all(text[r.start : r.end].lower() == r.term for r in found if r.content_id == i)
    got = {r.content_id: (r.start, r.end) for r in snippets(docs, ["the", "that"]).collect()}
    for i, text in TEXTS.items():
        places = [(s, s + len(t), t) for t, s in Lexer().offsets(text or "")]
        best = min(((e - s, e, s) for s, _, a in places for _, e, b in places if e > s and {t for x, y, t in places if s <= x and y <= e} >= {"the", "that"}), default=None)
        assert got.get(i) == (best and (best[2], best[1])), i
    assert snippets(docs, ["the"]).where("content_id = 8").first().end == 3 and snippets(docs.limit(0), ["the"]).count() == 0
    with pytest.raises(ValueError):
        snippets(docs, [])


def test_offsets_are_summed_up_where_the_text_is(spark):
    docs = spark.createDataFrame([(1, "a bb  ccc"), (1, None), (None, "x"), (2, ", a")], "content_id long, content string")
    found = offsets(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 0, "a", 0, 1), (1, 1, "bb", 2, 4), (1, 2, "ccc", 6, 9), (None, 0, "x", 0, 1), (2, 0, "a", 2, 3)], key=str)
