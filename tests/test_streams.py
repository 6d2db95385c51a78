"""Streams with state: killed and started again, they say what the batch rules say."""

import time

import pytest
from pyspark.sql import functions as F

from cadenza.operators import words as W
from cadenza.sources.shared import shared_dir
from cadenza.streaming import stateful

WORD = "vid long, seq long, text string, t_ms long, end_ms long, spk string, brk boolean, ts timestamp"


def word_rows(spark, rows):
    return spark.createDataFrame([(v, s, x, t, e, k, b) for v, s, x, t, e, k, b in rows], WORD.rsplit(",", 1)[0]).withColumn("ts", F.timestamp_millis("t_ms"))


HE = ["שלום", "עולם", "טוב", "מאוד", "היום"]
EN = ["yes", "okay", "fine", "stop."]


def speech():
    """Videos with pauses, marks from the first word on, speaker changes, sentence ends and runs of both scripts."""
    rows = []
    for vid in range(6):
        t = 0
        for i in range(60):
            english = (i * 7 + vid) % 11 in ((3,), (3, 4), (3, 4, 5), (3, 4, 5, 6))[(i // 11 + vid) % 4]
            text = EN[(i + vid) % 4] if english else HE[i % 5]
            t += 120 + (90 if i % 3 else 0) + (300 if i % 8 == 5 else 0) + (1200 if i % 13 == 12 else 0)
            rows.append((vid, i, text, t, t + 100 + (i % 4) * 40 if i % 5 else None, f"S{i // 9 % 2}", vid % 2 == 1 and i % 17 == 0))
    return rows


def test_segments_of_a_stream_that_is_started_again(spark):
    rows = speech()
    path, out, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    far = (-1, 0, "end", 10**9, 10**9 + 1, "S0", False)
    run = lambda: stateful.appended(stateful.segment_stream(spark.readStream.schema(WORD).parquet(path)), out, state)
    for some in ([r for r in rows if r[3] < 4000], [r for r in rows if 4000 <= r[3] < 9000], [r for r in rows if r[3] >= 9000], [far]):
        word_rows(spark, some).write.mode("append").parquet(path)
        got = run()
    got = got.where("vid >= 0")
    said = {(r["vid"], w["seq"], r["segment"]) for r in got.collect() for w in r["words"]}
    batch = W.sessions(word_rows(spark, rows))
    assert said == {(r["vid"], r["seq"], r["segment"]) for r in batch.collect()}
    ends = W.word_ends(batch)
    whole = {(r["vid"], r["segment"], r["start_ms"], r["n_words"]) for r in W.segments_of(ends).collect()}
    assert {(r["vid"], r["segment"], r["start_ms"], r["n_words"]) for r in got.collect()} == whole
    assert got.agg(F.max("late")).first()[0] == 0


def test_late_words_are_counted_and_left_out(spark):
    path, out, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    row = lambda seq, t: (1, seq, "word", t, t + 50, "S0", False)
    for some in ([row(0, 1000), row(2, 1200)], [row(1, 1100), row(3, 1300)], [(2, 0, "end", 10**8, 10**8 + 1, "S0", False)]):
        word_rows(spark, some).write.mode("append").parquet(path)
        got = stateful.appended(stateful.segment_stream(spark.readStream.schema(WORD).parquet(path)), out, state)
    (segment,) = got.where("vid = 1").collect()
    assert [w["seq"] for w in segment["words"]] == [0, 2, 3] and segment["late"] == 1


def test_videos_share_a_few_states(spark):
    path, out, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    rows = [(v, *rest) for v in range(40) for _, *rest in speech()[:60]] + [(None, *rest) for _, *rest in speech()[:60]]
    run = lambda: stateful.appended(stateful.segment_stream(spark.readStream.schema(WORD).parquet(path), groups=4), out, state)
    for some in ([r for r in rows if r[1] < 30], [r for r in rows if r[1] >= 30]):
        word_rows(spark, some).write.mode("append").parquet(path)
        run()
    assert 0 < spark.read.format("statestore").load(state).count() <= 4
    word_rows(spark, [(-1, 0, "end", 10**9, 10**9 + 1, "S0", False)]).write.mode("append").parquet(path)
    said = {(r["vid"], w["seq"], r["segment"]) for r in run().where("vid is null or vid >= 0").collect() for w in r["words"]}
    assert said == {(r["vid"], r["seq"], r["segment"]) for r in W.sessions(word_rows(spark, rows)).collect()}


OFFER = "sub string, t long, seq long, frame string, takes long"


def test_a_slow_reader_gets_the_newest_and_is_told_what_was_dropped(spark):
    path, out, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    offers = [[("a", i, i, f"f{i}", None) for i in range(1500)], [("a", i, i, f"f{i}", None) for i in range(1500, 3000)] + [("b", 5, 1, "g", None)],
              [("a", 9000, 0, None, 2), ("b", 9000, 0, None, 10)], [("a", 9001, 0, None, 5000), ("c", 9001, 0, None, 4)]]
    for some in offers:
        spark.createDataFrame(some, OFFER).write.mode("append").parquet(path)
        got = stateful.appended(stateful.buffer_stream(spark.readStream.schema(OFFER).parquet(path)), out, state)
    a = got.where("sub = 'a'").toPandas()
    assert a.loc[a["kind"] == "dropped", "n"].tolist() == [3000 - 2048]
    assert sorted(a.loc[a["kind"] == "frame", "seq"]) == list(range(3000 - 2048, 3000))
    assert [(r["seq"], r["frame"]) for r in got.where("sub = 'b'").collect()] == [(1, "g")] and got.where("sub = 'c'").count() == 0


FRAME = "sub string, seq long, t long, job long, stage string, status string"


def frames(spark, seqs):
    return spark.createDataFrame([(f"p{s % 2}", s, s * 10, s % 3, f"st{s % 4}", "running") for s in seqs], FRAME)


def test_replay_hands_over_without_loss_or_repeat(spark):
    path, out, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    frames(spark, range(40)).write.parquet(path)
    start = stateful.snapshot(spark.read.schema(FRAME).parquet(path))
    start.write.parquet(kept := shared_dir(spark))
    start = spark.read.parquet(kept)
    # Frames that come between the snapshot and the stream's first batch.
    frames(spark, range(40, 50)).write.mode("append").parquet(path)
    run = lambda: stateful.caught_up(stateful.live_stream(spark.readStream.schema(FRAME).parquet(path), start), out, state)
    run()
    frames(spark, range(50, 60)).write.mode("append").parquet(path)
    got = run().where("kind <> 'heartbeat'").toPandas()
    assert sorted(got.loc[got["kind"] == "frame", "seq"]) == list(range(40, 60))
    prelude = got[got["kind"] == "prelude"]
    assert sorted(prelude["seq"]) == list(range(34, 40))


def test_an_idle_subscriber_gets_heartbeats(spark):
    path, out, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    frames(spark, range(4)).write.parquet(path)
    start = stateful.snapshot(spark.read.schema(FRAME).parquet(path))
    with stateful.rocksdb(spark):
        live = stateful.live_stream(spark.readStream.schema(FRAME).parquet(path), start, heartbeat_ms=500)
        query = live.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        beats = 0
        while beats < 4 and time.time() < until:
            time.sleep(1)
            if query.recentProgress and query.lastProgress["batchId"] > 0:
                beats = spark.read.schema(stateful.LIVE).parquet(out).where("kind = 'heartbeat'").count()
    finally:
        query.stop()
    assert beats >= 4


def test_segment_stream_keeps_no_words_it_has_read(spark, sf):
    from pathlib import Path

    import __spark_entry__ as entry

    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    root.mkdir(exist_ok=True)
    before = set(root.iterdir())
    found = entry.queries()["st8_segment_stream"](spark, sf)
    assert len(set(root.iterdir()) - before) == 2 and found.count() > 0  # what it gave out, and its state
