"""Word operators over chunks: equal to the ones over whole videos, wherever the cuts fall."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import segmented as G
from cadenza.operators import words as W

SCHEMA = "vid long, seq long, t_ms long, end_ms long, text string, spk string, brk boolean"
TOKENS = ["yes", "Yes", "no.", "שלום", "עולם", "--", "", "go!", "ok"]


def stream(seed: int, videos: int = 6, n: int = 60):
    """Words with holes in seq, unknown ends and speakers, marks in every second video, many repeats."""
    rng, rows = random.Random(seed), []
    for vid in [None, *range(videos)]:
        t = 0
        for seq in range(n):
            t += rng.choice([0, 40, 120, 300, 900])
            if rng.random() < 0.8:
                end = t + rng.choice([10, 200, 900]) if rng.random() < 0.7 else None
                rows.append((vid, seq, t, end, rng.choice(TOKENS), rng.choice(["a", "b", None]), rng.random() < 0.03 if (vid or 0) % 2 else None))
    return rows


def same(left, right, columns):
    def rows(df):
        return sorted(map(str, df.select(*columns).collect()))
    assert rows(left) == rows(right)


@pytest.mark.parametrize("size", [1, 7])
def test_chunks_equal_whole_videos(spark, size):
    words = spark.createDataFrame(stream(size), SCHEMA).where("vid is not null")
    same(G.word_ends(words, size), W.word_ends(words), words.columns)
    same(G.speech_gaps(words, size), W.speech_gaps(words), [*words.columns, "gap_ms"])
    same(G.sessions(words, size=size), W.sessions(words), [*words.columns, "bucket", "embedded", "gap_ms", "segment"])
    ended = W.word_ends(words)
    same(G.without_echoes(ended, size), W.without_echoes(ended), words.columns)


@pytest.mark.parametrize("size", [5])
def test_speakers_equal_whole_videos(spark, size):
    words = spark.createDataFrame(stream(11), SCHEMA).where("vid is not null")
    rng, turns = random.Random(3), []
    for vid in range(5):
        t = 0
        for seq in range(12):
            t += rng.choice([0, 700, 3000])
            turns.append((vid, seq, rng.choice("xyz"), t, t + rng.choice([100, 450, 1500])))
            t = turns[-1][4] + 1
    table = spark.createDataFrame(turns, "vid long, seq long, speaker string, start_ms long, end_ms long")
    same(G.word_speakers(words, table, size), W.word_speakers(words, table), ["vid", "seq", "t_ms", "end_ms", "spk"])


def test_one_long_video_is_many_tasks(spark):
    """No partition of the pass in chunks holds more than chunks dealt to it; all rows equal the whole window."""
    n, size = 60_000, 2_000
    words = spark.range(n).select(
        F.lit(1).cast("long").alias("vid"), F.col("id").alias("seq"), (F.col("id") * 90 + F.col("id") % 7 * 10).alias("t_ms"),
        F.when(F.col("id") % 3 != 0, F.col("id") * 90 + 60).alias("end_ms"), F.concat(F.lit("w"), (F.col("id") % 5).cast("string")).alias("text"),
        F.concat(F.lit("S"), F.expr("id div 40 % 3").cast("string")).alias("spk"), F.lit(False).alias("brk"),
    )
    cut = G.sessions(words, size=size)
    whole = W.sessions(words)
    assert cut.select("seq", "segment").exceptAll(whole.select("seq", "segment")).isEmpty()
    assert cut.count() == n


def test_empty(spark):
    words = spark.createDataFrame([], SCHEMA)
    assert G.sessions(words).isEmpty() and G.without_echoes(words).isEmpty() and G.word_ends(words).isEmpty()


def plain_envelope(places, total_ms, hz=200):
    ms = 1000 // hz
    n = total_ms // ms + 2
    raw = [1.0] * n
    for start, end, keep in places:
        i0, i1 = max(0, start // ms), min(n, (end if keep else end + 400) // ms)
        low, attack, release = (0.0, 8, 12) if keep else (0.86, 16, 36)
        a_end = min(i1, i0 + attack)
        r_start = max(a_end, i1 - release)
        for f in range(i0, i1):
            if f < a_end:
                x = 1 + (low - 1) * (f - i0) / max(1, a_end - i0 - 1)
            else:
                x = low if f < r_start else low + (1 - low) * (f - r_start) / max(1, i1 - r_start - 1)
            raw[f] = min(raw[f], x)
    return [sum(raw[max(0, f - 6):f + 6]) / 12 for f in range(n)]


@pytest.mark.parametrize("tile", [1, 7, 64, 2000])
def test_envelope_by_tiles(spark, tile):
    from cadenza.operators import timeline as L

    rng = random.Random(tile)
    told = {v: [(s, s + rng.choice([0, 20, 300, 2500]), rng.random() < 0.5) for s in [rng.randrange(-100, 4000) for _ in range(v)]] for v in range(5)}
    rows = [(v, *p) for v, ps in told.items() for p in ps]
    places = spark.createDataFrame(rows, "vid long, start_ms long, end_ms long, keep boolean")
    totals = spark.createDataFrame([(v, 3000 + v) for v in told], "vid long, total_ms long")
    df = L.envelope(places, totals, tile=tile)
    got = {(r.vid, r.frame): r.level for r in df.collect()}
    want = {(v, f): x for v, ps in told.items() for f, x in enumerate(plain_envelope(ps, 3000 + v))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_envelope_moves_no_frames(spark):
    from cadenza.operators import timeline as L

    places = spark.range(100).selectExpr("id % 3 AS vid", "id * 1000 AS start_ms", "id * 1000 + 700 AS end_ms", "id % 2 = 0 AS keep")
    totals = places.groupBy("vid").agg(F.max("end_ms").alias("total_ms"))
    plan = L.envelope(places, totals)._jdf.queryExecution().executedPlan().toString()
    first_frame = plan.rindex("Generate explode(sequence(greatest(")
    assert "Exchange" not in plan[:first_frame].replace("AdaptiveSparkPlan", "")


def cut_documents(spark, folder, make):
    """The plan of a cut operator over the words of documents, and the rows and columns of what it stores."""
    from pathlib import Path

    from cadenza.sources import tables as T

    spark.createDataFrame([(i, "one two three. four " * 30) for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    root.mkdir(exist_ok=True)
    before = set(root.iterdir())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = make(T.words(spark, str(folder)), T.turns(spark, str(folder)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = {p.parent for d in set(root.iterdir()) - before for p in d.rglob("*.parquet")}
    return plan, [spark.read.parquet(str(p)) for p in kept]


def test_sessions_of_documents_move_and_store_no_words(spark, tmp_path):
    plan, kept = cut_documents(spark, tmp_path, lambda words, turns: G.sessions(words.withColumn("brk", F.lit(False)), size=40))
    assert "hashpartitioning(vid" in plan and not any("__c" in line for line in plan.split("\n") if "Exchange" in line)
    assert kept and all(df.count() == 120 and "text" not in df.columns for df in kept)  # forty texts of three chunks


def test_echoes_of_documents_move_and_store_no_words(spark, tmp_path):
    plan, kept = cut_documents(spark, tmp_path, lambda words, turns: G.without_echoes(words.drop("spk"), 40))
    assert "hashpartitioning(vid" in plan and not any("__c" in line or "__kept" in line for line in plan.split("\n") if "Exchange" in line)
    assert kept and all(df.count() == 120 and "text" not in df.columns for df in kept)


def test_speakers_of_documents_move_and_store_no_words(spark, tmp_path):
    plan, kept = cut_documents(spark, tmp_path, lambda words, turns: G.word_speakers(words, turns, 40))
    assert "hashpartitioning(vid" in plan and not any("__c" in line or "seq" in line for line in plan.split("\n") if "Exchange" in line)
    assert kept and all(df.count() <= 120 and "text" not in df.columns for df in kept)
