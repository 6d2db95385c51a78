"""How much work the word operators plan: no table read twice, no order made twice."""

import random
import re
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cadenza.operators import folds as K
from cadenza.operators import timeline as L
from cadenza.operators import words as W
from cadenza.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_words(spark, folder):
    rows = spark.range(400).selectExpr(
        "id % 4 AS vid", "id AS seq", "id * 300 AS t_ms", "id * 300 + 200 AS end_ms", "if(id % 9 = 0, 'yes.', 'שלום') AS text", "concat('S', id div 30 % 2) AS spk", "false AS brk"
    )
    rows.write.parquet(f"{folder}/words")
    return spark.read.parquet(f"{folder}/words")


def test_segments_read_their_words_once(spark, tmp_path):
    whole = W.segments_of(W.sessions(stored_words(spark, tmp_path)))
    assert plan(whole).count("FileScan parquet") == 1
    assert whole.count() > 4


def test_embedded_words_are_ordered_once(spark, tmp_path):
    assert plan(W.embedded_target(stored_words(spark, tmp_path), "he", "en")).count("Sort [") == 1


def test_loops_look_ahead_once(spark, tmp_path):
    text = plan(K.loops_collapsed(stored_words(spark, tmp_path)))
    assert len(set(re.findall(r"RowFrame, currentrow\$\(\), \d+", text))) == 1


def test_embedded_runs_of_all_lengths(spark):
    rng = random.Random(4)
    rows = [(vid, seq, rng.choice(["yes", "yes", "שלום", "12"])) for vid in range(20) for seq in range(vid * 3)]
    want = {}
    for vid in range(20):
        flags = [t == "yes" for v, _, t in rows if v == vid]
        for i, flag in enumerate(flags):
            a, b = i, i
            while a > 0 and flags[a - 1]:
                a -= 1
            while b + 1 < len(flags) and flags[b + 1]:
                b += 1
            want[vid, i] = flag and b - a + 1 < W.SEG.foreign_min_words
    got = W.embedded_target(spark.createDataFrame(rows, "vid long, seq long, text string"), "he", "en").select("vid", "seq", F.col("embedded").alias("e"))
    assert {(r.vid, r.seq): r.e for r in got.collect()} == want


def test_scans_leave_one_copy_of_the_words(spark, tmp_path):
    from cadenza.operators import segmented as G

    words = stored_words(spark, tmp_path)
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    turns = words.selectExpr("vid", "seq", "spk AS speaker", "t_ms AS start_ms", "end_ms")
    for make, copies in [
        (lambda: G.sessions(words, size=7), 1), (lambda: G.without_echoes(words.drop("brk", "spk"), 7), 1), (lambda: G.word_speakers(words, turns, 7), 2)
    ]:
        root.mkdir(exist_ok=True)
        before = set(root.iterdir())
        assert make().count() and len(set(root.iterdir()) - before) == copies


def documents(folder, texts):
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), f"{folder}/documents.parquet")
    return str(folder)


def test_documents_are_dealt_out_before_their_words_are_made(spark, tmp_path):
    """A shuffle takes whole texts; turns are sums of their words, with no window and no order of their own but the words'."""
    folder = documents(tmp_path, ["one two three. four"] * 20)
    for made in (T.words(spark, folder), T.turns(spark, folder)):
        text = plan(made)
        assert text.count("Exchange ") == 1 and text.count("Window [") == 1
        assert text.index("Generate") < text.index("Exchange ")  # plans are printed from the top


def test_turns_are_the_runs_of_one_speaker(spark, tmp_path):
    """Of texts of all lengths about the places where speakers change, with blanks at both ends and without words."""
    folder = documents(tmp_path, [" \n" * (n % 3) + "\n".join(["a."] * n) + " \n" * (n % 2) for n in range(100)] + [None, "", "\n\n"])
    by = W.in_order()
    heard = T.words(spark, folder).withColumn("speaker", F.expr("if(seq % 46 = 11, 'S9', spk)"))
    changed = heard.withColumn("b", (~F.lag("speaker").over(by).eqNullSafe(F.col("speaker"))).cast("int"))
    runs = changed.withColumn("k", F.sum("b").over(by)).groupBy("vid", "k").agg(F.min("speaker").alias("speaker"), F.min("t_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    told = runs.select("vid", (F.col("k") - 1).alias("seq"), "speaker", "start_ms", "end_ms")
    assert sorted(T.turns(spark, folder).collect()) == sorted(told.collect()) != []


def test_words_are_not_moved_to_find_their_speakers(spark, tmp_path):
    folder = documents(tmp_path, ["one two three. four"] * 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(W.word_speakers(T.words(spark, folder), T.turns(spark, folder)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert moved
    assert not any("seq" in m or "__b" in m for m in moved)


def test_speakers_by_all_turns_that_overlap(spark):
    """Turns that overlap, lie far apart, are long, backward or without a name, against all pairs."""
    draw = random.Random(3)
    words, turns = [], []
    for vid in range(12):
        t = draw.choice([0, 5_000_000, -40_000])
        for seq in range(60):
            t += draw.choice([20, 300, 1200, 9000, 90_000 if vid % 3 else 50])
            words.append((vid, seq, "x", t, draw.choice([None, t + 100, t + 30_000])))
            if vid and draw.random() < 0.3:
                start = t + draw.randint(-1500, 1500)
                turns.append((vid, seq, draw.choice(["A", "B", "C", None]), start, start + draw.choice([-50, 300, 450, 2000, 400_000])))
    w = spark.createDataFrame(words, "vid long, seq long, text string, t_ms long, end_ms long").withColumn("spk", F.lit("?"))
    t = spark.createDataFrame(turns, "vid long, seq long, speaker string, start_ms long, end_ms long")
    timed = {(r["vid"], r["seq"]): r["end_ms"] for r in W.word_ends(w).collect()}
    want, last = {}, {}
    for vid, seq, _, a, _ in words:
        b = timed[vid, seq]
        mine = [x for x in turns if x[0] == vid]
        real = [x for x in mine if x[4] - x[3] >= 400] or mine
        over = [(min(b, x[4]) - max(a, x[3]), -x[3], x[2] or "") for x in real if min(b, x[4]) > max(a, x[3])]
        edges = [(abs(2 * e - a - b), 2 * e > a + b, x[3], x[2]) for x in real if x[2] for e in x[3:5] if abs(2 * e - a - b) <= 1000]
        known = (max(over)[2] if over else "") or (min(edges)[3] if edges else "") or last.get(vid)
        last[vid] = known
        first = min(real, key=lambda x: (x[3], x[1]))[2] if real else None
        want[vid, seq] = known or first or "SPEAKER_00"
    assert {(r["vid"], r["seq"]): r["spk"] for r in W.word_speakers(w, t).collect()} == want


def stored_turns(spark, folder):
    turns = spark.range(40).selectExpr("id % 4 AS vid", "id AS seq", "concat('S', id div 4 % 3) AS speaker", "id * 3000 AS start_ms", "id * 3000 + 2500 AS end_ms")
    turns.write.parquet(f"{folder}/turns")
    return spark.read.parquet(f"{folder}/turns")


def test_segmentation_reads_words_and_turns_once_and_stores_neither(spark, tmp_path):
    whole = K.segmentation(stored_words(spark, tmp_path), stored_turns(spark, tmp_path))
    text = plan(whole)
    assert text.count("FileScan parquet") == 2 and "cadenza-" not in text
    assert whole.count() > 4


def test_islands_are_folded_without_making_their_words_twice(spark, tmp_path):
    words = stored_words(spark, tmp_path)
    for folded in (K.stretched_dropped(words), K.loops_collapsed(words)):
        assert plan(folded).count("FileScan parquet") == 1


def test_long_segments_are_cut_where_they_lie(spark, tmp_path):
    text = plan(K.long_split(stored_words(spark, tmp_path).withColumn("segment", F.lit(0))))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning") == 1


def test_boundaries_come_from_one_look_at_the_turns(spark, tmp_path):
    turns = stored_turns(spark, tmp_path)
    assert plan(W.turn_boundaries(turns)).count("FileScan parquet") == 1
    assert plan(W.filed_turns(turns)).count("FileScan parquet") == 1


def test_parts_of_the_bed_grow_with_its_frames(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_FRAMES", 2000, raising=False)
    places = spark.createDataFrame([(v, v * 1000, 120_000, False) for v in range(40)], "vid long, start_ms long, end_ms long, keep boolean")
    bed = L.envelope(places, places.selectExpr("vid", "end_ms AS total_ms"))
    assert bed.rdd.getNumPartitions() >= 40 * 24_000 // 2000


def test_captions_are_compressed_and_dealt_out_whole(spark, sf):
    from cadenza.plans.captions import s1

    read = s1(spark, sf)
    assert all(f.endswith(".gz") for f in read.inputFiles())
    text = plan(read)
    assert text.count("Exchange hashpartitioning") == 1 and text.count("REPARTITION_BY_NUM") == 1


def test_cuts_at_turns_are_not_made_again_by_a_filter(spark, tmp_path):
    words = stored_words(spark, tmp_path).withColumn("segment", F.expr("seq div 20"))
    text = plan(W.split_at_turns(words, stored_turns(spark, tmp_path)))
    assert not re.search(r"Filter .*transform\(", text)


def test_parts_of_documents_are_no_fewer_than_a_shuffle_s_and_grow_with_the_files(spark, tmp_path):
    """So a join by the key moves no words, and a task's share stays small: Spark puts a part's columns at half a megabyte."""
    folder = documents(tmp_path, ["".join(random.Random(n).choices("abcdefgh ", k=20_000)) for n in range(600)])
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        few = T.words(spark, folder).rdd.getNumPartitions()
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        many = T.whole_rows(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert few >= 29 and many >= Path(f"{folder}/documents.parquet").stat().st_size // 600_000
