"""Captions as a data source: reading by kind, refusals, and writing all files or none."""

import os

import pytest
from pyspark.sql import functions as F

from cadenza.sources import captions as C
from cadenza.sources import files as S


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def cues(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, seq long, start_ms long, end_ms long, text string")


def test_refusals_have_reasons(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi there\n", encoding="utf-8-sig")
    (tmp_path / "sub/b.VTT").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "plain").write_text("x")
    (tmp_path / "e.srt").write_text("")
    (tmp_path / "_hidden.srt").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.reason) for r in S.read_captions(spark, f"file://{tmp_path}").collect()}
    assert got == {
        "a.srt": ("srt", None), "b.VTT": ("vtt", "not UTF-8 at byte 0"), "c.txt": ("txt", "unknown kind of file"), "plain": ("", "unknown kind of file"), "e.srt": ("srt", None),
    }
    words, rejects = C.read_words(spark, f"file://{tmp_path}")
    assert [r.text for r in words.orderBy("seq").collect()] == ["hi", "there"]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}["e.srt"] == "no words"


def test_partitions_are_bounded_by_size(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.srt").write_text("x" * 100)
    (tmp_path / "big.srt").write_text("x" * 1000)
    parts = S.CaptionReader(str(tmp_path), 250).partitions()
    assert sorted(len(p.files) for p in parts) == [1, 2, 2, 2, 2, 2]
    spark.dataSource.register(S.Captions)
    assert spark.read.format("captions").option("partitionBytes", 250).load(str(tmp_path)).rdd.getNumPartitions() == 6


def test_empty_folder(spark, tmp_path):
    assert S.read_captions(spark, str(tmp_path)).count() == 0


def test_round_trip(spark, tmp_path):
    folder = tmp_path / "out"
    rows = [("x", 1, 1000, 2000, "b\n\nc"), ("x", 0, 0, 900, "a"), ("y", 0, 3_600_000, 3_600_500, "é"), ("y", 1, 3_600_600, 3_600_700, None)]
    S.write_srt(cues(spark, *rows), f"file://{folder}")
    assert listed(folder) == ["x.srt", "y.srt"]
    assert (folder / "x.srt").read_text() == "1\n00:00:00,000 --> 00:00:00,900\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb\nc\n\n"
    read = S.read_captions(spark, f"file://{folder}").select(F.col("path").alias("vid"), "text")
    got = sorted((r.vid[-5:], r.seq, r.start_ms, r.end_ms, r.text) for r in C.cues(read).collect())
    assert got == [("x.srt", 0, 0, 900, "a"), ("x.srt", 1, 1000, 2000, "b c"), ("y.srt", 0, 3_600_000, 3_600_500, "é")]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    rows = cues(spark, *[(f"n{i}", 0, 0, 10, "t") for i in range(20)])
    broken = rows.withColumn("text", F.when(F.col("name") == "n7", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        S.write_srt(broken, str(folder))
    assert listed(folder) == []
    S.write_srt(rows, str(folder))
    assert len(listed(folder)) == 20


def test_existing_names(spark, tmp_path):
    folder = str(tmp_path / "out")
    S.write_srt(cues(spark, ("a", 0, 0, 10, "old"), ("b", 0, 0, 10, "old")), folder)
    with pytest.raises(Exception, match="exists"):
        S.write_srt(cues(spark, ("a", 0, 0, 10, "new"), ("c", 0, 0, 10, "new")), folder)
    assert listed(folder) == ["a.srt", "b.srt"] and "old" in open(f"{folder}/a.srt").read()
    S.write_srt(cues(spark, ("a", 0, 0, 10, "new")), folder, "overwrite")
    assert listed(folder) == ["a.srt"] and "new" in open(f"{folder}/a.srt").read()


@pytest.mark.parametrize("name", ["../up", "", None, ".hidden"])
def test_names_stay_in_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name of a file"):
        S.write_srt(cues(spark, (name, 0, 0, 10, "t")), str(tmp_path / "out"))
    assert listed(tmp_path) == []


def test_cues_of_a_name_lie_together(spark, tmp_path):
    spark.dataSource.register(S.Captions)
    apart = cues(spark, ("a", 0, 0, 10, "t"), ("b", 0, 0, 10, "t"), ("a", 1, 20, 30, "t")).coalesce(1)
    with pytest.raises(Exception, match="not together"):
        apart.write.format("captions").mode("append").save(str(tmp_path / "out"))
    assert listed(tmp_path) == []
