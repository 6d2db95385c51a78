"""Edit, then only what follows."""

import os

import pytest
from pyspark.sql import functions as F

from cadenza.operators import rederive as R
from cadenza.plans.rederive import CHAIN
from cadenza.sources import captions as C
from cadenza.sources.shared import shared_dir

FIELDS = "vid long, seq long, speaker string, text string, start_ms long"


def segments(spark, videos=20, n=4):
    rows = [(v, s, "ab"[s % 2], f" line {v} {s}", 1000 * s) for v in range(videos) for s in range(n)]
    return spark.createDataFrame(rows, FIELDS)


def files(root):
    local = root.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(local) for f in names if "/data/" in d + "/"}


def fresh(spark, table):
    """The chain run from scratch."""
    root = shared_dir(spark)
    R.rederive(root, table, CHAIN)
    return rows(R.current(spark, root))


def rows(df):
    return sorted(df.drop("from_stage", "version").select(sorted(set(df.columns) - {"from_stage", "version"})).collect())


def edited(table, vid, seq, **values):
    here = (F.col("vid") == vid) & (F.col("seq") == seq)
    return table.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in values.items()})


def test_one_edit_rewrites_one_part(spark):
    root, table = shared_dir(spark), segments(spark)
    first = R.rederive(root, table, CHAIN, parts=8)
    assert first["version"] == 1 and first["videos"] == {"translate": 20}
    before = files(root)
    changed = edited(table, 7, 2, speaker="zed")
    report = R.rederive(root, changed, CHAIN, parts=8)
    assert report["videos"] == {"tts": 1} and len(report["parts"]) == 1
    after = files(root)
    assert {f: t for f, t in after.items() if f in before} == before
    assert {f.split("part=")[1].split("/")[0] for f in set(after) - set(before) if "part=" in f} == {str(report["parts"][0])}
    now = R.current(spark, root)
    assert rows(now) == fresh(spark, changed)
    assert {r.vid for r in now.where("version = 2").collect()} == {7}
    assert rows(R.current(spark, root, 1)) == fresh(spark, table)


def test_stages_before_the_edit_do_not_run(spark):
    """A stage that would fail is not asked where the edit comes after it."""
    root, table = shared_dir(spark), segments(spark, 3)
    R.rederive(root, table, CHAIN)

    def never(rows):
        return rows.withColumn("text_en", F.raise_error(F.lit("ran")).cast("string"))

    chain = [CHAIN[0]._replace(derive=never), *CHAIN[1:]]
    assert R.rederive(root, edited(table, 1, 1, start_ms=9000), chain)["videos"] == {"timeline": 1}
    with pytest.raises(Exception, match="ran"):
        R.rederive(root, edited(table, 1, 1, text="new"), chain)
    assert rows(R.current(spark, root)) == fresh(spark, edited(table, 1, 1, start_ms=9000))


def test_crash_before_the_version_shows_the_one_before(spark, monkeypatch):
    root, table = shared_dir(spark), segments(spark)
    R.rederive(root, table, CHAIN, parts=4)
    changed = edited(table, 3, 0, text="other")
    with monkeypatch.context() as m:
        m.setattr(R, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            R.rederive(root, changed, CHAIN, parts=4)
    assert rows(R.current(spark, root)) == fresh(spark, table)
    assert R.rederive(root, changed, CHAIN, parts=4)["version"] == 2
    assert rows(R.current(spark, root)) == fresh(spark, changed)


def test_two_runs_of_one_version(spark):
    root, table = shared_dir(spark), segments(spark, 2)
    R.rederive(root, table, CHAIN)
    with pytest.raises(Exception, match="(?i)exists"):
        R.commit(spark, root, 1, {})


def test_rows_and_videos_come_and_go(spark):
    root, table = shared_dir(spark), segments(spark, 6)
    R.rederive(root, table, CHAIN, parts=4)
    assert R.rederive(root, table, CHAIN, parts=4) == {"version": 1, "parts": [], "videos": {}}
    less = table.where("vid <> 2 and not (vid = 3 and seq = 0)").unionByName(segments(spark, 8).where("vid = 7"))
    assert R.rederive(root, less, CHAIN, parts=4)["videos"] == {"translate": 3}
    assert rows(R.current(spark, root)) == fresh(spark, less)
    assert R.rederive(root, table.where("false"), CHAIN, parts=4)["version"] == 3
    assert R.current(spark, root) is None
    assert R.rederive(root, table, CHAIN, parts=4)["version"] == 4


def test_saved_folders(spark):
    path = shared_dir(spark)
    rows_ = segments(spark, 10).selectExpr("vid", "seq AS id", "'u' AS uid", "start_ms", "start_ms + 10 AS end_ms", "text", "false AS keep")
    part = F.pmod("vid", F.lit(5))
    C.write_manifests(rows_, path, part)
    local = path.removeprefix("file://")
    def seen():
        return {d: sorted(os.listdir(os.path.join(local, d))) for d in os.listdir(local) if d.startswith("part=")}
    before = seen()
    C.write_manifests(rows_.where(part == 2).withColumn("text", F.lit("again")), path, part)
    after = seen()
    assert [d for d in after if after[d] != before[d]] == ["part=2"]
    assert spark.read.json(path).where("text = 'again'").count() == 8
