"""Progress frames as streams: reading, folding into job state, and sessions of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One schema for all kinds of frames; a kind leaves the other kinds' fields null.
FRAME = T.StructType(
    [
        T.StructField("t", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("project", T.LongType()),
        T.StructField("job", T.LongType()), T.StructField("type", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("progress", T.DoubleType()), T.StructField("stage", T.StringType()),
    ]
)
KINDS = ("stage", "segment", "job", "log", "heartbeat")


def decoded(lines: DataFrame) -> DataFrame:
    """S13, S14, ST1: frames of NDJSON lines (column value); lines that are no frame are skipped."""
    return lines.select(F.from_json("value", FRAME).alias("f")).where(F.col("f.type").isin(*KINDS)).select("f.*")


def counted(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """``decoded`` frames, and how many lines there were and how many of them were no frame, once it has run."""
    seen = Observation("lines")
    frame = F.from_json("value", FRAME)
    known = F.coalesce(frame["type"].isin(*KINDS), F.lit(False))
    told = lines.select("value", known.alias("known")).observe(seen, F.count("*").alias("lines"), F.count_if(~F.col("known")).alias("skipped"))
    return decoded(told.where("known")), seen


def with_progress(frames: DataFrame, path: str, state: str, done: Callable[[dict], None]) -> None:
    """UF3: saves a stream of frames batch by batch and calls ``done`` with each batch's number, rows and failures.

    The counts are taken while the batch is written; only they reach the caller. A batch that is run again
    takes the place of its first run.
    """
    def save(batch: DataFrame, number: int) -> None:
        seen = Observation("batch")
        batch.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("status") == "failed").alias("failed")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        done({"batch": number} | seen.get)

    frames.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def encoded(frames: DataFrame) -> DataFrame:
    """Frames as NDJSON lines."""
    return frames.select(F.to_json(F.struct(*FRAME.names)).alias("value"))


def fan_out(frames: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """ST2: a row for each frame and subscriber (sub, wants); null projects go to all, '*' gets everything.

    Subscribers are keyed by what they want, so the join is on a key and not on all pairs.
    """
    keys = F.when(F.col("project").isNull(), F.array(F.lit("?"))).otherwise(F.array(F.col("project").cast("string"), F.lit("*")))
    wanted = subscriptions.select("sub", F.explode(F.array("wants", F.lit("?"))).alias("key")).distinct()
    return frames.withColumn("key", F.explode(keys)).join(wanted, "key").drop("key")


def job_state(frames: DataFrame) -> DataFrame:
    """ST5: the last stage and the last progress that is not null of each job's stage frames."""
    order = F.struct("t", "seq")
    return frames.where("type = 'stage'").groupBy("job").agg(
        F.max_by("stage", order).alias("stage"), F.max_by("progress", F.when(F.col("progress").isNotNull(), order)).alias("progress"), F.count("*").alias("frames")
    )


def parsed_line(line: Column, stages: list[str]) -> Column:
    """ST6: a log line as (kind, stage, status, progress): '[stage]', '[stage] done in …', '[stage] n/N', or a log."""
    name = "|".join(stages)
    done = line.rlike(rf"^\[({name})\] (done in |up to date)")
    count = line.rlike(rf"^\[({name})\] \d+/\d+")
    n, total = F.regexp_extract(line, r"(\d+)/(\d+)", 1).cast("double"), F.regexp_extract(line, r"(\d+)/(\d+)", 2).cast("double")
    stage = F.regexp_extract(line, rf"^\[({name})\]", 1)
    progress = F.when(done, 1.0).when(count & (total > 0), F.least(F.lit(1.0), F.try_divide(n, total))).when(stage != "", 0.0)
    return F.struct(
        F.when(stage != "", "stage").otherwise("log").alias("kind"), F.nullif(stage, F.lit("")).alias("stage"),
        F.when(done, "done").when(stage != "", "running").alias("status"), progress.alias("progress"),
    )


def event_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """ST8: sessions of (key, ts): an event joins one if less than ``gap`` has passed; works on streams too."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(
        "key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is and returns its last output, written to ``path``."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    spark = result.sparkSession
    query = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def replay(frames: DataFrame, since: Column) -> DataFrame:
    """ST4: what a subscriber who comes at ``since`` is sent: one frame with each job's last state, then all later ones."""
    before = frames.where(F.col("t") <= since)
    last = before.groupBy("job").agg(F.max_by(F.struct("t", "seq", "stage", "status"), F.struct("t", "seq")).alias("f"))
    prelude = last.select(F.lit(True).alias("prelude"), "job", "f.t", "f.seq", "f.stage", "f.status")
    return prelude.unionByName(frames.where(F.col("t") > since).select(F.lit(False).alias("prelude"), "job", "t", "seq", "stage", "status"))
