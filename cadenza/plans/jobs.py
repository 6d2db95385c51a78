"""Queries of progress frames, job states and streams, over events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.edits import STAGES
from ..sources import tables as T
from ..sources.shared import forget, shared_dir, stored
from ..sources.tables import cte
from ..streaming import frames as S
from ..streaming import stateful
from .registry import query
from .words import BUCKETS, MIXED, mixed, session_sql

FRAMES = cte("frames")
LIST = "['" + "', '".join(STAGES) + "']"


@query("s13_ndjson_round_trip", f"{FRAMES} SELECT t, seq, project, job, type, status, progress, stage FROM frames")
def s13(spark, sf_dir):
    """Frames written as NDJSON, a broken line among them, and read back as a stream."""
    path, out = shared_dir(spark), shared_dir(spark)
    lines = S.encoded(T.frames(spark, sf_dir))
    broken = spark.range(1).select(F.lit('{"type": "stage", ').alias("value"))
    lines.unionByName(broken).write.text(path)
    stream = S.decoded(spark.readStream.schema("value string").text(path))
    query_ = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(S.FRAME).parquet(f"{out}/data")


@query("s14_tolerant_reader", f"{FRAMES} SELECT seq, type FROM frames WHERE seq % 7 NOT IN (2, 4, 6)")
def s14(spark, sf_dir):
    """Frames of lines of which some are cut off, some are empty and some are of no known kind."""
    value = F.col("value")
    lines = T.frames(spark, sf_dir).select("seq", F.to_json(F.struct(*S.FRAME.names)).alias("value")).select(
        F.when(F.col("seq") % 7 == 2, F.substring(value, 1, 20)).when(F.col("seq") % 7 == 4, "").when(F.col("seq") % 7 == 6, '{"type": "noise", "seq": 1}').otherwise(value).alias("value")
    )
    return S.counted(lines)[0].select("seq", "type")


@query("uf3_progress", f"{FRAMES} SELECT project, count(*) AS frames, count(*) FILTER (status = 'failed') AS failed, true AS told FROM frames GROUP BY project")
def uf3(spark, sf_dir):
    """Frames saved from a stream whose progress was told batch by batch; told says whether it came to all rows."""
    path, out = shared_dir(spark), shared_dir(spark)
    S.encoded(T.frames(spark, sf_dir)).write.text(path)
    told: list[dict] = []
    S.with_progress(S.decoded(spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(path)), f"{out}/data", f"{out}/state", told.append)
    saved = spark.read.schema(S.FRAME).parquet(f"{out}/data")
    rows = sum(t["rows"] for t in told)
    whole = F.sum(F.count("*")).over(Window.partitionBy()) == rows
    return saved.groupBy("project").agg(F.count("*").alias("frames"), F.count_if(F.col("status") == "failed").alias("failed"), whole.alias("told"))


@query("st1_typed_frames", f"{FRAMES} SELECT seq, type, status, CASE WHEN type = 'stage' THEN stage END AS stage FROM frames")
def st1(spark, sf_dir):
    frames = S.decoded(S.encoded(T.frames(spark, sf_dir)))
    return frames.select("seq", "type", "status", F.when(F.col("type") == "stage", F.col("stage")).alias("stage"))


@query("st2_fan_out", f"{FRAMES}, p AS (SELECT seq, CASE WHEN seq % 10 <> 0 THEN project END AS project FROM frames), s AS (SELECT unnest([0, 1, 2]) AS sub, unnest(['3', '7', '*']) AS wants) SELECT seq, sub FROM p JOIN s ON project IS NULL OR wants = '*' OR wants = project::VARCHAR")
def st2(spark, sf_dir):
    frames = T.frames(spark, sf_dir).select("seq", F.when(F.col("seq") % 10 != 0, F.col("project")).alias("project"))
    subs = spark.range(3).select(F.col("id").cast("int").alias("sub"), F.get(F.array(F.lit("3"), F.lit("7"), F.lit("*")), F.col("id").cast("int")).alias("wants"))
    return S.fan_out(frames, subs).select("seq", "sub")


@query("st3_bounded_pending", f"{FRAMES}, r AS (SELECT project, seq, row_number() OVER (PARTITION BY project ORDER BY t DESC, seq DESC) AS k, count(*) OVER (PARTITION BY project) AS n FROM frames) SELECT project, seq, greatest(n - 8, 0) AS dropped FROM r WHERE k <= 8")
def st3(spark, sf_dir):
    """The newest 8 frames of each project, and how many older ones were dropped."""
    by = Window.partitionBy("project").orderBy(F.desc("t"), F.desc("seq"))
    counts = T.frames(spark, sf_dir).groupBy("project").agg(F.greatest(F.count("*") - 8, F.lit(0)).alias("dropped"))
    newest = T.frames(spark, sf_dir).withColumn("k", F.row_number().over(by)).where("k <= 8")
    return newest.join(counts, "project").select("project", "seq", "dropped")


STATE = "SELECT job, arg_max(stage, (t, seq)) AS stage, arg_max(progress, (t, seq)) FILTER (progress IS NOT NULL) AS progress, count(*) AS frames FROM frames WHERE type = 'stage' GROUP BY job"


@query("st5_job_state", f"{FRAMES} {STATE}")
def st5(spark, sf_dir):
    return S.job_state(T.frames(spark, sf_dir))


@query("st5_job_state_stream", f"{FRAMES} {STATE}")
def st5_stream(spark, sf_dir):
    """The same fold over a stream of the frames."""
    path, out = shared_dir(spark), shared_dir(spark)
    S.encoded(T.frames(spark, sf_dir)).write.text(path)
    frames = S.decoded(spark.readStream.schema("value string").text(path))
    return S.run_once(S.job_state(frames), f"{out}/data", f"{out}/state")


LOG = f"{FRAMES}, l AS (SELECT seq, CASE seq % 5 WHEN 0 THEN '[' || stage || ']' WHEN 1 THEN '[' || stage || '] done in ' || seq || 's' WHEN 2 THEN '[' || stage || '] ' || (seq % 7) || '/' || (seq % 11) WHEN 3 THEN '[' || stage || '] up to date' ELSE 'note ' || stage END AS line FROM frames)"


@query("st6_parsed_lines", LOG + """ SELECT seq, CASE WHEN s <> '' THEN 'stage' ELSE 'log' END AS kind, nullif(s, '') AS stage, CASE WHEN dn THEN 'done' WHEN s <> '' THEN 'running' END AS status,
  CASE WHEN dn THEN 1.0 WHEN total > 0 THEN least(1.0::DOUBLE, c / total) WHEN s <> '' THEN 0.0 END::DOUBLE AS progress FROM (SELECT *, regexp_extract(line, '^\\[([a-z]+)\\]', 1) AS s, regexp_matches(line, '^\\[[a-z]+\\] (done in |up to date)') AS dn,
  try_cast(regexp_extract(line, '(\\d+)/(\\d+)', 1) AS DOUBLE) AS c, try_cast(regexp_extract(line, '(\\d+)/(\\d+)', 2) AS DOUBLE) AS total FROM l)""")
def st6(spark, sf_dir):
    lines = T.frames(spark, sf_dir).selectExpr("seq", "CASE seq % 5 WHEN 0 THEN '[' || stage || ']' WHEN 1 THEN '[' || stage || '] done in ' || seq || 's' WHEN 2 THEN '[' || stage || '] ' || (seq % 7) || '/' || (seq % 11) WHEN 3 THEN '[' || stage || '] up to date' ELSE 'note ' || stage END AS line")
    return lines.select("seq", S.parsed_line(F.col("line"), STAGES).alias("p")).select("seq", "p.*")


@query("st7_illegal_transitions", f"{FRAMES}, p AS (SELECT job, seq, lag(status) OVER (PARTITION BY job ORDER BY t, seq) AS before, status FROM frames) SELECT job, seq, before, status FROM p WHERE before IS NOT NULL AND before || '>' || status NOT IN ('queued>running', 'queued>failed', 'running>done', 'running>failed', 'running>running')")
def st7(spark, sf_dir):
    """Changes of a job's status that no job may make."""
    allowed = ["queued>running", "queued>failed", "running>done", "running>failed", "running>running"]
    before = F.lag("status").over(Window.partitionBy("job").orderBy("t", "seq"))
    moves = T.frames(spark, sf_dir).select("job", "seq", before.alias("before"), "status").where("before is not null")
    return moves.where(~F.concat_ws(">", "before", "status").isin(*allowed))


@query("st8_session_stream", """WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events), g AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t) AS p FROM e), r AS (SELECT *, sum((p IS NULL OR t >= p + 14400000000)::INT) OVER (PARTITION BY key ORDER BY t) AS k FROM g)
  SELECT key, min(t) AS start_us, max(t) + 14400000000 AS end_us, count(*) AS n FROM r GROUP BY key, k""")
def st8(spark, sf_dir):
    """Sessions of each user's events with gaps below four hours, as a stream over the event files."""
    path, out = shared_dir(spark), shared_dir(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    sessions = S.event_sessions(spark.readStream.schema("key long, ts timestamp").parquet(path), "4 hours")
    found = S.run_once(sessions, f"{out}/data", f"{out}/state")
    return found.select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


JOBS = f"""{FRAMES}, j AS (SELECT project, seq, stage, status FROM frames WHERE type IN ('job', 'stage')), d AS (SELECT project, max(seq) AS ok FROM j WHERE status = 'done' GROUP BY project),
  f AS (SELECT j.project, arg_max(stage, seq) AS failed FROM j LEFT JOIN d USING (project) WHERE status = 'failed' AND seq > coalesce(ok, -1) GROUP BY j.project),
  run AS (SELECT DISTINCT project, stage FROM j WHERE status = 'running' AND seq % 7 = 0), p AS (SELECT DISTINCT project FROM j), st AS (SELECT unnest({LIST}) AS stage, unnest(range(0, 9)) AS k),
  s AS (SELECT p.project, st.stage, st.k, CASE WHEN run.stage IS NOT NULL THEN 'running' WHEN f.failed = st.stage THEN 'failed' WHEN st.k <= p.project % 10 THEN 'done' ELSE 'pending' END AS status
    FROM p CROSS JOIN st LEFT JOIN f ON f.project = p.project LEFT JOIN run ON run.project = p.project AND run.stage = st.stage)"""


def stage_status(spark, sf_dir):
    """Per project and stage: done from its marks, failed where the last failure since a success was, running first."""
    jobs = T.frames(spark, sf_dir).where("type in ('job', 'stage')").select("project", "seq", "stage", "status")
    done = jobs.where("status = 'done'").groupBy("project").agg(F.max("seq").alias("ok"))
    failed = jobs.where("status = 'failed'").join(done, "project", "left").where("seq > coalesce(ok, -1)").groupBy("project").agg(F.max_by("stage", "seq").alias("failed"))
    running = jobs.where("status = 'running' AND seq % 7 = 0").select("project", "stage", F.lit(True).alias("running")).distinct()
    every = jobs.select("project").distinct().select("project", F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("k", "stage"))
    status = (
        F.when(F.col("running").isNotNull(), "running").when(F.col("failed") == F.col("stage"), "failed").when(F.col("k") <= F.col("project") % 10, "done").otherwise("pending")
    )
    return every.join(failed, "project", "left").join(running, ["project", "stage"], "left").select("project", "stage", F.col("k").cast("long").alias("k"), status.alias("status"))


@query("a13_stage_status", f"{JOBS} SELECT * FROM s")
def a13(spark, sf_dir):
    return stage_status(spark, sf_dir)


@query("a14_stage_summary", f"""{JOBS}, q AS (SELECT project, count(*) FILTER (status = 'done') AS done, arg_min(stage, k) FILTER (status = 'failed') AS failed, arg_min(stage, k) FILTER (status = 'running') AS running FROM s GROUP BY project)
  SELECT project, done, failed, CASE WHEN failed IS NOT NULL THEN 'Failed at ' || failed WHEN done = 9 THEN 'Complete' WHEN running IS NOT NULL THEN 'Running ' || running WHEN done > 0 THEN 'Stopped after ' || done || ' of 9' ELSE 'Not started' END AS label,
  CASE WHEN failed IS NOT NULL THEN 'bad' WHEN done = 9 THEN 'good' WHEN done > 0 OR running IS NOT NULL THEN 'warn' ELSE 'neutral' END AS tone FROM q""")
def a14(spark, sf_dir):
    q = stage_status(spark, sf_dir).groupBy("project").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.min_by("stage", F.when(F.col("status") == "failed", F.col("k"))).alias("failed"), F.min_by("stage", F.when(F.col("status") == "running", F.col("k"))).alias("running")
    )
    bad, whole = F.col("failed").isNotNull(), F.col("done") == 9
    label = (
        F.when(bad, F.concat(F.lit("Failed at "), "failed")).when(whole, "Complete").when(F.col("running").isNotNull(), F.concat(F.lit("Running "), "running"))
        .when(F.col("done") > 0, F.concat(F.lit("Stopped after "), F.col("done").cast("string"), F.lit(" of 9"))).otherwise("Not started")
    )
    tone = F.when(bad, "bad").when(whole, "good").when((F.col("done") > 0) | F.col("running").isNotNull(), "warn").otherwise("neutral")
    return q.select("project", "done", "failed", label.alias("label"), tone.alias("tone"))


@query("o8_earliest_stage", f"{FRAMES} SELECT job, arg_min(stage, list_position({LIST}, stage)) AS stage FROM frames GROUP BY job")
def o8(spark, sf_dir):
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return T.frames(spark, sf_dir).groupBy("job").agg(F.min_by("stage", order).alias("stage"))


@query("s12_runs", "SELECT o_custkey AS run, max(o_orderdate)::VARCHAR AS changed, count(*) AS segments, row_number() OVER (ORDER BY max(o_orderdate) DESC, o_custkey) <= 50 AS listed FROM orders GROUP BY o_custkey")
def s12(spark, sf_dir):
    """Runs with a summary; the 50 changed last are listed."""
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("run")).agg(F.max("o_orderdate").alias("at"), F.count("*").alias("segments"))
    newest = runs.orderBy(F.desc("at"), "run").limit(50).select("run", F.lit(True).alias("listed"))
    return runs.join(newest, "run", "left").select("run", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("changed"), "segments", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("st4_replay", f"{FRAMES}, b AS (SELECT * FROM frames WHERE t <= 1705276800000000 QUALIFY row_number() OVER (PARTITION BY job ORDER BY t DESC, seq DESC) = 1) SELECT true AS prelude, job, t, seq, stage, status FROM b UNION ALL SELECT false, job, t, seq, stage, status FROM frames WHERE t > 1705276800000000")
def st4(spark, sf_dir):
    return S.replay(T.frames(spark, sf_dir), F.lit(1705276800000000))


@query("st3_buffer_stream", f"""{FRAMES}, r AS (SELECT project, seq, row_number() OVER (PARTITION BY project ORDER BY t DESC, seq DESC) AS k, count(*) OVER (PARTITION BY project) AS n FROM frames)
  SELECT project::VARCHAR AS sub, 'frame' AS kind, seq, 1 AS n FROM r WHERE k <= 32 UNION ALL SELECT DISTINCT project::VARCHAR, 'dropped', NULL, n - 32 FROM r WHERE n > 32""")
def st3_stream(spark, sf_dir):
    """What a reader of each project gets who takes all at the end, over a stream that stops in between."""
    path, out, state = (shared_dir(spark) for _ in range(3))
    frames = T.frames(spark, sf_dir).select(F.col("project").cast("string").alias("sub"), "t", "seq", F.to_json(F.struct("type", "stage")).alias("frame"), F.lit(None).cast("long").alias("takes"))
    cut = frames.agg(F.percentile_approx("t", 0.5)).first()[0]
    ends = frames.select("sub").distinct().select("sub", F.lit(1 << 60).alias("t"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("frame"), F.lit(1 << 30).cast("long").alias("takes"))
    for part in (frames.where(F.col("t") <= cut), frames.where(F.col("t") > cut).unionByName(ends)):
        part.write.mode("append").parquet(path)
        sent = stateful.appended(stateful.buffer_stream(spark.readStream.schema(frames.schema).parquet(path), 32), out, state)
    return sent.select("sub", "kind", "seq", "n")


@query("st4_live_stream", f"""{FRAMES}, f AS (SELECT project::VARCHAR AS sub, seq, job, stage, status FROM frames), m AS (SELECT max(seq) * 4 // 5 AS mark FROM f),
  b AS (SELECT f.* FROM f, m WHERE seq <= mark QUALIFY row_number() OVER (PARTITION BY sub, job ORDER BY seq DESC) = 1)
  SELECT sub, 'prelude' AS kind, seq, job, stage, status FROM b UNION ALL SELECT sub, 'frame', seq, job, stage, status FROM f, m WHERE seq > mark""")
def st4_stream(spark, sf_dir):
    """Each project's subscriber: a snapshot of the first four fifths of the frames, then the rest as a stream that is started twice."""
    path, out, state, kept = (shared_dir(spark) for _ in range(4))
    frames = T.frames(spark, sf_dir).select(F.col("project").cast("string").alias("sub"), "seq", "t", "job", "stage", "status")
    top = frames.agg(F.max("seq")).first()[0]
    frames.where(F.col("seq") <= top * 4 // 5).write.parquet(path)
    stateful.snapshot(spark.read.schema(frames.schema).parquet(path)).write.parquet(kept)
    for part in (frames.where((F.col("seq") > top * 4 // 5) & (F.col("seq") <= top * 9 // 10)), frames.where(F.col("seq") > top * 9 // 10)):
        part.write.mode("append").parquet(path)
        live = stateful.live_stream(spark.readStream.schema(frames.schema).parquet(path), spark.read.parquet(kept), heartbeat_ms=3_600_000)
        sent = stateful.caught_up(live, out, state)
    return sent.where("kind <> 'heartbeat'").select("sub", "kind", "seq", "job", "stage", "status")


#: Marks from the first word on, as a stream knows of them from the first one.
MARKED = MIXED.replace("seq % 97 = 96", "seq % 97 IN (0, 96)")


@query("st8_segment_stream", cte("words") + f",{MARKED},{BUCKETS}," + session_sql("b5") + " SELECT vid, seq, segment FROM s3")
def st8_segments(spark, sf_dir):
    """Words as a stream in the order of each video that stops twice, cut into the segments of N19; a last word far ahead ends them all.

    Videos have clocks of their own, so the watermark lags by a day.
    """
    path, out, state = (shared_dir(spark) for _ in range(3))
    marked = mixed(spark, sf_dir).withColumn("brk", F.expr("seq % 97 IN (0, 96) AND vid % 3 = 0"))
    words = marked.select("vid", "seq", "text", "t_ms", "end_ms", "spk", "brk", F.timestamp_millis(F.col("t_ms") + 86_400_000).alias("ts"))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("vid"), F.lit(0).cast("long").alias("seq"), F.lit("end").alias("text"), F.lit(10**12).alias("t_ms"), F.lit(10**12 + 1).alias("end_ms"), F.lit("S0").alias("spk"), F.lit(False).alias("brk"), F.timestamp_millis(F.lit(10**12)).alias("ts"))
    for part in (words.where("seq < 100"), words.where("seq >= 100"), last):
        heard = stored(part, path)
        cut = stateful.appended(stateful.segment_stream(spark.readStream.schema(words.schema).parquet(path), late="1 day"), out, state)
        forget(heard)  # the stream knows what it has read, and goes on with what comes next
    return cut.where("vid >= 0").select("vid", F.explode("words").alias("w"), "segment").select("vid", "w.seq", "segment")
