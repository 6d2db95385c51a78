"""Queries of the caption readers, over captions written from words and conversations."""

from pyspark.sql import functions as F

from ..sources import captions as C
from ..sources import tables as T
from ..sources.files import read_captions, write_srt
from ..sources.shared import shared_dir
from ..sources.tables import cte
from .registry import query

RAW = "raw AS (SELECT *, CASE WHEN seq % 9 = 0 THEN '[music]' WHEN seq % 14 = 0 THEN '>> ' || text ELSE text END AS heard, seq % 27 = 0 AS change FROM words)"


@query("s1_json3_words", cte("words") + f",{RAW}," + r""" c AS (SELECT *, CASE WHEN seq % 9 = 0 THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(text, '>>+', ' ', 'g'), '[\[\(][^\]\)]{0,40}[\]\)]', ' ', 'g'), '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g')) END AS clean, change OR contains(heard, '>>') AS mark FROM raw),
  g AS (SELECT *, coalesce(sum((clean <> '')::INT) OVER (PARTITION BY vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM c), b AS (SELECT *, bool_or(mark) OVER (PARTITION BY vid, grp) AS brk FROM g)
  SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY b.seq) - 1 AS seq, max(t_ms) OVER (PARTITION BY vid ORDER BY b.seq) AS t_ms, clean AS text, brk FROM b WHERE clean <> ''""")
def s1(spark, sf_dir):
    """Caption documents written as JSON from the words, eight to an event, and read back."""
    words = T.words(spark, sf_dir).selectExpr("*", "CASE WHEN seq % 9 = 0 THEN '[music]' WHEN seq % 14 = 0 THEN '>> ' || text ELSE text END AS heard", "seq % 27 = 0 AS change")
    seg = F.struct("seq", F.struct(F.col("heard").alias("utf8"), (F.col("t_ms") - F.col("base")).cast("double").alias("tOffsetMs"), F.col("change").alias("isSpeakerChange")).alias("seg"))
    based = words.withColumn("e", F.floor(F.col("seq") / 8)).withColumn("base", F.min("t_ms").over(C.Window.partitionBy("vid", "e")))
    events = based.groupBy("vid", "e").agg(F.min("base").cast("double").alias("tStartMs"), F.transform(F.sort_array(F.collect_list(seg)), lambda x: x["seg"]).alias("segs"))
    docs = events.groupBy("vid").agg(F.transform(F.sort_array(F.collect_list(F.struct("e", "tStartMs", "segs"))), lambda x: F.struct(x["tStartMs"].alias("tStartMs"), x["segs"].alias("segs"))).alias("events"))
    path = shared_dir(spark)
    docs.write.option("compression", "gzip").json(path)
    return C.json3_words(T.whole_rows(spark.read.schema(C.JSON3).json(path), "vid"))


def subtitles(spark, sf_dir):
    """A subtitle text for each conversation, with a tag, an empty cue and a cue that ends before it starts."""
    from .decisions import timecode

    cue = F.concat(timecode(F.col("start_ms")), F.lit(" --> "), timecode(F.when(F.col("seq") % 5 == 3, F.col("start_ms")).otherwise(F.col("end_ms"))), F.lit("\n"),
                   F.when(F.col("seq") % 4 == 1, F.concat(F.lit("<i>"), F.regexp_replace("text", r"\n+", "\n"), F.lit("</i>"))).otherwise(F.regexp_replace("text", r"\n+", "\n")), F.lit("\n"))
    return T.segments(spark, sf_dir).withColumn("cue", cue).groupBy("vid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "cue"))), lambda x: x["cue"]), "\n").alias("text"))


CUES = cte("segments") + r", cu AS (SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY seq) - 1 AS seq, start_ms, end_ms, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM segments WHERE seq % 5 <> 3 AND end_ms > start_ms AND trim(text) <> '')"


@query("s2_cues", f"{CUES} SELECT * FROM cu")
def s2(spark, sf_dir):
    return C.cues(subtitles(spark, sf_dir))


@query("s3_cue_words", CUES + r""", w AS (SELECT vid, seq, start_ms, greatest(end_ms - start_ms, 50) AS len, regexp_extract_all(text, '([^ \t\n\x0B\f\r]+)') AS a FROM cu), k AS (SELECT vid, seq, start_ms, len, len(a) AS n, unnest(range(len(a))) AS k, unnest(a) AS text FROM w),
  t AS (SELECT vid, row_number() OVER o - 1 AS seq, max(start_ms + k * len // n) OVER o AS t_ms, len // n AS step, text FROM k WINDOW o AS (PARTITION BY vid ORDER BY seq, k)) SELECT vid, seq, t_ms, t_ms + greatest(20, step) AS end_ms, text FROM t""")
def s3(spark, sf_dir):
    return C.cue_words(C.cues(subtitles(spark, sf_dir))).drop("brk")


@query("s4_read_files", CUES + r""", w AS (SELECT vid, count(*) AS words FROM (SELECT vid, unnest(regexp_extract_all(text, '([^ \t\n\x0B\f\r]+)')) FROM cu WHERE vid % 4 < 2) GROUP BY vid UNION ALL SELECT vid, count(*) FROM segments WHERE vid % 4 = 3 AND trim(text) <> '' GROUP BY vid),
  f AS (SELECT DISTINCT vid, 'run-' || vid || (['.srt', '.VTT', '.txt', '.json3'])[(vid % 4 + 1)::INT] AS path FROM segments)
  SELECT path, words, CASE WHEN vid % 4 = 2 THEN 'unknown kind of file' WHEN words IS NULL THEN 'no words' END AS reason FROM f LEFT JOIN w USING (vid)""")
def s4(spark, sf_dir):
    """Transcripts of four kinds, told apart by their names: how many words each has, or why it is refused."""
    kind = F.element_at(F.array(*[F.lit(x) for x in (".srt", ".VTT", ".txt", ".json3")]), (F.col("vid") % 4 + 1).cast("int"))
    event = F.struct("seq", F.col("start_ms").cast("double").alias("tStartMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    events = F.transform(F.sort_array(F.collect_list(event)), lambda e: F.struct(e["tStartMs"].alias("tStartMs"), e["segs"].alias("segs")))
    captions = T.segments(spark, sf_dir).groupBy("vid").agg(F.to_json(F.struct(events.alias("events"))).alias("json"))
    files = subtitles(spark, sf_dir).join(captions, "vid").select(
        F.concat(F.lit("run-"), F.col("vid").cast("string"), kind).alias("path"), F.when(F.col("vid") % 4 == 3, F.col("json")).otherwise(F.col("text")).alias("text")
    )
    words, rejects = C.words_of(files)
    found = words.groupBy(F.col("vid").alias("path")).agg(F.count("*").alias("words"))
    return found.select("path", "words", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("path", F.lit(None).cast("bigint").alias("words"), "reason"))


@query("s9_written_srt", CUES + " SELECT 'run-' || vid || '.srt' AS path, seq, start_ms, end_ms, text FROM (SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY seq) - 1 AS seq, start_ms, end_ms, text FROM cu)")
def s9_written(spark, sf_dir):
    """Conversations written as subtitle files, one each, and their cues read back from the files."""
    path = shared_dir(spark)
    some = T.segments(spark, sf_dir).where("seq % 5 <> 3 and end_ms > start_ms").withColumn("name", F.concat(F.lit("run-"), F.col("vid").cast("string")))
    write_srt(some, path)
    files = read_captions(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("vid"), "text")
    return C.cues(files).withColumnRenamed("vid", "path")


@query("s5_checked_transcripts", CUES + " SELECT s.vid, count(cu.seq) AS cues, count(cu.seq) > 0 AS ok FROM (SELECT DISTINCT vid FROM segments) s LEFT JOIN cu USING (vid) GROUP BY s.vid")
def s5(spark, sf_dir):
    """How many cues each transcript has; none means refusal."""
    texts = subtitles(spark, sf_dir)
    counts = C.cues(texts).groupBy("vid").agg(F.count("*").alias("cues"))
    return texts.select("vid").join(counts, "vid", "left").select("vid", F.coalesce("cues", F.lit(0)).alias("cues"), F.col("cues").isNotNull().alias("ok"))


@query("s6_words_artefact", cte("segments") + " SELECT vid, count(*) AS words, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM segments GROUP BY vid")
def s6(spark, sf_dir):
    """A nested artefact written per run and its word list read back."""
    path = shared_dir(spark)
    T.segments(spark, sf_dir).groupBy("vid").agg(F.collect_list(F.struct(F.col("start_ms").alias("t_ms"), "end_ms", "text")).alias("words")).write.json(path)
    read = spark.read.schema("vid bigint, words array<struct<t_ms: bigint, end_ms: bigint, text: string>>").json(path)
    return read.select("vid", F.explode("words").alias("w")).groupBy("vid").agg(F.count("*").alias("words"), F.min("w.t_ms").alias("first_ms"), F.max("w.end_ms").alias("last_ms"))


@query("s7_manifests", cte("segments") + " SELECT vid, seq AS id, start_ms, end_ms, text, keep FROM segments")
def s7(spark, sf_dir):
    """Manifests written with a field too many, and their segments read back."""
    path = shared_dir(spark)
    seg = F.struct("seq", F.struct(F.lit("u").alias("uid"), "start_ms", "end_ms", "text", "keep", F.lit("x").alias("unknown")).alias("s"))
    runs = T.segments(spark, sf_dir).groupBy("vid").agg(F.transform(F.sort_array(F.collect_list(seg)), lambda x: x["s"]).alias("segments"))
    runs.write.json(path)
    return C.read_manifests(spark, path)[1].select("vid", F.col("id").cast("long").alias("id"), "start_ms", "end_ms", "text", "keep")


@query("s8_saved_fields", cte("segments") + " SELECT vid, seq AS id, start_ms, end_ms, CASE WHEN vid % 7 = 0 THEN 'saved again' ELSE text END AS text FROM segments")
def s8(spark, sf_dir):
    """Segments saved, every folder with a changed video saved again, and all read back."""
    path = shared_dir(spark)
    rows, part = T.segments(spark, sf_dir).withColumns({"id": F.col("seq"), "uid": F.lit("u")}), F.pmod(F.xxhash64("vid"), F.lit(64))
    C.write_manifests(rows, path)
    touched = rows.where("vid % 7 = 0").select(part.alias("folder")).distinct()
    again = rows.withColumn("folder", part).join(touched, "folder", "left_semi")
    C.write_manifests(again.withColumn("text", F.when(F.col("vid") % 7 == 0, "saved again").otherwise(F.col("text"))), path)
    return spark.read.schema("vid bigint, id bigint, start_ms bigint, end_ms bigint, text string").json(path).select("vid", "id", "start_ms", "end_ms", "text")
