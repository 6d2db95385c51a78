"""Readers of captions, subtitles and manifests, as tables of words, cues and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import script as S
from ..operators.words import clean_tokens
from .files import read_captions

#: A word-level caption document: events of segments, times in ms.
JSON3 = "vid bigint, events array<struct<tStartMs: double, segs: array<struct<utf8: string, tOffsetMs: double, isSpeakerChange: boolean>>>>"
MANIFEST = (
    "vid bigint, source struct<src_lang: string, tgt_lang: string, duration_ms: bigint>, stages map<string, string>,"
    " segments array<struct<uid: string, start_ms: bigint, end_ms: bigint, text: string, keep: boolean>>"
)
#: Fields of a segment that a saved manifest keeps.
SAVED = ["uid", "start_ms", "end_ms", "text", "keep"]
STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
SPACE = r"[ \t\n\x0B\f\r]+"


def json3_words(captions: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """Vid, seq, t_ms, text, brk of caption documents in the shape of ``JSON3``.

    A speaker mark on an empty token goes to the next real one, onsets never fall, and words from the
    first onset at or after the limit on are left out.
    """
    flat = captions.select("vid", F.posexplode("events").alias("e", "event")).select(
        "vid", "e", F.coalesce("event.tStartMs", F.lit(0.0)).alias("base"), F.posexplode("event.segs").alias("s", "seg")
    )
    raw = flat.select(
        "vid", "e", "s", F.coalesce("seg.utf8", F.lit("")).alias("raw"), F.coalesce("seg.isSpeakerChange", F.lit(False)).alias("change"),
        F.round(F.col("base") + F.coalesce("seg.tOffsetMs", F.lit(0.0))).cast("long").alias("t"),
    )
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", ">>+", " "), r"[\[\(][^\]\)]{0,40}[\]\)]", " "), r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]", "")
    marked = raw.withColumns({"text": F.trim(F.regexp_replace(text, SPACE, " ")), "mark": F.col("change") | F.col("raw").contains(">>")})
    by = Window.partitionBy("vid").orderBy("e", "s")
    real = (F.col("text") != "").cast("int")
    # A mark belongs to the real token that closes its group of tokens.
    group = F.coalesce(F.sum(real).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = marked.withColumn("group", group)
    brk = F.max("mark").over(Window.partitionBy("vid", "group"))
    words = held.withColumn("brk", brk).where("text <> ''")
    order = Window.partitionBy("vid").orderBy("e", "s")
    numbered = words.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    if limit_ms is not None:
        late = F.min(F.when(F.col("t") >= limit_ms, F.col("seq"))).over(Window.partitionBy("vid"))
        numbered = numbered.withColumn("late", late).where("late is null or seq < late").drop("late")
    return numbered.withColumn("t_ms", F.max("t").over(Window.partitionBy("vid").orderBy("seq"))).select("vid", "seq", "t_ms", "text", "brk")


def cues(files: DataFrame) -> DataFrame:
    """Vid, seq, start_ms, end_ms, text of SRT or WebVTT texts (vid, text).

    A cue is a line of times and the lines up to the next blank one or the next times; tags go; cues
    without text or with an end not after their start are dropped.
    """
    lines = files.select(
        "vid", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("n", "line")
    ).withColumn("line", F.trim("line"))
    is_cue = F.col("line").rlike(rf"^{STAMP}\s*-->\s*{STAMP}")
    by = Window.partitionBy("vid").orderBy("n")
    numbered = lines.withColumn("cue", is_cue).withColumn("k", F.sum(F.col("cue").cast("int")).over(by)).where("k > 0")
    inside = Window.partitionBy("vid", "k").orderBy("n")
    body = numbered.withColumn("over", F.sum((F.col("line") == "").cast("int")).over(inside)).where("over = 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("cue"), F.struct("n", "line")))), lambda x: x["line"]), " ")
    whole = body.groupBy("vid", "k").agg(F.max(F.when(F.col("cue"), F.col("line"))).alias("times"), text.alias("text"))

    def at(group: int):
        def part(i: int):
            return F.regexp_extract("times", rf"^{STAMP}\s*-->\s*{STAMP}", group + i)
        hours = F.when(part(0) == "", "0").otherwise(part(0)).cast("long")
        return hours * 3_600_000 + part(1).cast("long") * 60_000 + part(2).cast("long") * 1000 + F.rpad(part(3), 3, "0").cast("long")

    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"<[^>]{0,120}>|\{[^}]{0,60}\}", " "), SPACE, " "))
    timed = whole.select("vid", "k", at(1).alias("start_ms"), at(5).alias("end_ms"), clean.alias("text"))
    kept = timed.where("text <> '' and end_ms > start_ms")
    return kept.select("vid", (F.row_number().over(Window.partitionBy("vid").orderBy("k")) - 1).cast("long").alias("seq"), "start_ms", "end_ms", "text")


def cue_words(cue_rows: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """S3: words spread evenly over their cues: vid, seq, t_ms, end_ms, text, brk; times rounded down."""
    cleaned = clean_tokens(cue_rows)
    spread = cleaned.withColumn("w", S.split_words(F.col("text"))).withColumn("n", F.size("w")).select(
        "vid", F.col("seq").alias("cue"), "start_ms", "brk", "n", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(50)).alias("len"), F.posexplode("w").alias("k", "text")
    )
    timed = spread.select(
        "vid", "cue", "k", "text", (F.col("brk") & (F.col("k") == 0)).alias("brk"),
        (F.col("start_ms") + F.floor(F.col("k") * F.col("len") / F.col("n"))).alias("t"), F.floor(F.col("len") / F.col("n")).alias("step"),
    )
    by = Window.partitionBy("vid").orderBy("cue", "k")
    numbered = timed.withColumn("seq", (F.row_number().over(by) - 1).cast("long"))
    if limit_ms is not None:
        late = F.min(F.when(F.col("t") >= limit_ms, F.col("seq"))).over(Window.partitionBy("vid"))
        numbered = numbered.withColumn("late", late).where("late is null or seq < late").drop("late")
    t = F.max("t").over(Window.partitionBy("vid").orderBy("seq"))
    return numbered.withColumn("t_ms", t).select("vid", "seq", "t_ms", (F.col("t_ms") + F.greatest(F.lit(20), F.col("step"))).alias("end_ms"), "text", "brk")


def read_words(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``words_of`` all files below ``folder``, by the data source of captions, whose refusals are rejects too."""
    files = read_captions(spark, folder)
    words, rejects = words_of(files.where("reason is null").select("path", "text"))
    return words, rejects.unionByName(files.where("reason is not null").select("path", "reason"))


def words_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of transcript files (path, text), and the rejected files with reasons.

    ``.srt`` and ``.vtt`` are subtitles, ``.json3`` is JSON; a file's path takes the place of vid. Files
    of another kind, and files without a word, are rejects; none fails the job.
    """
    named = files.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    renamed = named.withColumn("vid", F.col("path"))
    subtitles = cue_words(cues(renamed.where(F.col("kind").isin("srt", "vtt")).select("vid", "text")))
    doc = F.from_json("text", JSON3.replace("vid bigint, ", ""))
    captions = json3_words(renamed.where("kind = 'json3'").select("vid", doc["events"].alias("events")))
    words = subtitles.select("vid", "seq", "t_ms", "text", "brk").unionByName(captions)
    some = words.select(F.col("vid").alias("path")).distinct()
    reason = F.when(~F.col("kind").isin("srt", "vtt", "json3"), "unknown kind of file").otherwise("no words")
    return words, named.join(some, "path", "left_anti").select("path", reason.alias("reason"))


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs and their segments from manifests, one JSON document a line; unknown fields fall away."""
    runs = spark.read.schema(MANIFEST).json(path)
    segments = runs.select("vid", F.posexplode("segments").alias("id", "s")).select("vid", "id", "s.*")
    return runs.drop("segments"), segments


def write_manifests(segments: DataFrame, path: str, part: Column | None = None) -> None:
    """Segments saved with the fields of ``SAVED`` only, in folders by ``part``, a hash of the video unless given.

    All videos of a folder are saved together: saving again replaces the folders of the rows given, and no
    others.
    """
    folder = F.pmod(F.xxhash64("vid"), F.lit(64)) if part is None else part
    (
        segments.select("vid", "id", *SAVED).withColumn("part", folder)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").json(path)
    )
