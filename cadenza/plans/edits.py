"""Queries of the edit operators, over segments of conversations."""

from pyspark.sql import functions as F

from ..operators import edits as E
from .decisions import CLIPS, WANTS, clips
from .registry import query

REOPEN = f"(NOT coalesce(passthrough, false) AND NOT (coalesce(locked_keep, false) AND NOT {WANTS}))"


@query("ed1_text_edits", f"""{CLIPS}, e AS (SELECT *, CASE seq % 4 WHEN 0 THEN ' new ' || n WHEN 1 THEN '?!' WHEN 2 THEN text_en END AS new FROM clips),
  f AS (SELECT *, new IS NOT NULL AND trim(new) IS DISTINCT FROM text_en AND coalesce(regexp_matches(new, '[\\p{{L}}\\p{{N}}]'), false) AS taken FROM e)
  SELECT vid, seq, CASE WHEN taken THEN trim(new) ELSE text_en END AS text_en, CASE WHEN NOT taken THEN clip END AS clip, taken AS changed FROM f""")
def ed1(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    new = all_.selectExpr("vid", "seq", "CASE seq % 4 WHEN 0 THEN ' new ' || n WHEN 1 THEN '?!' WHEN 2 THEN text_en END AS new_text_en")
    return E.text_edits(all_, new)[0].select("vid", "seq", "text_en", "clip", "changed")


@query("ed1_refused_edits", f"{CLIPS} SELECT vid, seq, 'nothing a voice can say' AS reason FROM clips WHERE seq % 4 = 1 AND '?!' IS DISTINCT FROM text_en")
def ed1_refused(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    new = all_.selectExpr("vid", "seq", "CASE seq % 4 WHEN 0 THEN ' new ' || n WHEN 1 THEN '?!' WHEN 2 THEN text_en END AS new_text_en")
    return E.text_edits(all_, new)[1]


LETTERS = r"length(regexp_replace(trim(coalesce(text_en, '')), '[^\p{L}]', '', 'g'))"
LATIN = r"length(regexp_replace(regexp_replace(trim(coalesce(text_en, '')), '[^\p{L}]', '', 'g'), '[^\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]', '', 'g'))"


@query("ed2_keep_edits", f"""{CLIPS}, w AS (SELECT *, CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS want FROM clips)
  SELECT vid, seq, coalesce(want, keep) AS keep, CASE WHEN want IS NULL THEN keep_reason WHEN want THEN 'manual' END AS keep_reason, CASE WHEN want IS NULL THEN clip END AS clip,
  CASE WHEN want IS NULL THEN text_en WHEN NOT want AND trim(coalesce(text_en, '')) <> trim(text) AND {LATIN} >= 2 AND {LATIN} > {LETTERS} - {LATIN} THEN trim(text_en) WHEN want AND locked_text THEN text_en END AS text_en FROM w""")
def ed2(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    return E.keep_edits(all_, all_.selectExpr("vid", "seq", "CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS want")).select("vid", "seq", "keep", "keep_reason", "clip", "text_en")


@query("ed3_speaker_edits", f"{CLIPS} SELECT vid, seq, CASE WHEN n % 4 = 0 THEN 'S' || n % 3 ELSE speaker END AS speaker, CASE WHEN n % 4 <> 0 THEN clip END AS clip, n % 4 = 0 AS locked_speaker FROM clips")
def ed3(spark, sf_dir):
    """Speakers set by hand: the old clip is in the old voice."""
    moved = F.expr("n % 4 = 0")
    return clips(spark, sf_dir).select("vid", "seq", F.when(moved, F.expr("'S' || n % 3")).otherwise(F.col("speaker")).alias("speaker"), F.when(~moved, F.col("clip")).alias("clip"), moved.alias("locked_speaker"))


@query("ed4_split", f"""{CLIPS}, w AS (SELECT *, regexp_extract_all(text, '([^ \\t\\n\\x0B\\f\\r]+)') AS a, start_ms + (end_ms - start_ms) * (seq % 5) // 4 AS pos FROM clips),
  k AS (SELECT *, greatest(1, least(len(a) - 1, round_even(len(a) * (pos - start_ms)::DOUBLE / (end_ms - start_ms)::DOUBLE, 0)::BIGINT)) AS k FROM w WHERE start_ms < pos AND pos < end_ms AND len(a) >= 2)
  SELECT vid, seq, 0 AS half, start_ms, pos AS end_ms, array_to_string(a[1:k], ' ') AS text FROM k UNION ALL SELECT vid, seq, 1, pos, end_ms, array_to_string(a[k+1:], ' ') FROM k""")
def ed4(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    return E.split_segments(all_, all_.selectExpr("vid", "seq", "start_ms + (end_ms - start_ms) * (seq % 5) div 4 AS at_ms"))[0].select("vid", "seq", "half", "start_ms", "end_ms", "text")


@query("ed5_merge", f"""{CLIPS}, o AS (SELECT vid, seq, CASE WHEN seq % 3 = 0 THEN lag(speaker) OVER w ELSE speaker END AS speaker, text, start_ms, end_ms, keep, keep_reason, lang FROM clips WINDOW w AS (PARTITION BY vid ORDER BY seq)),
  p AS (SELECT *, lead(speaker) OVER w AS os, lead(text) OVER w AS ot, lead(end_ms) OVER w AS oe, lead(keep) OVER w AS ok, lead(keep_reason) OVER w AS orr, lead(lang) OVER w AS ol, lead(seq) OVER w AS oq FROM o WINDOW w AS (PARTITION BY vid ORDER BY start_ms, seq))
  SELECT vid, seq, start_ms, oe AS end_ms, trim(text || ' ' || ot) AS text, keep AND ok AS keep, CASE WHEN keep AND ok THEN CASE WHEN keep_reason IS NOT DISTINCT FROM orr THEN keep_reason ELSE 'manual' END END AS keep_reason, CASE WHEN lang IS NOT DISTINCT FROM ol THEN lang END AS lang FROM p WHERE oq IS NOT NULL AND speaker IS NOT DISTINCT FROM os""")
def ed5(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    odd = all_.withColumn("speaker", F.when(F.col("seq") % 3 == 0, F.lag("speaker").over(E.Window.partitionBy("vid").orderBy("seq"))).otherwise(F.col("speaker")))
    return E.merge_segments(odd, odd)[0].drop("speaker")


@query("ed6_removed_and_added", f"{CLIPS} SELECT vid, seq, start_ms, end_ms FROM clips WHERE n % 7 <> 0 UNION ALL SELECT vid, 1000 + max(seq), max(end_ms) + 100, max(end_ms) + 1100 FROM clips GROUP BY vid")
def ed6(spark, sf_dir):
    """Some segments removed, and one added behind the last of each video."""
    all_ = clips(spark, sf_dir)
    gone = all_.where("n % 7 = 0").select("vid", "seq")
    new = all_.groupBy("vid").agg((F.max("seq") + 1000).alias("seq"), (F.max("end_ms") + 100).alias("start_ms"), (F.max("end_ms") + 1100).alias("end_ms"))
    return all_.join(gone, ["vid", "seq"], "left_anti").select("vid", "seq", "start_ms", "end_ms").unionByName(new)


FIELDS = "(['text', 'text_en', 'speaker', 'lang_override', 'colour', 'passthrough'])[(n % 6 + 1)::INT]"


@query("ed7_edit_batch", f"""{CLIPS}, e AS (SELECT vid, seq, {FIELDS} AS field FROM clips WHERE seq % 2 = 0), k AS (SELECT *, CASE field WHEN 'lang_override' THEN 'tgt_lang' ELSE field END AS name, CASE WHEN field IN ('text', 'lang_override') THEN 'translate' WHEN field = 'colour' THEN NULL ELSE 'tts' END AS stage FROM e)
  SELECT vid, count(DISTINCT seq) FILTER (stage IS NOT NULL) AS changed, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (stage IS NOT NULL), '') AS fields, max(stage) FILTER (stage = 'translate') IS NOT NULL AS again,
  CASE WHEN max(stage) FILTER (stage = 'translate') IS NOT NULL THEN 'translate' ELSE max(stage) END AS stage, coalesce(string_agg(DISTINCT field, ',') FILTER (stage IS NULL), '') AS refused FROM k GROUP BY vid""")
def ed7(spark, sf_dir):
    fields = F.expr("element_at(array('text', 'text_en', 'speaker', 'lang_override', 'colour', 'passthrough'), cast(n % 6 + 1 AS int))")
    batch = E.edit_batch(clips(spark, sf_dir).where("seq % 2 = 0").select("vid", "seq", fields.alias("field")))
    return batch.withColumn("again", F.coalesce(F.col("stage") == "translate", F.lit(False)))


@query("ed8_passthrough", f"""{CLIPS}, f AS (SELECT *, coalesce(passthrough <> keep, false) AND (passthrough OR trim(text) <> '') AS flip FROM clips)
  SELECT vid, seq, flip, CASE WHEN flip THEN passthrough ELSE keep END AS keep, CASE WHEN NOT flip THEN keep_reason WHEN passthrough THEN 'user' END AS keep_reason, CASE WHEN NOT flip OR locked_text THEN text_en END AS text_en, CASE WHEN NOT flip THEN clip END AS clip FROM f""")
def ed8(spark, sf_dir):
    return E.passthrough_applied(clips(spark, sf_dir)).select("vid", "seq", "flip", "keep", "keep_reason", "text_en", "clip")


STAGE = "CASE seq % 4 WHEN 0 THEN 'translate' WHEN 1 THEN 'tts' WHEN 2 THEN 'timeline' END"


@query("ed9_invalidated", f"""{CLIPS}, s AS (SELECT *, {STAGE} AS stage, keep AND coalesce(keep_reason NOT IN ('foreign', 'interjection'), true) AS own,
    CASE WHEN seq % 4 = 0 THEN coalesce(keep_reason IN ('tts_failed', 'mt_failed'), false) WHEN seq % 4 = 1 THEN coalesce(keep_reason = 'tts_failed', false) ELSE false END AND {REOPEN} AS undo FROM clips)
  SELECT vid, seq, CASE WHEN NOT (coalesce(stage = 'translate', false) AND NOT locked_text AND NOT own) THEN text_en END AS text_en, CASE WHEN NOT (coalesce(stage IN ('translate', 'tts'), false) AND NOT locked_tts) THEN clip END AS clip,
  CASE WHEN stage IS NULL THEN place_start END AS place_start, CASE WHEN undo THEN false ELSE keep END AS keep, CASE WHEN NOT undo THEN keep_reason END AS keep_reason FROM s""")
def ed9(spark, sf_dir):
    return E.invalidated(clips(spark, sf_dir), F.expr(STAGE)).select("vid", "seq", "text_en", "clip", "place_start", "keep", "keep_reason")


@query("ed10_predicted_patch", f"""{CLIPS} SELECT vid, seq, CASE WHEN n % 2 = 0 THEN true ELSE locked_text END AS locked_text, n % 2 <> 0 AND locked_tts AS locked_tts, CASE WHEN n % 2 <> 0 THEN clip END AS clip FROM clips""")
def ed10(spark, sf_dir):
    """What a patch of the line will lock, unlock and drop."""
    all_ = clips(spark, sf_dir)
    new = all_.where("n % 2 = 0").selectExpr("vid", "seq", "'patched ' || n AS new_text_en")
    return E.text_edits(all_, new)[0].select("vid", "seq", "locked_text", "locked_tts", "clip")


@query("ed11_inverse_edits", f"{CLIPS} SELECT vid, seq, 'text_en' AS field, text_en AS value FROM clips WHERE seq % 4 = 0 UNION ALL SELECT vid, seq, 'clip', clip FROM clips WHERE seq % 4 = 0 AND clip IS NOT NULL")
def ed11(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    new = all_.where("seq % 4 = 0").selectExpr("vid", "seq", "'new ' || n AS new_text_en")
    return E.inverse_edits(all_, E.text_edits(all_, new)[0], ["text_en", "clip"])


@query("ed12_failures_undone", f"{CLIPS}, u AS (SELECT *, coalesce(keep_reason = 'tts_failed', false) AND {REOPEN} AS undo FROM clips) SELECT vid, seq, CASE WHEN undo THEN false ELSE keep END AS keep FROM u")
def ed12(spark, sf_dir):
    from ..operators.decisions import reopened

    return clips(spark, sf_dir).select("vid", "seq", reopened(("tts_failed",))[0].alias("keep"))


MINE = "mine AS (SELECT vid, seq, text_en, keep, speaker, 'job' || n AS clip FROM clips), base AS (SELECT vid, seq, text_en, keep, speaker, clip FROM clips WHERE n % 11 <> 0), disk AS (SELECT vid, seq, CASE WHEN n % 3 = 0 THEN 'edited' ELSE text_en END AS text_en, CASE WHEN n % 5 = 0 THEN NOT keep ELSE keep END AS keep, speaker, clip FROM clips WHERE n % 13 <> 0)"


@query("ed13_three_way_merge", f"""{CLIPS},{MINE} SELECT m.vid, m.seq, CASE WHEN b.text_en IS DISTINCT FROM d.text_en THEN d.text_en ELSE m.text_en END AS text_en, CASE WHEN b.keep IS DISTINCT FROM d.keep THEN d.keep ELSE m.keep END AS keep, m.speaker,
  CASE WHEN b.clip IS DISTINCT FROM d.clip OR b.keep IS DISTINCT FROM d.keep THEN d.clip ELSE m.clip END AS clip FROM mine m JOIN base b USING (vid, seq) JOIN disk d USING (vid, seq)""")
def ed13(spark, sf_dir):
    return merged(spark, sf_dir)[0]


@query("ed13_conflicts", f"{CLIPS},{MINE} SELECT vid, seq, CASE WHEN n % 11 = 0 THEN 'appeared' ELSE 'vanished' END AS what FROM clips WHERE (n % 11 = 0) <> (n % 13 = 0)")
def ed13_conflicts(spark, sf_dir):
    return merged(spark, sf_dir)[1]


def merged(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    fields = ["text_en", "keep", "speaker", "clip"]
    disk = all_.where("n % 13 <> 0").withColumns({"text_en": F.expr("CASE WHEN n % 3 = 0 THEN 'edited' ELSE text_en END"), "keep": F.expr("CASE WHEN n % 5 = 0 THEN NOT keep ELSE keep END")})
    return E.three_way_merge(all_.where("n % 11 <> 0"), all_.withColumn("clip", F.expr("'job' || n")), disk, fields, ["clip"])


@query("ed14_still_present", f"{CLIPS}, w AS (SELECT vid, seq + 1 AS seq FROM clips) SELECT w.vid, w.seq, c.seq IS NOT NULL AS present, coalesce(locked_text, false) AS locked FROM w LEFT JOIN clips c USING (vid, seq)")
def ed14(spark, sf_dir):
    """Segments asked for by a batch: which still exist, and which of them are locked."""
    all_ = clips(spark, sf_dir)
    asked = all_.select("vid", (F.col("seq") + 1).alias("seq"))
    return asked.join(all_.select("vid", "seq", F.lit(True).alias("present"), "locked_text"), ["vid", "seq"], "left").select(
        "vid", "seq", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("locked_text", F.lit(False)).alias("locked")
    )


@query("ed15_stragglers", f"{CLIPS} SELECT vid, seq, CASE WHEN keep THEN 'slice' WHEN trim(coalesce(text_en, '')) <> '' THEN 'voice' WHEN {WANTS} THEN 'failed' ELSE 'keep' END AS outcome FROM clips WHERE clip IS NULL")
def ed15(spark, sf_dir):
    """What becomes of segments without audio: sliced, voiced, kept as failed, or named as failures."""
    from ..operators.decisions import trimmed, user_wants_dub

    outcome = F.when(F.col("keep"), "slice").when(trimmed("text_en") != "", "voice").when(user_wants_dub(), "failed").otherwise("keep")
    return clips(spark, sf_dir).where("clip is null").select("vid", "seq", outcome.alias("outcome"))
