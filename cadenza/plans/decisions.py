"""Queries of per-segment decisions and reports, over segments of conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..sources import tables as T
from ..sources.tables import cte
from .registry import query

CLIPS = cte("segments") + r""",
c0 AS (SELECT vid, seq, speaker, text, start_ms, end_ms, dur_ms, keep, passthrough, length(text) AS n, CASE WHEN seq % 6 <> 5 THEN text_en END AS text_en FROM segments),
clips AS (SELECT *, CASE WHEN keep THEN (['foreign', 'latin', 'tts_failed', 'mt_failed', 'interjection', 'no_text'])[(n % 6 + 1)::INT] END AS keep_reason,
  CASE n % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'und' END AS lang, n % 5 = 0 AS locked_text, CASE WHEN n % 2 = 0 THEN n % 7 = 0 END AS locked_keep, n % 3 = 0 AS locked_tts,
  CASE WHEN n % 6 <> 5 THEN 'clip' || n END AS clip, CASE WHEN n % 6 <> 5 THEN ((n*7) % 101) / 100.0::DOUBLE END AS overlap,
  (['ok', 'accepted', 'soft', 'keep', 'unverified', NULL])[(n % 6 + 1)::INT] AS verify,
  CASE WHEN n % 6 <> 5 THEN CASE WHEN n % 4 = 2 THEN 'old' ELSE substr(sha1(trim(coalesce(text_en, ''))), 1, 12) END END AS text_sha,
  CASE WHEN n % 9 <> 0 AND n % 6 <> 5 THEN start_ms + (n*11) % 1400 - 300 END AS place_start, (n*11) % 1400 - 300 AS drift_ms,
  0.8::DOUBLE + ((n*3) % 60) / 100.0::DOUBLE AS rate, greatest(0, (n*13) % 900 - 600) AS overrun_ms,
  CASE WHEN n % 10 = 3 THEN substr(text_en, 1, length(text_en) // 2) END AS spoken FROM c0)"""


def clips(spark, sf_dir):
    base = T.segments(spark, sf_dir).selectExpr(
        "vid", "seq", "speaker", "text", "start_ms", "end_ms", "dur_ms", "keep", "passthrough", "cast(length(text) AS bigint) AS n", "CASE WHEN seq % 6 <> 5 THEN text_en END AS text_en"
    )
    return base.selectExpr(
        "*",
        "CASE WHEN keep THEN element_at(array('foreign', 'latin', 'tts_failed', 'mt_failed', 'interjection', 'no_text'), cast(n % 6 + 1 AS int)) END AS keep_reason",
        "CASE n % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'und' END AS lang", "n % 5 = 0 AS locked_text", "CASE WHEN n % 2 = 0 THEN n % 7 = 0 END AS locked_keep", "n % 3 = 0 AS locked_tts",
        "CASE WHEN n % 6 <> 5 THEN 'clip' || n END AS clip", "CASE WHEN n % 6 <> 5 THEN cast((n*7) % 101 AS double) / 100D END AS overlap",
        "element_at(array('ok', 'accepted', 'soft', 'keep', 'unverified', NULL), cast(n % 6 + 1 AS int)) AS verify",
        "CASE WHEN n % 6 <> 5 THEN CASE WHEN n % 4 = 2 THEN 'old' ELSE substr(sha1(trim(coalesce(text_en, ''))), 1, 12) END END AS text_sha",
        "CASE WHEN n % 9 <> 0 AND n % 6 <> 5 THEN start_ms + (n*11) % 1400 - 300 END AS place_start", "(n*11) % 1400 - 300 AS drift_ms",
        "0.8D + cast((n*3) % 60 AS double) / 100D AS rate", "greatest(0L, (n*13) % 900 - 600) AS overrun_ms", "CASE WHEN n % 10 = 3 THEN substr(text_en, 1, length(text_en) div 2) END AS spoken",
    )


def clips_query(name, columns_sql, where=""):
    return query(name, f"{CLIPS} SELECT vid, seq, {columns_sql} FROM clips {where}")


WORDS_SQL = r"greatest(1, len(list_filter(regexp_split_to_array({x}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')))"
WANTS = "(coalesce(NOT passthrough, false) OR (passthrough IS NULL AND coalesce(locked_keep, false) AND NOT keep))"
NEEDS = "(NOT locked_text AND trim(coalesce(text_en, '')) = '')"
STALE = "coalesce(text_sha <> '' AND NOT keep AND text_sha <> substr(sha1(trim(coalesce(text_en, ''))), 1, 12), false)"
FAILED = "(keep AND coalesce(keep_reason IN ('tts_failed', 'mt_failed'), false))"
STATE = f"CASE WHEN {FAILED} THEN 'failed' WHEN keep THEN 'kept' WHEN place_start IS NOT NULL THEN 'dubbed' WHEN clip IS NOT NULL THEN 'unplaced' WHEN coalesce(text_en, '') <> '' THEN 'unvoiced' ELSE 'untranslated' END"
U = WORDS_SQL.format(x="text")


@clips_query("f12_clip_length_ok", f"dur_ms > 50 AND dur_ms >= 180*{U} AND NOT (dur_ms > 950*{U} AND {U} >= 3) AND dur_ms >= ({U}*1000/3.0::DOUBLE + 250)*0.4::DOUBLE AS ok")
def f12(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", D.clip_length_ok(F.col("dur_ms"), F.col("text"), "en").alias("ok"))


@clips_query("f13_exceeds_slot", "dur_ms * 2 > (end_ms - start_ms) // 3 * 3 + 8000 AS exceeds")
def f13(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", D.exceeds_slot(F.col("dur_ms") * 2, F.expr("(end_ms - start_ms) div 3")).alias("exceeds"))


@clips_query("f15_user_wants_dub", f"{WANTS} AS wants, coalesce(locked_keep, false) AS locked")
def f15(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", D.user_wants_dub().alias("wants"), F.coalesce("locked_keep", F.lit(False)).alias("locked"))


@clips_query("f16_needs", f"{NEEDS} AS translation, keep AND trim(text) NOT IN ('', '…') AND {NEEDS} AND (coalesce(keep_reason, '') = 'interjection' OR (coalesce(keep_reason, '') = 'foreign' AND coalesce(lang NOT IN ('', 'und'), false))) AS subtitle, nullif(trim(coalesce(text_en, '')), '') AS speakable")
def f16(spark, sf_dir):
    line = D.trimmed("text_en")
    return clips(spark, sf_dir).select("vid", "seq", D.needs_translation().alias("translation"), D.needs_subtitle().alias("subtitle"), F.when(line != "", line).alias("speakable"))


@clips_query("f17_clip_stale", f"{STALE} AS stale, {STALE} AND locked_tts AS conflict")
def f17(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", D.clip_stale().alias("stale"), (D.clip_stale() & F.col("locked_tts")).alias("conflict"))


@query("f18_pending", f"{CLIPS} SELECT vid, seq FROM clips WHERE NOT keep AND (clip IS NULL OR ({STALE} AND NOT locked_tts))")
def f18(spark, sf_dir):
    return clips(spark, sf_dir).where(D.needs_synthesis()).select("vid", "seq")


@query("f19_untranslated", f"{CLIPS} SELECT vid, seq FROM clips WHERE NOT keep AND trim(coalesce(text_en, '')) = ''")
def f19(spark, sf_dir):
    return clips(spark, sf_dir).where(~F.col("keep") & (D.trimmed("text_en") == "")).select("vid", "seq")


@query("f20_fallbacks", "SELECT conv_id AS vid, max(turn) AS turns, 'captions' AS origin FROM conversations GROUP BY conv_id HAVING conv_id % 3 = 0 AND conv_id % 2 = 1")
def f20(spark, sf_dir):
    """Runs whose transcript came from captions though something else was asked for."""
    runs = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("vid")).agg(F.max("turn").alias("turns"))
    told = runs.selectExpr("vid", "turns", "if(vid % 3 = 0, 'captions', 'asr') AS origin", "if(vid % 2 = 0, 'captions', 'auto') AS prefer")
    return told.where("prefer <> 'captions' AND origin = 'captions'").drop("prefer")


@clips_query("f21_reopened", f"CASE WHEN {{u}} THEN false ELSE keep END AS keep, CASE WHEN NOT {{u}} THEN keep_reason END AS keep_reason, keep AND coalesce(keep_reason NOT IN ('foreign', 'interjection'), true) AS own_subtitle".format(
    u=f"(coalesce(keep_reason IN ('tts_failed', 'mt_failed'), false) AND NOT coalesce(passthrough, false) AND NOT (coalesce(locked_keep, false) AND NOT {WANTS}))"))
def f21(spark, sf_dir):
    keep, reason = D.reopened()
    own = F.col("keep") & F.coalesce(~F.col("keep_reason").isin(*D.SUBTITLED_KEEPS), F.lit(True))
    return clips(spark, sf_dir).select("vid", "seq", keep.alias("keep"), reason.alias("keep_reason"), own.alias("own_subtitle"))


@clips_query("f22_state", f"{STATE} AS state")
def f22(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", D.state().alias("state"))


@clips_query("f23_flags", f"{STATE} IN ('untranslated', 'unvoiced', 'unplaced') AS unfinished, {STATE} <> 'unplaced' AS needs_model, trim(text) <> '' AS has_transcript, keep AND locked_text AND trim(coalesce(text_en, '')) <> '' AND trim(coalesce(text_en, '')) <> trim(text) AS subtitle_only")
def f23(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", *[c.alias(k) for k, c in D.flags().items()])


@clips_query("f24_concerns", f"CASE WHEN (keep AND NOT {FAILED}) OR overlap IS NULL THEN 'none' WHEN overlap < 0.6 THEN 'bad' WHEN overlap < 0.9 THEN 'soft' ELSE 'none' END AS verify, concat_ws(',', CASE WHEN rate > 1.25 THEN 'fast' END, CASE WHEN rate < 0.85 THEN 'slow' END, CASE WHEN abs(drift_ms) > 400 THEN 'drifts' END) AS placement")
def f24(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", D.verify_concern().alias("verify"), F.concat_ws(",", D.placement_concerns()).alias("placement"))


@clips_query("f25_keep_label", "CASE coalesce(trim(keep_reason), '') WHEN 'foreign' THEN 'another language' WHEN 'latin' THEN 'already the target language' WHEN '' THEN 'no reason recorded' ELSE trim(keep_reason) END AS label, coalesce(keep_reason = 'latin', false) AS as_target")
def f25(spark, sf_dir):
    phrases = {"foreign": "another language", "latin": "already the target language", "target_lang": "already the target language"}
    label = D.keep_label(phrases)
    return clips(spark, sf_dir).select("vid", "seq", label.alias("label"), (label == phrases["latin"]).alias("as_target"))


@clips_query("f28_placeholders", "CASE WHEN NOT keep THEN text_en WHEN keep_reason = 'foreign' AND coalesce(lang, 'und') = 'und' THEN '…' WHEN trim(coalesce(text_en, '')) <> '' THEN text_en ELSE text END AS subtitle")
def f28(spark, sf_dir):
    """Subtitles of keeps: a placeholder for unnamed foreign speech, else the line or the own text."""
    unnamed = F.coalesce(F.col("keep_reason") == "foreign", F.lit(False)) & (F.coalesce("lang", F.lit("und")) == "und")
    line = F.when(~F.col("keep"), F.col("text_en")).when(unnamed, "…").when(D.trimmed("text_en") != "", F.col("text_en")).otherwise(F.col("text"))
    return clips(spark, sf_dir).select("vid", "seq", line.alias("subtitle"))


HEB = "translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', repeat('ש', 52))"
LT = r"length(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '[^\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]', '', 'g'))"
AL = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
HE = r"length(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '[^\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}]', '', 'g'))"
MIXED = f"mixed AS (SELECT vid, seq, speaker, start_ms, end_ms, CASE WHEN (seq + vid) % 3 = 0 THEN {HEB} WHEN (seq + vid) % 17 = 1 THEN '…' ELSE text END AS text, CASE seq % 6 WHEN 0 THEN 'en' WHEN 1 THEN '' WHEN 2 THEN 'de' END AS span_lang, CASE vid % 3 WHEN 0 THEN 'he' WHEN 1 THEN 'de' END AS heard_lang, (seq % 10) / 10.0::DOUBLE AS heard_p FROM segments)"


def mixed(spark, sf_dir):
    hebrew = F.translate("text", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ש" * 52)
    return T.segments(spark, sf_dir).select(
        "vid", "seq", "speaker", "start_ms", "end_ms", F.when((F.col("seq") + F.col("vid")) % 3 == 0, hebrew).when((F.col("seq") + F.col("vid")) % 17 == 1, "…").otherwise(F.col("text")).alias("text"),
        F.expr("CASE seq % 6 WHEN 0 THEN 'en' WHEN 1 THEN '' WHEN 2 THEN 'de' END").alias("span_lang"),
        F.expr("CASE vid % 3 WHEN 0 THEN 'he' WHEN 1 THEN 'de' END").alias("heard_lang"), F.expr("cast(seq % 10 AS double) / 10D").alias("heard_p"),
    )


SPEAKERS = f"""owners AS (SELECT vid, speaker, true AS own FROM mixed WHERE {AL} >= 2 GROUP BY vid, speaker
  HAVING sum(end_ms - start_ms) > 0 AND sum(CASE WHEN {AL} > 0 AND {LT} > 0.5*{AL} THEN end_ms - start_ms ELSE 0 END) >= 0.6*sum(end_ms - start_ms))"""


@query("a2_target_speakers", cte("segments") + f",{MIXED},{SPEAKERS} SELECT vid, speaker FROM owners")
def a2(spark, sf_dir):
    return D.target_speakers(mixed(spark, sf_dir), "en")


@query("f27_keep_verdicts", cte("segments") + f",{MIXED},{SPEAKERS}," + f"""
  f AS (SELECT m.*, coalesce(own, false) AS own, {AL} > 0 AND {LT} > 0.5*{AL} AS tgt, {AL} > 0 AND {HE} > 0.5*{AL} AS src, {AL} AS al,
    heard_p >= 0.85 AND coalesce(heard_lang NOT IN ('', 'und', 'en'), false) AS other, span_lang NOT IN ('', 'und') AS named FROM mixed m LEFT JOIN owners o ON m.vid = o.vid AND m.speaker = o.speaker),
  g AS (SELECT *, span_lang = 'en' OR (NOT named AND tgt AND NOT other) AS st, src OR (heard_p >= 0.85 AND coalesce(heard_lang = 'he', false)) AS says FROM f),
  h AS (SELECT vid, seq, CASE WHEN span_lang IS NOT NULL THEN CASE WHEN NOT st AND named AND trim(text) NOT IN ('', '…') THEN NULL WHEN st THEN 'latin' ELSE 'foreign' END
    WHEN al < 2 THEN 'no_text' WHEN tgt THEN CASE WHEN other THEN 'foreign' ELSE 'latin' END WHEN own AND NOT says THEN 'speaker_en' END AS keep_reason FROM g)
  SELECT vid, seq, keep_reason, keep_reason IS NOT NULL AS keep FROM h""")
def f27(spark, sf_dir):
    return D.keep_verdicts(mixed(spark, sf_dir), "he", "en", dub_foreign=True).select("vid", "seq", "keep_reason", "keep")


@query("a3_speaker_totals", cte("segments") + " SELECT vid, speaker, sum(end_ms - start_ms)::BIGINT AS total_ms FROM segments GROUP BY vid, speaker")
def a3(spark, sf_dir):
    return T.segments(spark, sf_dir).groupBy("vid", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


@query("a5_declared_mismatch", cte("segments") + f",{MIXED}, t AS (SELECT vid, sum(end_ms - start_ms) AS total, sum(CASE WHEN {AL} > 0 AND {HE} > 0.5*{AL} THEN end_ms - start_ms ELSE 0 END) AS own FROM mixed WHERE trim(text) <> '' GROUP BY vid) SELECT vid, round(own::DOUBLE / total::DOUBLE, 2) AS in_source_script FROM t WHERE total >= 30000 AND own::DOUBLE / total::DOUBLE < 0.5")
def a5(spark, sf_dir):
    return D.declared_mismatch(mixed(spark, sf_dir), "he")


@query("a11_histograms", f"{CLIPS} SELECT vid, 'keep' AS kind, coalesce(keep_reason, '?') AS value, count(*) AS n FROM clips WHERE keep GROUP BY ALL UNION ALL SELECT vid, 'verify', verify, count(*) FROM clips WHERE verify IS NOT NULL GROUP BY ALL")
def a11(spark, sf_dir):
    all_ = clips(spark, sf_dir)
    kept = all_.where("keep").select("vid", F.lit("keep").alias("kind"), F.coalesce("keep_reason", F.lit("?")).alias("value"))
    return kept.unionByName(all_.where("verify is not null").select("vid", F.lit("verify").alias("kind"), F.col("verify").alias("value"))).groupBy("vid", "kind", "value").agg(F.count("*").alias("n"))


REPORT = f"""SELECT vid, count(*) AS segments, count(*) FILTER (NOT keep) AS dubbed, count(*) FILTER (keep) AS kept,
  coalesce(string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (clip IS NULL OR place_start IS NULL), '') AS unaccounted,
  coalesce(max(drift_ms) FILTER (place_start IS NOT NULL), 0) AS drift_max, coalesce(sum(drift_ms) FILTER (place_start IS NOT NULL), 0)::BIGINT AS drift_sum,
  count(*) FILTER (place_start IS NOT NULL AND drift_ms > 500) AS over_soft, coalesce(max(rate) FILTER (place_start IS NOT NULL), 1.0::DOUBLE) AS speed_max,
  count(*) FILTER (place_start IS NOT NULL AND rate > 1.01) AS compressed, count(*) FILTER (place_start IS NOT NULL AND overrun_ms > 0) AS overruns,
  coalesce(max(overrun_ms) FILTER (place_start IS NOT NULL), 0) AS overrun_max, count(*) FILTER (place_start IS NOT NULL AND spoken IS NOT NULL) AS shortened, count(*) FILTER ({STALE}) AS stale FROM clips GROUP BY vid"""


@query("a12_report", f"{CLIPS} {REPORT}")
def a12(spark, sf_dir):
    return D.reports(clips(spark, sf_dir))


@query("s10_report_json", f"{CLIPS}, r AS ({REPORT}) SELECT vid, '{{\"segments\":' || segments || ',\"dubbed\":' || dubbed || ',\"kept\":' || kept || ',\"unaccounted\":\"' || unaccounted || '\"}}' AS value FROM r")
def s10(spark, sf_dir):
    return D.reports(clips(spark, sf_dir)).select("vid", F.to_json(F.struct("segments", "dubbed", "kept", "unaccounted")).alias("value"))


@query("a15_model_cost", f"{CLIPS} SELECT vid, greatest(1, round((20*count(*) FILTER ({STATE} = 'untranslated') + 60*count(*) FILTER ({STATE} IN ('untranslated', 'unvoiced')))/60.0::DOUBLE))::BIGINT AS minutes FROM clips GROUP BY vid")
def a15(spark, sf_dir):
    seconds = F.sum(F.when(D.state() == "untranslated", 80).when(D.state() == "unvoiced", 60).otherwise(0))
    return clips(spark, sf_dir).groupBy("vid").agg(F.greatest(F.lit(1), F.round(seconds / 60)).cast("long").alias("minutes"))


@query("a16_total_duration", f"{CLIPS} SELECT vid, greatest(vid * 1000, max(end_ms), coalesce(max(place_start + dur_ms), 0), 1000) AS total_ms FROM clips GROUP BY vid")
def a16(spark, sf_dir):
    return clips(spark, sf_dir).groupBy("vid").agg(F.max("end_ms").alias("e"), F.max(F.col("place_start") + F.col("dur_ms")).alias("p")).select(
        "vid", F.greatest(F.col("vid") * 1000, "e", F.coalesce("p", F.lit(0)), F.lit(1000)).alias("total_ms")
    )


@query("j15_neighbours", cte("segments") + " SELECT vid, seq, lag(seq) OVER w AS prev, lead(seq) OVER w AS next FROM segments WINDOW w AS (PARTITION BY vid ORDER BY start_ms, seq)")
def j15(spark, sf_dir):
    return D.neighbours(T.segments(spark, sf_dir)).select("vid", "seq", "prev", "next")


@query("n24_preceding_line", f"{CLIPS} SELECT vid, seq, lag(CASE WHEN trim(coalesce(text_en, '')) <> '' THEN text_en ELSE text END) OVER (PARTITION BY vid ORDER BY seq) AS preceding FROM clips")
def n24(spark, sf_dir):
    line = F.when(D.trimmed("text_en") != "", F.col("text_en")).otherwise(F.col("text"))
    return clips(spark, sf_dir).select("vid", "seq", F.lag(line).over(Window.partitionBy("vid").orderBy("seq")).alias("preceding"))


@query("o1_renumbered", f"{CLIPS} SELECT vid, seq, row_number() OVER (PARTITION BY vid ORDER BY coalesce(place_start, start_ms), end_ms, seq) - 1 AS id FROM clips")
def o1(spark, sf_dir):
    by = Window.partitionBy("vid").orderBy(F.coalesce("place_start", "start_ms"), "end_ms", "seq")
    return clips(spark, sf_dir).select("vid", "seq", (F.row_number().over(by) - 1).alias("id"))


@query("o2_longest_lines", cte("segments") + " SELECT vid, seq, speaker, row_number() OVER (PARTITION BY vid, speaker ORDER BY end_ms - start_ms DESC, start_ms, seq) AS place FROM segments WHERE NOT keep QUALIFY place <= 30")
def o2(spark, sf_dir):
    """The 30 longest dubbed lines of each speaker."""
    by = Window.partitionBy("vid", "speaker").orderBy((F.col("end_ms") - F.col("start_ms")).desc(), "start_ms", "seq")
    return T.segments(spark, sf_dir).where("not keep").withColumn("place", F.row_number().over(by)).where("place <= 30").select("vid", "seq", "speaker", "place")


@query("s9_srt", f"""{CLIPS}, o AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY place_start, seq) AS number, trim(coalesce(spoken, text_en, '')) AS line FROM clips WHERE place_start IS NOT NULL)
  SELECT vid, number, printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS times, line
  FROM (SELECT *, greatest(place_start, 0) AS a, greatest(place_start, 0) + dur_ms AS b FROM o) WHERE line NOT IN ('', '…')""")
def s9(spark, sf_dir):
    """Subtitle cues in order of placement, numbered before empty ones go."""
    by = Window.partitionBy("vid").orderBy("place_start", "seq")
    cues = clips(spark, sf_dir).where("place_start is not null").withColumns(
        {"number": F.row_number().over(by), "line": F.trim(F.coalesce("spoken", "text_en", F.lit(""))), "a": F.greatest("place_start", F.lit(0))}
    )
    return cues.where(~F.col("line").isin("", "…")).select("vid", "number", F.concat(timecode(F.col("a")), F.lit(" --> "), timecode(F.col("a") + F.col("dur_ms"))).alias("times"), "line")


def timecode(ms):
    """Milliseconds as HH:MM:SS,mmm."""
    def part(size, most=None):
        whole = F.floor(ms / size)
        return whole % most if most else whole
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


@query("s15_verdicts", f"{CLIPS} SELECT c.vid, c.seq, s.ok FROM clips c LEFT JOIN (SELECT DISTINCT clip, overlap >= 0.35::DOUBLE AS ok FROM clips WHERE n % 2 = 0 AND clip IS NOT NULL) s ON c.clip = s.clip")
def s15(spark, sf_dir):
    """Side-car verdicts attached to segments by clip; none where there is no side-car."""
    all_ = clips(spark, sf_dir)
    cars = all_.where("n % 2 = 0 AND clip IS NOT NULL").select("clip", (F.col("overlap") >= 0.35).alias("ok")).distinct()
    return all_.join(cars, "clip", "left").select("vid", "seq", "ok")


@clips_query("s16_media_columns", "coalesce(CASE WHEN place_start IS NOT NULL THEN clip END, CASE WHEN keep THEN 'source' END) AS plays, CASE WHEN keep THEN start_ms END AS source_from, NOT keep AND coalesce(regexp_matches(clip, '^(fit_)?clip\\d*5$'), false) AS fallback")
def s16(spark, sf_dir):
    plays = F.coalesce(F.when(F.col("place_start").isNotNull(), F.col("clip")), F.when(F.col("keep"), "source"))
    fallback = ~F.col("keep") & F.coalesce(F.col("clip").rlike(r"^(fit_)?clip\d*5$"), F.lit(False))
    return clips(spark, sf_dir).select("vid", "seq", plays.alias("plays"), F.when(F.col("keep"), F.col("start_ms")).alias("source_from"), fallback.alias("fallback"))
