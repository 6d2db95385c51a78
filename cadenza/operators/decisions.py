"""Per-segment predicates, states, verdicts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import script as S

FAILED_KEEPS = ("tts_failed", "mt_failed")
SUBTITLED_KEEPS = ("foreign", "interjection")


def trimmed(x: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def clip_length_ok(ms: Column, text: Column, lang: str) -> Column:
    """seconds per unit within bounds, and at least 40 % of what the text would take."""
    by_char = S.script_name(lang) in ("cjk", "hangul")
    units = S.speech_units(text, lang)
    low, high, expected = (80, 600, units * 200 + 250) if by_char else (180, 950, units * 1000 / 3 + 250)
    return (ms > 50) & (ms >= low * units) & ~((ms > high * units) & (units >= 3)) & (ms >= expected * 0.4)


def exceeds_slot(ms: Column, slot: Column) -> Column:
    """longer than three times its slot and eight seconds."""
    return ms > slot * 3 + 8000


def user_wants_dub() -> Column:
    """the user asked for a dub: an override that says so, or a locked verdict of no keep."""
    return F.coalesce(~F.col("passthrough"), F.lit(False)) | (
        F.col("passthrough").isNull() & F.coalesce("locked_keep", F.lit(False)) & ~F.col("keep")
    )


def needs_translation() -> Column:
    """F16: no line yet, and not locked by the user."""
    return ~F.coalesce("locked_text", F.lit(False)) & (trimmed("text_en") == "")


def needs_subtitle() -> Column:
    """F16: a keep whose subtitle must be a translation."""
    known = F.coalesce((F.col("lang") != "") & (F.col("lang") != "und"), F.lit(False))
    reason = F.coalesce("keep_reason", F.lit(""))
    return (
        F.col("keep") & ~trimmed("text").isin("", "…") & needs_translation()
        & ((reason == "interjection") | ((reason == "foreign") & known))
    )


def text_sha(text: str = "text_en") -> Column:
    """Fingerprint of a line."""
    return F.substring(F.sha1(trimmed(text)), 1, 12)


def clip_stale() -> Column:
    """a dub's clip was made from another line."""
    return F.coalesce((F.col("text_sha") != "") & ~F.col("keep") & (F.col("text_sha") != text_sha()), F.lit(False))


def needs_synthesis() -> Column:
    """a dub without a clip, or with a stale one that is not locked."""
    locked = F.coalesce("locked_tts", F.lit(False))
    return ~F.col("keep") & (F.col("clip").isNull() | (clip_stale() & ~locked))


def reopened(reasons: tuple[str, ...] = FAILED_KEEPS) -> tuple[Column, Column]:
    """keep and keep_reason after keeps that the pipeline decided itself are undone."""
    undo = (
        F.coalesce(F.col("keep_reason").isin(*reasons), F.lit(False))
        & ~F.coalesce("passthrough", F.lit(False))
        & ~(F.coalesce("locked_keep", F.lit(False)) & ~user_wants_dub())
    )
    return F.when(undo, False).otherwise(F.col("keep")), F.when(~undo, F.col("keep_reason"))


def failed() -> Column:
    return F.col("keep") & F.coalesce(F.col("keep_reason").isin(*FAILED_KEEPS), F.lit(False))


def state() -> Column:
    """the first of failed, kept, dubbed, unplaced, unvoiced, untranslated that holds."""
    return (
        F.when(failed(), "failed").when(F.col("keep"), "kept").when(F.col("place_start").isNotNull(), "dubbed")
        .when(F.col("clip").isNotNull(), "unplaced").when(F.coalesce("text_en", F.lit("")) != "", "unvoiced").otherwise("untranslated")
    )


def flags() -> dict[str, Column]:
    """unfinished, needs_model, has_transcript, subtitle_only."""
    line = trimmed("text_en")
    return {
        "unfinished": state().isin("untranslated", "unvoiced", "unplaced"),
        "needs_model": state() != "unplaced",
        "has_transcript": trimmed("text") != "",
        "subtitle_only": F.col("keep") & F.coalesce("locked_text", F.lit(False)) & (line != "") & (line != trimmed("text")),
    }


def verify_concern() -> Column:
    """none, soft or bad, by the overlap of the heard with the written words."""
    return (
        F.when((F.col("keep") & ~failed()) | F.col("overlap").isNull(), "none")
        .when(F.col("overlap") < 0.6, "bad").when(F.col("overlap") < 0.9, "soft").otherwise("none")
    )


def placement_concerns() -> Column:
    """which of fast, slow and drifting hold; empty without a placement."""
    return F.array_compact(
        F.array(
            F.when(F.col("rate") > 1.25, "fast"), F.when(F.col("rate") < 0.85, "slow"), F.when(F.abs("drift_ms") > 400, "drifts")
        )
    )


def keep_label(phrases: dict[str, str]) -> Column:
    """the phrase for a keep reason, else the reason itself, else that there is none."""
    key = trimmed("keep_reason")
    table = F.create_map(*[F.lit(x) for k, v in phrases.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, key), F.when(key != "", key), F.lit("no reason recorded"))


def target_speakers(segments: DataFrame, target: str, share: float = 0.6) -> DataFrame:
    """A2: (vid, speaker) of speakers of whose lettered time ``share`` is in the target script."""
    length = F.col("end_ms") - F.col("start_ms")
    lettered = segments.where(S.letters(F.col("text")) >= 2)
    totals = lettered.groupBy("vid", "speaker").agg(
        F.sum(length).alias("total"), F.sum(F.when(S.is_script(F.col("text"), target), length).otherwise(0)).alias("own")
    )
    return totals.where((F.col("total") > 0) & (F.col("own") >= share * F.col("total"))).select("vid", "speaker")


def keep_verdicts(segments: DataFrame, source: str, target: str, dub_foreign: bool = False) -> DataFrame:
    """segments with keep and keep_reason decided anew, the first rule that holds deciding.

    ``segments`` has span_lang (null outside spans, '' where the span has no language) and the witness
    columns heard_lang and heard_p (null without one). In a span: a named language outranks the script,
    and with ``dub_foreign`` a known other language with real words is dubbed. Then: fewer than two
    letters, target script, a target-language speaker unless text or witness says source, else a dub.
    """
    cross = S.script_name(source) != S.script_name(target)
    own_name = "latin" if S.script_name(target) == "latin" else "target_lang"
    in_target = S.is_script(F.col("text"), target) if cross else F.lit(False)
    in_source = S.is_script(F.col("text"), source) if cross else F.lit(False)
    sure = F.coalesce(F.col("heard_p") >= 0.85, F.lit(False))
    names_other = sure & F.coalesce(~F.col("heard_lang").isin("", "und", target), F.lit(False))
    says_source = in_source | (sure & F.coalesce(F.col("heard_lang") == source, F.lit(False)))
    span, named = F.col("span_lang"), ~F.col("span_lang").isin("", "und")
    span_target = (span == target) | (~named & in_target & ~names_other)
    dubbed = F.lit(dub_foreign) & ~span_target & named & ~trimmed("text").isin("", "…")
    if cross:
        owners = target_speakers(segments, target).withColumn("own_speaker", F.lit(True))
        joined = segments.join(owners, ["vid", "speaker"], "left")
    else:
        joined = segments.withColumn("own_speaker", F.lit(False))
    prior = F.coalesce("own_speaker", F.lit(False)) & ~says_source
    reason = (
        F.when(span.isNotNull(), F.when(dubbed, F.lit(None)).when(span_target, own_name).otherwise("foreign"))
        .when(S.letters(F.col("text")) < 2, "no_text")
        .when(in_target, F.when(names_other, "foreign").otherwise(own_name))
        .when(prior, "speaker_en")
    )
    decided = joined.withColumn("keep_reason", reason)
    return decided.withColumn("keep", F.col("keep_reason").isNotNull()).drop("own_speaker")


def declared_mismatch(segments: DataFrame, source: str) -> DataFrame:
    """A5: videos of 30 s of speech or more of which less than half is in the declared script."""
    length = F.col("end_ms") - F.col("start_ms")
    totals = segments.where(trimmed("text") != "").groupBy("vid").agg(
        F.sum(length).alias("total"), F.sum(F.when(S.is_script(F.col("text"), source), length).otherwise(0)).alias("own")
    )
    share = F.col("own") / F.col("total")
    return totals.where((F.col("total") >= 30_000) & (share < 0.5)).select("vid", F.round(share, 2).alias("in_source_script"))


def reports(segments: DataFrame) -> DataFrame:
    """One report row per video; ``unaccounted`` must be empty for a finished one."""
    placed = F.col("place_start").isNotNull()
    drift, rate = F.when(placed, F.col("drift_ms")), F.when(placed, F.col("rate"))
    missing = F.col("clip").isNull() | ~placed
    return segments.groupBy("vid").agg(
        F.count("*").alias("segments"), F.count_if(~F.col("keep")).alias("dubbed"), F.count_if("keep").alias("kept"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(missing, F.col("seq"))))).alias("unaccounted"),
        F.coalesce(F.max(drift), F.lit(0)).alias("drift_max"), F.coalesce(F.sum(drift), F.lit(0)).alias("drift_sum"),
        F.count_if(drift > 500).alias("over_soft"),
        F.coalesce(F.max(rate), F.lit(1.0)).alias("speed_max"), F.count_if(rate > 1.01).alias("compressed"),
        F.count_if(placed & (F.col("overrun_ms") > 0)).alias("overruns"), F.coalesce(F.max(F.when(placed, F.col("overrun_ms"))), F.lit(0)).alias("overrun_max"),
        F.count_if(placed & F.col("spoken").isNotNull()).alias("shortened"), F.count_if(clip_stale()).alias("stale"),
    )


def neighbours(segments: DataFrame) -> DataFrame:
    """Segments with the seq of the one before and after them in time."""
    by = Window.partitionBy("vid").orderBy("start_ms", "seq")
    return segments.withColumns({"prev": F.lag("seq").over(by), "next": F.lead("seq").over(by)})
