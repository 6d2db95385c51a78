"""Batches of edits on the segment table. Refusals are rows with a reason, never errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import script as S
from ..functions import textqc as X
from .decisions import FAILED_KEEPS, trimmed

# What each stage produces, the lock that holds it back, and what follows it.
STAGES = "fetch stems transcript segments translate tts timeline mix report".split()
RESULTS = {"translate": ["text_en"], "tts": ["clip"], "timeline": ["place_start"]}
LOCKS = {"translate": "locked_text", "tts": "locked_tts"}
#: The stage that an edited field sends back to work.
FIELD_STAGE = {"text": "translate", "text_en": "tts", "speaker": "tts", "lang": "translate", "tgt_lang": "translate", "passthrough": "tts"}
ALIASES = {"lang_override": "tgt_lang"}


def invalidated(segments: DataFrame, stage: Column) -> DataFrame:
    """ED9: segments without their results from ``stage`` on (null: unchanged).

    Locked results stay, as does a keep's own subtitle; keeps that the pipeline decided itself are undone.
    """
    at = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(99))
    out, fields = segments, {}
    own_subtitle = F.col("keep") & F.coalesce(~F.col("keep_reason").isin("foreign", "interjection"), F.lit(True))
    for name, columns in RESULTS.items():
        reached = (at <= STAGES.index(name) + 1) & ~F.coalesce(F.col(LOCKS[name]) if name in LOCKS else F.lit(False), F.lit(False))
        for column in columns:
            drop = reached & ~own_subtitle if column == "text_en" else reached
            fields[column] = F.when(~drop, F.col(column))
    from .decisions import reopened

    reasons = {"translate": FAILED_KEEPS, "tts": ("tts_failed",)}
    keep, reason = F.col("keep"), F.col("keep_reason")
    for name, which in reasons.items():
        new_keep, new_reason = reopened(which)
        hit = at <= STAGES.index(name) + 1
        keep, reason = F.when(hit & ~new_keep, False).otherwise(keep), F.when(hit & new_reason.isNull(), F.lit(None)).otherwise(reason)
    return out.withColumns(fields | {"keep": keep, "keep_reason": reason})


def text_edits(segments: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ED1: new lines for segments, and the refusals.

    ``edits`` has (vid, seq, new_text_en), one row per segment. A line equal to the stored one is no
    edit; one without letters or digits is refused. An edit locks the line and drops clip and placement.
    """
    joined = segments.join(edits, ["vid", "seq"], "left").withColumn("new", F.trim("new_text_en"))
    asked = F.col("new_text_en").isNotNull() & ~F.col("new").eqNullSafe(F.col("text_en"))
    silent = ~F.coalesce(F.col("new").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    taken = asked & ~silent
    applied = joined.withColumns(
        {
            "text_en": F.when(taken, F.col("new")).otherwise(F.col("text_en")), "locked_text": F.when(taken, True).otherwise(F.col("locked_text")),
            "locked_tts": F.when(taken, False).otherwise(F.col("locked_tts")), "clip": F.when(~taken, F.col("clip")),
            "place_start": F.when(~taken, F.col("place_start")), "changed": taken,
        }
    ).drop("new", "new_text_en")
    refused = joined.where(asked & silent).select("vid", "seq", F.lit("nothing a voice can say").alias("reason"))
    return applied, refused


def keep_edits(segments: DataFrame, edits: DataFrame, target: str = "en") -> DataFrame:
    """ED2: verdicts set by hand: (vid, seq, want). Un-keeping leaves a real translation in place."""
    joined = segments.join(edits, ["vid", "seq"], "left")
    asked, want = F.col("want").isNotNull(), F.col("want")
    line = trimmed("text_en")
    stays = ~want & (line != trimmed("text")) & S.is_target_text(line, target)
    subtitle = want & F.coalesce("locked_text", F.lit(False))
    return joined.withColumns(
        {
            "text_en": F.when(~asked, F.col("text_en")).when(stays, line).when(subtitle, F.col("text_en")),
            "keep_reason": F.when(~asked, F.col("keep_reason")).when(want, "manual"), "passthrough": F.coalesce(want, F.col("passthrough")),
            "clip": F.when(~asked, F.col("clip")), "place_start": F.when(~asked, F.col("place_start")),
            "locked_keep": F.when(asked, True).otherwise(F.col("locked_keep")), "locked_tts": F.when(asked, False).otherwise(F.col("locked_tts")),
            "keep": F.coalesce(want, F.col("keep")),
        }
    ).drop("want")


def split_segments(segments: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ED4: both halves of segments cut at (vid, seq, at_ms), and the refusals.

    The text is cut at the word nearest in proportion, ties to the even word, one word at least on either
    side; both halves get new identities.
    """
    words = S.split_words(F.col("text"))
    joined = segments.join(cuts, ["vid", "seq"]).withColumn("words", words).withColumn("n", F.size("words"))
    inside = (F.col("start_ms") < F.col("at_ms")) & (F.col("at_ms") < F.col("end_ms"))
    reason = F.when(~inside, "outside the segment").when(F.col("n") < 2, "fewer than two words")
    marked = joined.withColumn("reason", reason)
    k = F.bround(F.col("n") * (F.col("at_ms") - F.col("start_ms")) / (F.col("end_ms") - F.col("start_ms"))).cast("int")
    good = marked.where("reason is null").withColumn("k", F.greatest(F.lit(1), F.least(F.col("n") - 1, k)))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("start_ms").alias("a"), F.col("at_ms").alias("b"), S.join_words(F.slice("words", F.lit(1), F.col("k"))).alias("t")),
        F.struct(F.lit(1).alias("half"), F.col("at_ms").alias("a"), F.col("end_ms").alias("b"), S.join_words(F.slice("words", F.col("k") + 1, F.col("n"))).alias("t")),
    )
    rows = good.select("vid", "seq", "speaker", F.explode(halves).alias("h")).select(
        "vid", "seq", "h.half", "speaker", F.col("h.a").alias("start_ms"), F.col("h.b").alias("end_ms"), F.col("h.t").alias("text")
    )
    return rows.withColumn("uid", X.uid(F.col("start_ms"), F.col("end_ms"), F.col("text"))), marked.where("reason is not null").select("vid", "seq", "reason")


def merge_segments(segments: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ED5: each (vid, seq) of ``pairs`` merged with its successor of the same speaker, and the refusals.

    Only attributes that agree survive; the whole is kept if both were. Texts join as words do, without
    a space at a seam of unspaced scripts.
    """
    by = Window.partitionBy("vid").orderBy("start_ms", "seq")
    after = F.lead(F.struct("speaker", "text", "end_ms", "keep", "keep_reason", "lang")).over(by)
    joined = segments.withColumn("o", after).join(pairs.select("vid", "seq"), ["vid", "seq"])
    reason = F.when(F.col("o").isNull(), "no successor").when(~F.col("speaker").eqNullSafe(F.col("o.speaker")), "different speakers")
    marked = joined.withColumn("reason", reason)
    keep = F.col("keep") & F.col("o.keep")
    same = F.col("keep_reason").eqNullSafe(F.col("o.keep_reason"))
    done = marked.where("reason is null").select(
        "vid", "seq", "speaker", "start_ms", F.col("o.end_ms").alias("end_ms"), S.join_words(F.array("text", "o.text")).alias("text"), keep.alias("keep"),
        F.when(keep, F.when(same, F.col("keep_reason")).otherwise("manual")).alias("keep_reason"),
        F.when(F.col("lang").eqNullSafe(F.col("o.lang")), F.col("lang")).alias("lang"),
    )
    return done, marked.where("reason is not null").select("vid", "seq", "reason")


def edit_batch(edits: DataFrame) -> DataFrame:
    """ED7: per video the changed segments, the fields, the stage to start again from, and refused fields.

    ``edits`` has (vid, seq, field); old names count as the new ones, unknown fields are refused.
    """
    alias = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), F.col("field")), F.col("field"))
    stage = F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_STAGE.items() for x in kv]), F.col("name"))
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    known = edits.withColumn("name", alias).withColumn("stage", stage)
    ok = F.col("stage").isNotNull()
    return known.groupBy("vid").agg(
        F.count_distinct(F.when(ok, F.col("seq"))).alias("changed"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(ok, F.col("name"))))).alias("fields"),
        F.min_by("stage", F.when(ok, order)).alias("stage"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(~ok, F.col("field"))))).alias("refused"),
    )


def passthrough_applied(segments: DataFrame) -> DataFrame:
    """ED8: overrides that differ from the verdict applied; what was made for the other path goes."""
    flip = F.coalesce(F.col("passthrough") != F.col("keep"), F.lit(False)) & (F.col("passthrough") | (trimmed("text") != ""))
    mine = F.coalesce("locked_text", F.lit(False))
    return segments.withColumn("flip", flip).withColumns(
        {
            "keep": F.when(F.col("flip"), F.col("passthrough")).otherwise(F.col("keep")),
            "keep_reason": F.when(~F.col("flip"), F.col("keep_reason")).when(F.col("passthrough"), "user"),
            "text_en": F.when(~F.col("flip") | mine, F.col("text_en")), "clip": F.when(~F.col("flip"), F.col("clip")),
            "place_start": F.when(~F.col("flip"), F.col("place_start")), "locked_tts": F.when(F.col("flip"), False).otherwise(F.col("locked_tts")),
        }
    )


def inverse_edits(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """ED11: (vid, seq, field, value) that undo the change from one state to another."""
    names = {f: f"b_{f}" for f in fields}
    both = before.select("vid", "seq", *[F.col(f).cast("string").alias(n) for f, n in names.items()]).join(
        after.select("vid", "seq", *[F.col(f).cast("string").alias(f) for f in fields]), ["vid", "seq"]
    )
    moved = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(n)), F.struct(F.lit(f).alias("field"), F.col(n).alias("value"))) for f, n in names.items()]))
    return both.select("vid", "seq", F.explode(moved).alias("e")).select("vid", "seq", "e.field", "e.value")


def three_way_merge(base: DataFrame, mine: DataFrame, disk: DataFrame, fields: list[str], audio: list[str]) -> tuple[DataFrame, DataFrame]:
    """ED13: the job's copy with the edits that the stored one gained since the base, and the conflicts.

    Per field the stored value wins if it moved from the base; a flipped keep also takes the audio fields.
    Segments that appeared or vanished are reported as conflicts and not resolved.
    """
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("vid", "seq", *[F.col(f).alias(prefix + f) for f in fields])

    joined = named(mine, "m_").join(named(base, "b_"), ["vid", "seq"]).join(named(disk, "d_"), ["vid", "seq"])
    flip = ~F.col("b_keep").eqNullSafe(F.col("d_keep"))
    merged = [
        F.when(~F.col("b_" + f).eqNullSafe(F.col("d_" + f)) | (flip if f in audio else F.lit(False)), F.col("d_" + f)).otherwise(F.col("m_" + f)).alias(f)
        for f in fields
    ]
    ids = base.select("vid", "seq", F.lit(True).alias("was")).join(disk.select("vid", "seq", F.lit(True).alias("is")), ["vid", "seq"], "full_outer")
    conflicts = ids.where("was is null or is is null").select("vid", "seq", F.when(F.col("was").isNull(), "appeared").otherwise("vanished").alias("what"))
    return joined.select("vid", "seq", *merged), conflicts
