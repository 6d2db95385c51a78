"""Voiced attempts: word overlap, verdicts, and the one to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import script as S
from ..functions import textqc as X
from .decisions import clip_length_ok, exceeds_slot

KEY = ["vid", "seq", "attempt"]


def word_overlap(attempts: DataFrame, lang: str = "en") -> DataFrame:
    """A4: attempts with overlap, the share of the spoken tokens, as a multiset, that was heard."""
    def counts(text: str, name: str) -> DataFrame:
        return attempts.select(*KEY, F.explode(X.compare_tokens(F.col(text), lang)).alias("tok")).groupBy(*KEY, "tok").agg(F.count("*").alias(name))

    both = counts("speak", "a").join(counts("heard", "b"), [*KEY, "tok"], "left")
    share = both.groupBy(*KEY).agg((F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a")).alias("overlap"))
    return attempts.join(share, KEY, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def verdict(source: str, target: str) -> Column:
    """bad_length, unverified, source_leak, ok or mismatch of an attempt with overlap."""
    if S.script_name(source) == S.script_name(target):
        leak = F.lit(False)
    else:
        s, t = S.count_letters(F.col("heard"), S.script_name(source)), S.count_letters(F.col("heard"), S.script_name(target))
        leak = (s > 0) & ((s >= t) | (t < 3))
    return (
        F.when(~clip_length_ok(F.col("dur_ms"), F.col("speak"), target), "bad_length").when(F.col("heard").isNull(), "unverified")
        .when(leak, "source_leak").when(F.col("overlap") >= 0.35, "ok").otherwise("mismatch")
    )


def best_attempt(judged: DataFrame) -> DataFrame:
    """(vid, seq, attempt, verify): the first good attempt, else the one that overlaps most.

    ``judged`` has ok, overlap, dur_ms and slot_ms. An attempt that exceeds its slot is out; from 0.85 an
    ok one is good; the best of the others is accepted if ok, else soft from 0.20.
    """
    fits = judged.where(~exceeds_slot(F.col("dur_ms"), F.col("slot_ms")))
    good = F.col("ok") & (F.col("overlap") >= 0.85)
    rank = F.struct("overlap", -F.col("attempt"))
    chosen = fits.groupBy("vid", "seq").agg(
        F.min(F.when(good, F.col("attempt"))).alias("first"), F.max_by("attempt", rank).alias("best"),
        F.max_by("ok", rank).alias("best_ok"), F.max("overlap").alias("most"),
    )
    label = F.when(F.col("first").isNotNull(), "ok").when(F.col("best_ok"), "accepted").when(F.col("most") >= 0.2, "soft")
    return chosen.select("vid", "seq", F.coalesce("first", "best").alias("attempt"), label.alias("verify")).where("verify is not null")
