"""Word operators for videos longer than a task should hold.

A window over ``vid`` is one task for one video. Here a video is cut into chunks of ``size`` positions
(``seq`` div size), every chunk is a partition of its own, and what leaks over a cut (the rows just before
and after it, sums, highest and last values so far) is made from one row a chunk. ``scan`` does that for any
number of looks at once: a native pass in each chunk; a window over the chunks' last rows, which are a
``size``-th of all; and a join that brings them to the rows of videos with more than one chunk. Only what is
handed to chunks is stored; words never are, and are made again by each scan that follows. Where the rows of a
video lie in one partition already, as those of ``tables.words`` do, they are not moved either; elsewhere
chunks are dealt out once. Results equal those of the functions of the same name in ``words``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import script as S
from ..params import SEG, SENTENCE_END
from ..sources.shared import shared_dir, stored
from .intervals import bucket_join
from .words import filed, heard

#: Positions of a video in one chunk.
CHUNK = 50_000
CELL = ("vid", "__c")


class Look(NamedTuple):
    """What ``scan`` finds for each row: a kind, the value it looks at, and how many rows away."""

    kind: str
    value: Column
    away: int = 1


def before(value: Column, away: int = 1) -> Look:
    """The value ``away`` rows before; null where there is no such row."""
    return Look("before", value, away)


def after(value: Column, away: int = 1) -> Look:
    """The value ``away`` rows after; null where there is no such row."""
    return Look("after", value, away)


def total(value: Column) -> Look:
    """The sum up to and with the row; nulls count nothing."""
    return Look("total", F.coalesce(value.cast("long"), F.lit(0)))


def last(value: Column, own: bool = False) -> Look:
    """The last value that is not null before the row, the row's own first if ``own``."""
    return Look("last_own" if own else "last", value)


def highest(value: Column) -> Look:
    """The highest value before the row; of structs, by their fields in order."""
    return Look("highest", value)


def overall(value: Column) -> Look:
    """The highest value of the video."""
    return Look("overall", value)


def _ordered(end: int | None = None) -> WindowSpec:
    """A chunk's rows in order, from its first row to ``end`` rows after the own one if that is given."""
    by = Window.partitionBy(*CELL).orderBy("seq")
    return by if end is None else by.rowsBetween(Window.unboundedPreceding, end)


def _chunks(start: int, end: int) -> WindowSpec:
    """A video's chunks from ``start`` to ``end`` of them away."""
    return Window.partitionBy("vid").orderBy("__c").rowsBetween(start, end)


def _inside(name: str, look: Look) -> dict[str, Column]:
    """Columns of the pass in a chunk: what the row sees there (l), and what the chunk hands on (e)."""
    kind, v, k = look
    at_end, at_start = F.col("__r") == F.col("__n"), F.col("__r") == 1
    boxed = F.struct(v.alias("x"))
    if kind == "before":
        tail = F.array_compact(F.array(*[F.lag(boxed, i).over(_ordered()) for i in range(k - 1, 0, -1)], boxed))
        return {f"__l_{name}": F.lag(boxed, k).over(_ordered()), f"__e_{name}": F.when(at_end, tail)}
    if kind == "after":
        head = F.array_compact(F.array(boxed, *[F.lead(boxed, i).over(_ordered()) for i in range(1, k)]))
        return {f"__l_{name}": F.lead(boxed, k).over(_ordered()), f"__e_{name}": F.when(at_start, head)}
    if kind == "total":
        seen = F.sum(v).over(_ordered(end=0))
        return {f"__l_{name}": seen, f"__e_{name}": F.when(at_end, seen)}
    if kind in ("last", "last_own"):
        with_own = F.last(v, ignorenulls=True).over(_ordered(end=0))
        seen = with_own if kind == "last_own" else F.last(v, ignorenulls=True).over(_ordered(end=-1))
        return {f"__l_{name}": seen, f"__e_{name}": F.when(at_end, with_own)}
    if kind == "highest":
        return {f"__l_{name}": F.max(v).over(_ordered(end=-1)), f"__e_{name}": F.when(at_end, F.max(v).over(_ordered(end=0)))}
    whole = F.max(v).over(Window.partitionBy(*CELL))
    return {f"__l_{name}": whole, f"__e_{name}": F.when(at_end, whole)}


def _handed(name: str, look: Look) -> Column:
    """What the other chunks of the video hand to a chunk."""
    e, k = F.col(f"__e_{name}"), look.away
    if look.kind == "before":
        return F.flatten(F.collect_list(e).over(_chunks(-k, -1)))
    if look.kind == "after":
        return F.flatten(F.collect_list(e).over(_chunks(1, k)))
    if look.kind == "total":
        return F.sum(e).over(_chunks(Window.unboundedPreceding, -1))
    if look.kind in ("last", "last_own"):
        return F.last(e, ignorenulls=True).over(_chunks(Window.unboundedPreceding, -1))
    return F.max(e).over(_chunks(Window.unboundedPreceding, -1) if look.kind == "highest" else Window.partitionBy("vid"))


def _both(name: str, look: Look) -> Column:
    """The row's view in its chunk together with what was handed to the chunk."""
    l, h, k = F.col(f"__l_{name}"), F.col(f"__h_{name}"), look.away
    if look.kind == "before":
        return F.coalesce(l, F.when(F.col("__r") <= k, F.try_element_at(h, F.col("__r") - k - 1)))["x"]
    if look.kind == "after":
        return F.coalesce(l, F.get(h, k - 1 - (F.col("__n") - F.col("__r"))))["x"]
    if look.kind == "total":
        return l + F.coalesce(h, F.lit(0))
    if look.kind == "highest":
        return F.greatest(l, h)
    return F.coalesce(h, l) if look.kind == "overall" else F.coalesce(l, h)


def together(df: DataFrame) -> bool:
    """Whether the plan of ``df`` has the rows of a video in one partition."""
    dealt = df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    return re.fullmatch(r"hashpartitioning\(vid#\d+L?, \d+\)", dealt) is not None


def chunked(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("__c", F.floor(F.col("seq") / size))


def brought(rows: DataFrame, handed: DataFrame) -> DataFrame:
    """``rows`` (vid, __c and others) with the columns of ``handed``, which has one row for a chunk or none.

    Chunks that lie together get a video's rows of ``handed`` as one map, as a join by chunk would deal them out again.
    """
    names = [c for c in handed.columns if c not in CELL]
    if not together(rows):
        return rows.join(handed, list(CELL), "left")
    each = F.map_from_entries(F.collect_list(F.struct("__c", F.struct(*names))))
    videos = handed.groupBy("vid").agg(each.alias("__chunks"))
    met = rows.join(videos, "vid", "left").withColumn("__mine", F.try_element_at("__chunks", F.col("__c")))
    return met.select(*rows.columns, *[F.col("__mine")[c].alias(c) for c in names])


def scan(df: DataFrame, looks: dict[str, Look], size: int = CHUNK, folder: str | None = None) -> DataFrame:
    """``df`` (vid, seq and others; vid is not null, a position occurs once in a video) with a column for each look.

    What is handed to chunks is stored below ``folder``, by the names of the looks.
    """
    placed = chunked(df, size).withColumns({"__r": F.row_number().over(_ordered()), "__n": F.count("*").over(Window.partitionBy(*CELL)).cast("int")})
    inside: dict[str, Column] = {}
    for name, look in looks.items():
        inside |= _inside(name, look)
    local = placed.withColumns(inside)
    edges = local.where("__r = 1 or __r = __n").groupBy(*CELL).agg(*[F.first(f"__e_{n}", ignorenulls=True).alias(f"__e_{n}") for n in looks])
    counted = edges.withColumns({"__k": F.count("*").over(Window.partitionBy("vid"))} | {f"__h_{n}": _handed(n, x) for n, x in looks.items()})
    handed = counted.where("__k > 1").select(*CELL, *[f"__h_{n}" for n in looks])
    kept = stored(handed, f"{folder or shared_dir(df.sparkSession)}/{'-'.join(looks)[:80]}")
    needed = [c for c in local.columns if not c.startswith("__e_")]
    return brought(local.select(*needed), kept).select(*df.columns, *[_both(n, x).alias(n) for n, x in looks.items()])


def word_ends(words: DataFrame, size: int = CHUNK, folder: str | None = None) -> DataFrame:
    """end_ms measured or the longest a word may take, not past the next onset, 20 ms at least."""
    end = F.coalesce("end_ms", F.col("t_ms") + SEG.word_max)
    seen = scan(words, {"__next": after(F.col("t_ms"))}, size, folder)
    return seen.withColumn("end_ms", F.greatest(F.least(end, F.coalesce("__next", end)), F.col("t_ms") + 20)).drop("__next")


def _guessed_end() -> Column:
    return F.coalesce("end_ms", F.col("t_ms") + F.least(F.lit(SEG.word_max), 100 + 60 * F.length("text")))


def _gap(previous: Column) -> Column:
    return F.greatest(F.lit(0), F.col("t_ms") - previous)


def speech_gaps(words: DataFrame, size: int = CHUNK) -> DataFrame:
    """gap_ms of silence before each word; without a measured end one is guessed from the word's length."""
    seen = scan(words, {"__prev": before(_guessed_end())}, size)
    return seen.withColumn("gap_ms", _gap(F.col("__prev"))).drop("__prev")


def _short_run(flag: Column, least: int, near: dict[int, Column]) -> Column:
    """Whether a flagged row's run of flagged rows has fewer than ``least``, by the rows around it."""
    def stretch(first: int) -> Column:
        held = F.lit(True)
        for i in range(first, first + least):
            held = held & (flag if i == 0 else F.coalesce(near[i], F.lit(False)))
        return held

    long = F.lit(False)
    for first in range(1 - least, 1):
        long = long | stretch(first)
    return flag & ~long


def sessions(words: DataFrame, src: str = "he", tgt: str = "en", size: int = CHUNK) -> DataFrame:
    """Words with bucket, embedded, gap_ms and segment, by the rules of ``words.sessions``; three scans."""
    bucketed = words.withColumn("bucket", S.text_bucket(F.col("text"), src, tgt)).withColumn("__tg", F.col("bucket").eqNullSafe("target"))
    mark = F.coalesce("brk", F.lit(False))
    reach = range(1, SEG.foreign_min_words)
    looks = {"__prev": before(F.struct("seq", "spk", "text", _guessed_end().alias("end"))), "__marks": overall(mark)}
    looks |= {f"__b{i}": before(F.col("__tg"), i) for i in reach} | {f"__a{i}": after(F.col("__tg"), i) for i in reach}
    near = {-i: F.col(f"__b{i}") for i in reach} | {i: F.col(f"__a{i}") for i in reach}
    folder = shared_dir(words.sparkSession)
    seen = scan(bucketed, looks, size, folder).withColumns(
        {"embedded": _short_run(F.col("__tg"), SEG.foreign_min_words, near), "gap_ms": _gap(F.col("__prev.end"))}
    ).drop("__tg", *[f"__{s}{i}" for s in "ab" for i in reach])
    own = F.when(~F.col("embedded"), F.col("bucket"))
    placed = scan(seen, {"__context": last(own)}, size, folder)
    starts = (
        F.col("__prev.seq").isNull()
        | (F.col("gap_ms") >= SEG.gap)
        | mark
        | (~F.col("__marks") & ~F.col("__prev.spk").eqNullSafe(F.col("spk")) & (F.col("gap_ms") >= SEG.speaker_gap))
        | F.coalesce(own != F.col("__context"), F.lit(False))
        | F.coalesce(F.col("__prev.text").rlike(SENTENCE_END), F.lit(False))
    )
    numbered = scan(placed.withColumn("__starts", starts).drop("__prev", "__marks", "__context"), {"segment": total(F.col("__starts"))}, size, folder)
    return numbered.drop("__starts")


def without_echoes(words: DataFrame, size: int = CHUNK) -> DataFrame:
    """Words without those decoded twice: the same word starting over 50 ms before its twin ends; four scans.

    A run is named by where it begins, so the highest pair of run and end before a word is that of its own
    run, if it has one. An echo's end goes to the kept word before it in one aggregate.
    """
    key = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_]", ""))
    folder = shared_dir(words.sparkSession)
    keyed = scan(words.withColumn("__key", key), {"__prev": before(F.struct("__key"))}, size, folder)
    flips = F.col("__prev").isNull() | ~F.col("__prev.__key").eqNullSafe(F.col("__key"))
    runs = scan(keyed.withColumn("__flip", F.when(flips, F.col("seq"))), {"__run": last(F.col("__flip"), own=True)}, size, folder)
    seen = scan(runs.drop("__prev", "__flip"), {"__top": highest(F.struct(F.col("__run").alias("run"), F.col("end_ms").alias("end")))}, size, folder)
    twin = F.when(F.col("__top.run") == F.col("__run"), F.col("__top.end"))
    marked = seen.withColumn("__echo", (F.col("__key") != "") & F.coalesce(F.col("t_ms") < twin - 50, F.lit(False))).drop("__top", "__run", "__key")
    kept = scan(marked.withColumn("__own", F.when(~F.col("__echo"), F.col("seq"))), {"__kept": last(F.col("__own"), own=True)}, size, folder)
    word = F.first(F.when(~F.col("__echo"), F.struct(*[F.col(c) for c in words.columns])), ignorenulls=True)
    whole = kept.groupBy("vid", "__kept").agg(word.alias("w"), F.max("end_ms").alias("__end"))
    return whole.select(*[F.col("__end").alias(c) if c == "end_ms" else F.col(f"w.{c}") for c in words.columns])


def word_speakers(words: DataFrame, turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """Words with spk, by the rules of ``words.word_speakers``.

    Turns meet chunks, not words: a chunk gets those within reach of its words as one row of cells, as long as its
    turns are many. The only look along the whole video is the last known speaker.
    """
    folder = shared_dir(words.sparkSession)
    length = (F.col("end_ms") - F.col("start_ms") >= SEG.min_turn).cast("int")
    real = scan(turns.withColumn("__long", length), {"__some": overall(F.col("__long"))}, size).where("__long = 1 or __some = 0").drop("__long", "__some")
    timed = chunked(word_ends(words.drop("spk"), size, folder), size)
    reach = timed.groupBy(*CELL).agg(F.min("t_ms").alias("start_ms"), F.max(F.greatest("t_ms", "end_ms")).alias("end_ms"))
    ends = real.select("vid", "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), F.col("end_ms").alias("off"), "speaker")
    near = bucket_join(reach, ends, touch=1000).select(
        F.struct(*CELL).alias("vid"), F.col("r_start_ms").alias("start_ms"), F.col("r_off").alias("end_ms"), F.col("r_speaker").alias("speaker")
    )
    cells = filed(near, F.struct("start_ms", "end_ms", "speaker")).select("vid.*", "lo", "width", "cells")
    known = heard(brought(timed, stored(cells, f"{folder}/cells"))).drop("__c").withColumnRenamed("known", "__known")
    filled = scan(known, {"__spk": last(F.col("__known"), own=True)}, size, folder)
    first = real.groupBy("vid").agg(F.min_by("speaker", F.struct("start_ms", "seq")).alias("__first"))
    return filled.join(first, "vid", "left").withColumn("spk", F.coalesce("__spk", "__first", F.lit("SPEAKER_00"))).drop("__spk", "__known", "__first")
