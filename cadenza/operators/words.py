"""Word streams: cleaning, timing, sessionizing into segments, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import script as S
from ..params import SEG, SENTENCE_END
from .intervals import bucket_join, islands


def in_order() -> WindowSpec:
    """A video's rows in order of seq."""
    return Window.partitionBy("vid").orderBy("seq")

#: Marks of caption chrome, and invisible characters.
CHROME = r"[\[\(][^\]\)]{0,40}[\]\)]"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"


def clean_tokens(words: DataFrame) -> DataFrame:
    """caption tokens without chrome and marks, with brk where a speaker mark stood; empty ones go."""
    text = F.regexp_replace("text", ">>+", " ")
    text = F.regexp_replace(F.regexp_replace(text, CHROME, " "), INVISIBLE, "")
    text = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return words.withColumns({"brk": F.col("text").contains(">>"), "text": text}).where("text <> ''")


def confident(chunks: DataFrame, least: float = -0.5) -> DataFrame:
    """decoded chunks whose mean log-probability is not below ``least``; unknown ones stay."""
    return chunks.where(F.col("avg_logprob").isNull() | (F.col("avg_logprob") >= least))


def word_ends(words: DataFrame) -> DataFrame:
    """end_ms measured or the longest a word may take, not past the next onset, 20 ms at least."""
    following = F.lead("t_ms").over(in_order())
    end = F.coalesce("end_ms", F.col("t_ms") + SEG.word_max)
    return words.withColumn("end_ms", F.greatest(F.least(end, F.coalesce(following, end)), F.col("t_ms") + 20))


def speech_gaps(words: DataFrame) -> DataFrame:
    """gap_ms of silence before each word; without a measured end one is guessed from the word's length."""
    guess = F.col("t_ms") + F.least(F.lit(SEG.word_max), 100 + 60 * F.length("text"))
    previous = F.lag(F.coalesce("end_ms", guess)).over(in_order())
    return words.withColumn("gap_ms", F.greatest(F.lit(0), F.col("t_ms") - previous))


def speaker_blocks(turns: DataFrame) -> DataFrame:
    """Maximal runs of turns of one speaker: vid, block, speaker, first, last."""
    changed = ~F.lag("speaker").over(in_order()).eqNullSafe(F.col("speaker"))
    return islands(turns, "vid", ["seq"], changed, "block").groupBy("vid", "block").agg(
        F.min("speaker").alias("speaker"), F.min("seq").alias("first"), F.max("seq").alias("last")
    )


def embedded_target(words: DataFrame, src: str, tgt: str) -> DataFrame:
    """Words with bucket and embedded, true in target-script runs of fewer than three words."""
    marked = words.withColumn("bucket", S.text_bucket(F.col("text"), src, tgt)).withColumn("__tg", F.col("bucket").eqNullSafe("target"))
    # A run's length is told by the nearest words on either side, so runs need no order of their own.
    near = {0: F.col("__tg")} | {
        sign * i: F.coalesce(look("__tg", i).over(in_order()), F.lit(False)) for i in range(1, SEG.foreign_min_words) for sign, look in ((-1, F.lag), (1, F.lead))
    }
    seen = marked.withColumns({f"__n{i}": x for i, x in near.items()})
    long = F.lit(False)
    for first in range(1 - SEG.foreign_min_words, 1):
        stretch = F.lit(True)
        for i in range(first, first + SEG.foreign_min_words):
            stretch = stretch & F.col(f"__n{i}")
        long = long | stretch
    return seen.withColumn("embedded", F.col("__tg") & ~long).drop("__tg", *[f"__n{i}" for i in near])


def sessions(words: DataFrame, src: str = "he", tgt: str = "en") -> DataFrame:
    """Words with their group: a pause, a mark, a confirmed speaker change, a script change, or a
    sentence end before a word starts one.

    A speaker change counts only in streams without marks and with a pause of 250 ms. Embedded words
    neither change nor set the script.
    """
    marked = speech_gaps(embedded_target(words, src, tgt))
    own = F.when(~F.col("embedded"), F.col("bucket"))
    context = F.last(own, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    marks = F.max(F.coalesce("brk", F.lit(False))).over(Window.partitionBy("vid"))
    starts = (
        F.lag("seq").over(in_order()).isNull()
        | (F.col("gap_ms") >= SEG.gap)
        | F.coalesce("brk", F.lit(False))
        | (~marks & ~F.lag("spk").over(in_order()).eqNullSafe(F.col("spk")) & (F.col("gap_ms") >= SEG.speaker_gap))
        | F.coalesce(own != context, F.lit(False))
        | F.coalesce(F.lag("text").over(in_order()).rlike(SENTENCE_END), F.lit(False))
    )
    return islands(marked, "vid", ["seq"], starts, "segment")


def _weight() -> Column:
    return F.sum(F.greatest(F.lit(SEG.word_overlap), F.col("end_ms") - F.col("t_ms")))


def _speaker() -> Column:
    return F.max_by("spk", F.struct("weight", -F.col("first")))


def majority_speaker(words: DataFrame) -> DataFrame:
    """A1: (vid, segment, speaker): the speaker with the most time, a word counting 50 ms at least; the
    first heard wins ties."""
    weights = words.groupBy("vid", "segment", "spk").agg(_weight().alias("weight"), F.min("seq").alias("first"))
    return weights.groupBy("vid", "segment").agg(_speaker().alias("speaker"))


def line_speaker(words: str) -> Column:
    """A1 of one segment's words, an array."""
    def votes(spk: Column) -> Column:
        own = F.filter(words, lambda w: w["spk"].eqNullSafe(spk))
        weight = F.aggregate(own, F.lit(0).cast("long"), lambda total, w: total + F.greatest(F.lit(SEG.word_overlap), w["end_ms"] - w["t_ms"]))
        return F.struct(weight.alias("weight"), (-F.get(own, F.lit(0))["seq"]).alias("first"), spk.alias("spk"))

    heard = F.array_distinct(F.transform(words, lambda w: w["spk"]))
    return F.when(F.size(heard) == 1, heard[0]).otherwise(F.array_max(F.transform(heard, votes))["spk"])


def segments_of(words: DataFrame) -> DataFrame:
    """Segments of sessionized words: vid, segment, start_ms, end_ms, speaker, text, n_words.

    The text joins the words in order, without a space at seams of unspaced scripts; the words of one
    segment, a few dozen, are gathered in one row.
    """
    # Speakers are counted and gathered in one pass over the words; a segment's rows lie together from the first.
    spoken = words.where("vid is not null").groupBy("vid", "segment", "spk").agg(
        _weight().alias("weight"), F.min("seq").alias("first"), F.min("t_ms").alias("t_ms"), F.max(F.struct("seq", "end_ms")).alias("last"),
        F.collect_list(F.struct("seq", "text")).alias("parts"), F.count("*").alias("n"),
    )
    line = S.join_words(F.transform(F.sort_array(F.flatten(F.collect_list("parts"))), lambda w: w["text"]))
    return spoken.groupBy("vid", "segment").agg(
        F.min("t_ms").alias("start_ms"), F.max("last")["end_ms"].alias("end_ms"), line.alias("text"), F.sum("n").alias("n_words"), _speaker().alias("speaker")
    )


def without_echoes(words: DataFrame) -> DataFrame:
    """Words without those decoded twice: the same word starting over 50 ms before its twin ends."""
    key = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_]", ""))
    keyed = islands(words.withColumn("key", key), "vid", ["seq"], ~F.lag("key").over(in_order()).eqNullSafe(F.col("key")), "run")
    twin = F.max("end_ms").over(Window.partitionBy("vid", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    marked = keyed.withColumn("echo", (F.col("key") != "") & F.coalesce(F.col("t_ms") < twin - 50, F.lit(False)))
    kept = islands(marked, "vid", ["seq"], ~F.col("echo"), "kept")
    end = F.max("end_ms").over(Window.partitionBy("vid", "kept"))
    return kept.withColumn("end_ms", end).where("not echo").drop("key", "run", "echo", "kept")


def without_seam_duplicates(words: DataFrame) -> DataFrame:
    """A word with the text of the one before it and less than 50 ms after it goes."""
    same = F.lag("text").over(in_order()).eqNullSafe(F.col("text")) & (F.col("t_ms") - F.lag("t_ms").over(in_order()) < 50)
    return words.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").drop("same")


def joined_marks(words: DataFrame) -> DataFrame:
    """K3: words split at a mark put together again, up to 400 ms apart and not after a sentence end."""
    joins = (
        F.col("text").rlike(r"^['׳`’\-–]")
        & F.coalesce(~F.lag("text").over(in_order()).rlike(r"[.!?]$") & (F.lag("text").over(in_order()) != ""), F.lit(False))
        & F.coalesce(F.col("t_ms") - F.lag(F.coalesce("end_ms", "t_ms")).over(in_order()) <= 400, F.lit(False))
        & ~F.coalesce("brk", F.lit(False))
    )
    parts = islands(words, "vid", ["seq"], ~joins, "whole")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), "")
    return parts.groupBy("vid", "whole").agg(
        F.min("seq").alias("seq"), F.min("t_ms").alias("t_ms"), F.max_by("end_ms", "seq").alias("end_ms"), text.alias("text")
    ).drop("whole")


def real_turns(turns: DataFrame) -> DataFrame:
    """Turns of at least 400 ms; all turns of a video that has none."""
    long = (F.col("end_ms") - F.col("start_ms") >= SEG.min_turn).cast("int")
    some = F.max(long).over(Window.partitionBy("vid"))
    return turns.withColumn("long", long).withColumn("some", some).where("long = 1 or some = 0").drop("long", "some")


def turn_boundaries(turns: DataFrame) -> DataFrame:
    """(vid, at_ms, protect): cuts at handovers between real turns and in the middle of long silences."""
    by = Window.partitionBy("vid").orderBy("start_ms", "seq")
    gap = F.lead("start_ms").over(by) - F.col("end_ms")
    long = (F.col("end_ms") - F.col("start_ms") >= SEG.min_turn).cast("int")
    seen = turns.withColumns({"gap": gap, "long": long, "some": F.max(long).over(Window.partitionBy("vid"))})
    real = seen.withColumn("real", F.coalesce(F.expr("long = 1 or some = 0"), F.lit(False)))
    # The real turn before, in a box that holds a speaker without a name too.
    before = F.last(F.when(F.col("real"), F.struct("speaker")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    told = real.withColumn("before", before["speaker"])
    silent = F.when(F.col("gap") >= SEG.turn_gap, F.struct((F.col("end_ms") + F.expr("gap div 2")).alias("at_ms"), F.lit(True).alias("protect")))
    handed = F.when(F.col("real") & (F.col("before") != F.col("speaker")), F.struct(F.col("start_ms").alias("at_ms"), F.lit(False).alias("protect")))
    return told.select("vid", F.explode(F.array_compact(F.array(silent, handed))).alias("at")).select("vid", "at.at_ms", "at.protect")


def gathered(words: DataFrame) -> DataFrame:
    """One row a segment: vid, segment, words, its words in order with all their other columns."""
    others = [c for c in words.columns if c not in ("vid", "segment", "seq")]
    return words.groupBy("vid", "segment").agg(F.sort_array(F.collect_list(F.struct("seq", *others))).alias("words"))


def split_at_turns(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessionized words with brk and piece: segments cut at turn boundaries that fall inside them.

    A word lies on the side of its midpoint; each side keeps a word. Protected cuts set brk.
    """
    # Outer, as from an inner explode Spark infers that the words are some, and asks so by making the cuts anew for every word.
    cut = cut_at_turns(gathered(words), turns).select("vid", "segment", F.explode_outer("words").alias("w"))
    return cut.select(*[F.col("w")[c].alias(c) if c not in ("vid", "segment") else c for c in words.columns if c != "brk"], "w.piece", "w.brk")


def cut_at_turns(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """``lines`` of ``gathered`` whose words have brk and piece by the rules of ``split_at_turns``.

    A video's boundaries come to its segments as one row of cells of time, where they lie in equal parts nothing is moved.
    """
    points = turn_boundaries(turns).select("vid", F.col("at_ms").alias("start_ms"), F.col("at_ms").alias("end_ms"), "protect")
    n = F.size("words")
    spans = lines.withColumns({"__a": F.array_min(F.transform("words", lambda w: w["t_ms"])), "__b": F.element_at("words", -1)["end_ms"]})
    first, last = F.expr("greatest(0L, (__a - lo) div width)"), F.expr("(__b - lo) div width")
    near = F.flatten(F.slice("cells", (first + 1).cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int")))
    inside = F.filter(near, lambda p: (F.col("__a") < p["start_ms"]) & (p["start_ms"] < F.col("__b")))
    met = spans.join(filed(points, F.struct("start_ms", "protect")), "vid", "left").withColumn("__points", F.when(n >= 2, inside))

    def place(p: Column) -> Column:
        sooner = F.size(F.filter("words", lambda w: w["t_ms"] + w["end_ms"] < 2 * p["start_ms"]))
        return F.struct(F.least(F.greatest(sooner, F.lit(1)), n - 1).alias("i"), p["protect"].alias("protect"))

    placed = met.withColumn("__cuts", F.transform("__points", place))
    names = [f.name for f in lines.schema["words"].dataType.elementType.fields if f.name not in ("brk", "piece")]

    def marked(w: Column, j: Column) -> Column:
        sooner = F.array_distinct(F.transform(F.filter("__cuts", lambda c: c["i"] <= j), lambda c: c["i"]))
        brk = F.exists("__cuts", lambda c: (c["i"] == j) & c["protect"])
        return F.struct(*[w[c].alias(c) for c in names], F.size(sooner).cast("long").alias("piece"), brk.alias("brk"))

    def whole(w: Column) -> Column:
        return F.struct(*[w[c].alias(c) for c in names], F.lit(0).cast("long").alias("piece"), F.lit(False).alias("brk"))

    cut = F.when(F.size("__cuts") > 0, F.transform("words", marked)).otherwise(F.transform("words", whole))
    return placed.withColumn("words", cut).select(*lines.columns)


#: Least width in ms of the cells that a video's turns are filed under.
CELL_MS = 10_000


def filed(spans: DataFrame, held: Column, **others: Column) -> DataFrame:
    """One row a video: lo, width, ``others``, and cells, each an array of what is ``held`` of the spans that meet it.

    Cells are as wide as makes no more than four to a span, so a video's row is as long as its spans are many.
    """
    video = Window.partitionBy("vid")
    names = list(others)
    sized = spans.withColumns({
        "lo": F.min("start_ms").over(video), "hi": F.max(F.greatest("start_ms", "end_ms")).over(video), "n": F.count("*").over(video)
    } | {c: x.over(video) for c, x in others.items()}).withColumn("width", F.greatest(F.lit(CELL_MS), F.ceil((F.col("hi") - F.col("lo")) / (4 * F.col("n")))))
    placed = sized.select(
        "vid", "lo", "width", *names, F.explode(F.expr("sequence((start_ms - lo) div width, (greatest(start_ms, end_ms) - lo) div width)")).alias("cell"), held.alias("one")
    )
    some = placed.groupBy("vid", "lo", "width", *names, "cell").agg(F.collect_list("one").alias("held"))
    # Cells that nothing meets lie behind the one before them.
    following = F.coalesce(F.lead("cell").over(video.orderBy("cell")) - 1, F.col("cell"))
    full = some.withColumn("to", following).select("vid", "lo", "width", *names, "cell", "held", F.explode(F.sequence("cell", "to")).alias("at"))
    own = F.when(F.col("at") == F.col("cell"), F.col("held")).otherwise(F.expr("slice(held, 1, 0)"))
    return full.groupBy("vid", "lo", "width", *names).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", own.alias("held")))), lambda c: c["held"]).alias("cells"))


def filed_turns(turns: DataFrame) -> DataFrame:
    """``filed`` turns, with first, the earliest turn's speaker."""
    return filed(turns, F.struct("start_ms", "end_ms", "speaker"), first=F.min_by("speaker", F.struct("start_ms", "seq")))


def heard(timed: DataFrame) -> DataFrame:
    """Words with known, the speaker that ``filed`` turns (lo, width, cells) tell, in place of these: by overlap, else by the nearest edge."""
    first, last = F.expr("greatest(0L, (t_ms - 500 - lo) div width)"), F.expr("(end_ms + 500 - lo) div width")
    near = F.flatten(F.slice("cells", (first + 1).cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int")))
    met = timed.withColumn("near", near).drop("lo", "width", "cells")

    def covering(r: Column) -> Column:
        cover = F.least("end_ms", r["end_ms"]) - F.greatest("t_ms", r["start_ms"])
        return F.when(cover > 0, F.struct(cover, -r["start_ms"], r["speaker"].alias("speaker")))

    def edge(r: Column, at: str) -> Column:
        # Twice the times keeps halves of milliseconds exact.
        past = 2 * r[at] - F.col("t_ms") - F.col("end_ms")
        return F.when(r["speaker"].isNotNull() & (F.abs(past) <= 1000), F.struct(F.abs(past), past > 0, r["start_ms"], r["speaker"].alias("speaker")))

    own = F.array_max(F.transform("near", covering))["speaker"]
    closest = lambda at: F.array_min(F.transform("near", lambda r: edge(r, at)))
    return met.withColumn("own", own).withColumn(
        "known", F.when(F.col("own").isNotNull(), F.col("own")).otherwise(F.least(closest("start_ms"), closest("end_ms"))["speaker"])
    ).drop("near", "own")


def word_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words with spk: the real turn that overlaps most, else the nearest turn edge within 500 ms of
    the midpoint, else the speaker of the word before.

    Looks at all turns, which equals a look at the nearby ones where turns do not overlap. A video's turns
    come to its words as one row of cells of time; a word reads the cells that it and the 500 ms reach, so
    words are neither moved nor multiplied.
    """
    known = heard(word_ends(words).drop("spk").join(filed_turns(real_turns(turns)), "vid", "left"))
    return known.withColumn(
        "spk", F.coalesce(F.last("known", ignorenulls=True).over(in_order()), F.col("first"), F.lit("SPEAKER_00"))
    ).drop("known", "first")


def snapped_handoffs(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """A segment after a speaker change starts at its speaker's turn onset, if one lies up to 300 ms
    before it and not before the previous segment's end.

    Of turns that still sound at the start the latest onset counts; time buckets bring the two together.
    """
    marked = segments.withColumns(
        {"prev_end": F.coalesce(F.lag("end_ms").over(in_order()), F.lit(0)), "handed": ~F.lag("speaker").over(in_order()).eqNullSafe(F.col("speaker"))}
    )
    lower = F.greatest("prev_end", F.col("start_ms") - SEG.snap)
    reach = marked.where("handed").select("vid", "seq", "speaker", F.col("start_ms").alias("start"), lower.alias("start_ms"), F.col("start_ms").alias("end_ms"))
    onsets = real_turns(turns).select("vid", "speaker", "start_ms", F.col("start_ms").alias("end_ms"), F.col("end_ms").alias("off"))
    hits = bucket_join(reach, onsets, touch=1).where(
        (F.col("speaker") == F.col("r_speaker")) & (F.col("r_off") > F.col("start")) & (F.col("r_start_ms") >= F.col("start_ms")) & (F.col("r_start_ms") < F.col("start") - 20)
    )
    best = hits.groupBy("vid", "seq").agg(F.max("r_start_ms").alias("snap"))
    return marked.join(best, ["vid", "seq"], "left").withColumn("start_ms", F.coalesce("snap", "start_ms")).drop("prev_end", "handed", "snap")


def target_runs(words: DataFrame, src: str, tgt: str, min_ms: int = 800, join_ms: int = 2000) -> DataFrame:
    """Spans of words in the target script, onsets at most 2 s apart, 0.8 s long at least."""
    own = words.where(S.text_is_target(F.col("text"), src, tgt))
    gap = F.col("t_ms") - F.lag("t_ms").over(in_order())
    runs = islands(own, "vid", ["seq"], gap.isNull() | (gap > join_ms), "run")
    return runs.groupBy("vid", "run").agg(
        F.min("t_ms").alias("start_ms"), (F.max("t_ms") + 800).alias("end_ms"), F.count("*").alias("n_words")
    ).where(F.col("end_ms") - F.col("start_ms") >= min_ms).drop("run")
