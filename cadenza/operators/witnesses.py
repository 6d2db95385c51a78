"""Languages, witnesses and candidates: what a segment is spoken in, and which of several lines to take."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textqc as X
from ..functions.script import contradicts_source
from .fold import ordered_fold


def decoded_words(chunks: DataFrame) -> DataFrame:
    """vid, seq, t_ms, end_ms, text, p of decoded chunks (vid, chunk, offset_ms, words).

    Words take their chunk's offset, last 20 ms at least, and count as certain where no confidence is given.
    """
    flat = chunks.select("vid", "chunk", "offset_ms", F.posexplode("words").alias("k", "w"))
    t = F.col("w.start_ms") + F.col("offset_ms")
    rows = flat.where(F.trim("w.text") != "").select(
        "vid", "chunk", "k", t.alias("t_ms"), F.greatest(F.col("w.end_ms") + F.col("offset_ms"), t + 20).alias("end_ms"), F.trim("w.text").alias("text"), F.coalesce("w.p", F.lit(1.0)).alias("p")
    )
    by = Window.partitionBy("vid").orderBy("chunk", "k")
    return rows.select("vid", (F.row_number().over(by) - 1).cast("long").alias("seq"), "t_ms", "end_ms", "text", "p")


def language_pair(source: str, target: str) -> tuple[Column, Column, Column]:
    """A segment's source and target language and whether it goes by way of English.

    The user's override comes first, then what was heard, then the declared source unless the text refutes
    it; an unknown source is empty and never goes by way of English.
    """
    def given(name: str) -> Column:
        return F.nullif(F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))), F.lit(""))

    src = F.coalesce(given("src_lang"), given("lang"), F.when(contradicts_source(F.col("text"), source), "").otherwise(source))
    tgt = F.coalesce(given("tgt_lang"), F.lit(target))
    return src, tgt, (src != "") & (src != tgt) & (src != "en") & (tgt != "en")


def nearest_speaker(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans (vid, seq, start_ms, end_ms) with the speaker of the segment nearest in time.

    The segments before and after a span come from one ordered pass; the earlier wins ties. Where a video
    has none the speaker is null.
    """
    a = spans.select("vid", "seq", "start_ms", "end_ms", F.lit(None).cast("struct<end_ms: bigint, speaker: string, start_ms: bigint>").alias("s"))
    b = segments.select("vid", F.lit(None).cast("long").alias("seq"), "start_ms", "end_ms", F.struct("end_ms", "speaker", "start_ms").alias("s"))
    # Both looks go back in their order: a look ahead to the end would be made anew for every row.
    low = Window.partitionBy("vid").orderBy("start_ms", F.col("seq").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    high = Window.partitionBy("vid").orderBy(F.desc("start_ms"), F.col("seq").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumns({"low": F.last("s", ignorenulls=True).over(low), "high": F.last("s", ignorenulls=True).over(high)}).where("seq is not null")
    below, above = F.greatest(F.lit(0), F.col("start_ms") - F.col("low.end_ms")), F.greatest(F.lit(0), F.col("high.start_ms") - F.col("end_ms"))
    pick = F.when(below.isNull() | (above < below), F.col("high.speaker")).otherwise(F.col("low.speaker"))
    return both.select("vid", "seq", pick.alias("speaker"))


def keeps_extended(keeps: DataFrame, levels: DataFrame, floor: float = 0.008, most: int = 25, quiet: int = 4, hop_ms: int = 100) -> DataFrame:
    """Keeps (vid, seq, end_ms, limit_ms) ending with the last loud frame before a pause of ``quiet`` frames.

    At most ``most`` frames are reclaimed, none from ``limit_ms`` on, where the next segment starts.
    """
    first = F.ceil(F.col("end_ms") / hop_ms)
    last = F.least(first + most, F.floor(F.col("limit_ms") / hop_ms)) - 1
    framed = keeps.withColumns({"a": first, "b": last}).where("b >= a").withColumn("frame", F.explode(F.sequence("a", "b"))).join(levels, ["vid", "frame"])
    by = Window.partitionBy("vid", "seq").orderBy("frame")
    silent = F.col("frame") - F.coalesce(F.max(F.when(F.col("rms") >= floor, F.col("frame"))).over(by), F.col("a") - 1)
    stop = F.min(F.when(F.col("silent") >= quiet, F.col("frame"))).over(Window.partitionBy("vid", "seq"))
    heard = framed.withColumn("silent", silent).withColumn("stop", stop).where((F.col("rms") >= floor) & (F.col("stop").isNull() | (F.col("frame") < F.col("stop"))))
    new = heard.groupBy("vid", "seq").agg(((F.max("frame") + 1) * hop_ms).alias("new_end"))
    return keeps.join(new, ["vid", "seq"], "left").select("vid", "seq", F.greatest("end_ms", F.coalesce("new_end", "end_ms")).alias("end_ms"))


def chosen_line(candidates: DataFrame) -> DataFrame:
    """(vid, seq, line) of candidate lines (vid, seq, attempt, src, out): the first clean one, else empty.

    A clean line with an adjacent repeat yields to a later clean one without, and is else stripped of it.
    """
    clean = ~X.not_a_translation(F.col("out"), F.col("src")) & (F.trim(F.coalesce("out", F.lit(""))) != "")
    marked = candidates.withColumns({"clean": clean, "twice": X.adjacent_repeat(F.col("out")).isNotNull()})
    first = marked.groupBy("vid", "seq").agg(
        F.min_by("out", F.when(F.col("clean"), F.col("attempt"))).alias("any"), F.min_by("out", F.when(F.col("clean") & ~F.col("twice"), F.col("attempt"))).alias("once")
    )
    return first.select("vid", "seq", F.coalesce("once", F.when(F.col("any").isNotNull(), X.without_adjacent_repeat(F.col("any"))), F.lit("")).alias("line"))


def interjection(lexicon: tuple[str, ...], most_ms: int = 1500, most_words: int = 2) -> Column:
    """a segment of its own of at most two words and 1.5 s, every word of them in the lexicon."""
    words = F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda x: x != "")
    known = F.array(*[F.lit(x) for x in lexicon])
    bare = F.transform(words, lambda x: F.regexp_replace(x, r"^[\"'.,!?…–—()\-]+|[\"'.,!?…–—()\-]+$", ""))
    return (F.col("end_ms") - F.col("start_ms") <= most_ms) & (F.size(words).between(1, most_words)) & F.forall(bare, lambda x: F.array_contains(known, x))


def with_worker(rows: DataFrame, work: Callable[[list[str]], list[str]]) -> DataFrame:
    """UF4: (id, text) with reply and error of ``work``, called on batches; one bad item spoils no other.

    A batch that fails is asked again item by item, so that each error stands beside its own row.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].to_list()
            try:
                replies, errors = list(work(texts)), [None] * len(texts)
                if len(replies) != len(texts):
                    raise ValueError("as many replies as items are needed")
            except Exception:
                replies, errors = [], []
                for t in texts:
                    try:
                        replies += work([t])
                        errors.append(None)
                    except Exception as problem:
                        replies.append(None)
                        errors.append(f"{type(problem).__name__}: {problem}")
            yield pd.DataFrame({"id": pdf["id"], "reply": replies, "error": errors})

    return rows.select("id", "text").mapInPandas(each, "id bigint, reply string, error string")


def rolling_names(lines: DataFrame, most: int = 12) -> DataFrame:
    """(vid, seq, names): the most recent distinct names as of each segment (vid, seq, text).

    A segment's own names come first, in text order. Only the list is carried from one segment to the next.
    """
    def step(rows: Iterator[dict]) -> Iterator[dict]:
        recent: list[str] = []
        for r in rows:
            recent = list(dict.fromkeys([*r["names"], *recent]))[:most]
            yield {"vid": r["vid"], "seq": r["seq"], "names": recent}

    named = lines.select("vid", "seq", F.coalesce(X.proper_nouns(F.col("text")), F.array().cast("array<string>")).alias("names"))
    return ordered_fold(named, ["vid"], ["seq"], step, "vid bigint, seq bigint, names array<string>")


# Stock lines that speech recognition invents over music.
STOCK = ("thanks for watching", "thank you for watching", "subtitles by", "subtitle by", "спасибо за просмотр", "продолжение следует")


def without_stock_phrases(words: DataFrame, gap_ms: int = 1000, reach_ms: int = 4000) -> DataFrame:
    """Words without stock phrases and the words around them, up to 4 s off and no pause of 1 s between."""
    by = Window.partitionBy("vid").orderBy("seq")
    keyed = words.withColumn("key", F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_]", "")))
    hit = F.lit(False)
    for phrase in STOCK:
        tokens = phrase.split()
        for at in range(len(tokens)):  # the word may be any of the phrase's
            same = [F.coalesce((F.lead("key", i - at) if i > at else F.lag("key", at - i)).over(by) == t, F.lit(False)) if i != at else F.col("key") == t for i, t in enumerate(tokens)]
            whole = same[0]
            for s in same[1:]:
                whole = whole & s
            hit = hit | whole
    pause = F.col("t_ms") - F.lag(F.coalesce("end_ms", "t_ms")).over(by)
    marked = keyed.withColumns({"hit": hit, "opens": F.coalesce(pause > gap_ms, F.lit(True)).cast("int")}).withColumn("run", F.sum("opens").over(by))
    inside, back = Window.partitionBy("vid", "run").orderBy("seq"), Window.partitionBy("vid", "run").orderBy(F.desc("seq"))
    when = F.when(F.col("hit"), F.col("t_ms"))
    before = F.last(when, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(when, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    near = F.coalesce(F.col("t_ms") - before <= reach_ms, F.lit(False)) | F.coalesce(after - F.col("t_ms") <= reach_ms, F.lit(False))
    return marked.withColumn("near", near).where("not near").select(*words.columns)


def _look_ups(word: Column) -> Column:
    """The word and all that is left of it without one letter: words that are one edit apart share one of these."""
    n = F.length(word)
    places = F.sequence(F.lit(1), n)
    without = F.transform(places, lambda i: F.concat(F.lit("-"), F.substring(word, 1, i - 1), F.substring(word, i + 1, n)))
    return F.array_append(without, F.concat(F.lit("-"), word))


def relevant_clauses(segments: DataFrame, clauses: DataFrame, script: str = "hebrew", exact: int = 4, loose: int = 5, fold: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(vid, seq, note): the clauses of a video's note that belong to each segment.

    ``clauses`` has (vid, k, clause). A clause without a word in the source script is background and belongs
    to all. One with such words belongs where one of them is said: words of ``exact`` letters as they are,
    of ``loose`` or more also inside a word or one edit from it. Edits are counted on ``fold`` of both words,
    for letters that count as one another.

    Words meet by keys, never all with all. Words one edit apart share a word of which at most one letter is
    left out; one that lies inside another has its first ``loose`` letters there. Only words that share a
    key are compared, each different word of a video once however often it is said.
    """
    from ..functions.script import count_letters, letters

    def own(x: Column) -> Column:
        return (letters(x) > 0) & (count_letters(x, script) * 2 > letters(x))

    told = clauses.withColumn("words", F.filter(X.words(F.lower("clause")), own))
    said = segments.select("vid", "seq", F.explode(F.array_distinct(X.words(F.lower("text")))).alias("token"))
    wanted = told.select("vid", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") >= exact).distinct()
    tokens = said.select("vid", "token").distinct().where(F.length("token") >= min(exact, loose - 1))

    grams = F.when(F.length("token") >= loose, F.transform(F.sequence(F.lit(1), F.length("token") - (loose - 1)), lambda i: F.substring(F.col("token"), i, F.lit(loose)))).otherwise(F.array().cast("array<string>"))
    filed = tokens.withColumn("key", F.explode(F.array_union(F.array_append(_look_ups(fold(F.col("token"))), F.concat(F.lit("-"), F.col("token"))), grams)))
    first = F.when(F.length("word") >= loose, F.array_append(_look_ups(fold(F.col("word"))), F.substring("word", 1, loose))).otherwise(F.array(F.concat(F.lit("-"), F.col("word"))))
    asked = wanted.withColumn("key", F.explode(first))
    like = F.when(F.length("word") < loose, F.col("token") == F.col("word")).otherwise(F.col("token").contains(F.col("word")) | (F.levenshtein(fold(F.col("token")), fold(F.col("word")), 1) >= 0))
    alike = filed.join(asked, ["vid", "key"]).where(like).select("vid", "token", "word").distinct()

    naming = told.select("vid", "k", "clause", F.explode(F.array_distinct("words")).alias("word"))
    named = said.join(alike, ["vid", "token"]).join(naming, ["vid", "word"]).select("vid", "seq", "k", "clause").distinct()
    background = segments.select("vid", "seq").join(told.where(F.size("words") == 0).select("vid", "k", "clause"), "vid")
    notes = named.unionByName(background).groupBy("vid", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "clause"))), lambda c: c["clause"]), "; ").alias("note"))
    return segments.select("vid", "seq").join(notes, ["vid", "seq"], "left").withColumn("note", F.coalesce("note", F.lit("")))


def attempt_plan(segments: DataFrame, canonical: DataFrame, others: DataFrame, references: int = 2) -> DataFrame:
    """(key, rung, ref, greedy): the attempts of each segment (key, speaker), in order.

    Its own window comes first, then up to ``references`` canonical and alternate ones (speaker, ref, place)
    of its speaker that differ, and last its own window with the other decoding.
    """
    own = segments.select("key", F.col("key").alias("ref"), F.lit(0).alias("at"))
    first = segments.join(canonical.select("speaker", F.col("key").alias("ref")), "speaker").select("key", "ref", F.lit(1).alias("at"))
    more = segments.join(others.select("speaker", F.col("key").alias("ref"), "place"), "speaker").select("key", "ref", (F.col("place") + 1).alias("at"))
    distinct = own.unionByName(first).unionByName(more).groupBy("key", "ref").agg(F.min("at").alias("at"))
    by = Window.partitionBy("key").orderBy("at", "ref")
    ladder = distinct.withColumn("rung", F.row_number().over(by) - 1).where(F.col("rung") <= references).select("key", "rung", "ref", F.lit(False).alias("greedy"))
    last = ladder.groupBy("key").agg((F.max("rung") + 1).alias("rung")).select("key", "rung", F.col("key").alias("ref"), F.lit(True).alias("greedy"))
    return ladder.unionByName(last)
