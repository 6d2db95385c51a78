"""Hand-written cases and properties of the rules that no SQL says."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cadenza.functions import script as S
from cadenza.functions import spoken as P
from cadenza.functions import textqc as X
from cadenza.operators import folds as K
from cadenza.operators import intervals as I
from cadenza.operators import timeline as L
from cadenza.operators import witnesses as N
from cadenza.operators import words as W
from cadenza.sources import captions as C
from cadenza.streaming import frames as Frames

WORDS = "vid long, seq long, text string, t_ms long, end_ms long"


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, words", [("これは テスト", ["こ", "れ", "は", "テ", "ス", "ト"]), ("a b", ["a", "b"]), ("", []), (None, [])])
def test_split_words(spark, text, words):
    assert one(spark, S.split_words(F.col("text")), text) == words


def test_join_words_drops_spaces_at_unspaced_seams(spark):
    parts = F.array(*[F.lit(x) for x in ["これ", "は", "test", " ", "one", "。"]])
    assert one(spark, S.join_words(parts)) == "これはtest one。"


@pytest.mark.parametrize("text, src, tgt, want", [("שלום", "he", "en", "source"), ("hello", "he", "en", "target"), ("123", "he", "en", None), ("hola", "en", "es", None)])
def test_text_bucket(spark, text, src, tgt, want):
    assert one(spark, S.text_bucket(F.col("text"), src, tgt), text) == want


@pytest.mark.parametrize("text, want", [
    ("in 1982 we had 4,003 of 21", "in nineteen eighty-two we had four thousand and three of twenty-one"), ("20% off, the 4th", "twenty percent off, the four"),
    ("at 10:30, A4 and 1.2.3 or 5-6", "at 10:30, A4 and 1.2.3 or 5-6"), ("1000000", "one million"), ("no digits", "no digits"), ("A7 and 7, 7% of 17", "A7 and seven, seven percent of seventeen"), ("0", "zero"), ("1,234,567", "one million, two hundred and thirty-four thousand, five hundred and sixty-seven"),
])
def test_spelled_numbers(spark, text, want):
    assert one(spark, X.spelled_numbers(F.col("text")), text) == want


@pytest.mark.parametrize("text, want", [
    ("education and education matter", "education matter"), ("education, education matter", "education matter"), ("Percent. Percent.", "Percent."), ("very very good", "very very good"),
])
def test_without_adjacent_repeat(spark, text, want):
    assert one(spark, X.without_adjacent_repeat(F.col("text")), text) == want


@pytest.mark.parametrize("text, k, want", [("1. one\n2. two", 2, ["one", "two"]), ("1. one\n3. two", 2, None), ("2. a\n1. b", 2, None), ("1) a\n", 1, ["a"])])
def test_numbered_lines(spark, text, k, want):
    assert one(spark, X.numbered_lines(F.col("text"), F.lit(k)), text) == want


@pytest.mark.parametrize("a, b, want", [("Jolani", "Julani", True), ("Iran", "Iraq", False), ("Jabhat al-Nusra", "Jablat al-Nusra", True), ("Golan", "Jolani", False)])
def test_variant_names(spark, a, b, want):
    assert one(spark, X.variant_names(F.lit(a), F.lit(b))) is want


def words(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], WORDS)


def texts(df):
    return [r["text"] for r in df.orderBy("seq").collect()]


def test_loops_collapse_to_one_copy(spark):
    rows = [(w, 100 * i, 100 * i + 90) for i, w in enumerate("a big big big. day to night to night to night x x".split())]
    assert texts(K.loops_collapsed(words(spark, rows))) == "a big day to night x x".split()


def test_stretched_word_goes_with_what_it_swallows(spark):
    rows = [("before", 0, 400), ("lead", 900, 1000), ("long", 1000, 4100), ("in", 1500, 1700), ("vented", 2000, 2300), ("real", 4000, 4300)]
    assert texts(K.stretched_dropped(words(spark, rows))) == ["before", "real"]
    assert texts(K.stretched_dropped(words(spark, [("long", 0, 4000), ("next", 4100, 4300)]))) == ["long", "next"]


def test_flutter_of_turns_is_one_speaker(spark):
    rows = [("A", 0, 540), ("B", 540, 560), ("A", 560, 580), ("B", 580, 600), ("A", 600, 940), ("B", 2000, 5000)]
    turns = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "vid long, seq long, speaker string, start_ms long, end_ms long")
    assert [r["speaker"] for r in K.turns_smoothed(turns).orderBy("seq").collect()] == ["A"] * 5 + ["B"]


def test_stub_joins_its_speaker(spark):
    rows = [("A", "one two three four", 0, 2000, 4, False), ("A", "five", 2300, 2600, 1, False), ("B", "six", 2700, 2900, 1, False), ("A", "seven eight nine ten", 9000, 12000, 4, False)]
    segs = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "vid long, seq long, speaker string, text string, start_ms long, end_ms long, n_words long, brk boolean")
    assert texts(K.stubs_merged(segs)) == ["one two three four five", "six", "seven eight nine ten"]
    marked = segs.withColumn("brk", F.col("seq") == 1)
    assert len(texts(K.stubs_merged(marked))) == 4


def test_torn_opener_joins_its_line(spark):
    rows = [("A", "In", 0, 500, False), ("A", "2013 I was there", 5000, 8000, False), ("A", "Yes.", 8100, 8500, False), ("A", "another line here", 12000, 14000, False)]
    segs = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "vid long, seq long, speaker string, text string, start_ms long, end_ms long, keep boolean")
    got = K.fragments_merged(segs).orderBy("seq").collect()
    assert [(r["text"], r["merged_from"]) for r in got] == [("In 2013 I was there", "0-500"), ("Yes.", None), ("another line here", None)]


def test_long_sentence_is_cut_at_its_pause(spark):
    rows = [("w", 500 * i + (1500 if i >= 20 else 0), 500 * i + (1500 if i >= 20 else 0) + 400) for i in range(40)]
    got = K.long_split(words(spark, rows).withColumn("segment", F.lit(0)), rounds=4).groupBy("piece").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("a").collect()
    assert got[0]["a"] == 0 and 19 in [r["b"] for r in got] and sum(r["b"] - r["a"] + 1 for r in got) == 40


def test_two_voices_need_alternation(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, k, v) for k, v in enumerate([a, b, a, b, a, b])] + [(2, 10 + k, v) for k, v in enumerate([a, a, a, b, b, b])] + [(3, 20 + k, a) for k in range(5)]
    turns = spark.createDataFrame(rows, "run long, key long, vec array<double>")
    got = {}
    for r in K.two_voices(turns).orderBy("key").collect():
        got.setdefault(r["run"], []).append(r["label"])
    assert got == {1: [0, 1, 0, 1, 0, 1], 2: [0] * 6, 3: [0] * 5}


def items(seed):
    rng, t, out = random.Random(seed), 0, []
    for i in range(40):
        t += rng.choice([0, 50, 300, 2000])
        own = rng.randrange(300, 5000)
        out.append({"vid": seed, "seq": i, "source_start": t, "source_end": t + own, "dur_ms": int(own * rng.uniform(0.4, 2.2)), "speaker": rng.choice("AB"), "stretchable": rng.random() < 0.8})
        t += own
    return out


ITEM = "vid long, seq long, source_start long, source_end long, dur_ms long, speaker string, stretchable boolean"


def frame_of(spark, rows):
    return spark.createDataFrame([[r[n.split()[0]] for n in ITEM.split(", ")] for r in rows], ITEM)


def test_placements_never_overlap_and_nothing_is_cut(spark):
    rows = {(r["vid"], r["seq"]): r for seed in range(40) for r in items(seed)}
    for genre, most in (("documentary", 1.3), ("movie", 1.15)):
        places = L.placed(frame_of(spark, rows.values()), genre).orderBy("vid", "seq").collect()
        assert len(places) == len(rows)
        for a, b in zip(places, places[1:]):
            assert a["vid"] != b["vid"] or b["start_ms"] >= a["end_ms"] - 1
        for p in places:
            it = rows[p["vid"], p["seq"]]
            assert abs(p["end_ms"] - p["start_ms"] - it["dur_ms"] / p["rate"]) < 2 + it["dur_ms"] * 1e-3
            assert p["start_ms"] >= it["source_start"] - L.LEAD_MAX - 1 and 0.82 - 1e-9 <= p["rate"] <= most + 1e-9
    assert L.violations(L.placed(frame_of(spark, rows.values())), frame_of(spark, rows.values())).count() == 0


def test_islands_do_not_change_places(spark, monkeypatch):
    """The same places if every video is folded whole."""
    frame = frame_of(spark, [r for seed in range(20) for r in items(seed)])
    apart = {tuple(r) for r in L.placed(frame).collect()}
    whole = L.cut
    monkeypatch.setattr(L, "cut", lambda df, order, opens, touched: whole(df, order, F.lit(False), touched))
    assert {tuple(r) for r in L.placed(frame).collect()} == apart


def test_closed_form_equals_the_fold_without_walls(spark):
    frame = frame_of(spark, [r | {"stretchable": False, "speaker": "A"} for seed in range(5) for r in items(seed)])
    closed = {(r["vid"], r["seq"]): r["start_ms"] for r in L.placed_closed(frame).collect()}
    assert {(r["vid"], r["seq"]): r["start_ms"] for r in L.placed(frame).collect()} == closed


def clips(spark, *rows):
    """Clips from (onset, length, end, speaker, stretchable), times in ms."""
    return frame_of(spark, [dict(vid=1, seq=i, source_start=a, dur_ms=d, source_end=e, speaker=s, stretchable=t) for i, (a, d, e, s, t) in enumerate(rows)])


@pytest.mark.parametrize("rows, want", [
    ([(5000, 4500, 8000, "A", True), (8200, 1000, 9200, "B", True)], lambda p: 4400 <= p[0]["start_ms"] < 5000 and p[0]["end_ms"] <= 8200 and p[0]["overrun_ms"] == 0 and p[1]["start_ms"] == 8200),
    ([(0, 3600, 3000, "A", True), (3200, 1000, 4200, "B", True)], lambda p: p[0]["start_ms"] == 0 and p[0]["rate"] == 1.2 and p[0]["overrun_ms"] == 0 and p[1]["drift_ms"] == 0),
    ([(0, 5000, 2000, "A", True), (2200, 1000, 3200, "B", True)], lambda p: p[0]["rate"] == 1.3 and abs(p[0]["end_ms"] - 5000 / 1.3) < 2 and abs(p[0]["overrun_ms"] - (p[0]["end_ms"] - 2200)) < 2 and p[1]["start_ms"] >= p[0]["end_ms"]),
    ([(0, 3000, 2000, "A", False), (2300, 1000, 3300, "B", True)], lambda p: p[0]["rate"] == 1.0 and p[0]["overrun_ms"] == 700),
    ([(0, 4000, 2000, "A", False), (2100, 800, 2900, "B", True), (3000, 1000, 4000, "C", True)], lambda p: p[1]["rate"] == 1.3 and p[1]["overrun_ms"] > 0),
    ([(0, 4000, 2000, "A", False), (2200, 2300, 4200, "B", True), (7000, 1000, 8000, "C", True)], lambda p: p[0]["overrun_ms"] > 1000 and p[1]["drift_ms"] > 1000 and p[1]["end_ms"] <= 7000 and p[1]["overrun_ms"] == 0 and p[2]["drift_ms"] == 0),
    ([(0, 5200, 3000, "A", True), (3200, 1000, 4200, "A", True)], lambda p: p[0]["start_ms"] == 0 and p[0]["rate"] == 1.3 and p[0]["end_ms"] > 3200 and p[0]["overrun_ms"] == 0),
    ([(0, 5000, 2000, "A", True), (2000, 1000, 3000, "B", True), (6000, 1000, 7000, "B", True)], lambda p: p[1]["drift_ms"] > 0 and p[2]["drift_ms"] == 0 and p[2]["start_ms"] == 6000),
])
def test_walls_and_drift(spark, rows, want):
    frame = clips(spark, *rows)
    places = L.placed(frame).orderBy("seq").collect()
    assert want(places) and L.violations(L.placed(frame), frame).count() == 0


def test_the_end_of_the_media_is_the_last_wall(spark):
    ends = lambda ms: spark.createDataFrame([(1, ms)], "vid long, media_end long")
    one_clip = clips(spark, (5000, 4000, 8000, "A", True))
    assert L.placed(one_clip).first()["end_ms"] > 8000
    walled = L.placed(one_clip, ends=ends(8000)).first()
    assert walled["end_ms"] <= 8000 and walled["overrun_ms"] == 0
    too_long = L.placed(clips(spark, (9000, 6000, 10000, "A", True)), ends=ends(10000)).first()
    assert abs(too_long["end_ms"] - too_long["start_ms"] - 6000 / too_long["rate"]) < 20 and too_long["overrun_ms"] > 0
    two = clips(spark, (1000, 2500, 3000, "A", True), (4000, 1500, 6000, "B", True))
    assert sorted(L.placed(two).collect()) == sorted(L.placed(two, ends=ends(10**9)).collect())


@pytest.mark.parametrize("rows, change", [
    ([(0, 4000, 2000, "A", True), (3000, 1700, 5000, "A", True), (20000, 1000, 21000, "B", True)], True),
    ([(0, 4000, 2000, "A", True), (2100, 1700, 4100, "B", True)], False),
    ([(0, 4000, 2000, "A", True), (2200, 1700, 4200, "B", True), (10000, 1700, 12000, "B", True)], False),
    ([(0, 4000, 2000, "A", False), (3000, 1700, 5000, "A", True), (20000, 1000, 21000, "B", True)], None),
    ([(0, 4000, 2000, "A", True), (2100, 1600, 4000, "A", True), (4200, 1000, 5200, "B", True)], None),
])
def test_rates_of_neighbours_come_together(spark, rows, change):
    frame = clips(spark, *rows)
    before = L.placed(frame, "movie").orderBy("seq").collect()
    after = L.smoothed(frame, L.placed(frame, "movie")).orderBy("seq").collect()
    assert [r["start_ms"] for r in after] == [r["start_ms"] for r in before]
    assert all(b["start_ms"] >= a["end_ms"] - 1 for a, b in zip(after, after[1:]))
    if change is False:
        assert [r["rate"] for r in after] == [r["rate"] for r in before]
    if change:
        assert before[0]["rate"] - before[1]["rate"] > 0.12 >= abs(after[0]["rate"] - after[1]["rate"]) - 1e-6
        assert after[0]["rate"] < before[0]["rate"] and before[1]["rate"] < after[1]["rate"] <= 1
    if not rows[0][4]:
        assert after[0]["rate"] == before[0]["rate"] == 1


def test_the_slow_one_is_raised_where_the_fast_one_has_no_room(spark):
    frame = clips(spark, (0, 1640, 2000, "A", True), (2000, 2600, 4000, "A", True), (4000, 1000, 5000, "B", True))
    places = spark.createDataFrame([(1, 0, 0, 2000, 0.82, 0, 0), (1, 1, 2000, 4000, 1.3, 0, 0), (1, 2, 4000, 5000, 1.0, 0, 0)], L.PLACES)
    assert [r["rate"] for r in L.smoothed(frame, places).orderBy("seq").collect()] == [1.0, 1.3, 1.0]


def test_a_settled_place_keeps_its_walls(spark):
    frame = clips(spark, (5000, 4500, 8000, "A", True), (8200, 1000, 9200, "B", True))
    first, second = L.settled_places(frame).orderBy("seq").collect()
    assert first["start_ms"] < 5000 and first["end_ms"] <= 8200 and second["start_ms"] == 8200 and first["rate"] > 1.01


def test_the_worst_overrunner_is_shortened_once(spark):
    frame = clips(spark, (0, 9000, 3000, "A", True), (3000, 4000, 6000, "B", False), (6000, 3000, 9000, "A", True), (90000, 1000, 91000, "B", True))
    told = frame.withColumns({"units": F.lit(20).cast("long"), "locked": F.lit(False)})
    asked = L.shorten_requests(L.placed(told).alias("p"), told.withColumn("tried", F.lit(False))).collect()
    assert [r["seq"] for r in asked] == [0]
    short = spark.createDataFrame([(1, 0, 6, 2500)], "vid long, seq long, units long, short_ms long")
    got = L.rescued(told, short).orderBy("seq").collect()
    assert [r["shortened"] for r in got] == [True, False, False, False] and got[1]["drift_ms"] == 0
    for other in (told.withColumn("locked", F.lit(True)), told.withColumn("units", F.lit(3).cast("long"))):
        assert not any(r["shortened"] for r in L.rescued(other, short).collect())


def test_every_word_survives_sessionizing(spark, sf):
    from cadenza.sources import tables as T

    stream = W.word_ends(T.words(spark, sf)).withColumn("brk", F.lit(False))
    assert W.segments_of(W.sessions(stream)).agg(F.sum("n_words")).first()[0] == stream.count()


def test_json3_marks_carry_over_and_limit_stops(spark):
    seg = lambda t, o=None, c=None: (t, o, c)
    docs = [(1, [(1000.0, [seg("one"), seg("two", 500.0)]), (2000.0, [seg(">>"), seg("[x]"), seg("three", 0.0, True)]), (1500.0, [seg("four")]), (9000.0, [seg("five")])])]
    got = C.json3_words(spark.createDataFrame(docs, C.JSON3), 5000).orderBy("seq").collect()
    assert [(r["t_ms"], r["text"], r["brk"]) for r in got] == [(1000, "one", False), (1500, "two", False), (2000, "three", True), (2000, "four", False)]


SRT = "1\n00:00:01,000 --> 00:00:03,000\n<i>Hello</i> there\n\n2\n00:00:04,500 --> 00:00:05,500\n[MUSIC] general kenobi\n\n3\n00:00:07,000 --> 00:00:06,000\nbackwards\n"
VTT = "WEBVTT\n\nNOTE x\n\nid\n00:01.000 --> 00:03.000 align:start\n<v Bob>Hello there\n\n00:04.500 --> 00:05.500\ngeneral {\\an8}kenobi\n"


def test_files_are_read_by_kind(spark, tmp_path):
    for name, text in (("a.srt", SRT), ("b.vtt", VTT), ("c.json3", '{"events":[{"tStartMs":1000,"segs":[{"utf8":"hi"}]}]}'), ("d.txt", "no clock"), ("e.srt", "nothing")):
        (tmp_path / name).write_text(text)
    found, rejects = C.read_words(spark, f"file://{tmp_path}")
    got = {}
    for r in found.orderBy("vid", "seq").collect():
        got.setdefault(r["vid"][-5:], []).append((r["t_ms"], r["text"]))
    line = [(1000, "Hello"), (2000, "there"), (4500, "general"), (5000, "kenobi")]
    assert got == {"a.srt": line, "b.vtt": line, "json3": [(1000, "hi")]}
    assert sorted((r["path"][-5:], r["reason"]) for r in rejects.collect()) == [("d.txt", "unknown kind of file"), ("e.srt", "no words")]


def test_options_strip_merge_and_refuse(spark):
    row = spark.createDataFrame([({"seed": "7", "greedy": "false", "speed": "1.2"}, {"speed": None, "greedy": "true", "pitch": "x", "seed": "a"})], "c map<string,string>, u map<string,string>").select(
        X.options_merged(F.col("c"), F.col("u")).alias("m"), X.option_violations(F.col("u")).alias("bad"), X.options_fingerprint(F.create_map().cast("map<string,string>")).alias("none")
    ).first()
    assert row["m"] == {"seed": "a", "greedy": "true"} and row["bad"] == ["pitch", "seed"]
    assert row["none"] == ""


@pytest.mark.parametrize("text, want", [
    ("may the Lord turn his face to you, and be kind, may the Lord turn his face to you.", "may the Lord turn his face to you, and be kind."), ("go on, go on.", "go on, go on."), ("", ""),
])
def test_without_repeated_end(spark, text, want):
    assert one(spark, X.without_repeated_end(F.col("text")), text) == want


@pytest.mark.parametrize("word, want", [("Welcome", "wlkm"), ("hello", "hl"), (None, "")])
def test_latin_skeleton(spark, word, want):
    assert one(spark, X.latin_skeleton(F.col("text")), word) == want


@pytest.mark.parametrize("text, lang, want", [
    ("It is not so", "en", True), ("I don't", "en", True), ("a knot", "en", False), ("я не знаю", "ru", True), ("небо", "ru", False), ("sin ti", "es", True),
    ("il ne va", "fr", True), ("kein Wort", "de", True), ("non lo so", "it", True), ("nonna", "it", False), ("não sei", "pt", True), ("我不知道", "zh", True),
    ("我知道", "zh", False), ("分からない", "ja", True), ("行きません", "ja", True), ("가지 않습니다", "ko", True), ("لم يكن", "ar", True), ("אין דבר", "he", True),
    ("הלאה", "he", False), (None, "zh", False), ("not", "xx", True),
])
def test_negation(spark, text, lang, want):
    assert one(spark, X.negated(F.col("text"), lang), text) is want


@pytest.mark.parametrize("pieces,want", [
    ([(0, 1000, "a", "segment", "A", None), (1000, 5000, "b", "span", "A", None), (5010, 5600, "c", "rest", "A", None)], [("a", 0, 1000), ("b c", 1000, 5600)]),
    ([(9000, 9500, "d", "rest", "A", None), (9520, 12000, "e", "span", "A", None)], [("d e", 9000, 12000)]),
    # Another speaker, another script, a span with a language of its own, too far, too long with three words.
    ([(0, 5000, "b", "span", "A", None), (5010, 5600, "c", "rest", "B", None)], [("b", 0, 5000), ("c", 5010, 5600)]),
    ([(0, 5000, "b", "span", "A", None), (5010, 5600, "שלום", "rest", "A", None)], [("b", 0, 5000), ("שלום", 5010, 5600)]),
    ([(0, 5000, "b", "span", "A", "fr"), (5010, 5600, "c", "rest", "A", None)], [("b", 0, 5000), ("c", 5010, 5600)]),
    ([(0, 5000, "b", "span", "A", None), (5051, 5600, "c", "rest", "A", None)], [("b", 0, 5000), ("c", 5051, 5600)]),
    ([(0, 5000, "b", "span", "A", None), (5000, 7000, "c d e", "rest", "A", None)], [("b", 0, 5000), ("c d e", 5000, 7000)]),
    # Two words may last longer; speakers unknown on both sides are one; a second rest touches the wider span.
    ([(0, 5000, "b", "span", None, None), (5000, 7000, "c d", "rest", None, None), (7040, 7100, "e", "rest", None, None)], [("b c d e", 0, 7100)]),
    ([(0, 5000, "b", "span", "A", None), (5000, 5400, "c", "rest", "B", None), (5400, 5600, "d", "rest", "A", None), (5600, 9000, "e", "span", "A", None)], [("b", 0, 5000), ("c", 5000, 5400), ("d e", 5400, 9000)]),
    ([], []),
])
def test_a_short_rest_joins_the_span_it_touches(spark, pieces, want):
    from cadenza.operators import intervals as I

    rows = [(1, *r) for r in pieces]
    got = I.absorbed_rests(spark.createDataFrame(rows, "vid long, start_ms long, end_ms long, text string, origin string, speaker string, lang string")).orderBy("start_ms").collect()
    assert [(r["text"], r["start_ms"], r["end_ms"]) for r in got] == want


def test_pieces_keep_their_speaker(spark):
    from cadenza.operators import intervals as I

    def table(*rows):
        return spark.createDataFrame(list(rows), "vid long, seq long, start_ms long, end_ms long, text string, speaker string, lang string")
    segs, spans = table((1, 0, 0, 6000, "a b", "A", None)), table((1, 0, 0, 5000, "x", "B", "fr"))
    words = spark.createDataFrame([(1, 0, 5100, 5900, "b")], "vid long, seq long, start_ms long, end_ms long, text string")
    assert sorted(I.spliced(segs, spans, words).select("text", "origin", "speaker", "lang").collect()) == [("b", "rest", "A", None), ("x", "span", "B", "fr")]


def test_long_keys_are_folded_too(spark):
    n = 300_000
    said = spark.range(n).selectExpr("7L AS vid", "id AS seq", "if(id >= 299998 OR id < 100000, 'go', concat('w', id)) AS text", "100 * id AS t_ms", "100 * id + 60 AS end_ms")
    assert K.loops_collapsed(said).count() == n - 100_000 + 4  # runs of four words are tried first
    items = spark.range(n).selectExpr("7L AS vid", "id AS seq", "2000 * id AS source_start", "2000 * id + 900 AS source_end", "2000L AS dur_ms", "'A' AS speaker", "false AS stretchable")
    assert L.placed(items).agg(F.count("*"), F.max("drift_ms")).first()[:] == (n, 100 * (n - 1))


# The rules said over whole lists, for comparison with those over islands.


def plain_loops(rows, longest=4, times=3):
    keys, out, at = [r["text"].strip(".").lower() for r in rows], [], 0
    while at < len(rows):
        for n in range(longest, 0, -1):
            copies = 1
            while keys[at + copies * n : at + (copies + 1) * n] == keys[at : at + n] and at + (copies + 1) * n <= len(keys):
                copies += 1
            if copies >= times:
                out += rows[at : at + n]
                at += copies * n
                break
        else:
            out.append(rows[at])
            at += 1
    return out


def plain_stretched(rows):
    out, left = [], list(rows)
    while left:
        w = left.pop(0)
        nested = [v for v in left if v["t_ms"] < w["end_ms"] - 50]
        if w["end_ms"] - w["t_ms"] <= 2500 or not nested:
            out.append(w)
            continue
        edge, taken = w["t_ms"], 0
        while out and taken < 2 and w["t_ms"] - out[-1]["t_ms"] <= 1000 and edge - out[-1]["end_ms"] < 150:
            edge, taken = out.pop()["t_ms"], taken + 1
        left = [v for v in left if not (v in nested and v["end_ms"] < w["end_ms"] - 250)]
    return out


def plain_smoothed(rows):
    names = [r["speaker"] for r in rows]
    while True:
        edges = [i for i in range(len(rows)) if i == 0 or names[i] != names[i - 1]] + [len(rows)]
        blocks = list(zip(edges, edges[1:]))
        length = [sum(r["end_ms"] - r["start_ms"] for r in rows[a:b]) for a, b in blocks]
        fits = []
        for k in range(1, len(blocks) - 1):
            (_, p), (a, b), (n, _) = blocks[k - 1 : k + 2]
            sides = sorted((length[k - 1], length[k + 1]))
            near = max(rows[a]["start_ms"] - rows[p - 1]["end_ms"], rows[n]["start_ms"] - rows[b - 1]["end_ms"]) <= 600
            if names[p - 1] == names[n] and length[k] < 400 and sides[0] >= length[k] and sides[1] >= 400 and near:
                fits.append((length[k], k))
        if not fits:
            return [r | {"speaker": s} for r, s in zip(rows, names)]
        a, b = blocks[min(fits)[1]]
        names[a:b] = [names[a - 1]] * (b - a)


def plain_stubs(rows):
    rows, weak = list(rows), lambda r: r["end_ms"] - r["start_ms"] < 1200 or r["n_words"] < 3
    while True:
        for at, r in enumerate(rows):
            options = []
            for j in (at - 1, at + 1):
                if weak(r) and 0 <= j < len(rows) and rows[j]["speaker"] == r["speaker"]:
                    gap = r["start_ms"] - rows[j]["end_ms"] if j < at else rows[j]["start_ms"] - r["end_ms"]
                    firm = rows[j]["end_ms"] - rows[j]["start_ms"] >= 1200 or rows[j]["n_words"] >= 3
                    if gap <= (1500 if firm and (r["n_words"] == 1 or r["end_ms"] - r["start_ms"] < 900) else 500):
                        options.append((gap, j))
            if options:
                i = min(at, min(options)[1])
                a, b = rows[i : i + 2]
                if not b["brk"] and b["end_ms"] - a["start_ms"] <= 10_000:
                    rows[i : i + 2] = [a | {"text": f"{a['text']} {b['text']}", "end_ms": b["end_ms"], "n_words": a["n_words"] + b["n_words"]}]
                    break
        else:
            return rows


def plain_fragments(rows):
    done = []
    for r in reversed(rows):
        nxt, text = done[-1] if done else None, r["text"]
        if nxt and not r["keep"] and not nxt["keep"] and r["speaker"] == nxt["speaker"] and 0 < len(text.split()) <= 2 and nxt["text"] and not text.endswith(".") and r["end_ms"] - r["start_ms"] <= 2000 and 2000 <= nxt["start_ms"] - r["end_ms"] <= 8000:
            done[-1] = nxt | {"text": f"{text} {nxt['text']}", "merged_from": ",".join(filter(None, [f"{r['start_ms']}-{r['end_ms']}", nxt["merged_from"]]))}
        else:
            done.append(r)
    return done[::-1]


def plain_names(rows):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def near(a, b):
        a, b = a.split(), b.split()
        return len(a) == len(b) and all(p == q or (min(len(p), len(q)) >= 5 and edits(p, q) <= (1 if min(len(p), len(q)) < 7 else 2)) for p, q in zip(a, b))

    groups = []
    for r in rows:
        home = next((g for g in groups if any(near(r["name"], f["name"]) for f in g)), None)
        groups.append([r]) if home is None else home.append(r)
    return {(f["vid"], f["name"]): min(g, key=lambda f: (-f["n"], f["first"]))["name"] for g in groups for f in g}


def by_video(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vid"], []).append(r)
    return out.values()


def whole(spark, rows, schema, operator, plain):
    """Whether the operator over islands says what the plain rule says of each whole list."""
    names = [x.split()[0] for x in schema.split(", ")]
    frame = spark.createDataFrame([[r[n] for n in names] for r in rows], schema)
    want = [r for part in by_video(rows) for r in plain(part)]
    names = [n for n in names if n in operator(frame).columns]
    got = sorted(tuple(r[n] for n in names) for r in operator(frame).collect())
    assert got == sorted(tuple(r[n] for n in names) for r in want) and want != rows


def test_islands_say_what_whole_lists_say(spark):
    rng = random.Random(11)
    said, turns, segments, names = [], [], [], []
    for vid in range(60):
        t = u = v = 0
        for i in range(60):
            long = rng.random() < 0.08
            said.append(dict(vid=vid, seq=i, text=rng.choice(["a", "b", "a.", "B"] if vid % 2 else "abcdefgh"), t_ms=t, end_ms=t + (rng.choice([3000, 4000]) if long else rng.choice([60, 200, 700]))))
            t += rng.choice([100, 200, 300, 900, 1200])
            n = rng.choice([20, 100, 300, 380, 400, 900])
            turns.append(dict(vid=vid, seq=i, speaker=rng.choice("AB" if vid % 2 else "ABC"), start_ms=u, end_ms=u + n))
            u += n + rng.choice([0, 50, 500, 700])
            w = rng.choice([1, 2, 3, 6])
            segments.append(dict(vid=vid, seq=i, speaker=rng.choice("AAB"), text=" ".join(["w"] * w) + rng.choice(["", "."]), start_ms=v, end_ms=v + 300 * w, n_words=w, brk=rng.random() < 0.1, keep=rng.random() < 0.1, merged_from=None))
            v += 300 * w + rng.choice([0, 400, 800, 1400, 1600, 2500, 6000])
            names.append(dict(vid=vid, name=" ".join(rng.choice(["jolani", "julani", "nusra", "nussra", "iran", "iraq", "jabhatal", "jablatal", "jablatall"]) for _ in range(1 + i % 2)), n=rng.randrange(9), first=i))
    whole(spark, said, "vid long, seq long, text string, t_ms long, end_ms long", K.loops_collapsed, plain_loops)
    whole(spark, said, "vid long, seq long, text string, t_ms long, end_ms long", K.stretched_dropped, plain_stretched)
    whole(spark, turns, "vid long, seq long, speaker string, start_ms long, end_ms long", K.turns_smoothed, plain_smoothed)
    whole(spark, segments, "vid long, seq long, speaker string, text string, start_ms long, end_ms long, n_words long, brk boolean", K.stubs_merged, plain_stubs)
    whole(spark, segments, "vid long, seq long, speaker string, text string, start_ms long, end_ms long, keep boolean, merged_from string", lambda df: K.fragments_merged(df.drop("merged_from")), plain_fragments)
    once = list({(r["vid"], r["name"]): r for r in reversed(names)}.values())
    frame = spark.createDataFrame([[r["vid"], r["name"], r["n"], r["first"]] for r in once], "vid long, name string, n long, first long")
    want = {k: x for part in by_video(sorted(once, key=lambda r: (r["vid"], r["first"], r["name"]))) for k, x in plain_names(part).items()}
    assert {(r["vid"], r["name"]): r["canonical"] for r in K.canonical_names(frame).collect()} == want


def test_long_split_leaves_no_long_piece(spark):
    """Against the rule applied to one piece at a time."""
    rng, rows, t = random.Random(4), [], 0
    for i in range(1500):
        rows.append((7, i, f"w{i}", t, t + 300))
        t += 300 + rng.randrange(250)

    def split(part, piece):
        a, b, n = part[0][3], part[-1][4], len(part)
        if b - a <= 13000 or n < 4:
            return {r[1]: piece for r in part}
        best = None
        for i in range(1, n):
            left, right = part[i - 1][4] - a, b - part[i][3]
            score = (part[i][3] - part[i - 1][4]) * 50 - abs(left - right)
            if left >= 1000 and right >= 1000 and score > -50_000 and (best is None or score > best[0]):
                best = score, i
        cut = best[1] if best else n // 2
        return split(part[:cut], piece + "a") | split(part[cut:], piece + "b")

    got = {r["seq"]: r["piece"] for r in K.long_split(words(spark, [r[2:] for r in rows]).withColumn("segment", F.lit(0))).collect()}
    assert got == split(rows, "") and max(map(len, got.values())) > 3


def test_two_voices_sees_all_vectors(spark, sf):
    from cadenza.plans import folds

    ids = [r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    sizes = {run: sum(i // 9 == run for i in ids) for run in {i // 9 for i in ids}}
    assert folds.k12(spark, sf).count() == sum(n for n in sizes.values() if n >= 3) > 300


@pytest.mark.parametrize("column, want", [
    (lambda: P.ordinal(F.lit(21)), "twenty-first"), (lambda: P.ordinal(F.lit(12)), "twelfth"), (lambda: P.ordinal(F.lit(24)), "twenty-fourth"), (lambda: P.ordinal(F.lit(30)), "thirtieth"),
    (lambda: P.year(F.lit(1907)), "nineteen oh seven"), (lambda: P.year(F.lit(1900)), "nineteen hundred"), (lambda: P.year(F.lit(2003)), "two thousand and three"), (lambda: P.year(F.lit(2000)), "two thousand"), (lambda: P.year(F.lit(2024)), "twenty twenty-four"),
    (lambda: P.digits(F.lit("204")), "two zero four"),
])
def test_spoken_parts(spark, column, want):
    assert one(spark, column()) == want


def test_spoken_pairs_of_all_kinds(spark):
    kind, written, spoken = P.spoken_pair(F.col("id"))
    rows = spark.range(4000).select("id", kind.alias("type"), written.alias("written"), spoken.alias("spoken")).collect()
    shares = {k: sum(r["type"] == k for r in rows) / 40 for k in P.KINDS}
    assert all(abs(shares[k] - w) < 3 for k, w in P.KINDS.items())
    assert not any("-" in r["spoken"] or " and " in r["spoken"] or not r["written"] for r in rows)
    shapes = {"time": r"\d\d:\d\d", "currency": r"\$\d+\.\d\d", "phone": r"\d{3}-\d{3}-\d{4}", "decimal": r"\d+\.\d{1,3}", "number": r"\d+", "date": r".*(19|20)\d\d.*"}
    assert all(re.fullmatch(shapes[r["type"]], r["written"]) for r in rows if r["type"] in shapes)


def segment_rows(spark, rows, schema="vid long, seq long, start_ms long, end_ms long, speaker string"):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("segments, turns, want", [
    ([(5000, 8000, "A"), (8500, 10000, "B")], [(4900, 8100, "A"), (8250, 10100, "B")], [4900, 8250]), ([(5000, 8000, "A"), (9000, 10000, "A")], [(4900, 8100, "A"), (8800, 10100, "A")], [4900, 9000]),
    ([(5000, 8000, "A"), (8200, 12000, "B")], [(4900, 8100, "A"), (7950, 12000, "B")], [4900, 8200]), ([(5000, 8000, "A"), (9000, 12000, "B")], [(4900, 8100, "A"), (8600, 12000, "B")], [4900, 9000]), ([(5000, 8000, "A"), (9000, 12000, "B")], [(4900, 8100, "A"), (9100, 12000, "B")], [4900, 9000]),
])
def test_handoffs_snap_back(spark, segments, turns, want):
    got = W.snapped_handoffs(segment_rows(spark, segments), segment_rows(spark, turns))
    assert [r["start_ms"] for r in got.orderBy("seq").collect()] == want


def gaps_of(spark, levels, segments, target=None, voice=None):
    rows = spark.createDataFrame([(1, i, x, v) for i, (x, v) in enumerate(zip(levels, voice or levels))], "vid long, frame long, rms double, voice double")
    spans = spark.createDataFrame([(1, *s) for s in segments], "vid long, start_ms long, end_ms long")
    return [(r["start_ms"], r["end_ms"]) for r in I.filled_gaps(rows, spans, F.lit(True) if target is None else target).orderBy("start_ms").collect()]


def test_gaps_are_filled_from_the_first_pause(spark):
    levels = [0.09] * 20 + [0.001] * 5 + [0.09] * 40
    assert gaps_of(spark, levels, [(0, 1500)]) == [(2100, 6500)]
    assert gaps_of(spark, [0.09] * 65, [(0, 1500)]) == [(1600, 6500)]
    assert gaps_of(spark, [0.09] * 200, [(0, 2000)], F.col("start_ms") >= 9990) == [(10100, 20000)]
    assert gaps_of(spark, [0.09] * 200, [(0, 2000)], F.lit(False)) == [] and gaps_of(spark, [0.01] * 65, [(0, 1500)]) == []


def test_lines_that_are_no_frames_are_counted(spark):
    lines = spark.createDataFrame([('{"t": 1, "type": "stage"}',), ('{"t": 1, "ty',), ("",), ('{"type": "noise"}',)], "value string")
    frames, seen = Frames.counted(lines)
    assert frames.count() == 1 and seen.get == {"lines": 4, "skipped": 3}


def walked_passages(runs, src, tgt, join_ms=1500):
    """N7 by a walk from each unused run to both sides."""
    used, out = set(), []
    for i, (start, end, lang) in enumerate(runs):
        if lang == src or i in used:
            continue
        a, b, mine = start, end, {i}
        for step in (1, -1) if lang != tgt else ():
            j = i + step
            while 0 <= j < len(runs) and (runs[j][0] - b if step == 1 else a - runs[j][1]) <= join_ms:
                x, y, other = runs[j]
                if other == lang:
                    a, b, mine = min(a, x), max(b, y), mine | {j}
                elif other is not None or y - x > join_ms:
                    break
                j += step
        used |= mine
        out.append((a, b, lang))
    return sorted(out, key=str)


def test_passages_against_a_walk(spark):
    rng, rows, wanted = random.Random(7), [], {}
    for vid in range(60):
        at, runs = 0, []
        for _ in range(rng.randrange(1, 25)):
            at += rng.choice([0, 100, 700, 800, 1500, 1501, 3000])
            end = at + rng.choice([300, 700, 1500, 1600, 4000])
            runs.append((at, end, rng.choice([None, None, "ar", "ar", "fr", "he", "en"])))
            at = end
        wanted[vid] = walked_passages(runs, "he", "en")
        rows += [(vid, *r) for r in runs]
    df = spark.createDataFrame(rows, "vid long, start_ms long, end_ms long, lang string")
    found = {vid: [] for vid in wanted}
    for r in I.passages(df, src="he", tgt="en").collect():
        found[r["vid"]].append((r["start_ms"], r["end_ms"], r["lang"]))
    assert {v: sorted(x, key=str) for v, x in found.items()} == wanted
    assert I.passages(df.limit(0)).count() == 0


def test_a_gap_counts_from_the_last_run_with_a_language(spark):
    runs = [(1, 0, 4000, "ar"), (1, 4500, 5000, None), (1, 5500, 9000, "ar"), (2, 0, 4000, "ar"), (2, 5000, 5800, None), (2, 6600, 9000, "ar")]
    got = I.passages(spark.createDataFrame(runs, "vid long, start_ms long, end_ms long, lang string")).where("lang is not null")
    assert sorted((r["vid"], r["start_ms"], r["end_ms"]) for r in got.collect()) == [(1, 0, 9000), (2, 0, 4000), (2, 6600, 9000)]


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_clauses_against_all_pairs_of_words(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("אבג") for _ in range(rng.randrange(1, 9)))
    clauses = [(v, k, " ".join([word() for _ in range(rng.randrange(3))] + ["means"])) for v in range(6) for k in range(5)]
    lines = [(v, s, " ".join(word() for _ in range(rng.randrange(4))) if rng.random() < 0.95 else None) for v in range(7) for s in range(60)]

    def said(word, tokens):
        if len(word) < 5:
            return len(word) == 4 and word in tokens
        return any(word in t or edits_between(word, t) <= 1 for t in tokens)

    wanted = {}
    for v, s, text in lines:
        tokens = (text or "").split()
        mine = [c for w, _, c in clauses if w == v and (c == "means" or any(said(x, tokens) for x in c.split()[:-1]))]
        wanted[v, s] = "; ".join(mine)
    segments = spark.createDataFrame(lines, "vid long, seq long, text string")
    notes = N.relevant_clauses(segments, spark.createDataFrame(clauses, "vid long, k long, clause string"))
    assert {(r["vid"], r["seq"]): r["note"] for r in notes.collect()} == wanted
    assert sum("means" in x and len(x) > 5 for x in wanted.values()) > 50
