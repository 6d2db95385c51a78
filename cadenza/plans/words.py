"""Queries of the word operators."""

from pyspark.sql import functions as F

from ..operators import words as W
from ..sources import tables as T
from ..sources.tables import cte
from .registry import query

# Words in captions' clothes: marks, chrome and invisible characters, by position.
RAW = r"""raw AS (SELECT vid, seq, t_ms, end_ms, spk, CASE WHEN seq % 7 = 0 THEN '>> ' || text WHEN seq % 11 = 0 THEN '[' || text || ']'
  WHEN seq % 13 = 0 THEN text || chr(8203) ELSE text END AS text FROM words)"""
# Every tenth stretch of five words in another script, and every 17th word alone.
MIXED = """mixed AS (SELECT vid, seq, t_ms, CASE WHEN seq % 5 <> 0 THEN end_ms END AS end_ms, spk, seq % 97 = 96 AND vid % 3 = 0 AS brk,
  CASE WHEN (seq // 5) % 10 = 3 OR seq % 17 = 0 THEN text ELSE translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', repeat('ש', 52)) END AS text FROM words)"""


def raw(spark, sf_dir):
    return T.words(spark, sf_dir).withColumn(
        "text", F.expr("CASE WHEN seq % 7 = 0 THEN '>> ' || text WHEN seq % 11 = 0 THEN '[' || text || ']' WHEN seq % 13 = 0 THEN text || '​' ELSE text END")
    )


def mixed(spark, sf_dir):
    hebrew = F.translate("text", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ש" * 52)
    return T.words(spark, sf_dir).withColumns(
        {
            "end_ms": F.expr("CASE WHEN seq % 5 <> 0 THEN end_ms END"), "brk": F.expr("seq % 97 = 96 AND vid % 3 = 0"),
            "text": F.when(F.expr("(seq div 5) % 10 = 3 OR seq % 17 = 0"), F.col("text")).otherwise(hebrew),
        }
    )


def md5_lines(column: str, order: str) -> str:
    return f"md5(string_agg({column}, '|' ORDER BY {order}))"


@query("f1_clean_tokens", cte("words") + "," + RAW + r""", c AS (SELECT vid, seq, contains(text, '>>') AS brk,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '>>+', ' ', 'g'), '[\[\(][^\]\)]{0,40}[\]\)]', ' ', 'g'),
  '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM raw)
  SELECT vid, seq, text, brk FROM c WHERE text <> ''""")
def f1(spark, sf_dir):
    return W.clean_tokens(raw(spark, sf_dir)).select("vid", "seq", "text", "brk")


@query("f2_confident", cte("words") + ", c AS (SELECT vid, seq, CASE WHEN seq % 6 <> 0 THEN -(seq % 11) / 10.0::DOUBLE END AS avg_logprob FROM words) SELECT * FROM c WHERE avg_logprob IS NULL OR avg_logprob >= -0.5::DOUBLE")
def f2(spark, sf_dir):
    chunks = T.words(spark, sf_dir).selectExpr("vid", "seq", "CASE WHEN seq % 6 <> 0 THEN -(seq % 11) / 10D END AS avg_logprob")
    return W.confident(chunks)


ENDS = """ends AS (SELECT vid, seq, t_ms, text, spk, greatest(least(coalesce(end_ms, t_ms + 800), coalesce(lead(t_ms) OVER w, coalesce(end_ms, t_ms + 800))), t_ms + 20) AS end_ms
  FROM mixed WINDOW w AS (PARTITION BY vid ORDER BY seq))"""


@query("n14_word_ends", cte("words") + f",{MIXED},{ENDS} SELECT vid, seq, end_ms FROM ends")
def n14(spark, sf_dir):
    return W.word_ends(mixed(spark, sf_dir)).select("vid", "seq", "end_ms")


GAPS = """gaps AS (SELECT *, greatest(0, t_ms - lag(coalesce(end_ms, t_ms + least(800, 100 + 60*length(text)))) OVER w) AS g,
  lag(seq) OVER w IS NULL AS is_first FROM mixed WINDOW w AS (PARTITION BY vid ORDER BY seq))"""


@query("n15_speech_gaps", cte("words") + f",{MIXED},{GAPS} SELECT vid, seq, CASE WHEN is_first THEN 0 ELSE g END AS gap_ms FROM gaps")
def n15(spark, sf_dir):
    return W.speech_gaps(mixed(spark, sf_dir)).select("vid", "seq", "gap_ms")


@query("n16_speaker_blocks", cte("turns") + """, b AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS s FROM turns WINDOW w AS (PARTITION BY vid ORDER BY seq)),
  c AS (SELECT *, sum(s) OVER (PARTITION BY vid ORDER BY seq)::BIGINT AS block FROM b)
  SELECT vid, block, min(speaker) AS speaker, min(seq) AS first, max(seq) AS last FROM c GROUP BY vid, block""")
def n16(spark, sf_dir):
    return W.speaker_blocks(T.turns(spark, sf_dir))


BUCKETS = r"""b0 AS (SELECT *, length(regexp_replace(text, '[^\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]', '', 'g')) AS tl,
  length(regexp_replace(text, '[^\x{05D0}-\x{05EA}]', '', 'g')) AS sl FROM mixed),
b1 AS (SELECT * EXCLUDE (tl, sl), CASE WHEN tl = 0 AND sl = 0 THEN NULL WHEN tl > sl THEN 'target' ELSE 'source' END AS bucket FROM b0),
b2 AS (SELECT *, coalesce(bucket = 'target', false) AS tg FROM b1),
b3 AS (SELECT *, CASE WHEN lag(tg) OVER w IS DISTINCT FROM tg THEN 1 ELSE 0 END AS s FROM b2 WINDOW w AS (PARTITION BY vid ORDER BY seq)),
b4 AS (SELECT *, sum(s) OVER (PARTITION BY vid ORDER BY seq) AS run FROM b3),
b5 AS (SELECT *, tg AND count(*) OVER (PARTITION BY vid, run) < 3 AS embedded FROM b4)"""


@query("n17_embedded_target", cte("words") + f",{MIXED},{BUCKETS} SELECT vid, seq, bucket, embedded FROM b5")
def n17(spark, sf_dir):
    return W.embedded_target(mixed(spark, sf_dir), "he", "en").select("vid", "seq", "bucket", "embedded")


def session_sql(table: str) -> str:
    return rf"""s0 AS (SELECT *, CASE WHEN NOT embedded THEN bucket END AS own,
    greatest(0, t_ms - lag(coalesce(end_ms, t_ms + least(800, 100 + 60*length(text)))) OVER w) AS gap, lag(spk) OVER w AS pspk, lag(text) OVER w AS ptext,
    lag(seq) OVER w IS NULL AS is_first, max(brk::INT) OVER (PARTITION BY vid) = 1 AS marks FROM {table} WINDOW w AS (PARTITION BY vid ORDER BY seq)),
s1 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ctx FROM s0),
s2 AS (SELECT *, CASE WHEN is_first OR gap >= 700 OR brk OR (NOT marks AND pspk <> spk AND gap >= 250) OR coalesce(own <> ctx, false)
    OR regexp_matches(ptext, '[.!?…。｡！？][''"»׳״」』]?$') THEN 1 ELSE 0 END AS starts FROM s1),
s3 AS (SELECT *, sum(starts) OVER (PARTITION BY vid ORDER BY seq)::BIGINT AS segment FROM s2)"""


@query("n19_groups", cte("words") + f",{MIXED},{BUCKETS}," + session_sql("b5") + " SELECT vid, seq, segment FROM s3")
def n19_groups(spark, sf_dir):
    return W.sessions(mixed(spark, sf_dir)).select("vid", "seq", "segment")


VOTES = """v AS (SELECT vid, segment, spk, sum(greatest(50, end_ms - t_ms)) AS weight, min(seq) AS f FROM s3 GROUP BY ALL),
votes AS (SELECT vid, segment, spk AS speaker FROM v QUALIFY row_number() OVER (PARTITION BY vid, segment ORDER BY weight DESC, f) = 1)"""
PLAIN = "plain AS (SELECT vid, seq, text, t_ms, end_ms, spk, false AS brk, 'target' AS bucket, false AS embedded FROM words)"
PLAIN_BUCKETS = BUCKETS.replace("mixed", "plain0")
PLAIN0 = "plain0 AS (SELECT vid, seq, t_ms, greatest(least(end_ms, coalesce(lead(t_ms) OVER (PARTITION BY vid ORDER BY seq), end_ms)), t_ms + 20) AS end_ms, spk, false AS brk, text FROM words)"


def timed(spark, sf_dir):
    return W.word_ends(T.words(spark, sf_dir)).withColumn("brk", F.lit(False))


@query("n19_sessionize", cte("words") + f",{PLAIN0},{PLAIN_BUCKETS}," + session_sql("b5") + f""",{VOTES}
  SELECT s.vid, s.segment, min(t_ms) AS start_ms, arg_max(end_ms, seq) AS end_ms, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n_words
  FROM s3 s JOIN votes USING (vid, segment) GROUP BY s.vid, s.segment""")
def n19(spark, sf_dir):
    """The flagship: words of every document sessionized into speaker-aware segments."""
    return W.segments_of(W.sessions(timed(spark, sf_dir)))


@query("a1_majority_speaker", cte("words") + f",{PLAIN0},{PLAIN_BUCKETS}," + session_sql("b5") + f",{VOTES} SELECT vid, segment, speaker FROM votes")
def a1(spark, sf_dir):
    return W.majority_speaker(W.sessions(timed(spark, sf_dir)))


ECHO = "echo AS (SELECT vid, seq, CASE WHEN seq % 3 = 1 THEN lag(text) OVER (PARTITION BY vid ORDER BY seq) ELSE text END AS text, t_ms, end_ms + (seq % 4) * 150 AS end_ms FROM words)"


def echo(spark, sf_dir):
    return T.words(spark, sf_dir).select(
        "vid", "seq", F.when(F.col("seq") % 3 == 1, F.lag("text").over(W.in_order())).otherwise(F.col("text")).alias("text"), "t_ms",
        F.expr("end_ms + (seq % 4) * 150").alias("end_ms"),
    )


@query("n21_without_echoes", cte("words") + f",{ECHO}," + r"""
  e0 AS (SELECT *, lower(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) AS key FROM echo),
  e1 AS (SELECT *, CASE WHEN lag(key) OVER w IS DISTINCT FROM key THEN 1 ELSE 0 END AS b FROM e0 WINDOW w AS (PARTITION BY vid ORDER BY seq)),
  e2 AS (SELECT *, sum(b) OVER (PARTITION BY vid ORDER BY seq) AS run FROM e1),
  e3 AS (SELECT *, key <> '' AND coalesce(t_ms < max(end_ms) OVER (PARTITION BY vid, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 50, false) AS echo FROM e2),
  e4 AS (SELECT *, sum((NOT echo)::INT) OVER (PARTITION BY vid ORDER BY seq) AS kept FROM e3),
  e5 AS (SELECT *, max(end_ms) OVER (PARTITION BY vid, kept) AS long_end FROM e4)
  SELECT vid, seq, text, t_ms, long_end AS end_ms FROM e5 WHERE NOT echo""")
def n21(spark, sf_dir):
    return W.without_echoes(echo(spark, sf_dir)).select("vid", "seq", "text", "t_ms", "end_ms")


CLOSE = "near AS (SELECT vid, seq, text, CASE WHEN seq % 3 = 1 THEN lag(t_ms) OVER (PARTITION BY vid ORDER BY seq) + 40 ELSE t_ms END AS t_ms FROM echo)"


@query("n22_seam_duplicates", cte("words") + f",{ECHO},{CLOSE}," + """
  c AS (SELECT *, coalesce(lag(text) OVER w = text AND t_ms - lag(t_ms) OVER w < 50, false) AS same FROM near WINDOW w AS (PARTITION BY vid ORDER BY seq))
  SELECT vid, seq, text, t_ms FROM c WHERE NOT same""")
def n22(spark, sf_dir):
    close = echo(spark, sf_dir).select("vid", "seq", "text", F.when(F.col("seq") % 3 == 1, F.lag("t_ms").over(W.in_order()) + 40).otherwise(F.col("t_ms")).alias("t_ms"))
    return W.without_seam_duplicates(close)


@query("k3_joined_marks", cte("words") + r""", k0 AS (SELECT vid, seq, t_ms, end_ms, CASE WHEN seq % 9 = 4 THEN '-' || text WHEN seq % 9 = 5 THEN '''' || text ELSE text END AS text FROM words),
  k1 AS (SELECT *, regexp_matches(text, '^[''׳`’\-–]') AND coalesce(NOT regexp_matches(lag(text) OVER w, '[.!?]$'), false) AND coalesce(t_ms - lag(end_ms) OVER w <= 400, false) AS j FROM k0 WINDOW w AS (PARTITION BY vid ORDER BY seq)),
  k2 AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY vid ORDER BY seq) AS whole FROM k1)
  SELECT vid, min(seq) AS seq, min(t_ms) AS t_ms, arg_max(end_ms, seq) AS end_ms, string_agg(text, '' ORDER BY seq) AS text FROM k2 GROUP BY vid, whole""")
def k3(spark, sf_dir):
    marked = T.words(spark, sf_dir).withColumns(
        {"text": F.expr("CASE WHEN seq % 9 = 4 THEN '-' || text WHEN seq % 9 = 5 THEN \"'\" || text ELSE text END"), "brk": F.lit(False)}
    )
    return W.joined_marks(marked)


REAL = "real AS (SELECT * FROM turns QUALIFY end_ms - start_ms >= 400 OR max((end_ms - start_ms >= 400)::INT) OVER (PARTITION BY vid) = 0)"


@query("n18_turn_boundaries", cte("turns") + f",{REAL}," + """
  g AS (SELECT vid, end_ms, lead(start_ms) OVER (PARTITION BY vid ORDER BY start_ms, seq) - end_ms AS gap FROM turns),
  h AS (SELECT vid, start_ms, speaker, lag(speaker) OVER (PARTITION BY vid ORDER BY start_ms, seq) AS before FROM real)
  SELECT vid, end_ms + gap // 2 AS at_ms, true AS protect FROM g WHERE gap >= 800 UNION ALL SELECT vid, start_ms, false FROM h WHERE before <> speaker""")
def n18(spark, sf_dir):
    return W.turn_boundaries(T.turns(spark, sf_dir))


@query("n20_split_at_turns", cte("turns") + f",{PLAIN0},{PLAIN_BUCKETS}," + session_sql("b5") + f",{REAL}," + """
  g AS (SELECT vid, end_ms, lead(start_ms) OVER (PARTITION BY vid ORDER BY start_ms, seq) - end_ms AS gap FROM turns),
  h AS (SELECT vid, start_ms, speaker, lag(speaker) OVER (PARTITION BY vid ORDER BY start_ms, seq) AS before FROM real),
  bounds AS (SELECT vid, end_ms + gap // 2 AS at_ms, true AS protect FROM g WHERE gap >= 800 UNION ALL SELECT vid, start_ms, false FROM h WHERE before <> speaker),
  num AS (SELECT vid, segment, seq, t_ms, end_ms, row_number() OVER (PARTITION BY vid, segment ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY vid, segment) AS n,
    min(t_ms) OVER (PARTITION BY vid, segment) AS s0, last_value(end_ms) OVER (PARTITION BY vid, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e0 FROM s3),
  cuts0 AS (SELECT num.vid, segment, at_ms, bool_or(protect) AS protect, max(n) AS n, count(*) FILTER (t_ms + end_ms < 2*at_ms) AS k FROM num JOIN bounds ON num.vid = bounds.vid AND n >= 2 AND s0 < at_ms AND at_ms < e0 GROUP BY ALL),
  cuts AS (SELECT vid, segment, least(greatest(k, 1), n - 1) AS i, bool_or(protect) AS protect FROM cuts0 GROUP BY ALL)
  SELECT num.vid, num.segment, num.seq, sum((cuts.i IS NOT NULL)::INT) OVER (PARTITION BY num.vid, num.segment ORDER BY num.seq)::BIGINT AS piece, coalesce(protect, false) AS brk
  FROM num LEFT JOIN cuts ON num.vid = cuts.vid AND num.segment = cuts.segment AND num.i = cuts.i""")
def n20(spark, sf_dir):
    return W.split_at_turns(W.sessions(timed(spark, sf_dir)), T.turns(spark, sf_dir)).select("vid", "segment", "seq", "piece", "brk")


@query("j1_word_speakers", cte("turns") + f",{PLAIN0},{REAL}," + """
  shifted AS (SELECT vid, seq, t_ms + 170 AS t_ms, end_ms + 170 AS end_ms FROM plain0),
  ov AS (SELECT s.vid, s.seq, r.speaker, least(s.end_ms, r.end_ms) - greatest(s.t_ms, r.start_ms) AS o, r.start_ms FROM shifted s JOIN real r ON s.vid = r.vid AND r.start_ms <= s.end_ms AND r.end_ms >= s.t_ms),
  best AS (SELECT vid, seq, speaker FROM ov WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY vid, seq ORDER BY o DESC, start_ms) = 1),
  near AS (SELECT s.vid, s.seq, r.speaker, least(abs(2*r.start_ms - s.t_ms - s.end_ms), abs(2*r.end_ms - s.t_ms - s.end_ms)) AS d, r.start_ms FROM shifted s JOIN real r ON s.vid = r.vid
    AND 2*r.start_ms <= s.t_ms + s.end_ms + 1000 AND 2*r.end_ms >= s.t_ms + s.end_ms - 1000),
  close AS (SELECT vid, seq, speaker FROM near WHERE d <= 1000 QUALIFY row_number() OVER (PARTITION BY vid, seq ORDER BY d, start_ms) = 1),
  k AS (SELECT s.vid, s.seq, coalesce(best.speaker, close.speaker) AS known FROM shifted s LEFT JOIN best USING (vid, seq) LEFT JOIN close USING (vid, seq)),
  f AS (SELECT vid, arg_min(speaker, start_ms) AS first FROM real GROUP BY vid)
  SELECT k.vid, k.seq, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY k.vid ORDER BY k.seq ROWS UNBOUNDED PRECEDING), first, 'SPEAKER_00') AS spk FROM k LEFT JOIN f ON k.vid = f.vid""")
def j1(spark, sf_dir):
    late = timed(spark, sf_dir).selectExpr("vid", "seq", "text", "t_ms + 170 AS t_ms", "end_ms + 170 AS end_ms")
    return W.word_speakers(late, T.turns(spark, sf_dir)).select("vid", "seq", "spk")


@query("n8_target_runs", cte("words") + f",{MIXED}," + r"""
  o AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY vid ORDER BY seq) AS gap FROM mixed WHERE length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0
    AND length(regexp_replace(text, '[^\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^\p{L}]', '', 'g'))),
  r AS (SELECT *, sum((gap IS NULL OR gap > 2000)::INT) OVER (PARTITION BY vid ORDER BY seq) AS run FROM o)
  SELECT vid, min(t_ms) AS start_ms, max(t_ms) + 800 AS end_ms, count(*) AS n_words FROM r GROUP BY vid, run HAVING max(t_ms) + 800 - min(t_ms) >= 800""")
def n8(spark, sf_dir):
    return W.target_runs(mixed(spark, sf_dir), "he", "en")


@query("j9_snapped_handoffs", cte("words", "turns") + f""",{REAL}, g AS (SELECT vid, seq, speaker, start_ms + (seq * 37) % 400 AS start_ms, greatest(end_ms, start_ms + (seq * 37) % 400) AS end_ms FROM turns),
  h AS (SELECT *, greatest(coalesce(lag(end_ms) OVER w, 0), start_ms - 300) AS low, lag(speaker) OVER w IS DISTINCT FROM speaker AS handed FROM g WINDOW w AS (PARTITION BY vid ORDER BY seq)),
  b AS (SELECT h.vid, h.seq, max(r.start_ms) AS snap FROM h JOIN real r ON h.vid = r.vid AND h.speaker = r.speaker AND h.handed AND r.end_ms > h.start_ms AND r.start_ms >= h.low AND r.start_ms < h.start_ms - 20 GROUP BY ALL)
  SELECT vid, seq, coalesce(snap, start_ms) AS start_ms FROM g LEFT JOIN b USING (vid, seq)""")
def j9(spark, sf_dir):
    """Turns heard up to 0.4 s late, set back to where their speaker began."""
    late = F.expr("start_ms + (seq * 37) % 400")
    heard = T.turns(spark, sf_dir).withColumns({"end_ms": F.greatest("end_ms", late), "start_ms": late})
    return W.snapped_handoffs(heard, T.turns(spark, sf_dir)).select("vid", "seq", "start_ms")
