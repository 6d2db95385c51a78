"""Queries of the ordered rules."""

from pyspark.sql import functions as F

from ..operators import folds as K
from ..operators import words as W
from ..sources import tables as T
from ..sources.tables import cte
from .registry import query


def stuttered(spark, sf_dir):
    """Words of which every 40th is said three times."""
    words = T.words(spark, sf_dir)
    copies = F.when(F.col("seq") % 40 == 7, F.expr("sequence(0L, 2L)")).otherwise(F.expr("array(0L)"))
    return words.withColumn("k", F.explode(copies)).selectExpr("vid", "seq * 3 + k AS seq", "text", "t_ms + 100*k AS t_ms", "end_ms + 100*k AS end_ms")


@query("k1_loops_collapsed")
def k1(spark, sf_dir):
    return K.loops_collapsed(stuttered(spark, sf_dir))


@query("k2_stretched_dropped")
def k2(spark, sf_dir):
    long = T.words(spark, sf_dir).withColumn("end_ms", F.when(F.col("seq") % 90 == 44, F.col("t_ms") + 3000).otherwise(F.col("end_ms")))
    return K.stretched_dropped(long)


@query("k4_turns_smoothed")
def k4(spark, sf_dir):
    return K.turns_smoothed(T.turns(spark, sf_dir))


def pieces(spark, sf_dir):
    words = W.sessions(W.word_ends(T.words(spark, sf_dir)).withColumn("brk", F.lit(False)))
    return W.segments_of(words).select("vid", F.col("segment").alias("seq"), "speaker", "text", "start_ms", "end_ms", "n_words", F.lit(False).alias("brk"))


@query("k7_stubs_merged")
def k7(spark, sf_dir):
    return K.stubs_merged(pieces(spark, sf_dir))


@query("k5_segmentation")
def k5(spark, sf_dir):
    """Words to segments by all rules: groups, long sentences cut, turns, stubs merged."""
    return K.segmentation(T.words(spark, sf_dir).withColumn("brk", F.lit(False)), T.turns(spark, sf_dir)).drop("bucket")


@query("k6_long_split", cte("words") + """, e AS (SELECT vid, seq, seq // 60 AS segment, t_ms, greatest(least(end_ms, coalesce(lead(t_ms) OVER (PARTITION BY vid ORDER BY seq), end_ms)), t_ms + 20) AS end_ms FROM words),
  g AS (SELECT *, greatest(0, t_ms - lag(end_ms) OVER (PARTITION BY vid ORDER BY seq)) AS gap FROM e),
  n AS (SELECT *, row_number() OVER s - 1 AS i, count(*) OVER p AS n, min(t_ms) OVER p AS a, arg_max(end_ms, seq) OVER p AS b, lag(end_ms) OVER s AS le FROM g WINDOW s AS (PARTITION BY vid, segment ORDER BY seq), p AS (PARTITION BY vid, segment)),
  c AS (SELECT *, CASE WHEN i > 0 AND le - a >= 1000 AND b - t_ms >= 1000 THEN gap * 50 - abs((le - a) - (b - t_ms)) END AS score FROM n)
  SELECT vid, segment, count(*) AS words, CASE WHEN max(b) - max(a) > 13000 AND count(*) >= 4 THEN coalesce(arg_max(seq, (score, -i)) FILTER (score > -50000), min(seq) FILTER (i = n // 2)) END AS cut FROM c GROUP BY vid, segment""")
def k6(spark, sf_dir):
    """Blocks of sixty words cut at their pauses: the words of each, and where its first cut is.

    The cuts after the first are held against the rule said by recursion, in the tests.
    """
    blocks = W.word_ends(T.words(spark, sf_dir)).withColumn("segment", F.floor(F.col("seq") / 60))
    return K.long_split(blocks).groupBy("vid", "segment").agg(F.count("*").alias("words"), F.min(F.when(F.col("piece").startswith("b"), F.col("seq"))).alias("cut"))


@query("k8_fragments_merged", cte("segments").replace("WITH ", "WITH RECURSIVE ") + """, l AS (SELECT vid, seq, 'A' AS speaker, CASE WHEN seq % 3 = 0 THEN 'Le' ELSE text END AS text, start_ms + seq * 3000 AS start_ms, CASE WHEN seq % 3 = 0 THEN start_ms + 900 ELSE end_ms END + seq * 3000 AS end_ms, false AS keep FROM segments),
  o AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY seq DESC) AS i, end_ms - start_ms <= 2000 AND len(regexp_extract_all(text, '\\S+')) BETWEEN 1 AND 2 AND NOT regexp_matches(trim(text), '[.!?…。｡！？][''"»׳״」』]?$') AS opener FROM l),
  r AS (SELECT vid, i, seq AS head, start_ms AS onset, text AS line, NULL::VARCHAR AS spans FROM o WHERE i = 1
    UNION ALL SELECT o.vid, o.i, CASE WHEN joins THEN head ELSE seq END, CASE WHEN joins THEN onset ELSE start_ms END, CASE WHEN joins THEN trim(text) || ' ' || line ELSE text END, CASE WHEN joins THEN concat_ws(',', start_ms || '-' || end_ms, spans) END
    FROM (SELECT o.*, r.*  EXCLUDE (vid, i), o.opener AND trim(line) <> '' AND onset - o.end_ms BETWEEN 2000 AND 8000 AS joins FROM r JOIN o ON o.vid = r.vid AND o.i = r.i + 1) o)
  SELECT o.vid, o.seq, speaker, m.line AS text, start_ms, end_ms, keep, m.spans AS merged_from FROM (SELECT vid, head, arg_max(line, i) AS line, arg_max({'s': spans}, i).s AS spans FROM r GROUP BY ALL) m JOIN o ON o.vid = m.vid AND o.seq = m.head""")
def k8(spark, sf_dir):
    torn = T.segments(spark, sf_dir).selectExpr("vid", "seq", "'A' AS speaker", "if(seq % 3 = 0, 'Le', text) AS text", "start_ms", "if(seq % 3 = 0, start_ms + 900, end_ms) AS end_ms", "false AS keep")
    spread = torn.withColumns({"start_ms": F.col("start_ms") + F.col("seq") * 3000, "end_ms": F.col("end_ms") + F.col("seq") * 3000})
    return K.fragments_merged(spread.withColumn("end_ms", F.when(F.col("seq") % 3 == 0, F.col("start_ms") + 900).otherwise(F.col("end_ms"))))


@query("k12_two_voices")
def k12(spark, sf_dir):
    turns = T.vectors(spark, sf_dir).select(F.floor(F.col("key") / 9).alias("run"), "key", "vec")
    return K.two_voices(turns)


@query("k13_canonical_names")
def k13(spark, sf_dir):
    from .textqc import a10

    return K.canonical_names(a10(spark, sf_dir))
