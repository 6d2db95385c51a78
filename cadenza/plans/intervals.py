"""Queries of the interval operators."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources import tables as T
from ..sources.tables import cte
from .registry import query

# Odd events are spans; even ones, a little later and shorter, stand for segments.
PAIR = """sp AS (SELECT * FROM spans WHERE seq % 2 = 1),
sg AS (SELECT vid, seq, lang, start_ms + 20000 AS start_ms, start_ms + 20000 + (end_ms - start_ms) // 4 AS end_ms, seq % 3 = 0 AS passthrough FROM spans WHERE seq % 2 = 0)"""
HOURS = 3_600_000


def sp(spark, sf_dir):
    return T.spans(spark, sf_dir).where("seq % 2 = 1").select("vid", "seq", "lang", "start_ms", "end_ms", (F.col("seq") % 3 == 0).alias("passthrough"))


def sg(spark, sf_dir):
    return T.spans(spark, sf_dir).where("seq % 2 = 0").selectExpr(
        "vid", "seq", "lang", "start_ms + 20000 AS start_ms", "start_ms + 20000 + (end_ms - start_ms) div 4 AS end_ms", "seq % 3 = 0 AS passthrough"
    )


def totals(spark, sf_dir):
    return T.spans(spark, sf_dir).groupBy("vid").agg((F.max("end_ms") + 5000).alias("total_ms"))


def merge_sql(slop: int, source: str = "spans") -> str:
    return f"""m0 AS (SELECT vid, start_ms, end_ms, max(end_ms) OVER (PARTITION BY vid ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source} WHERE end_ms > start_ms),
m1 AS (SELECT *, sum((before IS NULL OR start_ms > before + {slop})::INT) OVER (PARTITION BY vid ORDER BY start_ms, end_ms) AS island FROM m0),
merged AS (SELECT vid, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM m1 GROUP BY vid, island)"""


@query("n1_merged", cte("spans") + "," + merge_sql(60000) + " SELECT * FROM merged")
def n1(spark, sf_dir):
    return I.merged(T.spans(spark, sf_dir), 60_000)


@query("n5_vad_regions", cte("spans") + "," + merge_sql(500) + " SELECT * FROM merged")
def n5(spark, sf_dir):
    return I.merged(T.spans(spark, sf_dir), 500)


@query("n2_merged_first", cte("spans") + """,
  m0 AS (SELECT *, max(end_ms) OVER w AS before FROM spans WINDOW w AS (PARTITION BY vid ORDER BY start_ms, end_ms DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  m1 AS (SELECT *, sum((before IS NULL OR start_ms > before - 50)::INT) OVER (PARTITION BY vid ORDER BY start_ms, end_ms DESC, seq) AS island, row_number() OVER (PARTITION BY vid ORDER BY start_ms, end_ms DESC, seq) AS r FROM m0)
  SELECT vid, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(seq, r) AS seq, arg_min(lang, r) AS lang FROM m1 GROUP BY vid, island""")
def n2(spark, sf_dir):
    return I.merged_first(T.spans(spark, sf_dir))


def complement_sql(slop: int, least: int) -> str:
    return cte("spans") + "," + merge_sql(slop) + f""",
  tot AS (SELECT vid, max(end_ms) + 5000 AS total FROM spans GROUP BY vid),
  edges AS (SELECT vid, coalesce(lag(end_ms) OVER (PARTITION BY vid ORDER BY start_ms), 0) AS a, start_ms AS b FROM merged
    UNION ALL SELECT vid, max(end_ms), any_value(total) FROM merged JOIN tot USING (vid) GROUP BY vid)
  SELECT vid, a AS start_ms, b AS end_ms FROM edges WHERE b - a >= {least}"""


@query("n3_complement", complement_sql(50, 250))
def n3(spark, sf_dir):
    return I.complement(T.spans(spark, sf_dir), totals(spark, sf_dir))


@query("n4_complement_without_slop", complement_sql(0, 350))
def n4(spark, sf_dir):
    return I.complement(T.spans(spark, sf_dir), totals(spark, sf_dir), slop=0, min_len=350)


@query("n6_language_runs", cte("spans") + """,
  w AS (SELECT vid, seq, unnest(range(start_ms, end_ms, 60000)) AS s, end_ms, lang, p FROM spans),
  l AS (SELECT vid, seq, s, least(s + 60000, end_ms) AS e, CASE WHEN p >= 0.6::DOUBLE THEN lang END AS lang FROM w),
  k AS (SELECT *, lag(lang) OVER o IS NOT DISTINCT FROM lang AND lag(e) OVER o IS NOT NULL AND s - lag(e) OVER o <= 500 AS j FROM l WINDOW o AS (PARTITION BY vid ORDER BY s, seq)),
  r AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY vid ORDER BY s, seq) AS run FROM k)
  SELECT vid, min(s) AS start_ms, arg_max(e, (s, seq)) AS end_ms, any_value(lang) AS lang FROM r GROUP BY vid, run""")
def n6(spark, sf_dir):
    """Speech cut into windows, labelled if sure, neighbours of one label merged."""
    windows = T.spans(spark, sf_dir).where("end_ms > start_ms").select(
        "vid", "seq", "lang", "p", F.col("end_ms").alias("e"), F.explode(F.sequence("start_ms", F.col("end_ms") - 1, F.lit(60_000))).alias("start_ms")
    )
    labelled = windows.select(
        "vid", "seq", "start_ms", F.least(F.col("start_ms") + 60_000, F.col("e")).alias("end_ms"), F.when(F.col("p") >= 0.6, F.col("lang")).alias("lang")
    )
    by = I.Window.partitionBy("vid").orderBy("start_ms", "seq")
    joins = F.lag("lang").over(by).eqNullSafe(F.col("lang")) & F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by) <= 500, F.lit(False))
    return I.islands(labelled, "vid", ["start_ms", "seq"], ~joins, "run").groupBy("vid", "run").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "seq")).alias("end_ms"), F.min("lang").alias("lang")
    ).drop("run")


@query("n9_voiced_runs", cte("levels") + """, r AS (SELECT vid, frame, frame - row_number() OVER (PARTITION BY vid ORDER BY frame) AS run FROM levels WHERE rms >= 0.008::DOUBLE)
  SELECT vid, min(frame) * 100 AS start_ms, (max(frame) + 1) * 100 AS end_ms FROM r GROUP BY vid, run""")
def n9(spark, sf_dir):
    return I.voiced_runs(T.levels(spark, sf_dir), 0.008)


@query("n10_pauses", cte("levels") + """, r AS (SELECT vid, frame, frame - row_number() OVER (PARTITION BY vid ORDER BY frame) AS run FROM levels WHERE rms < 0.008::DOUBLE)
  SELECT vid, min(frame) * 100 AS pause_ms, count(*) AS frames FROM r GROUP BY vid, run HAVING count(*) >= 2""")
def n10(spark, sf_dir):
    return I.pauses(T.levels(spark, sf_dir), 0.008)


WINDOWS = "win AS (SELECT vec_id AS vid, k AS seq, 130 + 900*k AS start_ms, 130 + 900*k + 150 + 210*k AS end_ms FROM embeddings, (SELECT unnest([0, 1, 2, 3])::BIGINT AS k))"


@query("a7_window_level", cte("levels") + f",{WINDOWS}" + """
  SELECT win.*, median FROM win LEFT JOIN (SELECT w.vid, w.seq, quantile_cont(rms, 0.5) AS median FROM win w JOIN levels l ON l.vid = w.vid AND l.frame >= w.start_ms // 100 AND l.frame <= greatest(w.start_ms // 100, (w.end_ms + 99) // 100 - 1) GROUP BY ALL) m USING (vid, seq)""")
def a7(spark, sf_dir):
    vids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.explode(F.expr("array(0L, 1L, 2L, 3L)")).alias("seq"))
    return I.window_level(T.levels(spark, sf_dir), vids.selectExpr("vid", "seq", "130 + 900*seq AS start_ms", "130 + 900*seq + 150 + 210*seq AS end_ms"))


@query("n11_uncovered_windows", cte("levels") + """,
  hidden AS (SELECT vec_id AS vid, unnest(range(5 + vec_id % 20, 11 + vec_id % 20)) AS frame FROM embeddings),
  o AS (SELECT l.*, l.frame - row_number() OVER (PARTITION BY l.vid ORDER BY l.frame) AS run FROM levels l ANTI JOIN hidden h ON l.vid = h.vid AND l.frame = h.frame)
  SELECT vid, min(frame) * 100 AS start_ms, (max(frame) + 1) * 100 AS end_ms FROM o GROUP BY vid, run HAVING (max(frame) + 1 - min(frame)) * 100 >= 700 AND quantile_cont(rms, 0.5) >= 0.0085::DOUBLE""")
def n11(spark, sf_dir):
    """Audible stretches that neither words nor known ranges cover."""
    words = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.expr("700 + 100 * (vec_id % 20)").alias("t_ms"))
    return uncovered(T.levels(spark, sf_dir), words, 0.0085)


def uncovered(levels, words, floor: float, least_ms: int = 700, before: int = 200, after: int = 300, hop_ms: int = 100):
    """Runs of frames farther than ``before`` and ``after`` from any word, loud and long enough."""
    first, last = F.floor((F.col("t_ms") - before) / hop_ms), F.floor((F.col("t_ms") + after) / hop_ms)
    hidden = words.select("vid", F.explode(F.sequence(first, last)).alias("frame")).distinct()
    free = levels.join(hidden, ["vid", "frame"], "left_anti")
    run = F.col("frame") - F.row_number().over(I.Window.partitionBy("vid").orderBy("frame"))
    return (
        free.withColumn("run", run).groupBy("vid", "run")
        .agg((F.min("frame") * hop_ms).alias("start_ms"), ((F.max("frame") + 1) * hop_ms).alias("end_ms"), F.percentile("rms", F.lit(0.5)).alias("median"))
        .where((F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.col("median") >= floor)).select("vid", "start_ms", "end_ms")
    )


@query("j2_containing", cte("spans") + f",{PAIR}" + """,
  f AS (SELECT g.vid, g.seq, arg_min(p.lang, p.seq) AS span_lang FROM sg g JOIN sp p ON g.vid = p.vid AND p.start_ms - 50 <= g.start_ms AND g.end_ms <= p.end_ms + 50 GROUP BY ALL)
  SELECT sg.vid, sg.seq, span_lang FROM sg LEFT JOIN f USING (vid, seq)""")
def j2(spark, sf_dir):
    return I.containing(sg(spark, sf_dir), sp(spark, sf_dir)).select("vid", "seq", "span_lang")


@query("j3_residues", cte("spans") + f",{PAIR}" + """,
  c AS (SELECT g.vid, g.seq, g.start_ms, greatest(g.start_ms, p.start_ms) AS a, least(g.end_ms, p.end_ms) AS b FROM sg g JOIN sp p ON g.vid = p.vid AND p.start_ms < g.end_ms AND p.end_ms > g.start_ms
    UNION ALL SELECT vid, seq, start_ms, end_ms, end_ms FROM sg),
  d AS (SELECT *, coalesce(max(b) OVER (PARTITION BY vid, seq ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms) AS free FROM c)
  SELECT vid, seq, free AS start_ms, a AS end_ms FROM d WHERE a > free""")
def j3(spark, sf_dir):
    return I.residues(sg(spark, sf_dir), sp(spark, sf_dir))


@query("j6_uncovered_points", cte("spans") + f",{PAIR}" + """ SELECT vid, seq, start_ms FROM sg g WHERE NOT EXISTS (SELECT 1 FROM sp p WHERE p.vid = g.vid AND p.start_ms - 1000 <= g.start_ms AND g.start_ms <= p.end_ms + 1000)""")
def j6(spark, sf_dir):
    points = sg(spark, sf_dir).selectExpr("vid", "seq", "start_ms", "start_ms AS end_ms")
    return I.uncovered_points(points, sp(spark, sf_dir), 1000).select("vid", "seq", "start_ms")


@query("j7_carried_overrides", cte("spans") + """, o AS (SELECT vid, seq, start_ms + 9000 AS start_ms, end_ms + 5000 AS end_ms, seq % 3 = 0 AS passthrough FROM spans),
  m AS (SELECT g.vid, g.seq, arg_min(o.passthrough, o.seq) AS carried FROM spans g JOIN o ON g.vid = o.vid AND least(g.end_ms, o.end_ms) - greatest(g.start_ms, o.start_ms) >= 0.5*(g.end_ms - g.start_ms)
    AND least(g.end_ms, o.end_ms) - greatest(g.start_ms, o.start_ms) >= 0.5*(o.end_ms - o.start_ms) WHERE g.end_ms > g.start_ms AND o.end_ms > o.start_ms GROUP BY ALL)
  SELECT spans.vid, spans.seq, carried FROM spans LEFT JOIN m USING (vid, seq)""")
def j7(spark, sf_dir):
    overrides = T.spans(spark, sf_dir).selectExpr("vid", "seq", "start_ms + 9000 AS start_ms", "end_ms + 5000 AS end_ms", "seq % 3 = 0 AS passthrough")
    return I.carried_overrides(T.spans(spark, sf_dir), overrides).select("vid", "seq", "carried")


@query("j8_stamped_language", cte("spans") + f",{PAIR}" + """,
  c AS (SELECT g.vid, g.seq, p.lang, least(g.end_ms, p.end_ms) - greatest(g.start_ms, p.start_ms) AS cover, g.end_ms - g.start_ms AS len, p.start_ms, p.seq AS ps FROM sg g JOIN sp p ON g.vid = p.vid AND p.start_ms <= g.end_ms AND p.end_ms >= g.start_ms),
  b AS (SELECT vid, seq, CASE WHEN cover >= 0.6*len THEN lang END AS detected_lang FROM c WHERE cover > 0 QUALIFY row_number() OVER (PARTITION BY vid, seq ORDER BY cover DESC, start_ms, ps) = 1)
  SELECT sg.vid, sg.seq, detected_lang FROM sg LEFT JOIN b USING (vid, seq)""")
def j8(spark, sf_dir):
    return I.stamped_language(sg(spark, sf_dir), sp(spark, sf_dir)).select("vid", "seq", "detected_lang")


@query("j10_priority_union", cte("spans") + f",{PAIR}" + """ SELECT vid, seq, start_ms, end_ms FROM sp UNION ALL
  SELECT vid, seq, start_ms, end_ms FROM sg g WHERE NOT EXISTS (SELECT 1 FROM sp p WHERE p.vid = g.vid AND p.start_ms < g.end_ms AND p.end_ms > g.start_ms)""")
def j10(spark, sf_dir):
    return I.priority_union(sp(spark, sf_dir), sg(spark, sf_dir)).select("vid", "seq", "start_ms", "end_ms")


@query("j11_new_spans", cte("spans") + f",{PAIR}" + """ SELECT vid, seq FROM sg g WHERE NOT EXISTS (SELECT 1 FROM sp p WHERE p.vid = g.vid AND p.start_ms < g.end_ms AND p.end_ms > g.start_ms)""")
def j11(spark, sf_dir):
    known, new = sp(spark, sf_dir).select("vid", "start_ms", "end_ms"), sg(spark, sf_dir)
    hit = I.overlap_join(new, known).where(I.meets()).select("vid", "seq").distinct()
    return new.join(hit, ["vid", "seq"], "left_anti").select("vid", "seq")


@query("j14_refused_bounds", cte("spans") + f",{PAIR}" + """ SELECT g.vid, g.seq, min(p.seq) AS neighbour, 'overlaps a neighbour' AS reason FROM sg g JOIN sp p ON p.vid = g.vid AND p.start_ms < g.end_ms AND p.end_ms > g.start_ms GROUP BY ALL""")
def j14(spark, sf_dir):
    """New or moved segments refused because they overlap an existing one."""
    hit = I.overlap_join(sg(spark, sf_dir), sp(spark, sf_dir)).where(I.meets())
    return hit.groupBy("vid", "seq").agg(F.min("r_seq").alias("neighbour")).withColumn("reason", F.lit("overlaps a neighbour"))


@query("u1_appended", cte("spans") + f",{PAIR}" + " SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY start_ms, end_ms, seq) - 1 AS id, seq FROM (SELECT vid, seq, start_ms, end_ms FROM sp UNION ALL SELECT vid, seq, start_ms, end_ms FROM sg)")
def u1(spark, sf_dir):
    both = sp(spark, sf_dir).unionByName(sg(spark, sf_dir))
    return both.withColumn("id", F.row_number().over(I.Window.partitionBy("vid").orderBy("start_ms", "end_ms", "seq")) - 1).select("vid", "id", "seq")


@query("o5_best_window", cte("levels") + """, w AS (SELECT vec_id AS vid, unnest(range(0, 50, 2)) AS i FROM embeddings),
  s AS (SELECT w.vid, w.i, avg(rms) AS m, min(rms) AS low, max(rms) AS high FROM w JOIN levels l ON l.vid = w.vid AND l.frame >= w.i AND l.frame < w.i + 12 GROUP BY ALL)
  SELECT vid, i * 100 AS start_ms, (i + 12) * 100 AS end_ms FROM s QUALIFY row_number() OVER (PARTITION BY vid ORDER BY round((high - low) / greatest(m, 0.000001::DOUBLE), 9), i) = 1""")
def o5(spark, sf_dir):
    """The window of 1.2 s, at steps of 0.2 s, with the least spread for its level."""
    levels = T.levels(spark, sf_dir)
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("frame") - 11) / 2)) * 2, F.least(F.lit(48), F.floor(F.col("frame") / 2) * 2), F.lit(2))
    stats = levels.where("ceil((frame - 11) / 2) * 2 <= 48").withColumn("i", F.explode(starts)).groupBy("vid", "i").agg(
        F.avg("rms").alias("m"), F.min("rms").alias("low"), F.max("rms").alias("high")
    )
    score = F.round((F.col("high") - F.col("low")) / F.greatest("m", F.lit(0.000001)), 9)
    return stats.groupBy("vid").agg(F.min(F.struct(score.alias("s"), "i")).alias("b")).select("vid", (F.col("b.i") * 100).alias("start_ms"), ((F.col("b.i") + 12) * 100).alias("end_ms"))


LANGUAGE = "CASE WHEN seq % 4 <> 0 THEN CASE WHEN seq % 11 = 5 THEN 'src' WHEN seq % 11 IN (7, 9) THEN 'tgt' WHEN seq % 24 < 12 THEN 'a' ELSE 'b' END END"


@query("n7_passages", cte("spans") + f""", r AS (SELECT vid, start_ms // 60 AS a, start_ms // 60 + (end_ms - start_ms) // 60 AS b, {LANGUAGE} AS lang FROM spans),
  l AS (SELECT *, lag(lang) OVER w AS pl, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM r WHERE lang IS NOT NULL WINDOW w AS (PARTITION BY vid ORDER BY a, b)),
  wall AS (SELECT DISTINCT l.vid, l.a, l.b FROM l JOIN r ON r.vid = l.vid AND r.lang IS NULL AND r.b - r.a > 60000 AND (r.a, r.b) > (l.pa, l.pb) AND (r.a, r.b) < (l.a, l.b)),
  o AS (SELECT l.vid, l.a, l.b, lang, pl IS NULL OR lang <> pl OR lang = 'tgt' OR l.a - pb > 60000 OR wall.vid IS NOT NULL AS opens FROM l LEFT JOIN wall ON wall.vid = l.vid AND wall.a = l.a AND wall.b = l.b),
  n AS (SELECT *, lag(lang) OVER w AS pl, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM r WINDOW w AS (PARTITION BY vid ORDER BY a, b)),
  u AS (SELECT * FROM o UNION ALL SELECT vid, a, b, lang, pa IS NULL OR pl IS NOT NULL OR a - pb > 60000 FROM n WHERE lang IS NULL),
  k AS (SELECT *, sum(opens::INT) OVER (PARTITION BY vid, lang IS NULL ORDER BY a, b) AS k FROM u)
  SELECT vid, min(a) AS start_ms, max(b) AS end_ms, lang FROM k WHERE coalesce(lang, '') <> 'src' GROUP BY vid, lang, k""")
def n7(spark, sf_dir):
    runs = T.spans(spark, sf_dir).selectExpr("vid", "start_ms div 60 AS start_ms", "start_ms div 60 + (end_ms - start_ms) div 60 AS end_ms", f"{LANGUAGE} AS lang")
    return I.passages(runs, 60_000, "src", "tgt")


TOLD = """seg AS (SELECT vid, seq, start_ms, end_ms, 'segment ' || seq AS text FROM sg), spn AS (SELECT vid, seq, start_ms, end_ms, CASE WHEN seq % 7 <> 1 THEN 'span ' || seq ELSE ' ' END AS text FROM sp),
wd AS (SELECT vid, seq * 8 + k AS seq, start_ms + k * 4000 AS start_ms, start_ms + k * 4000 + 900 AS end_ms, 'w' || k AS text FROM sg, (SELECT unnest(range(8)) AS k)), told AS (SELECT * FROM spn WHERE trim(text) <> ''),
hit AS (SELECT DISTINCT g.vid, g.seq FROM seg g JOIN told p ON g.vid = p.vid AND p.start_ms < g.end_ms AND p.end_ms > g.start_ms),
c AS (SELECT g.vid, g.seq, g.start_ms, greatest(g.start_ms, p.start_ms) AS a, least(g.end_ms, p.end_ms) AS b FROM seg g JOIN hit USING (vid, seq) JOIN told p ON g.vid = p.vid AND p.start_ms < g.end_ms AND p.end_ms > g.start_ms UNION ALL SELECT g.vid, g.seq, g.start_ms, g.end_ms, g.end_ms FROM seg g JOIN hit USING (vid, seq)),
d AS (SELECT *, coalesce(max(b) OVER (PARTITION BY vid, seq ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms) AS free FROM c),
e AS (SELECT vid, seq, free AS start_ms, a AS end_ms FROM d WHERE a - free >= 400),
j4 AS (SELECT g.vid, g.start_ms, g.end_ms, g.text, 'segment' AS origin FROM seg g ANTI JOIN hit USING (vid, seq)
  UNION ALL SELECT e.vid, e.start_ms, e.end_ms, string_agg(wd.text, ' ' ORDER BY wd.seq), 'rest' FROM e JOIN wd ON e.vid = wd.vid AND least(e.end_ms, wd.end_ms) - greatest(e.start_ms, wd.start_ms) > 50 GROUP BY e.vid, e.seq, e.start_ms, e.end_ms
  UNION ALL SELECT vid, start_ms, end_ms, text, 'span' FROM told)"""


def splice(spark, sf_dir):
    segs = sg(spark, sf_dir)
    words = segs.select("vid", "seq", "start_ms", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).selectExpr(
        "vid", "seq * 8 + k AS seq", "start_ms + k * 4000 AS start_ms", "start_ms + k * 4000 + 900 AS end_ms", "'w' || k AS text"
    )
    told = sp(spark, sf_dir).selectExpr("vid", "seq", "start_ms", "end_ms", "CASE WHEN seq % 7 <> 1 THEN 'span ' || seq ELSE ' ' END AS text")
    return I.spliced(segs.selectExpr("vid", "seq", "start_ms", "end_ms", "'segment ' || seq AS text"), told, words)


@query("j4_spliced", cte("spans") + f",{PAIR},{TOLD} SELECT * FROM j4")
def j4(spark, sf_dir):
    return splice(spark, sf_dir)


@query("j5_absorbed_rests", cte("spans") + f",{PAIR},{TOLD}" + r""", p5 AS (SELECT vid, start_ms, end_ms, CASE WHEN origin = 'rest' AND start_ms % 4 = 0 THEN replace(text, 'w', 'ש') ELSE text END AS text, origin,
    'S' || (start_ms // 7000) % 2 AS speaker, CASE WHEN origin = 'span' AND start_ms % 5 = 0 THEN 'fr' END AS lang FROM j4),
  q AS (SELECT *, sum((origin = 'span')::INT) OVER w AS g, lead(origin) OVER w AS no, lead(start_ms) OVER w AS ns, lead(speaker) OVER w AS nsp, lead(lang) OVER w AS nl,
    origin = 'rest' AND (end_ms - start_ms < 60000 OR len(string_split(text, ' ')) < 3) AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > length(regexp_replace(text, '[^\x{05D0}-\x{05EA}]', '', 'g')) AS may
    FROM p5 WINDOW w AS (PARTITION BY vid ORDER BY start_ms, end_ms, text)),
  h AS (SELECT *, row_number() OVER i AS n, max(end_ms) OVER (PARTITION BY vid, g ORDER BY start_ms, end_ms, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
    first_value(speaker) OVER i AS hsp, first_value(lang) OVER i AS hl FROM q WINDOW i AS (PARTITION BY vid, g ORDER BY start_ms, end_ms, text)),
  k AS (SELECT *, CASE WHEN n = 1 AND g > 0 THEN 0 WHEN may AND g > 0 AND hl IS NULL AND hsp = speaker AND abs(start_ms - top) <= 50 THEN 0 ELSE 1 END AS fails FROM h),
  r AS (SELECT *, origin <> 'span' AND sum(fails) OVER (PARTITION BY vid, g ORDER BY start_ms, end_ms, text) = 0 AS back FROM k),
  s AS (SELECT *, coalesce(may AND NOT back AND no = 'span' AND nl IS NULL AND nsp = speaker AND abs(ns - end_ms) <= 50, false) AS ahead FROM r),
  o AS (SELECT *, NOT back AND NOT coalesce(lag(ahead) OVER (PARTITION BY vid ORDER BY start_ms, end_ms, text), false) AS opens FROM s),
  u AS (SELECT *, sum(opens::INT) OVER (PARTITION BY vid ORDER BY start_ms, end_ms, text) AS gg FROM o)
  SELECT vid, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY start_ms, end_ms, text) AS text, max(origin) AS origin, max(speaker) AS speaker, max(lang) AS lang FROM u GROUP BY vid, gg""")
def j5(spark, sf_dir):
    """Pieces of two speakers, rests in two scripts, spans with a language of their own among them."""
    pieces = splice(spark, sf_dir).withColumns(
        {
            "text": F.expr("if(origin = 'rest' and start_ms % 4 = 0, replace(text, 'w', 'ש'), text)"), "speaker": F.expr("concat('S', (start_ms div 7000) % 2)"),
            "lang": F.expr("CASE WHEN origin = 'span' AND start_ms % 5 = 0 THEN 'fr' END"),
        }
    )
    return I.absorbed_rests(pieces, most_ms=60_000)


LONG = """long AS (SELECT vec_id // 16 AS vid, vec_id % 16 * 64 + frame AS frame, rms * 3.0::DOUBLE AS rms, rms * 2.0::DOUBLE AS voice FROM (SELECT vid AS vec_id, frame, rms FROM levels)),
  said AS (SELECT DISTINCT vec_id // 16 AS vid, vec_id % 16 AS k, 6400 * (vec_id % 16) + (vec_id // 16 * 700) % 3000 AS start_ms, 6400 * (vec_id % 16) + (vec_id // 16 * 700) % 3000 + CASE WHEN vec_id % 3 = 0 THEN 6000 ELSE 1500 END AS end_ms FROM embeddings WHERE vec_id % 4 < 2)"""


@query("n13_filled_gaps", cte("levels") + f",{LONG}" + """, hid AS (SELECT DISTINCT vid, unnest(range(start_ms // 100, end_ms // 100 + 1)) AS frame FROM said),
  f AS (SELECT l.*, l.frame - row_number() OVER (PARTITION BY l.vid ORDER BY l.frame) AS run FROM long l ANTI JOIN hid h ON l.vid = h.vid AND l.frame = h.frame),
  p AS (SELECT *, min(frame) OVER g AS first, max(frame) OVER g + 1 AS stop FROM f WINDOW g AS (PARTITION BY vid, run)),
  o AS (SELECT *, least(coalesce(min(frame + 1) FILTER (voice < 0.008::DOUBLE AND frame - first < 10) OVER (PARTITION BY vid, run), first), stop) AS a FROM p),
  l AS (SELECT *, max(rms) OVER (PARTITION BY vid, run) AS top FROM o WHERE frame >= a), n AS (SELECT *, least((frame - a) // 40, greatest(1, (stop - a + 20) // 40) - 1) AS k FROM l WHERE stop - a >= 6 AND top >= 0.04::DOUBLE),
  w AS (SELECT vid, run, k, min(frame) * 100 AS start_ms, (max(frame) + 1) * 100 AS end_ms, max(rms) AS top FROM n GROUP BY ALL), t AS (SELECT *, k - row_number() OVER (PARTITION BY vid, run ORDER BY k) AS stretch FROM w WHERE (vid + start_ms // 1000) % 3 <> 0)
  SELECT vid, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM t GROUP BY vid, run, stretch HAVING max(end_ms) - min(start_ms) >= 600 AND max(top) >= 0.04::DOUBLE""")
def n13(spark, sf_dir):
    """What is heard between segments of videos of a hundred seconds; every third second speaks another language."""
    long = T.levels(spark, sf_dir).selectExpr("vid div 16 AS vid", "vid % 16 * 64 + frame AS frame", "rms * 3D AS rms", "rms * 2D AS voice")
    said = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 4 < 2").selectExpr(
        "vec_id div 16 AS vid", "6400 * (vec_id % 16) + (vec_id div 16 * 700) % 3000 AS start_ms", "6400 * (vec_id % 16) + (vec_id div 16 * 700) % 3000 + if(vec_id % 3 = 0, 6000, 1500) AS end_ms"
    )
    return I.filled_gaps(long, said, F.expr("(vid + start_ms div 1000) % 3 <> 0"))
