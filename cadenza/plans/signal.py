"""Queries of vectors and signals, over embeddings and events."""

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..sources import tables as T
from ..sources.tables import cte
from .registry import query

SAMPLES = "WITH samples AS (SELECT vec_id AS vid, unnest(range(len(embedding)))::BIGINT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def samples(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.posexplode("embedding").alias("pos", "x")).select("vid", F.col("pos").cast("long"), F.col("x").cast("double"))


@query("a6_frame_levels", f"{SAMPLES} SELECT vid, pos // 12 AS frame, round(sqrt(avg(x*x) + 1e-12), 9) AS rms FROM samples GROUP BY ALL HAVING count(*) = 12")
def a6(spark, sf_dir):
    return V.frame_levels(samples(spark, sf_dir), 12).withColumn("rms", F.round("rms", 9))


@query("a8_peaks", f"{SAMPLES} SELECT vid, pos // 3 AS bucket, round(max(abs(x)), 4) AS peak FROM samples WHERE pos // 3 < 20 GROUP BY ALL")
def a8(spark, sf_dir):
    return V.peaks(samples(spark, sf_dir), 20)


@query("a9_band_ratio")
def a9(spark, sf_dir):
    windows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("samples"))
    return V.band_ratio(windows, 44_100)


@query("v1_voice_outliers", cte("vectors") + """, d AS (SELECT speaker, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM vectors), sm AS (SELECT speaker, d, sum(x) AS x FROM d GROUP BY ALL), sv AS (SELECT speaker, list(x ORDER BY d) AS total FROM sm GROUP BY speaker),
  sz AS (SELECT speaker, count(*) AS n, sum(list_dot_product(vec, vec)) AS squares FROM vectors GROUP BY speaker), m AS (SELECT key, speaker, n, squares, list_dot_product(vec, total) AS w, list_dot_product(vec, vec) AS sq, list_dot_product(total, total) AS t FROM vectors JOIN sv USING (speaker) JOIN sz USING (speaker)),
  k AS (SELECT key, speaker, n < 3 OR round((w - sq)/(n - 1), 9) >= 0.25 OR round((t - 2*w + sq - (squares - sq))/((n - 1)*(n - 2)), 9) < 0.35 AS keep FROM m)
  SELECT key, speaker, keep OR NOT bool_or(keep) OVER (PARTITION BY speaker) AS keep FROM k""")
def v1(spark, sf_dir):
    return V.voice_outliers(T.vectors(spark, sf_dir))


@query("v2_same_voice", cte("vectors") + ", c AS (SELECT speaker, arg_min(vec, key) AS canon FROM vectors GROUP BY speaker) SELECT key, round(list_dot_product(vec, canon), 6) AS similarity, round(list_dot_product(vec, canon), 6) >= 0.25 AS same FROM vectors JOIN c USING (speaker)")
def v2(spark, sf_dir):
    canon = T.vectors(spark, sf_dir).groupBy("speaker").agg(F.min_by("vec", "key").alias("canon"))
    near = F.round(V.dot(F.col("vec"), F.col("canon")), 6)
    return T.vectors(spark, sf_dir).join(canon, "speaker").select("key", near.alias("similarity"), (near >= 0.25).alias("same"))


@query("v3_unit_vectors", cte("vectors") + " SELECT key, round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) AS first, 1.0::DOUBLE AS norm FROM vectors")
def v3(spark, sf_dir):
    u = V.unit(F.col("vec"))
    return T.vectors(spark, sf_dir).select("key", F.round(F.get(u, F.lit(0)), 6).alias("first"), F.round(F.sqrt(V.dot(u, u)), 6).alias("norm"))


WITNESS = cte("spans") + ", w AS (SELECT vid, seq, CASE seq % 4 WHEN 0 THEN 'he' WHEN 1 THEN 'en' WHEN 2 THEN 'ar' END AS lang, p, CASE WHEN seq % 5 <> 0 THEN -(seq % 9) / 10.0::DOUBLE END AS src_lp, -(seq % 7) / 10.0::DOUBLE AS tgt_lp, seq % 6 AS tgt_words FROM spans)"


@query("v4_third_language", f"""{WITNESS}, x AS (SELECT *, coalesce(lang <> 'he', false) AS other, coalesce(lang <> 'he', false) AND p >= 0.85 AS named, coalesce(tgt_lp >= -0.35::DOUBLE AND tgt_words >= 3 AND (src_lp IS NULL OR tgt_lp >= src_lp + 0.10::DOUBLE), false) AS rt FROM w)
  SELECT vid, seq, CASE WHEN coalesce(lang = 'he', false) AND p >= 0.6 THEN NULL WHEN other AND p >= 0.95 THEN lang WHEN (NOT named OR lang = 'en') AND rt THEN 'en' WHEN src_lp IS NULL OR src_lp >= -0.5::DOUBLE THEN NULL WHEN named THEN lang ELSE 'und' END AS verdict FROM x""")
def v4(spark, sf_dir):
    w = T.spans(spark, sf_dir).selectExpr(
        "vid", "seq", "CASE seq % 4 WHEN 0 THEN 'he' WHEN 1 THEN 'en' WHEN 2 THEN 'ar' END AS lang", "p", "CASE WHEN seq % 5 <> 0 THEN -cast(seq % 9 AS double) / 10D END AS src_lp",
        "-cast(seq % 7 AS double) / 10D AS tgt_lp", "seq % 6 AS tgt_words",
    )
    return w.select("vid", "seq", V.third_language("he", "en").alias("verdict"))


@query("v5_silence_cut", cte("levels") + """, q AS (SELECT *, rms < 0.008::DOUBLE AS quiet, sum((rms >= 0.008::DOUBLE)::INT) OVER (PARTITION BY vid ORDER BY frame) AS heard FROM levels),
  p AS (SELECT *, row_number() OVER (PARTITION BY vid, heard, quiet ORDER BY frame) AS place FROM q) SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY frame) - 1 AS frame, rms FROM p WHERE NOT quiet OR (heard > 0 AND place <= 2)""")
def v5(spark, sf_dir):
    return V.without_long_silence(T.levels(spark, sf_dir), 0.008, 2)


@query("v6_clip_gain", f"{SAMPLES}, s AS (SELECT vid, sqrt(avg(x*x) + 1e-12) AS rms, max(abs(x)) AS top FROM samples GROUP BY vid) SELECT vid, round(least(least(1.25::DOUBLE, 0.085::DOUBLE / rms), 0.98::DOUBLE / top), 6) AS gain FROM s")
def v6(spark, sf_dir):
    return V.clip_gain(samples(spark, sf_dir))


CAND = "WITH cand AS (SELECT vec_id AS key, label AS speaker, vec_id * 7000 AS start_ms, vec_id * 7000 + (vec_id * 37) % CASE WHEN label % 2 = 0 THEN 2400 ELSE 4000 END AS end_ms, (vec_id * 13) % 101 AS noise FROM embeddings)"
REFS = CAND + """, m AS (SELECT *, end_ms - start_ms AS len, max((end_ms - start_ms >= 2500)::INT) OVER (PARTITION BY speaker) AS lng FROM cand),
refs AS (SELECT speaker, key, start_ms, end_ms FROM m WHERE end_ms - start_ms >= 2500 QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY noise, start_ms, key) = 1
  UNION ALL SELECT speaker, key, start_ms, end_ms FROM m WHERE lng = 0 QUALIFY sum(len) OVER (PARTITION BY speaker ORDER BY noise, start_ms, key ROWS UNBOUNDED PRECEDING) - len < 4500)"""


def candidates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id AS key", "label AS speaker", "vec_id * 7000 AS start_ms", "vec_id * 7000 + (vec_id * 37) % if(label % 2 = 0, 2400, 4000) AS end_ms", "(vec_id * 13) % 101 AS noise"
    )


@query("o3_reference_windows", f"{REFS} SELECT * FROM refs")
def o3(spark, sf_dir):
    return V.reference_windows(candidates(spark, sf_dir))


@query("o4_alternates", f"{REFS} SELECT speaker, key, row_number() OVER (PARTITION BY speaker ORDER BY noise, start_ms, key) AS place FROM cand WHERE key NOT IN (SELECT key FROM refs) QUALIFY place <= 3")
def o4(spark, sf_dir):
    return V.alternates(candidates(spark, sf_dir), V.reference_windows(candidates(spark, sf_dir)))


@query("o9_attempt_plan", f"""{REFS}, alt AS (SELECT speaker, key AS ref, row_number() OVER (PARTITION BY speaker ORDER BY noise, start_ms, key) AS place FROM cand WHERE key NOT IN (SELECT key FROM refs) QUALIFY place <= 3),
  u AS (SELECT key, key AS ref, 0 AS pos FROM cand UNION ALL SELECT c.key, r.key, 1 FROM cand c JOIN refs r USING (speaker) UNION ALL SELECT c.key, a.ref, a.place + 1 FROM cand c JOIN alt a USING (speaker)),
  d AS (SELECT key, ref, min(pos) AS pos FROM u GROUP BY ALL), l AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos, ref) - 1 AS rung, ref, false AS greedy FROM d QUALIFY rung <= 2)
  SELECT * FROM l UNION ALL SELECT key, max(rung) + 1, key, true FROM l GROUP BY key""")
def o9(spark, sf_dir):
    from ..operators.witnesses import attempt_plan

    windows = candidates(spark, sf_dir)
    chosen = V.reference_windows(windows)
    return attempt_plan(windows.select("key", "speaker"), chosen, V.alternates(windows, chosen))


@query("o10_reference", f"{REFS}, c AS (SELECT speaker, arg_min(key, (start_ms, key)) AS canon FROM refs GROUP BY speaker) SELECT key, CASE WHEN key % 11 = 0 THEN key + 1 WHEN end_ms - start_ms >= 2500 AND noise < 60 THEN key WHEN noise < 20 AND canon IS NULL THEN key ELSE canon END AS ref FROM cand LEFT JOIN c USING (speaker)")
def o10(spark, sf_dir):
    """The reference of each line: pinned, else its own window if long and clean, else the canonical one."""
    windows = candidates(spark, sf_dir)
    canon = V.reference_windows(windows).groupBy("speaker").agg(F.min_by("key", F.struct("start_ms", "key")).alias("canon"))
    long, noise = F.col("end_ms") - F.col("start_ms") >= 2500, F.col("noise")
    ref = F.when(F.col("key") % 11 == 0, F.col("key") + 1).when(long & (noise < 60), F.col("key")).when((noise < 20) & F.col("canon").isNull(), F.col("key")).otherwise(F.col("canon"))
    return windows.join(canon, "speaker", "left").select("key", ref.alias("ref"))
