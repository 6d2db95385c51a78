"""Queries of fingerprints, staleness and identity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.edits import STAGES
from .decisions import CLIPS, clips
from .registry import query

LIST = "['" + "', '".join(STAGES) + "']"


def fingerprints(runs, stages, params: str):
    """M1: (vid, stage, fp): a hash of the stage, its parameters and the fingerprint before it, in order."""
    chain = F.aggregate(
        F.array(*[F.lit(s) for s in stages]), F.array().cast("array<string>"),
        lambda acc, s: F.concat(acc, F.array(F.substring(F.sha1(F.concat_ws("|", s, F.expr(params), F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")))), 1, 16))),
    )
    return runs.select("vid", F.posexplode(chain).alias("k", "fp")).select("vid", F.get(F.array(*[F.lit(s) for s in stages]), F.col("k")).alias("stage"), F.col("k").cast("long").alias("k"), "fp")


def runs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("vid"), F.col("c_mktsegment").alias("genre"), F.col("c_nationkey").cast("long").alias("nation"))


CHAIN = f"""WITH RECURSIVE st AS (SELECT unnest({LIST}) AS stage, unnest(range(0, 9)) AS k), ch AS (
  SELECT c_custkey AS vid, 0::BIGINT AS k, 'fetch' AS stage, substr(sha1('fetch|' || c_mktsegment || '|'), 1, 16) AS fp, c_mktsegment AS genre FROM customer
  UNION ALL SELECT ch.vid, ch.k + 1, st.stage, substr(sha1(st.stage || '|' || ch.genre || '|' || ch.fp), 1, 16), ch.genre FROM ch JOIN st ON st.k = ch.k + 1)"""


@query("m1_stage_fingerprints", f"{CHAIN} SELECT vid, stage, k, fp FROM ch")
def m1(spark, sf_dir):
    return fingerprints(runs(spark, sf_dir), STAGES, "genre")


@query("m2_stage_done", f"{CHAIN} SELECT vid, stage, (vid + k) % 4 <> 0 AND (vid + k) % 3 <> 0 AS done FROM ch")
def m2(spark, sf_dir):
    """Stages whose mark equals the fingerprint and whose outputs exist."""
    now = fingerprints(runs(spark, sf_dir), STAGES, "genre")
    marks = now.select("vid", "stage", F.when((F.col("vid") + F.col("k")) % 4 == 0, F.concat("fp", F.lit("~provisional"))).otherwise(F.col("fp")).alias("mark"))
    files = now.where((F.col("vid") + F.col("k")) % 3 != 0).select("vid", "stage", F.lit(True).alias("exists"))
    return now.join(marks, ["vid", "stage"], "left").join(files, ["vid", "stage"], "left").select(
        "vid", "stage", (F.col("mark").eqNullSafe(F.col("fp")) & F.coalesce("exists", F.lit(False))).alias("done")
    )


@query("m3_reopened_from", f"{CHAIN} SELECT vid, stage, CASE WHEN k < vid % 9 THEN fp END AS mark FROM ch")
def m3(spark, sf_dir):
    """Marks after a run was reopened from one of its stages on."""
    return fingerprints(runs(spark, sf_dir), STAGES, "genre").select("vid", "stage", F.when(F.col("k") < F.col("vid") % 9, F.col("fp")).alias("mark"))


def digest():
    """M4: a hash of a segment's decisions; null and empty differ."""
    def shown(c):
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.substring(F.sha1(F.concat_ws("|", *[shown(c) for c in ("speaker", "text", "text_en", "keep_reason", "clip", "start_ms", "end_ms")])), 1, 12)


DIGEST = "substr(sha1(concat_ws('|', " + ", ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in ("speaker", "text", "text_en", "keep_reason", "clip", "start_ms", "end_ms")) + ")), 1, 12)"


@query("m4_content_fingerprint", f"{CLIPS} SELECT vid, substr(sha1(string_agg({DIGEST}, '|' ORDER BY {DIGEST})), 1, 16) AS fp FROM clips GROUP BY vid")
def m4(spark, sf_dir):
    return clips(spark, sf_dir).groupBy("vid").agg(F.substring(F.sha1(F.array_join(F.sort_array(F.collect_list(digest())), "|")), 1, 16).alias("fp"))


@query("m4_segment_digests", f"{CLIPS} SELECT vid, seq, {DIGEST} AS digest FROM clips")
def m4_segments(spark, sf_dir):
    return clips(spark, sf_dir).select("vid", "seq", digest().alias("digest"))


def delta(before, after):
    """Per video, how many segments differ between two tables of digests, present on one side included."""
    both = before.select("vid", "seq", F.col("digest").alias("b")).join(after.select("vid", "seq", F.col("digest").alias("a")), ["vid", "seq"], "full_outer")
    return both.groupBy("vid").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


DELTA = f"{CLIPS}, b AS (SELECT vid, seq, {DIGEST} AS d FROM clips WHERE n % 10 <> 0), a AS (SELECT vid, seq, {DIGEST} || CASE WHEN n % 4 = 0 THEN 'x' ELSE '' END AS d FROM clips WHERE n % 7 <> 0), u AS (SELECT coalesce(a.vid, b.vid) AS vid, a.d AS ad, b.d AS bd FROM a FULL JOIN b USING (vid, seq)), c AS (SELECT vid, count(*) FILTER (ad IS DISTINCT FROM bd) AS changed FROM u GROUP BY vid)"


def changes(spark, sf_dir):
    all_ = clips(spark, sf_dir).withColumn("digest", digest())
    return delta(all_.where("n % 10 <> 0"), all_.where("n % 7 <> 0").withColumn("digest", F.when(F.col("n") % 4 == 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest"))))


@query("u2_digest_delta", f"{DELTA} SELECT * FROM c")
def u2(spark, sf_dir):
    return changes(spark, sf_dir)


@query("m5_render_state", f"{DELTA} SELECT vid, changed, CASE WHEN changed = 0 THEN 'current' ELSE 'stale' END AS state FROM c")
def m5(spark, sf_dir):
    return changes(spark, sf_dir).withColumn("state", F.when(F.col("changed") == 0, "current").otherwise("stale"))


@query("m6_unique_ids", f"{CLIPS}, u AS (SELECT vid, seq, 's' || substr(sha1((n % 5)::VARCHAR), 1, 11) AS uid FROM clips), r AS (SELECT *, row_number() OVER (PARTITION BY vid, uid ORDER BY seq) - 1 AS k FROM u) SELECT vid, seq, CASE WHEN k = 0 THEN uid ELSE 's' || substr(sha1(uid || '#' || k), 1, 11) END AS uid FROM r")
def m6(spark, sf_dir):
    """Identities made unique: from the second of a kind on, a hash with its number."""
    minted = clips(spark, sf_dir).select("vid", "seq", F.concat(F.lit("s"), F.substring(F.sha1((F.col("n") % 5).cast("string")), 1, 11)).alias("uid"))
    k = F.row_number().over(Window.partitionBy("vid", "uid").orderBy("seq")) - 1
    again = F.concat(F.lit("s"), F.substring(F.sha1(F.concat_ws("#", "uid", "k")), 1, 11))
    return minted.withColumn("k", k).select("vid", "seq", F.when(F.col("k") == 0, F.col("uid")).otherwise(again).alias("uid"))


@query("m7_start_stage", f"{CLIPS} SELECT vid, CASE WHEN count(*) FILTER (NOT keep AND trim(coalesce(text_en, '')) = '') > 0 THEN 'translate' WHEN count(*) FILTER (clip IS NULL) > 0 THEN 'tts' ELSE 'mix' END AS stage FROM clips GROUP BY vid")
def m7(spark, sf_dir):
    """Where a render asked for from mix on must really start."""
    from ..operators.decisions import trimmed

    holes = clips(spark, sf_dir).groupBy("vid").agg(F.count_if(~F.col("keep") & (trimmed("text_en") == "")).alias("a"), F.count_if(F.col("clip").isNull()).alias("b"))
    return holes.select("vid", F.when(F.col("a") > 0, "translate").when(F.col("b") > 0, "tts").otherwise("mix").alias("stage"))


@query("m8_settings", "SELECT c_custkey AS vid, CASE WHEN c_custkey % 3 = 0 THEN 'en' WHEN c_custkey % 3 = 1 THEN 'fr' ELSE 'de' END AS tgt, coalesce(CASE WHEN c_nationkey > 12 THEN 'movie' END, 'documentary') AS genre FROM customer")
def m8(spark, sf_dir):
    """Effective settings: typed, else recorded, else default."""
    asked = runs(spark, sf_dir).selectExpr(
        "vid", "map_filter(map('tgt', if(vid % 3 = 0, 'en', null)), (k, v) -> v is not null) AS typed",
        "map_filter(map('tgt', if(vid % 3 < 2, 'fr', null), 'genre', if(nation > 12, 'movie', null)), (k, v) -> v is not null) AS recorded", "map('tgt', 'de', 'genre', 'documentary') AS standard",
    )
    def setting(k):
        return F.coalesce(F.try_element_at("typed", F.lit(k)), F.try_element_at("recorded", F.lit(k)), F.try_element_at("standard", F.lit(k)))
    return asked.select("vid", setting("tgt").alias("tgt"), setting("genre").alias("genre"))


@query("m9_new_work", f"{CLIPS}, k AS (SELECT vid, seq, sha1(coalesce(text_en, '') || '|' || speaker || '|' || n % 3) AS key FROM clips WHERE NOT keep) SELECT vid, seq, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE seq % 4 = 0)")
def m9(spark, sf_dir):
    """Voicings that no earlier one with the same key can stand for."""
    keyed = clips(spark, sf_dir).where("not keep").select("vid", "seq", F.sha1(F.concat_ws("|", F.coalesce("text_en", F.lit("")), "speaker", F.col("n") % 3)).alias("key"))
    return keyed.join(keyed.where("seq % 4 = 0").select("key").distinct(), "key", "left_anti").select("vid", "seq", "key")


@query("m10_input_identity", "SELECT page_id AS vid, substr(sha1(url), 1, 8) || '@' || substr(sha1(html), 1, 16) AS identity FROM pages")
def m10(spark, sf_dir):
    """Identity of an input: its path and its bytes."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("vid"), F.concat_ws("@", F.substring(F.sha1("url"), 1, 8), F.substring(F.sha1("html"), 1, 16)).alias("identity"))


@query("m11_unspoken", f"{CLIPS} SELECT vid, seq, CASE WHEN coalesce(NOT passthrough, false) OR (passthrough IS NULL AND coalesce(locked_keep, false)) THEN 'warning' ELSE 'violation' END AS kind FROM clips WHERE NOT keep AND trim(coalesce(text_en, '')) = ''")
def m11(spark, sf_dir):
    """Dubs without a line: violations, or warnings where the user insisted."""
    from ..operators.decisions import trimmed, user_wants_dub

    return clips(spark, sf_dir).where(~F.col("keep") & (trimmed("text_en") == "")).select("vid", "seq", F.when(user_wants_dub(), "warning").otherwise("violation").alias("kind"))
