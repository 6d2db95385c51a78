"""Queries of the script functions over documents."""

from pyspark.sql import functions as F

from ..functions import script as S
from .registry import query

AS_HEBREW = "regexp_replace(text, 'th', 'ש', 'g')"
L = r"regexp_replace(regexp_replace({x}, '[^\p{{L}}]', '', 'g'), '[^{r}]', '', 'g')"


def docs(spark, sf_dir):
    """Documents in which a frequent letter pair is written in Hebrew, so that scripts mix."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("vid"), "lang", F.regexp_replace("text", "th", "ש").alias("text")
    )


def sql(columns: str) -> str:
    return f"WITH d AS (SELECT doc_id AS vid, lang, {AS_HEBREW} AS text FROM documents) SELECT vid, {columns} FROM d"


def n(script: str, x: str = "text") -> str:
    return "length(" + L.format(x=x, r=S.char_class(S.RANGES[script])) + ")"


ALL = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"


@query("x1_script_for", "SELECT doc_id AS vid, 'latin' AS script, 'cyrillic' AS other, true AS same_as_en, false AS same_as_ru FROM documents")
def x1(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "vid", S.script_for(F.col("lang")).alias("script"), S.script_for(F.when(F.col("lang").isNotNull(), "UK")).alias("other"),
        S.same_script(F.col("lang"), F.lit("en")).alias("same_as_en"), S.same_script(F.col("lang"), F.lit("ru")).alias("same_as_ru"),
    )


@query("x2_count_letters", sql(f"{n('latin')} AS latin, {n('hebrew')} AS hebrew, {n('cjk')} AS cjk, {ALL} AS letters"))
def x2(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select(
        "vid", *[S.count_letters(t, s).cast("long").alias(s) for s in ("latin", "hebrew", "cjk")], S.letters(t).cast("long").alias("letters")
    )


@query("x3_script_ratio", sql(f"CASE WHEN {ALL} > 0 THEN {n('hebrew')}::DOUBLE / {ALL} ELSE 0.0::DOUBLE END AS ratio"))
def x3(spark, sf_dir):
    return docs(spark, sf_dir).select("vid", S.script_ratio(F.col("text"), "he").alias("ratio"))


@query("x4_latin_ratio", sql(f"CASE WHEN {n('latin')} + {n('hebrew')} > 0 THEN {n('latin')}::DOUBLE / ({n('latin')} + {n('hebrew')}) ELSE 0.0::DOUBLE END AS ratio"))
def x4(spark, sf_dir):
    return docs(spark, sf_dir).select("vid", S.latin_ratio(F.col("text")).alias("ratio"))


@query("x5_is_script", sql(f"{n('latin')} > 0.97 * {ALL} AND {ALL} > 0 AS mostly_latin"))
def x5(spark, sf_dir):
    return docs(spark, sf_dir).select("vid", S.is_script(F.col("text"), "fr", 0.97).alias("mostly_latin"))


@query("x6_speech_units", sql(r"greatest(1, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS words, greatest(1, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS characters"))
def x6(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("vid", S.speech_units(t, "fr").cast("long").alias("words"), S.speech_units(t, "ja").cast("long").alias("characters"))


@query(
    "x7_join_words",
    "WITH d AS (SELECT doc_id AS vid, list_filter(regexp_split_to_array(regexp_replace(text, 'the', '語', 'g'), '[ \\n]+'), lambda x: x <> '') AS a FROM documents)"
    f" SELECT vid, regexp_replace(regexp_replace(array_to_string(a, ' '), '([{S.SPACELESS}]) ', '\\1', 'g'), ' ([{S.SPACELESS}])', '\\1', 'g') AS line FROM d",
)
def x7(spark, sf_dir):
    text = F.regexp_replace("text", "the", "語")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("vid"), S.join_words(F.split(text, "[ \\n]+")).alias("line"))


@query(
    "x8_split_words",
    f"WITH d AS (SELECT doc_id AS vid, regexp_extract_all(regexp_replace(text, 'the', '語ん', 'g'), '([{S.SPACELESS}]|[^ \\t\\n\\x0B\\f\\r{S.SPACELESS}]+)') AS a FROM documents)"
    " SELECT vid, len(a) AS units, array_to_string(a, '|') AS line FROM d",
)
def x8(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    units = S.split_words(F.regexp_replace("text", "the", "語ん"))
    return d.select(F.col("doc_id").alias("vid"), F.size(units).cast("long").alias("units"), F.array_join(units, "|").alias("line"))


@query("f4_text_bucket", sql(f"CASE WHEN {n('latin')} = 0 AND {n('hebrew')} = 0 THEN NULL WHEN {n('latin')} > {n('hebrew')} THEN 'target' ELSE 'source' END AS bucket, NULL::VARCHAR AS same"))
def f4(spark, sf_dir):
    return docs(spark, sf_dir).select("vid", S.text_bucket(F.col("text"), "he", "en").alias("bucket"), S.text_bucket(F.col("text"), "en", "es").alias("same"))


@query("f5_text_is_target", sql(f"{ALL} > 0 AND {n('latin')} > 0.5 * {ALL} AS is_target"))
def f5(spark, sf_dir):
    return docs(spark, sf_dir).select("vid", S.text_is_target(F.col("text"), "he", "en").alias("is_target"))


@query("f6_is_target_text", sql(f"{n('latin')} >= 2 AND {n('latin')} > {ALL} - {n('latin')} AS ok, {n('hebrew')} >= 2 AND {n('hebrew')} > {ALL} - {n('hebrew')} AS ok_he"))
def f6(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("vid", S.is_target_text(t, "en").alias("ok"), S.is_target_text(t, "he").alias("ok_he"))


@query("f7_contradicts_source", sql(f"{ALL} >= 4 AND NOT ({n('hebrew')} > 0.5 * {ALL}) AS refuted"))
def f7(spark, sf_dir):
    return docs(spark, sf_dir).select("vid", S.contradicts_source(F.col("text"), "he").alias("refuted"))


@query("f8_leaks_source_script", sql(f"{n('hebrew')} > 0 AS leaks, false AS same"))
def f8(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("vid", S.leaks_source_script(t, "he", "en").alias("leaks"), S.leaks_source_script(t, "en", "es").alias("same"))


@query("f11_source_script_leak", sql(f"{n('hebrew')} > 0 AND ({n('hebrew')} >= {n('latin')} OR {n('latin')} < 3) AS leak"))
def f11(spark, sf_dir):
    s, t = S.count_letters(F.col("text"), "hebrew"), S.count_letters(F.col("text"), "latin")
    return docs(spark, sf_dir).select("vid", ((s > 0) & ((s >= t) | (t < 3))).alias("leak"))
