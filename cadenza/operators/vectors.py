"""Vectors and sampled signals: levels, peaks, voices, silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """V3: a vector at length 1; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def frame_levels(samples: DataFrame, hop: int) -> DataFrame:
    """Root mean square of each whole frame of ``hop`` samples (vid, pos, x); a rest is dropped."""
    frame = F.floor(F.col("pos") / hop).alias("frame")
    return samples.groupBy("vid", frame).agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12).alias("rms"), F.count("*").alias("n")).where(F.col("n") == hop).drop("n")


def peaks(samples: DataFrame, buckets: int, probe: int = 256) -> DataFrame:
    """(vid, bucket, peak): the largest magnitude among the first samples of each of ``buckets`` parts."""
    buckets = max(16, min(4000, buckets))
    sizes = samples.groupBy("vid").agg((F.max("pos") + 1).alias("n"))
    per = F.greatest(F.lit(1), F.floor(F.col("n") / buckets))
    own = samples.join(sizes, "vid").withColumn("per", per).withColumn("bucket", F.floor(F.col("pos") / F.col("per")))
    tops = own.where((F.col("bucket") < buckets) & (F.col("pos") % F.col("per") < F.least(F.lit(probe), F.col("per")))).groupBy("vid", "bucket").agg(F.max(F.abs("x")).alias("top"))
    every = sizes.select("vid", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return every.join(tops, ["vid", "bucket"], "left").select("vid", "bucket", F.round(F.coalesce("top", F.lit(0.0)), 4).alias("peak"))


def band_ratio(windows: DataFrame, rate: int) -> DataFrame:
    """(vid, ratio) of the mean energy at 5.5–14 kHz to that at 0.2–3.5 kHz of (vid, samples)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for samples in batch.column("samples"):
                x = np.asarray(samples.as_py() or [], np.float64)
                if not len(x):
                    out.append(None)
                    continue
                power, at = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
                high, middle = power[(at >= 5500) & (at < 14000)], power[(at >= 200) & (at < 3500)]
                out.append(float((high.mean() if len(high) else 0.0) / ((middle.mean() if len(middle) else 0.0) + 1e-12)))
            yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array(out, pa.float64())], ["vid", "ratio"])

    return windows.select("vid", "samples").mapInArrow(each, "vid bigint, ratio double")


def voice_outliers(vectors: DataFrame, low: float = 0.25, coherent: float = 0.35) -> DataFrame:
    """V1: (key, speaker, keep): a window goes only if it is unlike its speaker's others and those are alike.

    Mean similarities come from the speaker's sum vector, so nothing is paired. Fewer than three windows
    are all kept, and never are all rejected.
    """
    square = dot(F.col("vec"), F.col("vec"))
    each = vectors.withColumn("sq", square)
    by_dim = each.select("speaker", F.posexplode("vec").alias("d", "x")).groupBy("speaker", "d").agg(F.sum("x").alias("x"))
    sums = by_dim.groupBy("speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("sum"))
    sizes = each.groupBy("speaker").agg(F.count("*").alias("n"), F.sum("sq").alias("squares"))
    joined = each.join(sums.join(sizes, "speaker"), "speaker")
    with_sum = dot(F.col("vec"), F.col("sum"))
    mean = (with_sum - F.col("sq")) / (F.col("n") - 1)
    others = (dot(F.col("sum"), F.col("sum")) - 2 * with_sum + F.col("sq") - (F.col("squares") - F.col("sq"))) / ((F.col("n") - 1) * (F.col("n") - 2))
    judged = joined.select("key", "speaker", F.when(F.col("n") < 3, True).otherwise((F.round(mean, 9) >= low) | (F.round(others, 9) < coherent)).alias("keep"))
    some = F.max("keep").over(Window.partitionBy("speaker"))
    return judged.select("key", "speaker", (F.col("keep") | ~some).alias("keep"))


def third_language(source: str, target: str) -> Column:
    """V4: the language to keep a passage for, or null to dub it, from the witnesses heard (lang, p), src_lp,
    tgt_lp and tgt_words."""
    lang, p, src_lp = F.col("lang"), F.coalesce("p", F.lit(0.0)), F.col("src_lp")
    other = F.coalesce((lang != "") & (lang != source), F.lit(False))
    named = other & (p >= 0.85)
    reads_target = F.coalesce((F.col("tgt_lp") >= -0.35) & (F.col("tgt_words") >= 3) & (src_lp.isNull() | (F.col("tgt_lp") >= src_lp + 0.10)), F.lit(False))
    return (
        F.when(F.coalesce(lang == source, F.lit(False)) & (p >= 0.6), F.lit(None)).when(other & (p >= 0.95), lang)
        .when((~named | (lang == target)) & reads_target, F.lit(target)).when(src_lp.isNull() | (src_lp >= -0.5), F.lit(None))
        .otherwise(F.when(named, lang).otherwise("und"))
    )


def without_long_silence(levels: DataFrame, floor: float, keep: int) -> DataFrame:
    """V5: frames renumbered after leading silence and all but ``keep`` frames of later silences are cut."""
    by = Window.partitionBy("vid").orderBy("frame")
    quiet = F.col("rms") < floor
    marked = levels.withColumn("quiet", quiet).withColumn("heard", F.sum((~quiet).cast("int")).over(by))
    place = F.row_number().over(Window.partitionBy("vid", "heard", "quiet").orderBy("frame"))
    kept = marked.withColumn("place", place).where(~F.col("quiet") | ((F.col("heard") > 0) & (F.col("place") <= keep)))
    return kept.select("vid", (F.row_number().over(by) - 1).cast("long").alias("frame"), "rms")


def clip_gain(samples: DataFrame, target: float = 0.085, cap: float = 1.25, peak: float = 0.98) -> DataFrame:
    """V6: (vid, gain): brings a clip's level to the target, at most ``cap`` times and below the peak limit."""
    stats = samples.groupBy("vid").agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12).alias("rms"), F.max(F.abs("x")).alias("top"))
    gain = F.least(F.lit(cap), target / F.col("rms"))
    return stats.select("vid", F.round(F.least(gain, F.when(F.col("top") > 0, peak / F.col("top")).otherwise(cap)), 6).alias("gain"))


def reference_windows(windows: DataFrame, least_ms: int = 2500, target_ms: int = 4500) -> DataFrame:
    """O3: each speaker's cleanest window of 2.5 s or more, else the cleanest ones until 4.5 s are together."""
    length = F.col("end_ms") - F.col("start_ms")
    by = Window.partitionBy("speaker").orderBy("noise", "start_ms", "key")
    long = (length >= least_ms).cast("int")
    marked = windows.withColumns({"len": length, "long": long, "any": F.max(long).over(Window.partitionBy("speaker"))})
    best = marked.where("long = 1").withColumn("r", F.row_number().over(by)).where("r = 1")
    several = marked.where("any = 0").withColumn("before", F.sum("len").over(by) - F.col("len")).where(F.col("before") < target_ms)
    return best.select("speaker", "key", "start_ms", "end_ms").unionByName(several.select("speaker", "key", "start_ms", "end_ms"))


def alternates(windows: DataFrame, chosen: DataFrame, most: int = 3) -> DataFrame:
    """The next cleanest windows of each speaker that were not chosen."""
    by = Window.partitionBy("speaker").orderBy("noise", "start_ms", "key")
    return windows.join(chosen.select("key"), "key", "left_anti").withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("speaker", "key", "place")
