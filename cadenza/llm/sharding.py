"""Sharding by sampled splitters: shards of nearly equal bytes, ranges of a hash of the text.

Records are ordered by a hash of their text, so equal texts lie together. A size-weighted sample of the
keys gives quantile boundaries, which cut the order into many ranges; each range is summed and sorted on
its own, and the sums say where in the whole order it starts. A key that alone is heavy overfills its
range: it gets a range of its own, subdivided by a hash of the document id.

Equal texts stay together. Groups that are heavy but fit in a shard are dealt to shards first, the largest
first; all other records fill up the shards in their order. Only a group larger than a shard is spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Hexadecimal digits of an md5 that make a key; 15 stay below 2**60.
DIGITS = 15


def hash_key(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, DIGITS), 16, 10).cast("long")


def position_in(bounds: list[int], key: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``: a binary search without branches."""
    width = 1
    while width <= len(bounds):
        width *= 2
    array = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(width >> s) for s in range(1, width.bit_length())] or [F.lit(0)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.try_element_at(array, at + step) <= key), at + step
        ).otherwise(at),
    )


def dealt(groups: list[tuple[int, int, int]], shards: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(key, shard, rows ahead) of groups (key, size, rows), the largest first to the emptiest shard; and the shards' sizes."""
    sizes, rows, out = [0] * shards, [0] * shards, []
    for key, size, copies in sorted(groups, key=lambda g: (-g[1], g[0])):
        shard = min(range(shards), key=lambda i: (sizes[i], i))
        out.append((key, shard, rows[shard]))
        sizes[shard] += size
        rows[shard] += copies
    return out, sizes


def room(sizes: list[int], rest: int) -> list[int]:
    """How much of ``rest`` each shard takes so that the shards become as equal as ``sizes`` allow, added up."""
    level, left = 0.0, list(range(len(sizes)))
    while left:
        level = (rest + sum(sizes[i] for i in left)) / len(left)
        over = [i for i in left if sizes[i] > level]
        if not over:
            break
        left = [i for i in left if i not in over]
    ends, at = [], 0.0
    for i, size in enumerate(sizes):
        at += max(0.0, level - size) if i in left else 0.0
        ends.append(math.ceil(at - 1e-3))
    return ends


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    ranges_per_shard: int = 32,
    rows_per_range: int = 1_000_000,
    samples_per_range: int = 40,
    tolerance: float = 0.01,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 length plus 1. Equal texts share a shard unless together they are larger than an
    even share of all bytes; then they are spread like single records, in the order of a hash of their ids. Where no
    group exceeds ``tolerance`` of a shard, shards differ by at most that and one document at either end; larger
    groups are dealt whole, and the rest evens them out as far as it goes. ``slot`` counts the rows of a shard
    from 0 without gaps.

    Null texts count as empty; null ids hash as the empty string; rows that agree in everything are
    interchangeable; an empty table gives no rows; other columns are ignored. What reaches the driver is
    two sums and the boundaries of the ranges, ``ranges_per_shard`` for a shard or one for
    ``rows_per_range`` records if that is more, and the only table that every task gets
    holds the heavy keys, of which there are at most ``shards / tolerance``.
    """
    text = F.coalesce("text", F.lit(""))
    id_hash = hash_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            hash_key(text).alias("key"),
            id_hash.alias("id_hash"),
        )
    )
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy_size = max(1, int(total / shards * tolerance))
    # At most ``shards / tolerance`` groups are heavy; they are all that the driver sees of the records.
    heavy = (
        keyed.groupBy("key").agg(F.sum("size").alias("heavy"), F.count("*").alias("copies"))
        .where((F.col("heavy") > heavy_size) & (F.col("copies") > 1)).collect()
    )
    whole, sizes = dealt([tuple(g) for g in heavy if g["heavy"] * shards <= total], shards)
    homes = {key: (shard, ahead) for key, shard, ahead in whole}
    told = docs.sparkSession.createDataFrame(
        [(g["key"], g["heavy"], *homes.get(g["key"], (None, None))) for g in heavy], "key long, heavy long, home int, ahead long"
    )
    ends = room(sizes, total - sum(sizes))
    marked = keyed.join(F.broadcast(told), "key", "left")

    # A record enters the sample with a probability in proportion to its size.
    ranges = max(shards * ranges_per_shard, -(-rows // rows_per_range))
    rate = ranges * samples_per_range / max(1, total)
    drawn = marked.where(F.col("heavy").isNull() & (F.col("id_hash") / float(16**DIGITS) < F.col("size") * rate))
    quantiles = [i / ranges for i in range(1, ranges)]
    bounds = drawn.agg(F.percentile_approx("key", quantiles, 20 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))

    cut = F.greatest(F.lit(1), F.ceil(F.col("heavy") / heavy_size))
    placed = marked.select(
        "doc_id", "size", "text_crc32", "key", "id_hash", "home", "ahead",
        F.col("heavy").isNotNull().alias("alone"),
        (F.lit(2) * position_in(bounds, F.col("key"))).alias("range"),
        F.when(F.col("heavy").isNotNull(), F.floor(F.col("id_hash") / float(16**DIGITS) * cut)).otherwise(0).cast("long").alias("part"),
    ).withColumn("heavy_key", F.when(F.col("alone"), F.col("key")).otherwise(F.lit(-1)))

    # A heavy key stands before the other keys of its range; its parts follow one another.
    group = ["range", "heavy_key", "part"]
    order = [F.col("range"), F.col("heavy_key").desc(), F.col("part")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Groups that have a home take no part in the order of bytes; rows are counted in the whole order.
    loose = F.col("home").isNull()
    starts = (
        placed.groupBy(*group)
        .agg(F.sum(F.when(loose, F.col("size")).otherwise(0)).alias("bytes"), F.count_if(loose).alias("loose"), F.count("*").alias("rows"))
        .select(*group, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "loose", "rows")))
    )
    inside = Window.partitionBy(*group).orderBy("key", "id_hash", "doc_id", "size")
    same = Window.partitionBy(*group, "key").orderBy("id_hash", "doc_id", "size")
    offset = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    counted = placed.withColumns(
        {"offset": offset, "n": F.row_number().over(inside) - 1}
    ).withColumn("lead", F.when(F.col("alone"), F.col("offset")).otherwise(F.first("offset").over(same)))
    place = position_in(ends[:-1], F.col("bytes_before") + F.col("lead"))
    located = stored(counted.join(F.broadcast(starts), group).select(
        "doc_id", "size", "text_crc32", "home", "ahead", F.when(~loose, F.col("key")).alias("group"),
        F.coalesce("home", F.least(F.lit(shards - 1), place)).cast("int").alias("shard"),
        (F.when(loose, F.col("loose_before")).otherwise(F.col("rows_before")) + F.col("n")).alias("at"),
    ))
    first = located.where(loose).groupBy("shard").agg(F.min("at").alias("first"), F.count("*").alias("loose"))
    opened = located.where(~loose).groupBy("group").agg(F.min("at").alias("opened"))
    slot = F.when(loose, F.col("at") - F.col("first")).otherwise(F.coalesce("loose", F.lit(0)) + F.col("ahead") + F.col("at") - F.col("opened"))
    return located.join(F.broadcast(first), "shard", "left").join(F.broadcast(opened), "group", "left").select(
        "doc_id", "size", "text_crc32", "shard", slot.alias("slot")
    )
