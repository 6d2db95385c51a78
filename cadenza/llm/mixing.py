"""Mixing sources to target weights by whole repetitions and one seeded Bernoulli copy.

Tokens are summed per source, each source gets a target by weight, and its rate of repetition is
target / size. A document is emitted floor(rate) times, and once more with a probability equal to the
rest of the rate, decided by a hash of its id: reruns and lost tasks decide alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, word_count

SEED = "mix-1"
#: Hexadecimal digits of the hash that make a number in [0, 1); 13 digits fit a double exactly.
DIGITS = 13


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """Targets per source from (source, source_size), one row for each source.

    Sources in code-point order, null last, take the weights in turn. They share ``share`` times the
    total in proportion to weight; a target above ``most`` times its source's size stops there and the
    excess goes to the others by weight, until none is above. That is the level at which, filling the
    sources in the order of cap / weight, the rest of the total is used up, so one ordered pass finds
    it. The pass runs over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long").alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return filled.select(
        "source",
        "source_size",
        F.when(F.col("ratio") >= final, final * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    Reads doc_id, text and source; other columns are ignored whatever their names. Null texts have
    size 0, a null source is a source of its own, a null id hashes as the empty string, repeated rows
    decide alike, and an empty table gives an empty plan. A source without words has target 0.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    joined = sized.alias("d").join(
        targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))
    )
    return joined.withColumn("copies", F.floor(rate) + extra).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


#: Sources whose rates are still broadcast.
MANY_SOURCES = 100_000


def mix_documents(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = SEED,
) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the plan takes it.

    All columns pass through. Edge cases are those of ``mixing_plan``; a document taken 0 times goes.
    """
    size = word_count(F.col("text"))
    targets = source_targets(docs.groupBy("source").agg(F.sum(size).alias("source_size")), weights, share, most)
    rates = targets.select(
        F.col("source").alias("of"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    # The columns of the input travel in one struct and cannot clash with those of the plan.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    # Few sources, counted first, are broadcast, so that no text is shuffled; many are joined by their key.
    rates = stored(rates)
    joined = rows.join(F.broadcast(rates) if rates.count() <= MANY_SOURCES else rates, F.col("row.source").eqNullSafe(F.col("of")))
    extra = (unit_hash(F.col("row.doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    copies = joined.select("row", (F.floor("rate").cast("int") + extra).alias("copies")).where("copies > 0")
    each = copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, [5, 2, 1][(k - 1) % 3 + 1]::BIGINT AS weight, source_size * 2 AS cap FROM sources
), levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER before, 0)::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    CASE WHEN ratio >= f THEN f * weight ELSE cap::DOUBLE END AS target
  FROM levels, (SELECT arg_min(level, ratio) AS f FROM levels WHERE ratio >= level)
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies,
  (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT * size AS taken
FROM rated
"""
