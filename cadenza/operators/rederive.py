"""Edit, then only what follows: results of a chain of stages, kept in versions and derived again where an
edit reaches them.

A store is a folder. ``data/<generation>/part=<p>`` holds whole videos, dealt to parts by a hash; a version
is one small file that says which generation holds each part. A run writes the parts it touches as a new
generation and then the version, in one job of one file, so until that is there readers see the version
before, whole. Files of other parts are left as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Parts of a store; fixed when it is made.
PARTS = 64


class Stage(NamedTuple):
    """A step of the chain.

    ``derive`` takes rows of whole videos and returns them with the columns that it ``gives``; a change of
    one of its ``inputs`` sends a video back to it.
    """

    name: str
    inputs: Sequence[str]
    gives: Sequence[str]
    derive: Callable[[DataFrame], DataFrame]


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("vid"), F.lit(parts))


def versions(spark: SparkSession, root: str) -> DataFrame | None:
    """v, part, path of all versions; None where there is none yet."""
    try:
        return spark.read.schema("part bigint, path string, v bigint").json(f"{root}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def layout(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[int, str]]:
    """The newest version, or the one asked for, and the folder of each of its parts, of which there are few."""
    every = versions(spark, root)
    if every is None:
        return 0, {}
    number = version or every.agg(F.max("v")).first()[0] or 0
    rows = every.where((F.col("v") == number) & F.col("path").isNotNull()).collect()
    return number, {r.part: r.path for r in rows}


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The rows of the newest version, or of the one asked for; None where it has none."""
    folders = layout(spark, root, version)[1]
    return spark.read.parquet(*folders.values()) if folders else None


def reached(held: DataFrame | None, segments: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """vid, start: the first stage that a change of the video reaches, of videos with a change.

    A row that is new or gone reaches all stages; a field that no stage takes reaches the end of the chain,
    so that its value is kept and nothing runs.
    """
    if held is None:
        return segments.groupBy("vid").agg(F.lit(0).alias("start"))
    fields = [c for c in segments.columns if c not in ("vid", "seq")]
    old = held.select("vid", "seq", F.struct(*fields).alias("o"))
    both = segments.select("vid", "seq", F.struct(*fields).alias("n")).join(old, ["vid", "seq"], "full_outer")
    first = F.when(F.col("o").isNull() | F.col("n").isNull(), 0)
    for i, stage in enumerate(stages):
        for field in stage.inputs:
            first = first.when(~F.col(f"o.{field}").eqNullSafe(F.col(f"n.{field}")), i)
    first = first.when(~F.col("o").eqNullSafe(F.col("n")), len(stages))
    return both.groupBy("vid").agg(F.min(first).alias("start")).where("start is not null")


def derived(touched: DataFrame, stages: Sequence[Stage], starts: Sequence[int]) -> DataFrame:
    """Rows of touched videos, with start and the results held so far, after the stages from start on."""
    done = []
    for start in starts:
        rows = touched.where(F.col("start") == start)
        for stage in stages[start:]:
            rows = stage.derive(rows.drop(*stage.gives))
        done.append(rows)
    whole = done[0]
    for rows in done[1:]:
        whole = whole.unionByName(rows)
    return whole


def commit(spark: SparkSession, root: str, version: int, folders: dict[int, str]) -> None:
    """Makes a version seen. Fails if another run has made it; a version without parts has one row of nulls."""
    rows = [(p, f, version) for p, f in sorted(folders.items())] or [(None, None, version)]
    table = spark.createDataFrame(rows, "part bigint, path string, v bigint").coalesce(1)
    table.drop("v").write.mode("errorifexists").json(f"{root}/versions/v={version}")


def rederive(root: str, segments: DataFrame, stages: Sequence[Stage], parts: int = PARTS) -> dict:
    """Brings the store up to ``segments`` (vid, seq and fields; one row each, neither of them null).

    Rows get the stages' results, ``from_stage`` (where the chain began when the video was last derived) and
    ``version`` (when). Videos without a change are not derived, parts without one not written; a run that
    finds no change makes no version. Returns version, parts written, and how many videos began at which stage.
    """
    spark = segments.sparkSession
    number, folders = layout(spark, root)
    held = spark.read.parquet(*folders.values()) if folders else None
    reach = stored(reached(held, segments, stages))
    begun = {r.start: r["count"] for r in reach.groupBy("start").count().collect()}
    names = [s.name for s in stages] + [None]
    report = {"version": number, "parts": [], "videos": {names[k]: n for k, n in sorted(begun.items())}}
    if not begun:
        return report
    hit = sorted(r.part for r in reach.select(part_of(parts).alias("part")).distinct().collect())
    gives = [c for s in stages for c in s.gives]
    touched = segments.join(reach, "vid")
    if held is not None:
        touched = touched.join(held.select("vid", "seq", *gives), ["vid", "seq"], "left")
    at = F.get(F.array(*[F.lit(n).cast("string") for n in names]), F.col("start"))
    fresh = derived(touched, stages, sorted(begun)).withColumns({"from_stage": at, "version": F.lit(number + 1).cast("long")}).drop("start")
    if held is not None:
        kept = [folders[p] for p in hit if p in folders]
        if kept:
            fresh = fresh.unionByName(spark.read.parquet(*kept).join(reach, "vid", "left_anti"))
    generation = f"{root}/data/{uuid.uuid4().hex}"
    fresh.withColumn("part", part_of(parts)).write.partitionBy("part").parquet(generation)
    written = _written(spark, generation, fresh)
    commit(spark, root, number + 1, {p: f for p, f in folders.items() if p not in hit} | {p: f"{generation}/part={p}" for p in written})
    return report | {"version": number + 1, "parts": hit}


def _written(spark: SparkSession, generation: str, fresh: DataFrame) -> list[int]:
    """The parts that a generation has rows in."""
    table = spark.read.schema(fresh.withColumn("part", F.lit(0).cast("long")).schema).parquet(generation)
    return [r.part for r in table.select("part").distinct().collect()]
