"""The one mechanism for rules whose result depends on rows already rewritten."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())
}
#: Rows of a batch of results.
OUT_ROWS = 4096


def fields(schema: str) -> dict[str, str]:
    """Names and types of a schema such as ``vid bigint, text string``."""
    return dict(x.split() for x in schema.split(","))


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, TYPES[t]) for n, t in fields(schema).items()])


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[Iterator[dict]], Iterable[dict]], schema: str
) -> DataFrame:
    """Applies ``step`` to the rows of every key in order; it gets them one by one and may carry state along.

    Spark deals the keys out and sorts them, spilling where it must; a task never holds more of a key than
    the step keeps. A key is folded by one task, so callers cut long keys where their rule cannot reach
    across, and leave out what it cannot change. All rows are folded; a null key is a key.
    """
    each = _each(keys, step, schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def _each(keys: list[str], step: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` over the rows of sorted batches, key after key."""
    arrow, most = arrow_schema(schema), OUT_ROWS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        folded = (x for _, group in itertools.groupby(rows, lambda r: [r[k] for k in keys]) for x in step(group))
        while part := list(itertools.islice(folded, most)):
            yield pa.RecordBatch.from_pylist(part, arrow)

    return each


def cut(df: DataFrame, order: list[str | Column], opens: Column, touched: Column, key: str = "vid") -> DataFrame:
    """``df`` with island, counted anew in every key where ``opens``, and fold, whether a row of the island is ``touched``."""
    by = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumns({"__opens": F.coalesce(opens, F.lit(True)).cast("int"), "__touched": F.coalesce(touched, F.lit(False))})
    islands = numbered.withColumn("island", F.sum("__opens").over(by))
    return islands.withColumn("fold", F.max("__touched").over(Window.partitionBy(key, "island"))).drop("__opens", "__touched")


def fold_islands(
    df: DataFrame, order: list[str | Column], step: Callable[[Iterator[dict]], Iterable[dict]], schema: str, key: str = "vid"
) -> DataFrame:
    """The rows of ``df`` after ``cut``: islands marked ``fold`` go through ``step``, the others pass by.

    ``df`` comes from windows over ``key``, so a key's rows lie in one partition; they are sorted there, those that
    pass by first, and are neither moved nor made twice.
    """
    kinds = fields(schema)
    arrow, each_island = arrow_schema(schema), _each([key, "island"], step, schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            past = batch.num_rows - batch.column("fold").true_count
            if past:
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(0, past) for c in arrow.names], schema=arrow)
            if past < batch.num_rows:
                yield from each_island(itertools.chain([batch.slice(past)], batches))

    typed = df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if c in df.columns} | {"fold": F.coalesce("fold", F.lit(False))})
    return typed.sortWithinPartitions("fold", key, "island", *order).mapInArrow(each, schema)
