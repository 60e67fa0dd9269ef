"""Integer names for sorted rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Rows of a sorted range, about.
RANGE_ROWS = 100_000
_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with a column `name`: their place (from 0) in the given order, which must tell all rows apart.

    Rows are range-sorted; a row's place is its place within its range plus the rows of the ranges before it. Only the number of rows of each
    range reaches the driver: one in about range_rows rows.
    """
    n = rows.count()
    sorted_ = rows.repartitionByRange(n // range_rows + 1, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = materialize(sorted_, "sorted")
    ranges = placed.groupBy(F.shiftrightunsigned(name, _BITS).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    skipped, skip = {}, 0
    for r in ranges:
        skipped[r["range"]] = skip - (r["range"] << _BITS)
        skip += r["n"]
    if len(skipped) < 2:
        return placed
    # ranges that begin a new offset; found by position, so that the plan stays small
    offsets = F.array(*[F.lit(skipped.get(i, 0)).cast("long") for i in range(max(skipped) + 1)])
    return placed.withColumn(name, F.col(name) + F.element_at(offsets, (F.shiftrightunsigned(name, _BITS) + 1).cast("int")))
