"""Samples of an ordered history at positions that grow apart like Fibonacci numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ranges import RANGE, in_ranges, sum_before, sum_of_all, with_earlier, within


def positions(last: int) -> list[int]:
    """0-based positions up to last: running sums of 0, 1, 1, 2, 3, 5, ..."""
    out, a, b, at = [], 0, 1, 0
    while at <= last:
        out.append(at)
        a, b = b, a + b
        at += a
    return out


def numbered(df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Adds pos, from 0, and size of the partition.

    Rows are dealt to ranges, written with their range, counted, and numbered within it from the
    sum of the ranges before, so no task sees all rows of a partition, or of the table where
    there is none and the order is global.
    """
    if partition:
        rows = with_earlier(in_ranges(df, partition, order), partition, F.count(F.lit(1)), _before=sum_before, size=sum_of_all)
        place = F.row_number().over(within(partition).orderBy(*order)) - 1
        return rows.withColumn("pos", (F.col("_before") + place).cast("long")).drop("_before", RANGE)
    ranged = in_ranges(df, [], order)
    sizes = ranged.groupBy(RANGE).count().collect()  # a row for each range
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: r[RANGE]):
        rows.append((r[RANGE], before))
        before += r["count"]
    if not rows:
        return df.withColumns({"pos": F.lit(0).cast("long"), "size": F.lit(0).cast("long")})
    offset = F.create_map(*(x for p, n in rows for x in (F.lit(p), F.lit(n))))
    place = F.row_number().over(within([]).orderBy(*order)) - 1
    return ranged.withColumns({"pos": (F.element_at(offset, F.col(RANGE)) + place).cast("long"), "size": F.lit(before).cast("long")}).drop(RANGE)


def _at_positions(df: DataFrame) -> DataFrame:
    # O(log n) positions below any number of rows a table may have
    return df.where(F.col("pos").isin(*positions(1 << 50)))


def sample_list(df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Rows at the positions; the last row only if it is at one."""
    return _at_positions(numbered(df, order, partition)).drop("size")


def sample_fibonacci(df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Rows at the positions, and the last row."""
    rows = numbered(df, order, partition)
    return rows.where(F.col("pos").isin(*positions(1 << 50)) | (F.col("pos") == F.col("size") - 1)).drop("size")


def at_most(df: DataFrame, n: int, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """The n-th row, or the last if there are fewer; none for n below 1."""
    if n <= 0:
        return numbered(df, order, partition).where(F.lit(False)).drop("size")
    rows = numbered(df, order, partition)
    return rows.where(F.col("pos") == F.least(F.lit(n), F.col("size")) - 1).drop("size")
