"""Orders within groups of any size.

Rows are dealt to ranges of group and order and written with their range, so a large group
spreads over many tasks. What a range adds is summed up per group and range, which is a row for
each group and each range at most, and what the earlier ranges of a group add is joined back.
Rows with the same order stay in one range; a null in a group's key is a value like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .pinned import pinned

#: The column of a row's range.
RANGE = "_p"


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written once, with the range of each row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pinned(df.repartitionByRange(parts, *group, *order).withColumn(RANGE, F.spark_partition_id()))


def within(group: Sequence[str]) -> W:
    """Window over a group's rows of one range."""
    return W.partitionBy(*group, RANGE)


def with_earlier(rows: DataFrame, group: Sequence[str], value: Column, **earlier) -> DataFrame:
    """Adds columns to rows of in_ranges: value is an aggregate of a group's rows of one range, each of
    earlier takes it and the window of the group's ranges in order."""
    sums = rows.groupBy(*group, RANGE).agg(value.alias("_value"))
    order = W.partitionBy(*group).orderBy(RANGE)
    keys = [*group, RANGE]
    made = sums.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(f(F.col("_value"), order).alias(name) for name, f in earlier.items()))
    same = [rows[k].eqNullSafe(made[f"_key{i}"]) for i, k in enumerate(keys)]
    return rows.join(made, same).drop(*(f"_key{i}" for i in range(len(keys))))


def sum_before(value: Column, order: W) -> Column:
    return F.coalesce(F.sum(value).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def sum_of_all(value: Column, order: W) -> Column:
    return F.sum(value).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def least_after(value: Column, order: W) -> Column:
    return F.min(value).over(order.rowsBetween(1, W.unboundedFollowing))


def one_before(value: Column, order: W) -> Column:
    return F.lag(value).over(order)
