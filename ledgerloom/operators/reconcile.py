"""Field-by-field differences of two tables of transactions given as child tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.pinned import pinned


def _rows(section: str, df: DataFrame) -> DataFrame:
    columns = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("~"))) for c in df.columns if c != "tx_id"]
    return df.select("tx_id", F.lit(section).alias("section"), F.concat_ws(",", *columns).alias("element"))


#: Elements that a task compares, on average.
ELEMENTS = 500_000


def _differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Elements with different numbers on the two sides.

    Both sides are written and counted, and dealt to so many tasks by tx that each holds about
    ELEMENTS, whatever the session's number of partitions and however well the texts compress.
    """
    both = pinned(one.withColumn("n", F.lit(1)).unionByName(other.withColumn("n", F.lit(-1))))
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), both.count() // ELEMENTS + 1)
    sums = both.repartition(parts, "tx_id").groupBy("tx_id", "section", "element").agg(F.sum("n").alias("n")).where("n <> 0")
    return sums.select("tx_id", "section", "element", F.when(F.col("n") > 0, "expected").otherwise("actual").alias("side"), F.abs("n").cast("long").alias("n"))


def diff_structural(expected: Mapping[str, DataFrame], actual: Mapping[str, DataFrame]) -> DataFrame:
    """(tx_id, section, element, side, n): elements that only one side has, n times more than the other.

    Sections are child tables by name: inputs, outputs, mint and so on, without fee, signatures
    and integrity digest. A section that a mapping lacks counts as empty.
    """
    def union(tables: Mapping[str, DataFrame]) -> DataFrame:
        parts = [_rows(k, tables[k]) for k in sorted(tables)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return _differences(union(expected), union(actual))


def diff_balanced(expected: DataFrame, actual: DataFrame, change: DataFrame, fees: DataFrame, units: DataFrame | None = None, actual_units: DataFrame | None = None) -> DataFrame:
    """(tx_id, problem): balanced outputs must be the expected ones and one more, at the change address, without datum, with a fee, with equal units.

    expected, actual: tx_id, ix, address, lovelace, has_datum; change: tx_id, address; fees: tx_id, fee;
    units, actual_units: tx_id, purpose, ix, mem, steps of the redeemers, both or none.
    """
    n = expected.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"))
    sized = actual.join(n, "tx_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    last = sized.groupBy("tx_id").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.max(F.struct("ix", "address", "has_datum")).alias("last"))
    wanted = change.select("tx_id", F.col("address").alias("wanted"))
    facts = last.join(wanted, "tx_id", "full_outer").join(fees.select("tx_id", "fee"), "tx_id", "left")
    facts = facts.withColumns({"m": F.coalesce("m", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    names = {
        "not one extra output": F.col("m") == F.col("n") + 1, "change address": F.col("last.address").eqNullSafe(F.col("wanted")),
        "change has datum": ~F.coalesce("last.has_datum", F.lit(False)), "no fee": F.coalesce(F.col("fee") > 0, F.lit(False)),
    }
    failed = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in names.items()))
    shape = facts.select("tx_id", F.explode(failed).alias("problem")).where("problem is not null")
    columns = ["tx_id", "ix", "address", "lovelace", "has_datum"]
    rest = _differences(_rows("outputs", expected.select(*columns)), _rows("outputs", sized.where("ix < n").select(*columns)))
    out = shape.unionByName(rest.select("tx_id", F.lit("outputs differ").alias("problem")).distinct())
    if units is None or actual_units is None:
        return out
    columns = ["tx_id", "purpose", "ix", "mem", "steps"]
    other = _differences(_rows("redeemers", units.select(*columns)), _rows("redeemers", actual_units.select(*columns)))
    return out.unionByName(other.select("tx_id", F.lit("units differ").alias("problem")).distinct())
