"""Protocol parameters as data: the ones in force at a transaction's epoch, and the formulas over them."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, Window as W, functions as F

from ..params import DEFAULT, Params
from .balance import balance

#: Parameters that a table may give, by column; prices are two columns each.
PRICES = {"price_mem": ("price_mem_up", "price_mem_down"), "price_steps": ("price_steps_up", "price_steps_down")}
#: Rows of a table of parameters that may be broadcast, after they were counted.
FEW = 100_000


def as_columns(columns: list[str], default: Params = DEFAULT) -> Params:
    """Parameters read from the columns of a row; what has no column keeps its default."""
    found = {f.name: F.col(f.name) for f in fields(Params) if f.name in columns}
    prices = {name: tuple(map(F.col, pair)) for name, pair in PRICES.items() if set(pair) <= set(columns)}
    return replace(default, **found, **prices)


def in_force(tx: DataFrame, params: DataFrame, slot: str = "slot", epoch_slots: int = 432_000) -> DataFrame:
    """tx with the parameters in force at its slot: of the last row of params whose epoch is not later.

    params: epoch, unique, and any parameters; they change at the start of an epoch only. A row is
    laid out over the epochs it holds for, and the join is one of equal epochs. Before the first
    epoch, or without a slot, parameters are null.
    """
    order = W.orderBy("epoch")  # a row each change of parameters
    spans = params.withColumn("_until", F.lead("epoch").over(order))
    last = params.agg(F.max("epoch").alias("last")).first()["last"]
    each = spans.withColumn("_epoch", F.explode(F.sequence("epoch", F.coalesce(F.col("_until") - 1, F.col("epoch"))))).drop("_until", "epoch")
    if each.limit(FEW + 1).count() <= FEW:
        each = F.broadcast(each)
    epoch = F.least(F.call_function("div", F.col(slot), F.lit(epoch_slots).cast("long")), F.lit(last).cast("long"))
    epoch = F.when(F.col(slot).isNotNull(), epoch)
    return tx.withColumn("_epoch", epoch).join(each, "_epoch", "left").drop("_epoch")


def balance_in_force(tx: DataFrame, params: DataFrame, slot: str = "slot", epoch_slots: int = 432_000) -> DataFrame:
    """balance under the parameters in force at each transaction's slot; NoParameters where there are none."""
    known = in_force(tx, params, slot, epoch_slots)
    given = [c for c in params.columns if c != "epoch"]
    out = balance(known, as_columns(given))
    return out.withColumn("error", F.when(F.coalesce(*given).isNull(), "NoParameters").otherwise(F.col("error"))).drop(*given)
