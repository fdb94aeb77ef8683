"""Checks of transactions; each gives the violations as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..params import DEFAULT, Params
from .balance import ASSET, sum_assets

OUTPUT_OVERHEAD = 160


def check_min_utxo(outputs: DataFrame, params: Params = DEFAULT, only: DataFrame | None = None) -> DataFrame:
    """(tx_id, ix, actual, required) of outputs below coins_per_byte * (160 + size); outputs: tx_id, ix, lovelace, size.

    only: (tx_id, ix) of the outputs to check; one past the end passes.
    """
    if only is not None:
        outputs = outputs.join(only.select("tx_id", "ix"), ["tx_id", "ix"], "left_semi")
    required = (F.lit(params.coins_per_byte) * (OUTPUT_OVERHEAD + F.col("size"))).cast("long")
    return outputs.where(F.col("lovelace") < required).select("tx_id", "ix", F.col("lovelace").alias("actual"), required.alias("required"))


def check_tx_size(tx: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(tx_id, actual, max) of transactions above the limit; tx: tx_id, size."""
    limit = F.lit(params.max_tx_size).cast("long")
    return tx.where(F.col("size") > limit).select("tx_id", F.col("size").alias("actual"), limit.alias("max"))


def check_conservation(inputs: DataFrame, outputs: DataFrame, fees: DataFrame, mint: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """(tx_id, policy_id, asset_name, diff): inputs + mint + withdrawals - outputs - fee where it is not 0; the coin has no policy."""
    def coin(df: DataFrame, column: str, sign: int) -> DataFrame:
        none = F.lit(None).cast("long")
        return df.select("tx_id", none.alias("policy_id"), none.alias("asset_name"), (F.col(column) * sign).alias("qty"))

    def assets(df: DataFrame, sign: int) -> DataFrame:
        return df.where("policy_id is not null").select("tx_id", *ASSET, (F.col("qty") * sign).alias("qty"))

    rows = coin(inputs, "lovelace", 1).unionByName(coin(outputs, "lovelace", -1)).unionByName(coin(fees, "fee", -1)).unionByName(coin(withdrawals, "amount", 1))
    for part in (assets(inputs, 1), assets(outputs, -1), assets(mint, 1)):
        rows = rows.unionByName(part)
    return sum_assets(rows, "tx_id").where("qty <> 0").withColumnRenamed("qty", "diff")


def check_collateral(fees: DataFrame, collateral: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(tx_id, actual, required) where collateral does not cover the fee's percentage. fees: tx_id, fee; collateral: tx_id, lovelace."""
    held = collateral.groupBy("tx_id").agg(F.sum("lovelace").cast("long").alias("actual"))
    required = F.ceil(F.col("fee") * params.collateral_percent / F.lit(100)).cast("long")
    out = fees.join(held, "tx_id", "left").select("tx_id", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"), required.alias("required"))
    return out.where("actual < required")


def run_checks(tx: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(tx_id, place, check): failed checks of each tx in the order they are given; a null result fails."""
    failed = F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in checks.items()))
    every = tx.select("tx_id", F.posexplode(failed).alias("place", "check"))
    return every.where(F.col("check").isNotNull()).withColumn("place", F.col("place").cast("long"))
