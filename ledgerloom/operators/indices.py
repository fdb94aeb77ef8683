"""Ledger indices: places in sorted distinct sets of a transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _place(rank: Column) -> Column:
    return (rank - 1).cast("long")


def spending_index(tx_input: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(tx_id, src_tx_id, src_ix, ix): places among the sorted distinct spent inputs, extra fee inputs included."""
    keys = tx_input.where("kind = 'spend'").select("tx_id", "src_tx_id", "src_ix")
    if extra is not None:
        keys = keys.unionByName(extra.select("tx_id", "src_tx_id", "src_ix"))
    order = W.partitionBy("tx_id").orderBy("src_tx_id", "src_ix")
    return keys.distinct().withColumn("ix", _place(F.row_number().over(order)))


def index_of(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Index of each asked input; error names the ones that the tx does not spend."""
    found = asked.select("tx_id", "src_tx_id", "src_ix").join(index, ["tx_id", "src_tx_id", "src_ix"], "left")
    return found.withColumn("error", F.when(F.col("ix").isNull(), "MissingInput"))


def output_index(tx_output: DataFrame) -> DataFrame:
    """first_ix: for each pay instruction the place of the first equal output, so equal outputs share it."""
    same = W.partitionBy("tx_id", "address", "lovelace", "policy_id", "asset_name", "qty", "has_datum")
    return tx_output.withColumn("first_ix", F.min("ix").over(same))


def policy_index(tx_mint: DataFrame) -> DataFrame:
    """(tx_id, policy_id, ix) of the sorted distinct policies with a quantity other than 0."""
    keys = tx_mint.where("qty <> 0").select("tx_id", "policy_id").distinct()
    return keys.withColumn("ix", _place(F.row_number().over(W.partitionBy("tx_id").orderBy("policy_id"))))


def withdrawal_index(withdrawals: DataFrame) -> DataFrame:
    """(tx_id, account, ix) of the sorted distinct accounts; account is the sort key supplied with the data."""
    keys = withdrawals.select("tx_id", "account").distinct()
    return keys.withColumn("ix", _place(F.row_number().over(W.partitionBy("tx_id").orderBy("account"))))


def redeemer_targets(redeemer: DataFrame, inputs: DataFrame, policies: DataFrame, accounts: DataFrame) -> DataFrame:
    """Targets with the redeemer at their index: inputs (I1), policies (I3), accounts (I4).

    A spend or withdrawal without redeemer is key-witnessed; a mint without one is an error.
    """
    def side(targets: DataFrame, purpose: str, key: Column) -> DataFrame:
        own = redeemer.where(F.col("purpose") == purpose).select("tx_id", "ix", "data")
        return targets.join(own, ["tx_id", "ix"], "left").select("tx_id", F.lit(purpose).alias("purpose"), "ix", key.alias("target"), "data")

    spends = side(inputs, "spend", F.concat_ws("#", "src_tx_id", "src_ix"))
    mints = side(policies, "mint", F.col("policy_id").cast("string"))
    rewards = side(accounts, "reward", F.col("account").cast("string"))
    witness = F.when(F.col("data").isNotNull(), "script").when(F.col("purpose") != "mint", "key")
    return spends.unionByName(mints).unionByName(rewards).withColumns({"witness": witness, "error": F.when(witness.isNull(), "MissingRedeemer")})
