"""Lookup of unspent outputs: projections, filters and joins keyed by (tx_id, ix)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.pinned import pinned
from ..functions.ranges import in_ranges, sum_before, with_earlier, within


def utxos_at(utxo: DataFrame, addresses: DataFrame) -> DataFrame:
    """Outputs at any of the addresses; an unknown address gives no rows."""
    return utxo.join(addresses.select("address"), "address", "left_semi")


def input_keys(tx_input: DataFrame) -> DataFrame:
    """Distinct (tx_id, src_tx_id, src_ix) over spent, collateral and reference inputs."""
    return tx_input.select("tx_id", "src_tx_id", "src_ix").distinct()


def _by_source(utxo: DataFrame) -> DataFrame:
    return utxo.withColumnsRenamed({"tx_id": "src_tx_id", "ix": "src_ix"})


def resolve_inputs(tx_input: DataFrame, utxo: DataFrame) -> DataFrame:
    """Each tx's inputs of any role with the outputs they name; unknown keys are absent."""
    return input_keys(tx_input).join(_by_source(utxo), ["src_tx_id", "src_ix"])


def unresolved_inputs(tx_input: DataFrame, utxo: DataFrame) -> DataFrame:
    return input_keys(tx_input).join(_by_source(utxo.select("tx_id", "ix")), ["src_tx_id", "src_ix"], "left_anti")


def spent_keys(tx_input: DataFrame) -> DataFrame:
    """Keys that some tx consumes; collateral and reference inputs are not spent."""
    return tx_input.where("kind = 'spend'").select(F.col("src_tx_id").alias("tx_id"), F.col("src_ix").alias("ix"))


def live_utxos(tx_output: DataFrame, tx_input: DataFrame) -> DataFrame:
    """Outputs made and not consumed."""
    return tx_output.join(spent_keys(tx_input), ["tx_id", "ix"], "left_anti")


def live_utxos_at(tx_output: DataFrame, tx_input: DataFrame, addresses: DataFrame) -> DataFrame:
    """As live_utxos, restricted to addresses before the join over all history."""
    return live_utxos(utxos_at(tx_output, addresses), tx_input)


def utxos_with_policy(utxo: DataFrame, policies: DataFrame) -> DataFrame:
    return utxo.join(policies.select("policy_id"), "policy_id", "left_semi")


def utxos_with_asset(utxo: DataFrame, assets: DataFrame) -> DataFrame:
    """Outputs holding an asset with exactly the asked quantity; assets: policy_id, asset_name, qty."""
    return utxo.join(assets.select("policy_id", "asset_name", "qty"), ["policy_id", "asset_name", "qty"], "left_semi")


def change_outputs(tx_output: DataFrame) -> DataFrame:
    """The last output of each tx, named as the input of a next one."""
    last = tx_output.groupBy("tx_id").agg(F.max(F.struct("ix", "address", "lovelace")).alias("last"))
    return last.select(F.col("tx_id").alias("src_tx_id"), F.col("last.ix").alias("src_ix"), "last.address", "last.lovelace")


def ref_script_bytes(tx_input: DataFrame, ref_utxo: DataFrame) -> DataFrame:
    """Script bytes of the listed outputs that a tx references; an output listed twice counts twice, no match is 0."""
    keys = tx_input.where("kind = 'reference'").select("tx_id", "src_tx_id", "src_ix").distinct()
    met = keys.join(_by_source(ref_utxo.select("tx_id", "ix", "script_bytes")), ["src_tx_id", "src_ix"], "left")
    return met.groupBy("tx_id").agg(F.sum(F.coalesce("script_bytes", F.lit(0))).cast("long").alias("ref_bytes"))


def pick_change_address(tx_output: DataFrame) -> DataFrame:
    """The address of the first output without datum, else of the first output."""
    return tx_output.groupBy("tx_id").agg(F.min_by("address", F.struct("has_datum", "ix")).alias("address"))


def output_at(tx_output: DataFrame, requests: DataFrame) -> DataFrame:
    """The output at a requested (tx_id, ix); nulls past the end."""
    return requests.select("tx_id", "ix").join(tx_output.select("tx_id", "ix", "address", "lovelace"), ["tx_id", "ix"], "left")


def select_coins(utxo: DataFrame, targets: DataFrame) -> DataFrame:
    """Largest-first coins of each owner until the target is covered, with the shortfall if it is not.

    utxo: owner, tx_id, ix, lovelace. targets: owner, target. An owner without coins keeps one
    row with null coins and the whole target as shortfall.

    Coins are classed by the number of binary digits of their value, and an owner's classes are
    summed first. Classes that are needed whole are taken whole, smaller ones than needed never
    travel, and only the coins of the one class in which the target falls are put in order, in
    ranges, so that an owner with many coins of one class spreads over many tasks.
    """
    digits = F.length(F.bin(F.col("lovelace"))).alias("digits")
    sums = utxo.groupBy("owner", digits).agg(F.sum("lovelace").alias("held"))
    larger = W.partitionBy("owner").orderBy(F.desc("digits")).rowsBetween(W.unboundedPreceding, -1)
    classes = sums.select("owner", "digits", "held", F.coalesce(F.sum("held").over(larger), F.lit(0)).alias("above"), F.sum("held").over(W.partitionBy("owner")).alias("total"))
    asked = targets.select("owner", "target").join(classes, "owner", "left").withColumn("shortfall", F.greatest(F.lit(0), F.col("target") - F.coalesce("total", F.lit(0))))
    needed = asked.where("above < target").select("owner", "digits", "target", "shortfall", "above", (F.col("above") + F.col("held") <= F.col("target")).alias("whole"))
    coins = pinned(utxo.select("owner", "tx_id", "ix", "lovelace", digits).join(needed, ["owner", "digits"]))  # read whole, and cut in ranges
    placed = in_ranges(coins.where("not whole").drop("whole", "digits").withColumn("_size", -F.col("lovelace")), ["owner"], ["_size", "tx_id", "ix"])
    cut = with_earlier(placed, ["owner"], F.sum("lovelace"), _larger=sum_before)
    order = within(["owner"]).orderBy("_size", "tx_id", "ix").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.col("above") + F.col("_larger") + F.coalesce(F.sum("lovelace").over(order), F.lit(0))).where("before < target")
    columns = ["owner", "target", "tx_id", "ix", "lovelace", "shortfall"]
    none = asked.where("total is null").select("owner", "target", *(F.lit(None).cast(utxo.schema[c].dataType).alias(c) for c in ("tx_id", "ix", "lovelace")), "shortfall")
    return coins.where("whole").select(columns).unionByName(cut.select(columns)).unionByName(none)


def with_collateral(chosen: DataFrame, collateral: DataFrame, scripted: DataFrame) -> DataFrame:
    """Adds one collateral row, the largest key-owned output, for each owner whose tx runs scripts."""
    best = collateral.join(scripted.select("owner"), "owner", "left_semi").groupBy("owner").agg(F.max(F.struct("lovelace", "tx_id", "ix")).alias("c"))
    rows = best.select("owner", "c.tx_id", "c.ix", "c.lovelace", F.lit("collateral").alias("kind"))
    return chosen.where("tx_id is not null").select("owner", "tx_id", "ix", "lovelace", F.lit("spend").alias("kind")).unionByName(rows)
