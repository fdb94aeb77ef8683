"""Value sums, fee search and change for many transactions at once; failures are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fees import cbor_length, execution_fee, fixed_point, min_fee, ref_script_fee, size_fee
from ..functions.ranges import in_ranges, sum_before, with_earlier, within
from ..params import DEFAULT, Params

ASSET = ("policy_id", "asset_name")


def sum_values(rows: DataFrame, *keys: str) -> DataFrame:
    """Coin of each key."""
    return rows.groupBy(*keys).agg(F.sum("lovelace").cast("long").alias("lovelace"))


def sum_assets(rows: DataFrame, *keys: str) -> DataFrame:
    """Quantity of each asset of each key."""
    return rows.groupBy(*keys, *ASSET).agg(F.sum("qty").cast("long").alias("qty"))


def _signed_assets(inputs: DataFrame, mint: DataFrame, outputs: DataFrame) -> DataFrame:
    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select("tx_id", *ASSET, (F.col("qty") * sign).alias("qty"))

    return sum_assets(side(inputs, 1).unionByName(side(mint, 1)).unionByName(side(outputs, -1)), "tx_id")


def change_assets(inputs: DataFrame, mint: DataFrame, outputs: DataFrame) -> DataFrame:
    """Residual inputs + mint - outputs of each asset, as far as it is positive; shortfalls are dropped."""
    return _signed_assets(inputs, mint, outputs).where("qty > 0")


def balancing(params: Params = DEFAULT) -> Callable[[DataFrame], DataFrame]:
    """balance for the tables of many rounds, whose expressions are made once."""
    left = F.col("total_in") - F.col("total_out")

    def estimate(fee: Column) -> Column:
        size = F.col("base_size") + cbor_length(fee) + cbor_length(F.greatest(F.lit(0), left - fee))
        return size_fee(size, F.col("_other"), params)

    other = execution_fee(F.col("mem"), F.col("steps"), params) + ref_script_fee(F.col("ref_bytes"), params)
    search = fixed_point(estimate)
    fee = F.when(F.col("_search.converged"), F.col("_search.fee"))
    error = F.when(~F.col("_search.converged"), "FeeNotConverged").when(left - fee < 0, "InsufficientFee")
    added = [fee.alias("fee"), (left - fee).alias("change"), F.col("n_outputs").cast("long").alias("change_ix"), error.alias("error")]
    return lambda tx: tx.withColumn("_other", other).withColumn("_search", search).select(*tx.columns, *added)


def balance(tx: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds fee, change, change_ix and error to tx_id, base_size, total_in, total_out, n_outputs, mem, steps, ref_bytes.

    The size depends on the fee only by the lengths of the fee and of the change, which counts
    as 0 while it is negative. change is what is left, also when it is negative and the error
    is InsufficientFee; FeeNotConverged leaves fee and change null.
    """
    return balancing(params)(tx)


def balance_inputs(tx: DataFrame, spent: DataFrame, outputs: DataFrame, units: DataFrame | None = None, ref: DataFrame | None = None) -> DataFrame:
    """The columns balance needs. spent: tx_id, lovelace of resolved inputs; units: tx_id, mem, steps; ref: tx_id, ref_bytes."""
    out = tx.select("tx_id", "base_size")
    out = out.join(spent.groupBy("tx_id").agg(F.sum("lovelace").cast("long").alias("total_in")), "tx_id", "left")
    out = out.join(outputs.groupBy("tx_id").agg(F.sum("lovelace").cast("long").alias("total_out"), F.count(F.lit(1)).alias("n_outputs")), "tx_id", "left")
    zero = F.lit(0).cast("long")
    for part, columns in ((units, ("mem", "steps")), (ref, ("ref_bytes",))):
        if part is None:
            out = out.withColumns(dict.fromkeys(columns, zero))
        else:
            out = out.join(part.groupBy("tx_id").agg(*(F.sum(c).cast("long").alias(c) for c in columns)), "tx_id", "left")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("total_in", "total_out", "n_outputs", "mem", "steps", "ref_bytes")})


def even_refunds(fee: Column) -> Column:
    """What is left of total_in after the fee and a tip for each of n requests, split evenly; the remainder goes to the first; null if negative."""
    n = F.col("n").cast("long")
    total = F.col("total_in") - fee - n * F.col("tip")
    each = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.call_function("div", total, n) + F.when(i == 1, total % n).otherwise(0))
    return F.when(total >= 0, each)


def balance_fee_loop(requests: DataFrame, make_outputs: Callable[[Column], Column] = even_refunds, n_witnesses: int = 1, params: Params = DEFAULT) -> DataFrame:
    """Outputs that depend on the fee: make_outputs gives the array of their coins for a fee, or null, which is an OutputError.

    requests: tx_id, base_size and what make_outputs reads. Gives one row an output: tx_id, ix,
    lovelace, fee, error; a tx without outputs has one row, with the error. The size depends on the
    fee by the lengths of the fee and of the outputs.
    """
    zero = F.lit(0).cast("long")

    def estimate(fee: Column) -> Column:
        lengths = F.aggregate(F.coalesce(make_outputs(fee), F.array().cast("array<bigint>")), F.lit(0), lambda a, x: a + cbor_length(x))
        return min_fee(F.col("base_size") + 106 * n_witnesses + cbor_length(fee) + lengths, zero, zero, zero, params)

    out = requests.withColumn("_s", fixed_point(estimate)).withColumn("fee", F.when(F.col("_s.converged"), F.col("_s.fee")))
    out = out.withColumn("_made", make_outputs(F.col("fee")))
    error = F.when(F.col("fee").isNull(), "FeeNotConverged").when(F.col("_made").isNull(), "OutputError")
    made = out.withColumn("error", error).select("tx_id", "fee", "error", F.posexplode_outer(F.when(error.isNull(), F.col("_made"))).alias("ix", "lovelace"))
    return made.select("tx_id", F.col("ix").cast("long").alias("ix"), "lovelace", "fee", "error")


def bump_fee(outputs: DataFrame, tx: DataFrame) -> DataFrame:
    """Moves target - fee out of the change output. tx: tx_id, fee, target, change_ix.

    No lower guard: change may get negative, and a lower target raises it. A change index that
    names no output is an error on all rows of the tx.
    """
    seen = F.max(F.col("ix") == F.col("change_ix")).over(W.partitionBy("tx_id"))
    out = outputs.join(tx, "tx_id").withColumn("error", F.when(~seen, "BadChangeIndex"))
    moved = F.when(F.col("ix") == F.col("change_ix"), F.col("lovelace") - (F.col("target") - F.col("fee"))).otherwise(F.col("lovelace"))
    return out.select("tx_id", "ix", "address", moved.alias("lovelace"), F.col("target").alias("fee"), "error")


def chain_balances(seed: DataFrame, fees: DataFrame) -> DataFrame:
    """Remaining coin after each of a chain of self-transfers; a null fee is none. seed: chain, seed; fees: chain, n, fee."""
    rows = with_earlier(in_ranges(fees.select("chain", "n", "fee"), ["chain"], ["n"]), ["chain"], F.sum("fee"), before=sum_before)
    spent = F.col("before") + F.coalesce(F.sum("fee").over(within(["chain"]).orderBy("n").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return rows.select("chain", "n", "fee", spent.alias("spent")).join(seed, "chain").select("chain", "n", "fee", (F.col("seed") - F.col("spent")).cast("long").alias("balance"))
