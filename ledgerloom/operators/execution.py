"""Execution units of redeemers, failures and the outcome of a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.pinned import pinned
from ..params import DEFAULT, EVALUATION_MEM, EVALUATION_STEPS, Params
from .assembly import integrity_digest
from .balance import balance, bump_fee

KEY = ["tx_id", "purpose", "ix"]
#: Purposes of redeemers in the order of their keys.
PURPOSES = ("spend", "mint", "reward")


def with_units(redeemer: DataFrame, mem: int = 0, steps: int = 0) -> DataFrame:
    """Placeholder units, or with_evaluation_budget's."""
    return redeemer.withColumns({"mem": F.lit(mem).cast("long"), "steps": F.lit(steps).cast("long")})


def with_evaluation_budget(redeemer: DataFrame) -> DataFrame:
    return with_units(redeemer, EVALUATION_MEM, EVALUATION_STEPS)


def patch_units(redeemer: DataFrame, results: DataFrame, margin: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Units from the results with a margin; a missing or failed result keeps the old ones."""
    new = results.where("ok").select(*KEY, F.col("mem").alias("new_mem"), F.col("steps").alias("new_steps"))
    out = redeemer.join(new, KEY, "left")
    patched = {c: F.coalesce(margin(F.col(f"new_{c}")), F.col(c)).cast("long") for c in ("mem", "steps")}
    return out.withColumns(patched).drop("new_mem", "new_steps")


def eval_failures(results: DataFrame) -> DataFrame:
    """(tx_id, purpose, ix, n_failed): the first failed redeemer of each tx in key order, and how many failed.

    Keys are ordered by purpose as in PURPOSES, then by index; other purposes come last.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PURPOSES)), F.col("purpose")), F.lit(0))
    first = F.min(F.struct(F.when(rank == 0, len(PURPOSES) + 1).otherwise(rank).alias("rank"), "purpose", "ix"))
    failed = results.where("not ok").groupBy("tx_id").agg(first.alias("x"), F.count(F.lit(1)).alias("n_failed"))
    return failed.select("tx_id", "x.purpose", "x.ix", "n_failed")


def failure_decision(attempts: DataFrame) -> DataFrame:
    """terminal after a retry, reuse of the units if a fee is known, else retry with the estimate. attempts: retried, prev_fee."""
    return attempts.withColumn("decision", F.when(F.col("retried"), "terminal").when(F.col("prev_fee") > 0, "reuse").otherwise("retry"))


def fee_trace(history: DataFrame) -> DataFrame:
    """Adds max_fee, converged, oscillates, low and high to (tx_id, n, fee): fees of a build in order."""
    order = W.partitionBy("tx_id").orderBy("n")
    before = F.lag("fee").over(order)
    seen = F.row_number().over(W.partitionBy("tx_id", "fee").orderBy("n")) > 1
    oscillates = F.coalesce(seen & (F.col("fee") != before), F.lit(False))
    return history.select(
        "tx_id", "n", "fee", F.max("fee").over(order).alias("max_fee"), F.coalesce(F.col("fee") == before, F.lit(False)).alias("converged"), oscillates.alias("oscillates"),
        F.when(oscillates, F.least("fee", before)).alias("low"), F.when(oscillates, F.greatest("fee", before)).alias("high"),
    )


def smallest_passing_fee(evals: DataFrame, bounds: DataFrame) -> DataFrame:
    """The smallest evaluated fee in (low, high] without failure, high if none. evals: tx_id, fee, ok; bounds: tx_id, low, high."""
    inside = (F.col("fee") > F.col("low")) & (F.col("fee") <= F.col("high")) & F.col("ok")
    found = bounds.join(evals, "tx_id", "left").groupBy("tx_id", "low", "high").agg(F.min(F.when(inside, F.col("fee"))).alias("found"))
    return found.select("tx_id", "low", "high", F.coalesce("found", "high").alias("fee"))


def evaluate_and_balance(inputs: DataFrame, redeemer: DataFrame, results: DataFrame, checks: Sequence[tuple[str, Column]] = (), margin: Callable[[Column], Column] = lambda x: x, params: Params = DEFAULT) -> DataFrame:
    """Units patched, digest taken, balanced, checked: tx_id, fee, change, integrity, outcome.

    inputs: what balance needs, without units. outcome: ok, EvalFailure, BalanceFailed or ChecksFailed.
    """
    patched = patch_units(redeemer, results, margin)
    units = patched.groupBy("tx_id").agg(F.sum("mem").cast("long").alias("mem"), F.sum("steps").cast("long").alias("steps"))
    zero = F.lit(0).cast("long")
    ready = inputs.drop("mem", "steps").join(units, "tx_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("mem", "steps")})
    failed = eval_failures(results).select("tx_id", "n_failed")
    out = balance(ready, params).join(integrity_digest(patched), "tx_id", "left").join(failed, "tx_id", "left")
    outcome = F.when(F.col("n_failed") > 0, "EvalFailure").when(F.col("error").isNotNull(), "BalanceFailed").when(_broken(checks), "ChecksFailed").otherwise("ok")
    return out.select("tx_id", "mem", "steps", "fee", "change", "integrity", outcome.alias("outcome"))


def _broken(checks: Sequence[tuple[str, Column]]) -> Column:
    """Whether any check fails; one without a result does."""
    broken = F.lit(False)
    for _, holds in checks:
        broken = broken | ~F.coalesce(holds, F.lit(False))
    return broken


def settle_at_fee(inputs: DataFrame, outputs: DataFrame, chosen: DataFrame, checks: Sequence[tuple[str, Column]] = (), params: Params = DEFAULT) -> DataFrame:
    """Balances, raises the fee to the chosen one where the balanced fee is lower, then checks: tx_id, ix, address, lovelace, fee, error.

    outputs: tx_id, ix, address, lovelace; chosen: tx_id, chosen; a tx without one settles at its
    balanced fee. The change output is the last. Checks see what balance gives, with the final fee
    and change; a tx that fails one keeps its outputs, with the error ChecksFailed. A tx that cannot
    be balanced has one row without output, with the error of balance.
    """
    # written, as a filter on the error would be pushed down and run the fee search once for each mention of it
    balanced = pinned(balance(inputs, params)).withColumnRenamed("fee", "balanced_fee").join(chosen.select("tx_id", "chosen"), "tx_id", "left")
    target = F.greatest("balanced_fee", "chosen")
    fees = balanced.withColumns({"fee": target, "change": F.col("change") - (target - F.col("balanced_fee"))})
    fees = fees.withColumn("error", F.when(F.col("error").isNull() & _broken(checks), "ChecksFailed").otherwise(F.col("error")))
    failed = F.col("fee").isNull() | F.col("error").eqNullSafe("InsufficientFee")
    good = fees.where(~failed).select("tx_id", "balanced_fee", "fee", "change", "change_ix", F.col("error").alias("failure"))
    change = good.select("tx_id", F.col("change_ix").alias("ix"), F.lit(None).cast("long").alias("address"), (F.col("change") + (F.col("fee") - F.col("balanced_fee"))).alias("lovelace"))
    every = outputs.select("tx_id", "ix", "address", "lovelace").join(good.select("tx_id"), "tx_id", "left_semi").unionByName(change)
    bumped = bump_fee(every, good.select("tx_id", F.col("balanced_fee").alias("fee"), F.col("fee").alias("target"), "change_ix"))
    settled = bumped.join(good.select("tx_id", "failure"), "tx_id").withColumn("error", F.coalesce("error", "failure")).drop("failure")
    none = F.lit(None).cast("long")
    return settled.unionByName(fees.where(failed).select("tx_id", *(none.alias(c) for c in ("ix", "address", "lovelace", "fee")), "error"))
