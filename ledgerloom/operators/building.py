"""Building many transactions at once: interpret, evaluate, balance, again until each settles.

A builder's outputs may depend on the fee, and the fee on the outputs and on what the scripts
cost, so each transaction goes through rounds. All of a round's transactions go through it
together, as joins over tables; only the ones that aren't settled go on, and each round is
written, so a lost executor costs its tasks. A fee that comes back without being the previous one
oscillates, and its transaction is bisected between the two. Where scripts fail under one of the
two, it is not bisected but goes round; what it has in the last round is then known at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fees import cbor_length, min_fee
from ..functions.pinned import pinned
from ..params import DEFAULT, Params
from .balance import balancing
from .execution import PURPOSES

#: Execution units of a redeemer, in the order of keys.
UNITS = "array<struct<rank:int,purpose:string,ix:bigint,mem:bigint,steps:bigint>>"
_STATE = {
    "prev_fee": "long", "prev_change": "long", "units": UNITS, "seen": "array<bigint>", "max_fee": "long", "retries": "int",
    "low": "long", "high": "long", "base_fee": "long", "base_change": "long",
    "mark": f"struct<at:int,prev_fee:bigint,prev_change:bigint,units:{UNITS},fees:int,max_fee:bigint,retries:int>", "ends": "int",
}
_RESULT = {
    "tx_id": None, "fee": "long", "change": "long", "mem": "long", "steps": "long", "outcome": "string", "error": "string", "purpose": "string", "ix": "long", "rounds": "int",
}
#: First round whose state is kept to be compared with later ones; most transactions are settled before.
MARKED = 4


@dataclass(frozen=True)
class Program:
    """What a user says about the transactions.

    interpret: adds base_size, total_out, n_outputs and peeked to rows of tx_id, the columns of tx,
    prev_fee and prev_change, the fee and change of the transaction before (0 and null at first);
    peeked is whether all values that were read off that transaction are final.
    evaluate: results (tx_id, prev_fee, purpose, ix, ok, mem, steps, error) of the scripts of such
    rows, whose prev_fee is the fee they run under; one for each redeemer, or none. Both depend on
    these columns alone, so a transaction whose state comes back goes round for ever.
    margin: what evaluated units are raised to. checks: names and conditions over what balancing gives.
    """

    interpret: Callable[[DataFrame], DataFrame]
    evaluate: Callable[[DataFrame], DataFrame]
    margin: Callable[[Column], Column] = lambda x: x
    checks: Sequence[tuple[str, Column]] = ()


def _rank(purpose: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, PURPOSES)), purpose)
    return F.when(at == 0, len(PURPOSES) + 1).otherwise(at).cast("int")


def _named(redeemers: DataFrame) -> DataFrame:
    """units of each transaction that has redeemers: all of them in the order of keys, with nothing evaluated."""
    key = F.struct(_rank(F.col("purpose")).alias("rank"), "purpose", F.col("ix").cast("long").alias("ix"))
    zero = F.lit(0).cast("long")
    units = F.transform(F.array_sort(F.collect_set(key)), lambda r: F.struct(r["rank"].alias("rank"), r["purpose"].alias("purpose"), r["ix"].alias("ix"), zero.alias("mem"), zero.alias("steps")))
    return redeemers.groupBy("tx_id").agg(units.cast(UNITS).alias("units"))


def _evaluating(program: Program) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Gives drafts with failure, the first one in key order, and found, the units of all redeemers; asked are the drafts whose scripts run."""
    keys = ["tx_id", "prev_fee"]
    result = F.struct(_rank(F.col("purpose")).alias("rank"), "purpose", F.col("ix").cast("long").alias("ix"), "ok", "mem", "steps", "error")

    def answered(r: Column) -> Column:
        answer = F.get(F.filter("results", lambda x: x["ok"] & (x["purpose"] == r["purpose"]) & (x["ix"] == r["ix"])), 0)
        return F.struct(r.alias("of"), answer.alias("answer"))

    def units(a: Column) -> Column:
        parts = [F.coalesce(program.margin(a["answer"][c]), F.lit(0)).cast("long").alias(c) for c in ("mem", "steps")]
        return F.struct(*(a["of"][c].alias(c) for c in ("rank", "purpose", "ix")), *parts)

    failures = F.transform(F.filter("results", lambda x: ~x["ok"]), lambda x: F.struct(x["rank"].alias("rank"), x["purpose"].alias("purpose"), x["ix"].alias("ix"), x["error"].alias("error")))
    gathered, made = F.collect_list(result).alias("results"), {"failure": F.array_min(failures), "found": F.transform(F.transform("units", answered), units).cast(UNITS)}

    def evaluated(drafts: DataFrame, asked: DataFrame) -> DataFrame:
        return drafts.join(program.evaluate(asked).groupBy(*keys).agg(gathered), keys, "left").withColumns(made).drop("results")

    return evaluated


def _total(units: Column, part: str) -> Column:
    return F.aggregate(units, F.lit(0).cast("long"), lambda a, u: a + u[part])


def _broken(checks: Sequence[tuple[str, Column]]) -> Column:
    broken = F.lit(False)
    for _, holds in checks:
        broken = broken | ~F.coalesce(holds, F.lit(False))
    return broken


def _round(program: Program, params: Params) -> Callable[[DataFrame], DataFrame]:
    """Gives the state after a round, with outcome where the round settles a transaction, from the state before.

    Of a bisected one the middle fee is tried; where none is left, the upper one is final. Scripts
    run before it is known whether the transaction balances. All expressions are made once, as
    making them takes longer than a round of few transactions.
    """
    fee, change, prev_fee, prev_change, units, low, high = map(F.col, ("fee", "change", "prev_fee", "prev_change", "units", "low", "high"))
    halves, last, trial = low.isNotNull(), F.col("last"), low.isNotNull() & ~F.col("last")
    zero, middle = F.lit(0).cast("long"), F.expr("low + (high - low) div 2")
    is_last = {"last": F.coalesce(high <= low + 1, F.lit(False)), "rounds": F.col("rounds") + 1}
    under = {
        "prev_fee": F.when(~halves, prev_fee).when(last, high).otherwise(middle),
        "prev_change": F.when(~halves, prev_change).when(trial, F.col("base_change") - (middle - F.col("base_fee"))),
    }
    failed = F.col("failure").isNotNull()
    used, totals = F.when(halves | failed, units).otherwise(F.col("found")), {c: F.when(trial, zero).otherwise(_total(units, c)) for c in ("mem", "steps")}
    held = {"fee": F.when(halves, prev_fee).otherwise(fee), "change": F.when(halves, change - (prev_fee - fee)).otherwise(change)}
    # columns of their own, as code that repeats them at each mention gets too long to be compiled
    facts = {
        "_again": ~halves & failed & (F.col("retries") == 0) & (prev_fee == 0), "_same": fee == prev_fee, "_top": F.greatest("max_fee", "fee"),
        "_seen": F.array_contains("seen", fee), "_passed": trial & F.col("error").isNull() & ~failed,
    }
    again, same, top, seen, passed = map(F.col, facts)
    ended = same & (top == fee) & (F.col("peeked") | (fee == 0))
    stuck = same & (top == fee) & change.eqNullSafe(prev_change)
    checked = F.when(_broken(program.checks), "ChecksFailed").otherwise("ok")
    outcome = (
        F.when(last, F.when(F.col("error").isNotNull(), "BalanceFailed").otherwise(checked)).when(halves, None)
        .when(failed & (F.col("retries") > 0), "EvalFailure").when(again, None).when(F.col("error").isNotNull(), "BalanceFailed")
        .when(failed, F.when(same, "ok")).when(ended, checked).when(stuck, "NotConverged")
    )
    estimate = min_fee(F.col("base_size") + cbor_length(prev_fee), zero, zero, F.col("ref_bytes"), params)
    raised, swings = ~halves & ~failed & same & (top > fee), ~failed & ~same & seen
    then = {
        "outcome": outcome,
        "prev_fee": F.when(again, estimate).when(raised, top).otherwise(fee),
        "prev_change": F.when(again, F.lit(None)).when(raised, change - (top - fee)).otherwise(change),
        "units": F.when(passed, F.col("found")).otherwise(units),
        "seen": F.when(halves | again | same | seen, F.col("seen")).otherwise(F.array_append("seen", fee)),
        "max_fee": F.when(halves | again, F.col("max_fee")).otherwise(top),
        "retries": F.when(again, F.col("retries") + 1).otherwise(0),
        "low": F.when(halves, F.when(last | passed, low).otherwise(fee)).when(swings, F.least(fee, prev_fee)),
        "high": F.when(halves, F.when(passed, fee).otherwise(high)).when(swings, F.greatest(fee, prev_fee)),
        "base_fee": F.when(halves, F.when(passed, fee).otherwise(F.col("base_fee"))).when(swings, fee),
        "base_change": F.when(halves, F.when(passed, change).otherwise(F.col("base_change"))).when(swings, change),
    }
    balanced, evaluated = balancing(params), _evaluating(program)

    def go(state: DataFrame) -> DataFrame:
        drafts = program.interpret(state.withColumns(is_last).withColumns(under))
        return balanced(evaluated(drafts, drafts.where(~last)).withColumn("units", used).withColumns(totals)).withColumns(held).withColumns(facts).withColumns(then)

    return go


def _returning(rounds: int) -> dict[str, Column]:
    """ends, the round in which a transaction whose state came back has what it will have in the last one, and mark.

    A round depends on the state alone and seen only grows, so a state that equals an earlier one
    comes back for ever, in steps of the rounds between. What it is compared with, mark, is the state
    after the last round whose number is a power of two, from MARKED on.
    """
    number, mark, at_large = F.col("rounds"), F.col("mark"), F.col("low").isNull()
    now = F.struct(number.alias("at"), "prev_fee", "prev_change", "units", F.size("seen").alias("fees"), "max_fee", "retries")
    back = at_large & mark.isNotNull()
    for c in ("prev_fee", "prev_change", "units", "fees", "max_fee", "retries"):
        back = back & mark[c].eqNullSafe(now[c])
    ends = F.when(back, number + (rounds - number) % (number - mark["at"]))
    marks = (number >= MARKED) & (number.bitwiseAND(number - 1) == 0)
    return {"ends": F.coalesce("ends", ends), "mark": F.when(at_large, F.when(marks, now).otherwise(mark))}


def build(tx: DataFrame, redeemers: DataFrame, program: Program, params: Params = DEFAULT, rounds: int = 60) -> DataFrame:
    """tx_id, fee, change, mem, steps, outcome, error, purpose, ix and rounds of each transaction.

    tx: tx_id, total_in, ref_bytes and what the program reads; redeemers: tx_id, purpose, ix.
    Outcomes: ok; EvalFailure with the first failing redeemer and its error, once a failure is
    repeated under an estimated fee; BalanceFailed with the error of balance; ChecksFailed;
    NotConverged where what is read off the transaction never is final though nothing changes, or
    after that many rounds. A failure under a known fee reuses the units evaluated before; a
    transaction that settles in this way is not checked. A fee that settles below an earlier one is
    raised to the highest, and interpreted again. A transaction whose state comes back is not taken
    through all rounds, but ends with what it has in the last one.
    """
    empty = {c: F.lit(None).cast(t) for c, t in _STATE.items()}
    start = {"prev_fee": F.lit(0).cast("long"), "units": F.coalesce("units", F.array().cast(UNITS)), "seen": F.array().cast("array<bigint>"), "max_fee": F.lit(0).cast("long"), "retries": F.lit(0)}
    own = [c for c in tx.columns if c not in _STATE]
    state = pinned(tx.select(*own).join(_named(redeemers), "tx_id", "left").withColumns({**empty, **start, "rounds": F.lit(0)}))
    keep = [*own, *_STATE, "rounds"]
    columns = [*(F.col(c).cast(_STATE[c]).alias(c) if c in _STATE else F.col(c) for c in keep), *map(F.col, ("fee", "change", "outcome", "error", "failure"))]
    go, returning, open_, comes_back = _round(program, params), _returning(rounds), F.col("outcome").isNull(), F.coalesce(F.col("ends") == F.col("rounds"), F.lit(False))
    over = open_ & (comes_back | (F.col("rounds") == rounds))
    ended = {"outcome": F.when(over, "NotConverged").otherwise(F.col("outcome")), "rounds": F.when(over, rounds).otherwise(F.col("rounds"))}
    settled, some = None, rounds > 0 and not state.isEmpty()
    while some:
        after = pinned(go(state).withColumns(returning).select(*columns))
        done, state = after.where(~open_ | over).withColumns(ended), after.where(open_ & ~over).select(*keep)
        settled = done if settled is None else settled.unionByName(done)
        some = not state.isEmpty()
    if settled is None:
        return state.select("tx_id", *(F.lit(None).cast(t).alias(c) for c, t in _RESULT.items() if t))
    failed, unsettled = F.col("outcome") == "EvalFailure", F.col("outcome").isin("EvalFailure", "BalanceFailed")
    units = {c: F.when(~unsettled, _total(F.col("units"), c)) for c in ("mem", "steps")}
    out = settled.withColumns({
        "fee": F.when(~unsettled, F.col("fee")), "change": F.when(~unsettled, F.col("change")), **units,
        "error": F.when(failed, F.col("failure.error")).otherwise(F.col("error")), "purpose": F.when(failed, F.col("failure.purpose")), "ix": F.when(failed, F.col("failure.ix")),
    })
    return out.select(*(F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in _RESULT.items()))
