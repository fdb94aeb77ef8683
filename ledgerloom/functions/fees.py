"""Fee arithmetic as column expressions. The formulas are those of the public ledger rules; byte-level agreement is not promised."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..params import DEFAULT, Params

#: Rounds that the fee search may take.
ROUNDS = 11


def cbor_length(n: Column) -> Column:
    """Bytes of an unsigned integer in CBOR: 1, 2, 3, 5 or 9."""
    return F.when(n < 24, 1).when(n < 1 << 8, 2).when(n < 1 << 16, 3).when(n < 1 << 32, 5).otherwise(9)


def _whole(x: int | Column, digits: int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(f"decimal({digits},0)")


def _unless(nothing: Column, fee: Column) -> Column:
    """The fee; where there is nothing to pay for, 0 without decimals, which take most of the time of a fee."""
    return F.when(nothing, F.lit(0).cast("long")).otherwise(fee)


def execution_fee(mem: Column, steps: Column, params: Params = DEFAULT) -> Column:
    """Units times rational prices over a common denominator, exact, their sum rounded up once."""
    (mem_up, mem_down), (steps_up, steps_down) = params.price_mem, params.price_steps
    if isinstance(mem_down, Column) or isinstance(steps_down, Column):
        whole, up = _whole(mem_down, 10) * _whole(steps_down, 10), (_whole(mem_up, 9) * _whole(steps_down, 10), _whole(steps_up, 9) * _whole(mem_down, 10))
        total = _whole(mem, 19) * up[0].cast("decimal(18,0)") + _whole(steps, 19) * up[1].cast("decimal(18,0)") + whole - 1
        return F.call_function("div", total, whole)
    whole = math.lcm(mem_down, steps_down)
    up = (_whole(mem_up * (whole // mem_down), 17), _whole(steps_up * (whole // steps_down), 17))
    fee = F.call_function("div", _whole(mem, 19) * up[0] + _whole(steps, 19) * up[1] + _whole(whole - 1, 19), _whole(whole, 19))
    return _unless((mem == 0) & (steps == 0), fee)


#: Whole tiers of reference-script bytes whose price is exact in 38 digits; the ledger allows eight.
TIERS = 35


def ref_script_fee(size: Column, params: Params = DEFAULT) -> Column:
    """Tiered price of reference-script bytes: each further tier costs its growth more a byte; exact, rounded down.

    Null beyond TIERS tiers, four times what the ledger allows in a transaction. Where the growth is
    one, all bytes cost the same, and any number of them has a price.
    """
    tier, (up, down) = params.ref_script_tier, params.ref_script_growth
    if up == down:
        return (size.cast("long") * params.ref_script_per_byte).cast("long")
    n = F.call_function("div", size.cast("long"), F.lit(tier).cast("long")).cast("int")

    def of_tiers(value: Callable[[int], int]) -> Column:
        prices = ", ".join(f"cast('{value(i)}' as decimal(33,0))" for i in range(TIERS + 1))
        return F.get(F.expr(f"array({prices})"), n)  # one text, as a call for each price slows down plans that are made in a loop

    # n whole tiers cost tier * (g^n - 1) / (g - 1), what is left g^n a byte, times the price; over one denominator
    whole, rest, under = of_tiers(lambda i: tier * down * (up**i - down**i)), of_tiers(lambda i: (up - down) * up**i), of_tiers(lambda i: (up - down) * down**i)
    left = (size.cast("long") % tier).cast("decimal(5,0)")
    return _unless(size == 0, F.call_function("div", _whole(params.ref_script_per_byte, 5) * (whole + left * rest), under))


def min_fee(size: Column, mem: Column, steps: Column, ref_bytes: Column, params: Params = DEFAULT) -> Column:
    """a * size + b, execution prices rounded up once, and reference-script bytes."""
    return size_fee(size, execution_fee(mem, steps, params) + ref_script_fee(ref_bytes, params), params)


def size_fee(size: Column, other: Column, params: Params = DEFAULT) -> Column:
    """min_fee where what does not depend on the size is known."""
    return (size * params.fee_per_byte + params.fee_fixed + other).cast("long")


def fixed_point(estimate: Callable[[Column], Column]) -> Column:
    """struct(fee, converged): from 0, each round estimates anew and stops with the current fee as soon as the estimate is no higher.

    A fold inside the row, of ROUNDS estimates at most; what a round estimates is kept for the next one.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("fee"), estimate(zero).cast("long").alias("next"))

    def step(acc: Column, _: Column) -> Column:
        more = F.struct(acc["next"].alias("fee"), estimate(acc["next"]).cast("long").alias("next"))
        return F.when(acc["next"] <= acc["fee"], acc).otherwise(more)  # what has stopped is passed on as it is

    def found(acc: Column) -> Column:
        stop = acc["next"] <= acc["fee"]
        return F.struct(F.when(stop, acc["fee"]).otherwise(acc["next"]).alias("fee"), stop.alias("converged"))

    return F.aggregate(F.sequence(F.lit(2), F.lit(ROUNDS)), start, step, found)
