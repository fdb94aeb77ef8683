from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.fees import TIERS, execution_fee, ref_script_fee
from ledgerloom.operators.balance import balance
from ledgerloom.operators.parameters import as_columns, balance_in_force, in_force


def tiered(size, price=44):
    """Tier by tier, in fractions."""
    total, each = Fraction(0), Fraction(price)
    while size > 0:
        total += min(size, 25_600) * each
        size, each = size - 25_600, each * Fraction(6, 5)
    return total.numerator // total.denominator


def test_script_bytes_of_any_tier(spark):
    sizes = [0, 1, 25_599, 25_600, 25_601, 204_800, 204_801, 204_933, 500_000, 25_600 * (TIERS + 1) - 1]
    rows = spark.createDataFrame([(s,) for s in [*sizes, 25_600 * (TIERS + 1), 10**9]], "size long").select("size", ref_script_fee(F.col("size")).alias("fee")).collect()
    assert {r["size"]: r["fee"] for r in rows} == {**{s: tiered(s) for s in sizes}, 25_600 * (TIERS + 1): None, 10**9: None}


@pytest.mark.parametrize("mem,steps", [(0, 0), (1, 1), (16_500_000, 10_000_000_000), (123_457, 7)])
def test_prices_as_columns(spark, mem, steps):
    row = spark.createDataFrame([(mem, steps, 577, 10_000, 721, 10_000_000)], "mem long, steps long, price_mem_up int, price_mem_down int, price_steps_up int, price_steps_down int")
    both = row.select(execution_fee(F.col("mem"), F.col("steps")), execution_fee(F.col("mem"), F.col("steps"), as_columns(row.columns))).first()
    want = Fraction(577 * mem, 10_000) + Fraction(721 * steps, 10_000_000)
    assert both[0] == both[1] == -(-want.numerator // want.denominator)


def test_parameters_in_force(spark):
    """Of the last row that has begun; none before the first, nor without a slot; the last one stays."""
    params = spark.createDataFrame([(3, 50), (5, 60)], "epoch long, fee_per_byte long")
    tx = spark.createDataFrame([(i, s) for i, s in enumerate([None, 299, 300, 499, 500, 99_999])], "tx_id long, slot long")
    got = {r["tx_id"]: r["fee_per_byte"] for r in in_force(tx, params, epoch_slots=100).collect()}
    assert got == {0: None, 1: None, 2: 50, 3: 50, 4: 60, 5: 60}
    assert {r["fee_per_byte"] for r in in_force(tx, params.limit(0), epoch_slots=100).collect()} == {None}


def test_balance_of_two_epochs(spark):
    columns = "tx_id long, slot long, base_size long, total_in long, total_out long, n_outputs long, mem long, steps long, ref_bytes long"
    tx = spark.createDataFrame([(1, 100, 300, 10_000_000, 3_000_000, 1, 0, 0, 0), (2, 200, 300, 10_000_000, 3_000_000, 1, 0, 0, 0), (3, 50, 300, 10_000_000, 3_000_000, 1, 0, 0, 0)], columns)
    params = spark.createDataFrame([(1, 44, 155_381), (2, 88, 155_381)], "epoch long, fee_per_byte long, fee_fixed long")
    out = {r["tx_id"]: r for r in balance_in_force(tx, params, epoch_slots=100).collect()}
    plain = {r["tx_id"]: r["fee"] for r in balance(tx).collect()}
    assert out[1]["fee"] == plain[1] and out[2]["fee"] - 155_381 == 2 * (plain[2] - 155_381) and (out[3]["fee"], out[3]["error"]) == (None, "NoParameters")
