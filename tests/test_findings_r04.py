"""Transactions of the build loop that go round for ever."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import building


@pytest.mark.parametrize("rounds", [60, 61])
def test_state_that_comes_back_ends_as_in_the_last_round(spark, rounds):
    """Scripts fail under every known fee and the size flips with the fee, so the fee swings: high in odd rounds, low in even ones."""
    rows, low, calls = spark.createDataFrame([(1, "spend", 0), (2, "spend", 0)], "tx_id long, purpose string, ix long"), 155381 + 44 * (300 + 5 + 5), []

    def interpret(state):
        extra = F.when((F.col("tx_id") == 1) & (F.col("prev_fee") < low + 880), 40).otherwise(0)
        return state.withColumns({"base_size": F.lit(300) + extra, "total_out": F.lit(3_000_000), "n_outputs": F.lit(1), "peeked": F.lit(True)})

    def evaluate(drafts):
        calls.append(1)
        good = F.col("prev_fee") == 0
        unit = lambda n: F.when(good, F.lit(n).cast("long"))
        return drafts.join(rows, "tx_id").select("tx_id", "prev_fee", "purpose", "ix", good.alias("ok"), unit(1000).alias("mem"), unit(2000).alias("steps"), F.when(~good, "no").alias("error"))

    tx = spark.createDataFrame([(1, 10_000_000, 0), (2, 10_000_000, 0)], "tx_id long, total_in long, ref_bytes long")
    out = {r["tx_id"]: r for r in building.build(tx, rows, building.Program(interpret, evaluate), rounds=rounds).collect()}
    fee = low + 58 + (40 * 44 if rounds % 2 else 0)  # 1000 units of memory and 2000 steps cost 58
    assert (out[1]["outcome"], out[1]["rounds"], out[1]["fee"], out[1]["change"], out[1]["mem"], out[1]["error"]) == ("NotConverged", rounds, fee, 7_000_000 - fee, 1000, None)
    assert (out[2]["outcome"], out[2]["rounds"], out[2]["fee"]) == ("ok", 2, low + 58)
    assert len(calls) <= 8
