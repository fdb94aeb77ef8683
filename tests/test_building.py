"""The build loop, the evaluator stage and derived values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import building
from ledgerloom.operators.derived import Derived, derive, in_order, refresh
from ledgerloom.operators.scripts import evaluate_scripts

TX = "tx_id long, total_in long, ref_bytes long, size long, out long"


def _plain(state):
    return state.withColumns({"base_size": F.col("size"), "total_out": F.col("out"), "n_outputs": F.lit(1), "peeked": F.lit(True)})


def _build(spark, tx, redeemers, evaluate, interpret=_plain, **more):
    rows = spark.createDataFrame(redeemers, "tx_id long, purpose string, ix long")
    program = building.Program(interpret, lambda drafts: evaluate(drafts.join(rows, "tx_id")), **{k: more.pop(k) for k in ("checks", "margin") if k in more})
    return {r["tx_id"]: r for r in building.build(spark.createDataFrame(tx, TX), rows, program, **more).collect()}


def _results(ok, error="no"):
    def evaluate(asked):
        passes = F.coalesce(ok, F.lit(False))
        unit = lambda n: F.when(passes, F.lit(n).cast("long"))
        return asked.select("tx_id", "prev_fee", "purpose", "ix", passes.alias("ok"), unit(1000).alias("mem"), unit(2000).alias("steps"), F.when(~passes, error).alias("error"))

    return evaluate


def test_failure_under_no_fee_is_retried_with_an_estimate(spark):
    """Scripts that need the fee pass in the second round; those that never pass end it, at the first redeemer in key order."""
    tx = [(1, 10_000_000, 0, 300, 3_000_000), (2, 10_000_000, 0, 300, 3_000_000), (3, 1, 0, 300, 0)]
    red = [(1, "spend", 0), (2, "mint", 0), (2, "spend", 4), (2, "spend", 1)]
    out = _build(spark, tx, red, _results((F.col("tx_id") == 1) & (F.col("prev_fee") > 0)))
    assert out[1]["outcome"] == "ok" and out[1]["change"] == 7_000_000 - out[1]["fee"] and (out[1]["mem"], out[1]["steps"]) == (1000, 2000)
    assert (out[2]["outcome"], out[2]["purpose"], out[2]["ix"], out[2]["error"], out[2]["rounds"]) == ("EvalFailure", "spend", 1, "no", 2)
    assert (out[3]["outcome"], out[3]["error"], out[3]["fee"]) == ("BalanceFailed", "InsufficientFee", None)


def test_failure_under_a_known_fee_reuses_units_and_skips_checks(spark):
    tx = [(1, 10_000_000, 0, 300, 3_000_000), (2, 10_000_000, 0, 300, 3_000_000)]
    never = [("never", F.lit(False))]
    out = _build(spark, tx, [(1, "spend", 0)], _results(F.col("prev_fee") == 0), checks=never)
    assert (out[1]["outcome"], out[1]["mem"]) == ("ok", 1000) and out[2]["outcome"] == "ChecksFailed"


def test_margin_raises_units(spark):
    tx = [(1, 10_000_000, 0, 300, 3_000_000)]
    bare = _build(spark, tx, [(1, "spend", 0)], _results(F.lit(True)))[1]
    more = _build(spark, tx, [(1, "spend", 0)], _results(F.lit(True)), margin=lambda x: x * 2)[1]
    assert more["mem"] == 2 * bare["mem"] and more["fee"] >= bare["fee"]


@pytest.mark.parametrize("least", [0, 700])
def test_oscillating_fee_is_bisected(spark, least):
    """The size flips with the fee it sees: the smallest fee above the lower one that scripts pass under is taken."""
    tx, low = [(1, 10_000_000, 0, 300, 3_000_000)], 155381 + 44 * (300 + 5 + 5)

    def flips(state):
        extra = F.when(F.col("prev_fee") < low + 880, 40).otherwise(0)
        return _plain(state).withColumn("base_size", F.col("size") + extra)

    good = (F.col("prev_fee") <= low) | (F.col("prev_fee") >= low + least)
    out = _build(spark, tx, [(1, "spend", 0)], _results(good), interpret=flips)[1]
    execution = 1  # 1000 units of memory and 2000 steps cost 58
    assert out["outcome"] == "ok" and out["rounds"] > 8
    assert low + max(least, execution) <= out["fee"] <= low + max(least, 60) and out["change"] == 7_000_000 - out["fee"]


def test_value_read_off_the_transaction_settles(spark):
    """An output that is a tenth of the change before; and one that is never final."""
    tx = [(1, 10_000_000, 0, 300, 3_000_000), (2, 10_000_000, 0, 300, 3_000_000)]

    def tenth(state):
        tip = F.when(F.col("tx_id") == 1, F.least(F.lit(500), F.expr("coalesce(prev_change, 0) div 10"))).otherwise(0)
        out = _plain(state).withColumn("total_out", F.col("out") + tip)
        return out.withColumn("peeked", (F.col("tx_id") == 1) & F.coalesce(F.col("total_in") - F.col("total_out") - F.col("prev_fee") == F.col("prev_change"), F.lit(False)))

    out = _build(spark, tx, [], _results(F.lit(True)), interpret=tenth)
    assert out[1]["outcome"] == "ok" and out[1]["change"] == 7_000_000 - 500 - out[1]["fee"]
    assert out[2]["outcome"] == "NotConverged"
    assert _build(spark, tx[:1], [], _results(F.lit(True)), interpret=tenth, rounds=1)[1]["outcome"] == "NotConverged"
    assert building.build(spark.createDataFrame([], TX), spark.createDataFrame([], "tx_id long, purpose string, ix long"), building.Program(_plain, None)).count() == 0


def test_user_code_runs_once_for_equal_requests(spark, tmp_path):
    """Calls leave files; exceptions are rows; answers are kept for later calls."""
    asked = spark.createDataFrame([(i, i % 3) for i in range(30)], "tx_id long, x long").repartition(4)

    def call(request):
        with open(f"{tmp_path}/{request['x']}", "a") as f:
            f.write("x")
        return 10 // request["x"], 7

    out, known = evaluate_scripts(asked, ["x"], call)
    rows = out.collect()
    assert len(rows) == 30 and {(r["x"], r["ok"], r["mem"], r["error"]) for r in rows} == {(1, True, 10, None), (2, True, 5, None), (0, False, None, "ZeroDivisionError: integer division or modulo by zero")}
    more, known = evaluate_scripts(asked.unionByName(spark.createDataFrame([(99, 5)], "tx_id long, x long")), ["x"], call, known)
    assert more.count() == 31 and known.count() == 4
    assert sorted((p.name, p.read_text()) for p in tmp_path.iterdir()) == [("0", "x"), ("1", "x"), ("2", "x"), ("5", "x")]


def _values():
    place = Derived("place", ("inputs",), lambda d: d.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n")))
    datum = Derived("datum", ("place", "outputs"), lambda p, o: o.join(p, "tx_id").select("tx_id", (F.col("n") * 10 + F.col("ix")).alias("datum")))
    top = Derived("top", ("datum",), lambda d: d.groupBy("tx_id").agg(F.max("datum").alias("top")))
    return [top, datum, place]


def test_derived_values_follow_their_needs(spark):
    assert [v.name for v in in_order(_values(), ["inputs", "outputs"])] == ["place", "datum", "top"]
    with pytest.raises(ValueError):
        in_order([Derived("a", ("b",), None), Derived("b", ("a",), None)], [])
    tables = {"inputs": spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "tx_id long, k long"), "outputs": spark.createDataFrame([(1, 0), (1, 3), (2, 0), (3, 1)], "tx_id long, ix long")}
    made = derive(_values(), tables)
    assert sorted(map(tuple, made["top"].collect())) == [(1, 23), (2, 10)]
    # one more input of tx 2 and of tx 3; an input of tx 1 is replaced, which changes no count
    now = {**tables, "inputs": spark.createDataFrame([(1, 5), (1, 8), (2, 7), (2, 9), (3, 1)], "tx_id long, k long")}
    again, moved = refresh(_values(), now, made, {"inputs": spark.createDataFrame([(1,), (2,), (3,)], "tx_id long")})
    assert sorted(map(tuple, again["top"].collect())) == [(1, 23), (2, 20), (3, 11)] == sorted(map(tuple, derive(_values(), now)["top"].collect()))
    assert {k: sorted(r["tx_id"] for r in v.collect()) for k, v in moved.items()} == {"place": [2, 3], "datum": [2, 3], "top": [2, 3]}
