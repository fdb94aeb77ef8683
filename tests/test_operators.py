"""The reference's own test examples as literal rows."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.fees import cbor_length, fixed_point, min_fee
from ledgerloom.functions.ranges import in_ranges
from ledgerloom.functions.sampling import at_most, numbered, positions, sample_fibonacci, sample_list
from ledgerloom.operators import assembly as A, balance as B, chain as C, checks as K, execution as E, indices as I, utxo as U

INPUT = "tx_id long, kind string, src_tx_id long, src_ix long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def log(spark, *instructions):
    return spark.createDataFrame([tuple(x.get(n) for n in A.LOG.names) for x in ({"tx_id": 1, "seq": i, **x} for i, x in enumerate(instructions))], A.LOG)


def test_spending_index(spark):
    spent = spark.createDataFrame([(1, "spend", i, 0) for i in (5, 1, 3, 3)] + [(1, "reference", 2, 0)], INPUT)
    assert rows(I.spending_index(spent).select("src_tx_id", "ix"), "ix") == [(1, 0), (3, 1), (5, 2)]
    extra = spark.createDataFrame([(1, 2, 0)], "tx_id long, src_tx_id long, src_ix long")
    assert rows(I.spending_index(spent, extra).select("src_tx_id", "ix"), "ix") == [(1, 0), (2, 1), (3, 2), (5, 3)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(0, 3)), min_size=1, max_size=40))
def test_spending_index_is_dense_and_ascending(spark, keys):
    out = rows(I.spending_index(spark.createDataFrame([(t, "spend", a, b) for t, a, b in keys], INPUT)), "tx_id", "ix")
    for tx in {k[0] for k in keys}:
        own = [r for r in out if r[0] == tx]
        assert [r[3] for r in own] == list(range(len(own)))
        assert [r[1:3] for r in own] == sorted({k[1:] for k in keys if k[0] == tx})


def test_equal_outputs_share_the_first_index(spark):
    out = A.ordered_outputs(log(spark, *({"op": "pay", "address": a, "lovelace": 5} for a in (7, 8, 7))))
    assert rows(I.output_index(out).select("ix", "first_ix"), "ix") == [(0, 0), (1, 1), (2, 0)]


def test_mint_withdrawals_metadata_validity(spark):
    mint = {"op": "mint", "policy_id": 1, "asset_name": 1}
    assert rows(A.net_mint(log(spark, {**mint, "qty": -1}, {**mint, "qty": 0})).select("qty"), "qty") == [(-1,)]
    assert A.net_mint(log(spark, {**mint, "qty": 2}, {**mint, "qty": -2})).count() == 0
    take = {"op": "withdraw", "account": 3}
    assert rows(A.withdrawals(log(spark, {**take, "lovelace": 1}, {**take, "lovelace": 3_000_000})), "tx_id") == [(1, 3, 3_000_000, None)]
    note = {"op": "metadata", "label": 674}
    assert rows(A.metadata(log(spark, {**note, "value": "first"}, {**note, "value": "second"})), "label") == [(1, 674, "second")]
    assert rows(A.validity(log(spark, {"op": "valid_from", "slot": 10}, {"op": "valid_to", "slot": 20})), "tx_id") == [(1, 10, 20)]
    assert rows(A.validity(log(spark, {"op": "valid_to", "slot": 20}, {"op": "valid_to", "slot": 5})), "tx_id") == [(1, None, 5)]


def test_redeemers_of_script_spend_and_mint(spark):
    out = A.redeemers(log(
        spark, {"op": "spend", "src_tx_id": 9, "src_ix": 0, "witness": "key"}, {"op": "spend", "src_tx_id": 4, "src_ix": 1, "witness": "script"},
        {"op": "mint", "policy_id": 2, "asset_name": 1, "qty": 1, "witness": "script"}, {"op": "mint", "policy_id": 2, "asset_name": 2, "qty": 1, "witness": None},
    ))
    assert rows(out, "purpose") == [(1, "mint", 0, "r2", 0, 0), (1, "spend", 0, "r1", 0, 0)]


def test_assembled_and_exploded_again(spark):
    first = log(
        spark, {"op": "spend", "src_tx_id": 4, "src_ix": 1, "witness": "key"}, {"op": "pay", "address": 1, "lovelace": 5, "has_datum": False}, {"op": "pay", "address": 2, "lovelace": 6, "has_datum": True},
        {"op": "mint", "policy_id": 2, "asset_name": 1, "qty": 1}, {"op": "metadata", "label": 1, "value": "x"}, {"op": "sign", "signer": 3}, {"op": "valid_to", "slot": 9},
    )
    tx = A.assemble(first)
    again = A.assemble(A.explode_to_log(**A.children_of(tx)))
    columns = [c for c in tx.columns if c not in ("integrity", "redeemers")]
    assert rows(tx.select(columns), "tx_id") == rows(again.select(columns), "tx_id")
    assert tx.first()["collateral"] is None and tx.first()["integrity"] is None and tx.first()["aux"]


def test_assembled_like_the_sections(spark):
    rng, made = random.Random(4), []
    for tx in range(1, 9):
        for seq in range(40):
            op = rng.choice(A.SECTIONS)
            x = {"tx_id": tx, "seq": seq, "op": op, "witness": rng.choice(["script", "key", None])}
            x |= {"src_tx_id": rng.randrange(4), "src_ix": rng.randrange(2), "address": rng.randrange(3), "lovelace": rng.randrange(99), "has_datum": rng.random() < 0.5, "policy_id": rng.randrange(3), "asset_name": rng.randrange(2), "qty": rng.randrange(-2, 3), "account": rng.randrange(3), "label": rng.randrange(3), "value": str(rng.randrange(9)), "signer": rng.randrange(3), "script_hash": rng.randrange(3), "slot": rng.randrange(99)}
            made.append(x)
    df = spark.createDataFrame([tuple(x.get(n) for n in A.LOG.names) for x in made], A.LOG)
    extra = spark.createDataFrame([(1, 9, 9), (2, 0, 0), (77, 1, 1)], "tx_id long, src_tx_id long, src_ix long")
    tx = {r["tx_id"]: r for r in A.assemble(df, extra).collect()}
    assert sorted(tx) == list(range(1, 9))

    def same(name, section, *columns):
        want = {}
        for r in section.collect():
            want.setdefault(r["tx_id"], []).append(tuple(r[c] for c in columns))
        for t, r in tx.items():
            assert [tuple(x[c] for c in columns) for x in r[name] or []] == sorted(want.get(t, [])), name

    sets, brought = A.input_sets(df, extra).where("tx_id < 77"), A.redeemers(df, extra)
    for kind, name in zip(A.ROLES, ("inputs", "collateral", "reference_inputs"), strict=True):
        same(name, sets.where(F.col("kind") == kind), "src_tx_id", "src_ix")
    same("outputs", A.ordered_outputs(df), "ix", "address", "lovelace", "has_datum", "policy_id", "asset_name", "qty")
    same("mint", A.net_mint(df), "policy_id", "asset_name", "qty")
    same("withdrawals", A.withdrawals(df), "account", "amount")
    same("metadata", A.metadata(df), "label", "value")
    same("redeemers", brought, "purpose", "ix", "data", "mem", "steps")
    bounds = {r["tx_id"]: (r["valid_from"], r["valid_to"]) for r in A.validity(df).collect()}
    digests = {r["tx_id"]: r["integrity"] for r in A.integrity_digest(brought).collect()}
    notes = {r["tx_id"]: r["aux"] for r in A.aux_digest(A.metadata(df)).collect()}
    for t, r in tx.items():
        assert (r["valid_from"], r["valid_to"]) == bounds.get(t, (None, None)) and (r["integrity"], r["aux"]) == (digests.get(t), notes.get(t))


def values(spark, *x):
    return spark.createDataFrame([(1, 5, 6, q) for q in x], "tx_id long, policy_id long, asset_name long, qty long")


def test_change_assets(spark):
    def change(i, m, o):
        return [r["qty"] for r in B.change_assets(values(spark, *i), values(spark, *m), values(spark, *o)).collect()]

    assert change([5], [], [2]) == [3] and change([], [1], []) == [1] and change([2], [], [5]) == [] and change([5], [-5], []) == []


READY = "tx_id long, base_size long, total_in long, total_out long, n_outputs long, mem long, steps long, ref_bytes long"


def test_balance(spark):
    data = [(1, 230, 10_000_000, 3_000_000, 1, 0, 0, 0), (2, 230, 1, 0, 0, 0, 0, 0), (3, 230, 10_000_000, 3_000_000, 1, 0, 0, 215)]
    out = {r["tx_id"]: r for r in B.balance(spark.createDataFrame(data, READY)).collect()}
    assert out[1]["change"] == 7_000_000 - out[1]["fee"] and out[1]["change_ix"] == 1 and out[1]["error"] is None
    assert out[1]["fee"] >= 44 * (230 + 5 + 5) + 155_381
    assert out[2]["error"] == "InsufficientFee"
    assert out[3]["fee"] - out[1]["fee"] == 215 * 44


def test_search_that_does_not_converge(spark):
    out = spark.range(1).select(fixed_point(lambda fee: fee + 1).alias("x")).first()["x"]
    assert not out["converged"]
    stops = spark.range(1).select(fixed_point(lambda fee: F.least(fee + 1, F.lit(10))).alias("x")).first()["x"]
    assert stops["converged"] and stops["fee"] == 10


def test_fee_parts(spark):
    n = [0, 23, 24, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    assert [r[0] for r in df.select(cbor_length(F.col("n"))).collect()] == [1, 1, 2, 2, 3, 3, 5, 5, 9]
    zero = F.lit(0)
    fees = spark.range(1).select(min_fee(zero, zero, zero, F.lit(25_600)), min_fee(zero, zero, zero, F.lit(25_610)), min_fee(zero, F.lit(1), zero, zero)).first()
    assert tuple(f - 155_381 for f in fees) == (25_600 * 44, 25_600 * 44 + 528, 1)


def test_fee_loop_splits_refunds(spark):
    requests = spark.createDataFrame([(1, 300, 100_000_003, 5, 50_000), (2, 300, 100_000, 5, 50_000)], "tx_id long, base_size long, total_in long, n long, tip long")
    out = rows(B.balance_fee_loop(requests), "tx_id", "ix")
    good = [r for r in out if r[0] == 1]
    assert sum(r[2] for r in good) + good[0][3] + 5 * 50_000 == 100_000_003
    assert len({r[2] for r in good[1:]}) == 1 and 0 <= good[0][2] - good[1][2] < 5
    assert {r[4] for r in out if r[0] == 2} == {"OutputError"}


def test_fee_loop_with_outputs_of_its_own(spark):
    requests = spark.createDataFrame([(1, 300, 1_000_000, 2, 0), (2, 300, 1000, 2, 0)], "tx_id long, base_size long, total_in long, n long, tip long")

    def thirds(fee):  # two thirds to one, a third to the other; none below a limit
        rest = F.col("total_in") - fee
        return F.when(rest > 10_000, F.array(F.expr("bigint(0)") + F.call_function("div", rest * 2, F.lit(3)), F.call_function("div", rest, F.lit(3))))

    out = rows(B.balance_fee_loop(requests, thirds), "tx_id", "ix")
    fee = out[0][3]
    assert [(r[0], r[1], r[2]) for r in out] == [(1, 0, (1_000_000 - fee) * 2 // 3), (1, 1, (1_000_000 - fee) // 3), (2, None, None)]
    assert out[2][4] == "OutputError" and fee == 44 * (300 + 106 + 5 + 5 + 5) + 155_381


def test_prices_of_any_denominator(spark):
    from fractions import Fraction
    from math import ceil

    from ledgerloom.functions.fees import execution_fee
    from ledgerloom.params import Params

    params = Params(price_mem=(2, 7), price_steps=(5, 3_000_017))
    units = [(0, 0), (1, 1), (7, 3_000_017), (16_500_000, 10_000_000_000), (13, 999_999_937)]
    got = spark.createDataFrame(units, "mem long, steps long").select("mem", "steps", execution_fee(F.col("mem"), F.col("steps"), params).alias("fee")).collect()
    assert all(r["fee"] == ceil(r["mem"] * Fraction(2, 7) + r["steps"] * Fraction(5, 3_000_017)) for r in got)


def test_first_failure_by_purpose_and_index(spark):
    data = [(1, "mint", 0, False), (1, "spend", 2, False), (1, "spend", 1, True), (1, "reward", 0, False), (2, "reward", 0, False), (2, "mint", 3, False), (3, "spend", 0, True)]
    out = E.eval_failures(spark.createDataFrame(data, "tx_id long, purpose string, ix long, ok boolean"))
    assert rows(out, "tx_id") == [(1, "spend", 2, 3), (2, "mint", 3, 2)]


def test_settled_transactions_keep_their_errors(spark):
    data = [(1, 230, 10_000_000, 3_000_000, 1, 0, 0, 0), (2, 230, 1, 0, 0, 0, 0, 0), (3, 230, 10_000_000, 9_700_000, 1, 0, 0, 0)]
    outputs = spark.createDataFrame([(1, 0, 7, 3_000_000), (3, 0, 7, 9_700_000)], "tx_id long, ix long, address long, lovelace long")
    chosen = spark.createDataFrame([(1, 200_000), (2, 200_000)], "tx_id long, chosen long")
    out = rows(E.settle_at_fee(spark.createDataFrame(data, READY), outputs, chosen, [("large", F.col("change") > 1_000_000), ("unknown", F.lit(None).cast("boolean") | (F.col("tx_id") == 1))]), "tx_id", "ix")
    assert out[:2] == [(1, 0, 7, 3_000_000, 200_000, None), (1, 1, None, 6_800_000, 200_000, None)]
    assert out[2] == (2, None, None, None, None, "InsufficientFee")
    assert {r[5] for r in out[3:]} == {"ChecksFailed"} and sum(r[3] for r in out[3:]) + out[3][4] == 10_000_000


@pytest.mark.parametrize("seed", range(3))
def test_coins_of_large_owners(spark, seed):
    rng = random.Random(seed)
    coins = [(o, i, 0, rng.choice([0, 1, 5, 5, 64, rng.randrange(1, 10**rng.randrange(1, 7))])) for o in (1, 2, 3) for i in range(60)]
    targets = [(o, t) for o, t in ((1, rng.randrange(10**6)), (2, 10**9), (3, 0), (4, 7))]
    want = []
    for o, t in targets:
        own, before = sorted((c for c in coins if c[0] == o), key=lambda c: (-c[3], c[1])), 0
        short = max(0, t - sum(c[3] for c in own))
        for c in own:
            if before < t:
                want.append((o, t, c[1], c[2], c[3], short))
            before += c[3]
        if not own:
            want.append((o, t, None, None, None, short))
    utxo = spark.createDataFrame(coins, "owner long, tx_id long, ix long, lovelace long")
    got = [tuple(r) for r in U.select_coins(utxo, spark.createDataFrame(targets, "owner long, target long")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bump_fee(spark):
    outputs = spark.createDataFrame([(1, 0, 1, 3_000_000), (1, 1, 2, 7_000_000)], "tx_id long, ix long, address long, lovelace long")
    def bump(target, ix):
        return [(r["lovelace"], r["error"]) for r in B.bump_fee(outputs, spark.createDataFrame([(1, 200, target, ix)], "tx_id long, fee long, target long, change_ix long")).orderBy("ix").collect()]

    assert bump(500, 1) == [(3_000_000, None), (6_999_700, None)]
    assert bump(100, 1)[1] == (7_000_100, None) and bump(500, 4) == [(3_000_000, "BadChangeIndex"), (7_000_000, "BadChangeIndex")]


def test_reference_script_bytes(spark):
    utxo = spark.createDataFrame([(9, 0, 215), (9, 0, 215), (9, 1, None)], "tx_id long, ix long, script_bytes long")
    keys = spark.createDataFrame([(1, "reference", 9, 0), (2, "reference", 9, 1), (3, "reference", 8, 0), (4, "spend", 9, 0)], INPUT)
    assert rows(U.ref_script_bytes(keys, utxo), "tx_id") == [(1, 430), (2, 0), (3, 0)]


def test_checks(spark):
    outputs = spark.createDataFrame([(1, 0, 1, 65)], "tx_id long, ix long, lovelace long, size long")
    bad = K.check_min_utxo(outputs).first()
    assert (bad["ix"], bad["actual"]) == (0, 1) and bad["required"] > 1
    assert K.check_min_utxo(outputs, only=spark.createDataFrame([(1, 7)], "tx_id long, ix long")).count() == 0
    assert rows(K.check_tx_size(spark.createDataFrame([(1, 16_384), (2, 16_385)], "tx_id long, size long")), "tx_id") == [(2, 16_385, 16_384)]
    failed = K.run_checks(spark.createDataFrame([(1, 5)], "tx_id long, x long"), {"a": F.col("x") > 9, "b": F.col("x") > 1, "c": F.col("x") > 7})
    assert rows(failed, "place") == [(1, 0, "a"), (1, 2, "c")]


def test_units_and_decisions(spark):
    redeemer = spark.createDataFrame([(1, "spend", i, "d", 1, 1) for i in range(3)], "tx_id long, purpose string, ix long, data string, mem long, steps long")
    results = spark.createDataFrame([(1, "spend", 0, True, 10, 20), (1, "spend", 1, False, 0, 0)], "tx_id long, purpose string, ix long, ok boolean, mem long, steps long")
    out = E.patch_units(redeemer, results, lambda x: x * 2)
    assert rows(out.select("ix", "mem", "steps"), "ix") == [(0, 20, 40), (1, 1, 1), (2, 1, 1)]
    attempts = spark.createDataFrame([(1, True, 5), (2, False, 5), (3, False, 0)], "tx_id long, retried boolean, prev_fee long")
    assert [r["decision"] for r in E.failure_decision(attempts).orderBy("tx_id").collect()] == ["terminal", "reuse", "retry"]
    trace = E.fee_trace(spark.createDataFrame([(1, i, f) for i, f in enumerate([100, 120, 100, 100])], "tx_id long, n long, fee long"))
    assert rows(trace.select("max_fee", "converged", "oscillates", "low", "high", "n"), "n") == [(100, False, False, None, None, 0), (120, False, False, None, None, 1), (120, False, True, 100, 120, 2), (120, True, False, None, None, 3)]


def test_sampling(spark):
    df = spark.range(378).withColumnRenamed("id", "x")
    want = [0, 1, 2, 4, 7, 12, 20, 33, 54, 88, 143, 232, 376]
    assert [r["x"] for r in sample_fibonacci(df, ["x"]).orderBy("x").collect()] == [*want, 377]
    assert [r["x"] for r in sample_list(df, ["x"]).orderBy("x").collect()] == want and positions(20) == want[:7]
    assert sample_fibonacci(df.limit(0), ["x"]).count() == 0
    part = df.withColumn("g", F.lit(1))
    assert [at_most(part, n, ["x"], ["g"]).select("x").collect() for n in (0, 3, 999)] == [[], [(2,)], [(377,)]]


def test_orders_of_large_groups_are_dealt_to_ranges(spark):
    """One group holds most rows, others a few, one has a null key; against plain Python."""
    rng = random.Random(5)
    data = [(g, n, rng.choice([None, *range(9)])) for g, size in ((1, 2000), (2, 3), (None, 50), (3, 1)) for n in range(size)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g long, x long, fee long")
    groups = {g: sorted((r for r in data if r[0] == g), key=lambda r: r[1]) for g in (1, 2, 3, None)}
    out = numbered(df, ["x"], ["g"])
    assert {(r["g"], r["x"], r["pos"], r["size"]) for r in out.collect()} == {(g, r[1], i, len(own)) for g, own in groups.items() for i, r in enumerate(own)}
    assert out.count() == len(data) and numbered(df.limit(0), ["x"], ["g"]).count() == 0
    assert in_ranges(df, ["g"], ["x"]).where("g = 1").select("_p").distinct().count() > 1

    chain = df.withColumnsRenamed({"g": "follower", "x": "seq"})
    batches = {(r["follower"], r["seq"]): (r["n"], r["batch"]) for r in C.block_batches(chain, 3).collect()}
    assert batches == {(g, r[1]): (i + 1, i // 3) for g, own in groups.items() for i, r in enumerate(own)}
    for n in (2, 1500):
        assert {(r["follower"], r["seq"], r["n"]) for r in C.take_blocks(chain, n).collect()} == {(g, r[1], i + 1) for g, own in groups.items() for i, r in enumerate(own[:n])}

    seed = spark.createDataFrame([(1, 10_000), (2, 5)], "chain long, seed long")
    want = {(g, r[1], start - sum(x[2] or 0 for x in groups[g][: i + 1])) for g, start in ((1, 10_000), (2, 5)) for i, r in enumerate(groups[g])}
    assert {(r["chain"], r["n"], r["balance"]) for r in B.chain_balances(seed, df.withColumnsRenamed({"g": "chain", "x": "n"})).collect()} == want

    txs = [(g, i, f"{g}.{i}") for g, own in groups.items() for i in range(len(own))]
    pos = {t: rng.randrange(3 * i + 5) for _, i, t in txs if i % 7}
    found = C.audit_order(spark.createDataFrame(txs, "chain long, n long, tx_id string"), spark.createDataFrame(list(pos.items()), "tx_id string, pos long"))
    before = {t: pos.get(f"{g}.{i - 1}") for g, i, t in txs}
    want = {(t, "missing") for *_, t in txs if t not in pos} | {(t, "out of order") for *_, t in txs if t in pos and before[t] is not None and pos[t] <= before[t]}
    assert {(r["tx_id"], r["problem"]) for r in found.collect()} == want


def test_phases(spark):
    tips = [(1, 0, None), (1, 1, 5), (1, 2, 2), (1, 3, 9), (1, 4, 4), (None, 0, 9), (None, 1, 1), (2, 0, 0)]  # slot is seq
    df = spark.createDataFrame([(f, s, "forward", s, None, t) for f, s, t in tips], "follower long, seq long, kind string, slot long, back_slot long, tip_slot long")
    out = {(r["follower"], r["seq"]): (r["phase"][0], r["transition"]) for r in C.phases(df).collect()}
    assert out == {(1, 0): ("r", False), (1, 1): ("r", False), (1, 2): ("f", True), (1, 3): ("f", False), (1, 4): ("f", False), (None, 0): ("r", False), (None, 1): ("f", True), (2, 0): ("r", False)}


@pytest.mark.parametrize("seed", range(3))
def test_canonical_chain(spark, seed):
    rng = random.Random(seed)
    events, slot = [], 0
    for seq in range(120):
        if rng.random() < 0.15:
            back = rng.choice([None, max(0, slot - rng.randint(0, 8))])
            events.append((1, seq, "back", None, back, None))
            slot = -1 if back is None else back
        else:
            slot += rng.randint(1, 3)
            events.append((1, seq, "forward", slot, None, None))
    want = []
    for e in events:
        want = [*want, e[1]] if e[2] == "forward" else [s for s in want if events[s][3] <= (-1 if e[4] is None else e[4])]
    df = spark.createDataFrame(events, "follower long, seq long, kind string, slot long, back_slot long, tip_slot long")
    assert [r["seq"] for r in C.canonical_chain(df).orderBy("seq").collect()] == want
    assert [r["seq"] for r in C.canonical_chain_bucketed(df, 17).orderBy("seq").collect()] == want
