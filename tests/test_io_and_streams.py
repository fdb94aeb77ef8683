import json

from pyspark.sql import functions as F

from ledgerloom import views
from ledgerloom.jobs.submissions import outcome_counts, route_submissions, write_submissions
from ledgerloom.operators import chain as C, utxo as U
from ledgerloom.sources import readers
from ledgerloom.streaming.follow import follow_stream, live_after, utxo_at, utxo_stream

SF = "/root/testdata/sf0.001"


def test_utxo_lines(spark, tmp_path):
    good = "ab" * 32 + "#2 32066511"
    (tmp_path / "x.inputs").write_text(f"{good}\n\nbroken\n{'cd' * 32}#99999999999999999999 5\n")
    out = readers.read_utxo_lines(spark, str(tmp_path)).collect()
    assert [(r["ix"], r["lovelace"], r["error"] is None) for r in out] == [(2, 32066511, True), (None, None, False), (None, 5, False)]
    try:
        readers.read_utxo_lines(spark, str(tmp_path), "FAILFAST").collect()
        raise AssertionError("a bad line must fail")
    except Exception as e:
        assert "bad UTxO line" in str(e)


def test_tx_hex(spark, tmp_path):
    (tmp_path / ("0a" * 32 + ".cbor.hex")).write_text("84 a0\nf5f6\n")
    (tmp_path / ("0b" * 32 + ".cbor.hex")).write_text("zz")
    out = {r["tx_id"]: r for r in readers.read_tx_hex(spark, str(tmp_path)).collect()}
    assert out["0a" * 32]["size"] == 4 and bytes(out["0a" * 32]["data"]) == b"\x84\xa0\xf5\xf6" and out["0b" * 32]["error"] == "NotHex"


def test_genesis(spark, tmp_path):
    (tmp_path / "shelley-genesis.json").write_text(json.dumps({"initialFunds": {"60f9": 30_000_000_000_000_000}, "protocolParams": {"minFeeA": 44, "minFeeB": 155381, "maxTxSize": 16384}, "slotLength": 0.1, "epochLength": 500, "securityParam": 10}, indent=1))
    (tmp_path / "alonzo-genesis.json").write_text(json.dumps({"collateralPercentage": 150, "lovelacePerUTxOWord": 34480}))
    (tmp_path / "conway-genesis.json").write_text(json.dumps({"minFeeRefScriptCostPerByte": 15}))
    p = readers.read_params(spark, str(tmp_path)).first()
    assert (p["fee_per_byte"], p["fee_fixed"], p["max_tx_size"], p["slot_len_ms"], p["collateral_percent"], p["coins_per_byte"], p["ref_script_per_byte"]) == (44, 155381, 16384, 100, 150, 4310, 15)
    assert [tuple(r) for r in readers.genesis_utxos(spark, str(tmp_path / "shelley-genesis.json")).collect()] == [("60f9", 30_000_000_000_000_000)]


def test_submissions(spark, tmp_path):
    tx = spark.range(4).withColumnRenamed("id", "tx_id")
    routed = route_submissions(tx, spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "tx_id long, reason string"))
    write_submissions(routed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["outcome"], r["reason"], r["n"]) for r in outcome_counts(back).collect()} == {("Submitted", None, 2), ("Rejected", "a", 1), ("Rejected", "unknown", 1)}


def events_in_files(spark, path, parts=3):
    """Chain events of the test tables, written as some files in order."""
    events = views.chain_event(spark, SF).select(*readers.EVENTS.names)
    cut = events.agg(F.max("seq")).first()[0] // parts + 1
    for i in range(parts):
        events.where(f"seq div {cut} = {i}").coalesce(1).write.mode("append").parquet(path)
    return events


def test_followed_stream_ends_where_the_batch_does(spark, tmp_path):
    path = str(tmp_path / "events")
    events = events_in_files(spark, path)
    stream = readers.read_chain_events(spark, path, streaming=True)
    q = follow_stream(stream, k=10**9).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    actions = spark.read.parquet(str(tmp_path / "out"))
    got = {(r["follower"], r["seq"]) for r in live_after(actions).collect()}
    assert got == {(r["follower"], r["seq"]) for r in C.canonical_chain(events).collect()} and got
    phases = {(r["follower"], r["seq"]): r["phase"] for r in C.phases(events).collect()}
    assert all(phases[r["follower"], r["seq"]] == r["phase"] for r in actions.where("action = 'live'").collect())


def test_deep_rollback_is_an_error_row(spark, tmp_path):
    rows = [(1, i, "forward", i * 10, None, None) for i in range(6)] + [(1, 6, "back", None, 5, None), (1, 7, "back", None, 40, None)]
    spark.createDataFrame(rows, readers.EVENTS).coalesce(1).write.parquet(str(tmp_path / "e"))
    q = follow_stream(readers.read_chain_events(spark, str(tmp_path / "e"), streaming=True), k=20).writeStream.format("memory").queryName("deep").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = [(r["seq"], r["action"]) for r in spark.table("deep").where("action <> 'live'").collect()]
    assert out == [(6, "TooDeep"), (5, "undo"), (4, "undo"), (3, "undo")]


def test_utxo_stream_like_the_batch(spark, tmp_path):
    outputs, inputs = views.tx_output(spark, SF), views.tx_input(spark, SF)
    made = outputs.select("tx_id", "ix", "address", "lovelace", F.lit("create").alias("action"), (F.col("tx_id") * 2).alias("n"))
    spent = U.spent_keys(inputs).join(outputs, ["tx_id", "ix"]).select("tx_id", "ix", "address", "lovelace", F.lit("spend").alias("action"), (F.col("tx_id") * 2 + 1).alias("n"))
    changes = made.unionByName(spent)
    third = changes.agg(F.max("n")).first()[0] // 3 + 1
    for i in range(3):  # in the order of the changes
        changes.where(f"n div {third} = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
    utxo_stream(stream, str(tmp_path / "utxo"), str(tmp_path / "ck"), buckets=4).awaitTermination()
    got = {(r["tx_id"], r["ix"], r["lovelace"]) for r in utxo_at(spark, str(tmp_path / "utxo")).collect()}
    batch = {(r["tx_id"], r["ix"], r["lovelace"]) for r in U.live_utxos(outputs, inputs).collect()}
    assert batch and got == batch
    epochs = [p.name for p in (tmp_path / "utxo").iterdir() if p.name.startswith("epoch=")]
    assert len(list((tmp_path / "utxo" / "manifest").iterdir())) <= 2 and len(epochs) <= 3


def test_no_outputs_before_the_first_batch(spark, tmp_path):
    assert utxo_at(spark, str(tmp_path / "none")).count() == 0


def test_a_broken_manifest_is_an_error(spark, tmp_path):
    (tmp_path / "manifest" / "0").mkdir(parents=True)
    (tmp_path / "manifest" / "0" / "_SUCCESS").touch()
    (tmp_path / "manifest" / "0" / "part-0.parquet").write_text("no parquet")
    try:
        utxo_at(spark, str(tmp_path)).collect()
        raise RuntimeError("must fail")
    except Exception as e:
        assert "must fail" not in str(e)


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from ledgerloom.functions.pinned import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    try:
        shared_folder(SimpleNamespace(sparkContext=context, conf={}))
        raise RuntimeError("must fail")
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
