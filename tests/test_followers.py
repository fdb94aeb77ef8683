"""Followers with little state, stopped and started again, and unspent outputs under roll-backs."""

import time

import pandas as pd

from ledgerloom.sources.readers import EVENTS, read_chain_events
from ledgerloom.streaming.blocks import Follower, cut_back, follow_blocks, resume_points, stored
from ledgerloom.streaming.callbacks import Tracer, kept_rows, on_batches
from ledgerloom.streaming.follow import OUT, utxo_at, utxo_follow

ROWS = [
    (1, 1, "forward", 10, None, 100), (1, 2, "forward", 20, None, 100), (1, 3, "forward", 30, None, 30), (1, 4, "back", None, 10, None),
    (1, 5, "forward", 40, None, 100), (1, 6, "forward", 65, None, 100), (1, 7, "back", None, 5, None), (1, 8, "forward", 70, None, 100),
    (2, 1, "forward", 10, None, None), (2, 2, "back", None, None, None), (2, 3, "forward", 12, None, 12),
]
#: With 50 slots kept, the block at 10 is gone once the one at 65 comes; 20 and 30 were undone before.
WANT = [
    (1, 1, 10, "live", "restoration"), (1, 2, 20, "live", "restoration"), (1, 3, 30, "live", "following"), (1, 2, 20, "undo", "following"), (1, 3, 30, "undo", "following"),
    (1, 5, 40, "live", "following"), (1, 6, 65, "live", "following"), (1, 7, 5, "TooDeep", "following"), (1, 5, 40, "undo", "following"), (1, 6, 65, "undo", "following"),
    (1, 8, 70, "live", "following"), (2, 1, 10, "live", "restoration"), (2, 1, 10, "undo", "restoration"), (2, 3, 12, "live", "following"),
]


def _write(spark, rows, path):
    columns = ("follower", "seq", "kind", "slot", "back_slot", "tip_slot")
    spark.createDataFrame([tuple({**dict.fromkeys(EVENTS.names), **dict(zip(columns, r, strict=True))}[n] for n in EVENTS.names) for r in rows], EVENTS).coalesce(1).write.parquet(str(path))


def _follow(spark, path, k=50, kept=None):
    out = follow_blocks(read_chain_events(spark, str(path), streaming=True), k, kept)
    out.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{path}-out")


def test_small_window_and_restart(spark, tmp_path):
    _write(spark, ROWS, tmp_path / "all")
    assert sorted(map(tuple, _follow(spark, tmp_path / "all").collect())) == sorted(WANT)
    for cut in (3, 6):
        one, two = tmp_path / f"one{cut}", tmp_path / f"two{cut}"
        _write(spark, [r for r in ROWS if r[1] <= cut], one)
        _write(spark, [r for r in ROWS if r[1] > cut], two)
        before = _follow(spark, one)
        after = _follow(spark, two, kept=stored(before, 50))
        assert sorted(map(tuple, before.union(after).collect())) == sorted(WANT)


def test_points_and_cut(spark):
    kept = spark.createDataFrame([(1, s, 10 * s, True, None) for s in range(1, 9)] + [(2, None, None, False, 4)], "follower long, seq long, slot long, following boolean, floor long")
    points = sorted(map(tuple, resume_points(kept).collect()))
    assert points == [(1, 0, 80, 8), (1, 1, 70, 7), (1, 2, 60, 6), (1, 4, 40, 4), (1, 7, 10, 1)]
    left = cut_back(kept, spark.createDataFrame([(1, 40)], "follower long, slot long")).collect()
    assert sorted(r["seq"] for r in left if r["seq"]) == [1, 2, 3, 4] and len(left) == 9


class _Kept(dict):
    """A state as the processor sees it."""

    def iterator(self):
        return iter(list(self.items()))

    removeKey = dict.pop
    updateValue = dict.__setitem__

    def exists(self):
        return "v" in self

    def get(self):
        return self["v"]

    def update(self, v):
        self["v"] = v


def test_idle_follower_is_evicted():
    """Its blocks go, what it knows stays, and a roll-back below them is too deep."""
    f = Follower(1000, 5)
    f.blocks, f.known = _Kept({(10, 1): (1,), (20, 2): (1,)}), _Kept(v=(True, None))
    assert all(frame.empty for frame in f.handleExpiredTimer((1,), None, None)) and not f.blocks and f.known.get() == (True, 20)
    f.idle_ms = None
    back = pd.DataFrame([(3, "back", None, 15, None)], columns=["seq", "kind", "slot", "back_slot", "tip_slot"])
    assert list(next(f.handleInputRows((1,), iter([back]), None))["action"]) == ["TooDeep"]


def test_unspent_outputs_under_roll_backs(spark, tmp_path):
    """Blocks and their undoing in several batches: what was spent comes back, what was made goes, a block may come again."""
    rows = [[(1, 1, 10, "live"), (1, 2, 20, "live")], [(1, 3, 30, "live"), (1, 3, 30, "undo"), (1, 2, 20, "undo"), (1, 4, 25, "live")], [(1, 4, 25, "undo"), (1, 5, 26, "live")], [(1, 9, 9, "TooDeep")]]
    for i, part in enumerate(rows):
        spark.createDataFrame([(*r, "following") for r in part], OUT).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    bodies = spark.createDataFrame(
        [(1, 1, "create", 1, 0, 7, 100), (1, 1, "create", 1, 1, 7, 200), (1, 2, "spend", 1, 0, None, None), (1, 2, "create", 2, 0, 8, 90), (1, 3, "spend", 2, 0, None, None), (1, 3, "spend", 1, 1, None, None),
         (1, 4, "spend", 1, 1, None, None), (1, 4, "create", 4, 0, 9, 150), (1, 5, "spend", 1, 0, None, None), (1, 5, "create", 5, 0, 9, 95)],
        "follower long, seq long, op string, tx_id long, ix long, address long, lovelace long",
    )
    for number, want in ((2, {(1, 1, 7, 200), (2, 0, 8, 90)}), (3, {(1, 0, 7, 100), (4, 0, 9, 150)}), (5, {(1, 1, 7, 200), (5, 0, 9, 95)})):
        out = tmp_path / f"utxo{number}"
        parts = {2: 1, 3: 2, 5: 4}[number]
        source = spark.readStream.schema(OUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / ("*" if parts == 4 else "{" + ",".join(map(str, range(parts))) + "}")))
        utxo_follow(source, bodies, 1000, str(out), f"{out}-ck", buckets=2).awaitTermination()
        assert {tuple(r) for r in utxo_at(spark, str(out)).select("tx_id", "ix", "address", "lovelace").collect()} == want


def test_callbacks_by_epoch_and_trace(spark, tmp_path):
    """Each epoch is handed over once, a stream that begins anew included; a failed call leaves nothing behind."""
    for i, part in enumerate(([(1,), (2,)], [(3,)])):
        spark.createDataFrame(part, "x long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    seen, tracer = [], Tracer()
    spark.streams.addListener(tracer)

    def call(batch, epoch):
        seen.append(epoch)
        if seen == [0, 1]:
            batch.write.mode("overwrite").parquet(str(tmp_path / "kept" / "rows" / "epoch=1"))
            raise RuntimeError("stopped half-way")
        return batch

    for attempt in range(3):
        stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = on_batches(stream, call, str(tmp_path / "kept"), str(tmp_path / f"ck{min(attempt, 1)}"))
        try:
            q.awaitTermination()
        except Exception as e:
            assert attempt == 0 and "stopped half-way" in str(e)
            assert kept_rows(spark, str(tmp_path / "kept"), "x long").count() == 2
    assert seen == [0, 1, 1]
    assert sorted(map(tuple, kept_rows(spark, str(tmp_path / "kept"), "x long").collect())) == [(1, 0), (2, 0), (3, 1)]
    for _ in range(50):
        if tracer.lines:
            break
        time.sleep(0.2)
    spark.streams.removeListener(tracer)
    assert {r["epoch"] for r in tracer.table(spark).collect()} <= {0, 1} and tracer.lines
