"""Streaming followers: blocks kept for k slots, undone on roll-back; and outputs kept unspent, also under roll-backs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.pinned import exists, pinned, removed

OUT = "follower long, seq long, slot long, action string, phase string"
STATE = "slots array<long>, seqs array<long>, following boolean, floor long"


def follow_stream(events: DataFrame, k: int) -> DataFrame:
    """live, undo and error rows of each follower, from events in the order of seq.

    State: the blocks of the last k slots, whether the tip was reached, and the highest slot
    that is no longer kept. A roll-back below that slot cannot be undone and is an error row
    (TooDeep); what is still kept above its target is undone. Events of a follower must reach
    the stream in order of seq, a batch at a time.
    """

    def run(key, frames: Iterator[pd.DataFrame], state):
        slots, seqs, following, floor = state.get if state.exists else ([], [], False, None)
        blocks, rows = list(zip(slots, seqs, strict=True)), []
        for e in pd.concat(frames).sort_values("seq").itertuples():
            phase = "following" if following else "restoration"
            if e.kind == "back":
                target = -1 if pd.isna(e.back_slot) else int(e.back_slot)
                if floor is not None and target < floor:
                    rows.append((key[0], e.seq, target, "TooDeep", phase))
                rows += [(key[0], q, s, "undo", phase) for s, q in reversed(blocks) if s > target]
                blocks = [b for b in blocks if b[0] <= target]
                continue
            tip = 0 if pd.isna(e.tip_slot) else int(e.tip_slot)
            following = following or (tip > 0 and e.slot >= tip)
            blocks.append((int(e.slot), int(e.seq)))
            rows.append((key[0], e.seq, e.slot, "live", "following" if following else "restoration"))
            gone = [s for s, _ in blocks if s < e.slot - k]
            if gone:
                floor = max([*gone, *([] if floor is None else [floor])])
                blocks = [b for b in blocks if b[0] >= e.slot - k]
        state.update(([s for s, _ in blocks], [q for _, q in blocks], following, floor))
        yield pd.DataFrame(rows, columns=["follower", "seq", "slot", "action", "phase"]).astype({"follower": "int64", "seq": "int64", "slot": "int64"})

    return events.groupBy("follower").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def live_after(actions: DataFrame) -> DataFrame:
    """Blocks that are live after all rows of follow_stream: announced more often than undone."""
    sign = F.when(F.col("action") == "live", 1).when(F.col("action") == "undo", -1).otherwise(0)
    return actions.groupBy("follower", "seq", "slot").agg(F.sum(sign).alias("n")).where("n > 0").drop("n")


ROWS = "tx_id long, ix long, address long, lovelace long, bucket int"


def _write_changes(batch: DataFrame, epoch: int, path: str, buckets: int) -> None:
    """Applies a batch of changes to the buckets that it touches."""
    spark = batch.sparkSession
    keyed = batch.withColumn("bucket", F.pmod(F.xxhash64("tx_id", "ix"), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # buckets numbers at most
    if not touched:
        return
    old = _manifest(spark, path, before=epoch)
    last = keyed.groupBy("bucket", "tx_id", "ix").agg(F.max(F.struct("n", "action", "address", "lovelace")).alias("x"))
    alive = last.where(F.col("x.action").isin("create", "undo_spend")).select("tx_id", "ix", "x.address", "x.lovelace", "bucket")
    again = {b: e for b, e in old.items() if b in set(touched)}
    if again:
        kept = _read(spark, path, again).join(last.select("tx_id", "ix"), ["tx_id", "ix"], "left_anti")
        alive = alive.unionByName(kept.select(*alive.columns))
    alive.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")
    now = {**old, **dict.fromkeys(touched, epoch)}
    spark.createDataFrame(sorted(now.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{epoch}")
    named = {*now.values(), *old.values()}
    older = _epochs(spark, f"{path}/manifest", epoch)[:-1]
    for e in _epochs(spark, path, epoch):
        if e not in named:
            removed(spark, f"{path}/epoch={e}")
    for e in older:
        removed(spark, f"{path}/manifest/{e}")


def utxo_stream(changes: DataFrame, path: str, checkpoint: str, buckets: int = 16):
    """Starts a stream that keeps the unspent outputs at path, in buckets by a hash of their key.

    changes: tx_id, ix, address, lovelace, action (create, spend, undo_create, undo_spend), n, the
    order of the change. The last change of a key decides; batches come in the order of n. A batch
    writes the buckets it touches anew, into a folder named by its epoch, and then a manifest that
    tells the newest epoch of each bucket; repeating an epoch gives the same. What neither this
    manifest nor the one before it names is deleted, so the folder holds two versions at most.
    buckets: so many that a batch touches few of them and each holds about a million outputs.
    """

    return changes.writeStream.foreachBatch(lambda batch, epoch: _write_changes(batch, epoch, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LOG = "follower long, seq long, slot long, tx_id long, ix long, address long, lovelace long"


def utxo_follow(actions: DataFrame, bodies: DataFrame, k: int, path: str, checkpoint: str, buckets: int = 16):
    """Starts a stream that keeps the unspent outputs at path under blocks that come and are undone.

    actions: a stream of live and undo rows of blocks (follower, seq, slot, action), as a follower
    gives them; error rows change nothing. bodies: what blocks do (follower, seq, op, tx_id, ix,
    address, lovelace), op create or spend; a spend names its output by tx_id and ix alone. Keys of
    outputs are unique, and only a block's own chain spends its outputs.

    What a batch adds and takes back in all is applied at once: outputs that undone blocks made go,
    those they spent come back as they were, then the outputs of new blocks come and what these
    spend goes. How a spent output was is read from a log of before-images by follower and slot,
    which holds the blocks that can still be undone: of the last k slots of each follower. An epoch
    writes its own version of the log and reads the one before, so repeating it changes nothing.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        sign = F.when(F.col("action") == "live", 1).when(F.col("action") == "undo", -1).otherwise(0)
        net = pinned(batch.groupBy("follower", "seq", "slot").agg(F.sum(sign).alias("n"), F.max(sign).alias("came")).where("n <> 0 or came = 1"))
        if net.isEmpty():
            return
        key = ["tx_id", "ix"]
        old = _log(spark, path, before=epoch)
        done = bodies.join(net.where("n <> 0"), ["follower", "seq"])
        undone, fresh = done.where("n < 0"), done.where("n > 0")
        back = old.join(net.where("n < 0").select("follower", "seq"), ["follower", "seq"], "left_semi")
        made = fresh.where("op = 'create'").select(*key, "address", "lovelace")
        held = _read(spark, path, _manifest(spark, path, before=epoch)).select(*key, "address", "lovelace")
        spent = fresh.where("op = 'spend'").select("follower", "seq", "slot", *key)
        images = spent.join(held.unionByName(made).unionByName(back.select(*made.columns)).distinct(), key)
        none = F.lit(None).cast("long")
        changes = [
            back.select(*key, "address", "lovelace", F.lit("undo_spend").alias("action"), F.lit(0).alias("n")),
            undone.where("op = 'create'").select(*key, none.alias("address"), none.alias("lovelace"), F.lit("undo_create").alias("action"), F.lit(1).alias("n")),
            made.select(*made.columns, F.lit("create").alias("action"), F.lit(2).alias("n")),
            spent.select(*key, none.alias("address"), none.alias("lovelace"), F.lit("spend").alias("action"), F.lit(3).alias("n")),
        ]
        every = changes[0]
        for more in changes[1:]:
            every = every.unionByName(more)
        kept = old.join(net.where("n < 0").select("follower", "seq"), ["follower", "seq"], "left_anti").unionByName(images.select(*old.columns))
        top = net.where("came = 1").select("follower", "slot").unionByName(old.select("follower", "slot")).groupBy("follower").agg(F.max("slot").alias("top"))
        log = kept.join(top, "follower", "left").where(F.col("top").isNull() | (F.col("slot") >= F.col("top") - k)).drop("top")
        log.write.mode("overwrite").parquet(f"{path}/log/{epoch}")
        _write_changes(every, epoch, path, buckets)
        for e in _epochs(spark, f"{path}/log", epoch)[:-1]:
            removed(spark, f"{path}/log/{e}")

    return actions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _log(spark, path: str, before: int | None = None) -> DataFrame:
    """The before-images of the newest finished epoch, of epochs before one if given."""
    done = [e for e in _epochs(spark, f"{path}/log", before) if exists(spark, f"{path}/log/{e}/_SUCCESS")]
    return spark.read.schema(LOG).parquet(f"{path}/log/{done[-1]}") if done else spark.createDataFrame([], LOG)


def _epochs(spark, path: str, before: int | None = None) -> list[int]:
    """Epochs that have a folder at path, in order, each named by its number."""
    if not exists(spark, path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName().removeprefix("epoch=") for f in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    return sorted(int(n) for n in names if n.isdigit() and (before is None or int(n) < before))


def _manifest(spark, path: str, before: int | None = None) -> dict[int, int]:
    """The newest finished epoch of each bucket, of epochs before one if given."""
    done = [e for e in _epochs(spark, f"{path}/manifest", before) if exists(spark, f"{path}/manifest/{e}/_SUCCESS")]
    return {r["bucket"]: r["epoch"] for r in spark.read.parquet(f"{path}/manifest/{done[-1]}").collect()} if done else {}


def _read(spark, path: str, newest: dict[int, int]) -> DataFrame:
    """The outputs of the named versions; a bucket without outputs has no folder."""
    folders = [f"{path}/epoch={e}/bucket={b}" for b, e in newest.items() if exists(spark, f"{path}/epoch={e}/bucket={b}")]
    if not folders:
        return spark.createDataFrame([], ROWS)
    plain = spark.read.schema("tx_id long, ix long, address long, lovelace long").parquet(*folders)
    return plain.withColumn("bucket", F.regexp_extract(F.col("_metadata.file_path"), "bucket=([0-9]+)", 1).cast("int"))


def utxo_at(spark, path: str) -> DataFrame:
    """The unspent outputs after the last finished batch; none before the first one."""
    return _read(spark, path, _manifest(spark, path)).drop("bucket")
