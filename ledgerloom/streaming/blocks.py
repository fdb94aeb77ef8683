"""Followers of a chain with state that is written as it changes: a map of the blocks of the last k slots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.sampling import sample_fibonacci
from .follow import OUT

#: A follower's stored chain, as a restarted stream takes it: blocks that can still be undone, and what is known beside them.
KEPT = "follower long, seq long, slot long, following boolean, floor long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Follower(StatefulProcessor):
    """Blocks of a follower by (slot, seq), and (following, floor): whether the tip was reached and the highest slot no longer kept."""

    def __init__(self, k: int, idle_ms: int | None):
        self.k, self.idle_ms, self.last = k, idle_ms, None

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "slot long, seq long", "n int")
        self.known = handle.getValueState("known", "following boolean, floor long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values("seq").itertuples()
        plain = ((int(e.seq), e.kind, *(None if pd.isna(x) else int(x) for x in (e.slot, e.back_slot, e.tip_slot))) for e in events)
        yield pd.DataFrame(self.followed(int(key[0]), plain, timerValues), columns=["follower", "seq", "slot", "action", "phase"])

    def followed(self, follower: int, events: Iterable[tuple], timerValues) -> list[tuple]:
        """Rows of a follower's events (seq, kind, slot, back_slot, tip_slot), which are in order, and its state after them."""
        was = self.known.get()
        following, floor = was or (False, None)
        window = sorted(k for k, _ in self.blocks.iterator())
        stored, out = set(window), []
        for seq, kind, slot, target, tip in events:
            phase = "following" if following else "restoration"
            if kind == "back":
                target = -1 if target is None else target
                if floor is not None and target < floor:
                    out.append((follower, seq, target, "TooDeep", phase))
                out += [(follower, q, s, "undo", phase) for s, q in sorted(window, key=lambda b: -b[1]) if s > target]
                window = [b for b in window if b[0] <= target]
                continue
            tip = tip or 0
            following = following or (tip > 0 and slot >= tip)
            out.append((follower, seq, slot, "live", "following" if following else "restoration"))
            gone = [s for s, _ in window if s < slot - self.k]
            if gone:
                floor = max(*gone, floor if floor is not None else gone[0])
                window = [b for b in window if b[0] >= slot - self.k]
            window.append((slot, seq))
        for block in stored.difference(window):
            self.blocks.removeKey(block)
        for block in set(window).difference(stored):
            self.blocks.updateValue(block, (1,))
        if was is None or tuple(was) != (bool(following), floor):
            self.known.update((bool(following), floor))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An idle follower's blocks go; a later roll-back below the newest of them is too deep."""
        slots = [k[0] for k, _ in self.blocks.iterator()]
        following, floor = self.known.get()
        self.blocks.clear()
        self.known.update((following, max([*slots, *([] if floor is None else [floor])], default=None)))
        yield pd.DataFrame([], columns=["follower", "seq", "slot", "action", "phase"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            if not pd.isna(r.seq):
                self.blocks.updateValue((int(r.slot), int(r.seq)), (1,))
            self.known.update((bool(r.following), None if pd.isna(r.floor) else int(r.floor)))

    def close(self) -> None:
        pass


class RowFollower(Follower):
    """The same over plain rows: a follower's few events need no data frame of their own, and rows of many followers go out together."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(((r["seq"], r["kind"], r["slot"], r["back_slot"], r["tip_slot"]) for r in rows), key=lambda e: e[0])
        for row in self.followed(int(key[0]), events, timerValues):
            yield Row(follower=row[0], seq=row[1], slot=row[2], action=row[3], phase=row[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for _ in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            pass
        return iter(())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """A row of a follower's stored chain; what is known beside the blocks is the same on all of them."""
        if initialState["seq"] is not None:
            self.blocks.updateValue((initialState["slot"], initialState["seq"]), (1,))
        if self.last != key[0]:
            self.known.update((bool(initialState["following"]), initialState["floor"]))
            self.last = key[0]


def follow_blocks(events: DataFrame, k: int, kept: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """live, undo and error rows of each follower, from a stream of events; undo rows come newest first.

    State: the blocks of the last k slots as a map, of which a batch writes what it changes; whether
    the tip was reached; and the highest slot that is no longer kept. A roll-back below that slot is
    an error row (TooDeep), and what is still kept above its target is undone. Events of a follower
    must reach the stream in order of seq, a batch at a time; a batch's events of one follower are
    sorted in memory, so the source's trigger options bound them. kept: what stored() gives, with
    which a new stream begins. idle_ms: blocks of a follower without events for that long go.
    The session's state store becomes RocksDB's, which such a state needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    grouped = None if kept is None else kept.groupBy("follower")
    return events.groupBy("follower").transformWithState(RowFollower(k, idle_ms), OUT, "Append", "None" if idle_ms is None else "ProcessingTime", grouped)


def stored(actions: DataFrame, k: int) -> DataFrame:
    """The state that rows of follow_blocks leave, for a stream that goes on from there (columns of KEPT).

    A block is kept while it was not undone and no later block was more than k slots newer. A
    follower of which no block is kept has one row without a block.
    """
    live = actions.where("action = 'live'").groupBy("follower", "seq", "slot").agg(F.max(F.col("phase") == "following").alias("f"))
    later = W.partitionBy("follower").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    undone = actions.where("action = 'undo'").select("follower", "seq", F.lit(True).alias("undone"))
    marked = live.withColumn("newest", F.max("slot").over(later)).join(undone, ["follower", "seq"], "left")
    gone = F.coalesce(F.col("newest") - k > F.col("slot"), F.lit(False)) & F.col("undone").isNull()
    whole = marked.groupBy("follower").agg(F.max("f").alias("following"), F.max(F.when(gone, F.col("slot"))).alias("floor"))
    open_ = marked.where(F.col("undone").isNull() & ~gone).select("follower", "seq", "slot")
    return whole.join(open_, "follower", "left").select("follower", "seq", "slot", "following", "floor")


def resume_points(kept: DataFrame) -> DataFrame:
    """(follower, place, slot, block): points to offer a node, the newest block first, then ever sparser ones, the oldest last."""
    blocks = kept.where("seq is not null").select("follower", "slot", F.col("seq").alias("block"), (-F.col("slot")).alias("_age"), (-F.col("seq")).alias("_later"))
    picked = sample_fibonacci(blocks, ["_age", "_later"], ["follower"])
    return picked.select("follower", F.col("pos").alias("place"), "slot", "block")


def cut_back(kept: DataFrame, met: DataFrame) -> DataFrame:
    """kept without the blocks above the point that a node knows; met: follower, slot, null for origin."""
    point = met.select("follower", F.coalesce("slot", F.lit(-1).cast("long")).alias("_point"))
    out = kept.join(point, "follower", "left")
    over = F.coalesce(F.col("slot") > F.col("_point"), F.lit(False))
    return out.select("follower", *(F.when(~over, F.col(c)).alias(c) for c in ("seq", "slot")), "following", "floor")

