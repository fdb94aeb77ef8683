"""Following chains in batch: roll-backs, phases, block contents and the mapping of time to slots.

Events: follower, seq, kind (forward or back), slot, back_slot (target of a roll-back, null for
origin) and tip_slot. Where blocks or txs are put in order, a follower's or chain's rows are dealt
to ranges. canonical_chain_bucketed does the same as canonical_chain without writing: in ranges of
seq of a given width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ranges import RANGE, in_ranges, least_after, one_before, with_earlier, within
from ..functions.sampling import numbered


def fetched(events: DataFrame) -> DataFrame:
    """Roll-forwards with tip slot, 0 at genesis, and how far they are behind the tip."""
    tip = F.coalesce("tip_slot", F.lit(0).cast("long"))
    return events.where("kind = 'forward'").select("follower", "seq", "slot", tip.alias("tip_slot"), F.greatest(F.lit(0).cast("long"), tip - F.col("slot")).alias("lag"))


def _target(kind: str = "kind") -> Column:
    """Where a roll-back goes to; origin is before slot 0."""
    return F.when(F.col(kind) == "back", F.coalesce("back_slot", F.lit(-1).cast("long")))


def canonical_chain(events: DataFrame) -> DataFrame:
    """Roll-forwards that no later roll-back takes back.

    Events are dealt to ranges: what later events of a range and all later ranges of a follower
    take back is a least target each, so a chain of any length spreads over many tasks.
    """
    rows = with_earlier(in_ranges(events, ["follower"], ["seq"]), ["follower"], F.min(_target()), _after=least_after)
    later = within(["follower"]).orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    kept = rows.withColumn("_least", F.least(F.min(_target()).over(later), "_after")).where("kind = 'forward' and (_least is null or slot <= _least)")
    return kept.drop("_least", "_after", RANGE, "back_slot", "kind")


def canonical_chain_bucketed(events: DataFrame, width: int) -> DataFrame:
    """The same for chains too long for one window: ranges of seq, then the least target of all later ranges.

    Ranges are joined with ranges: a chain has far fewer of them than events.
    """
    bucketed = events.withColumn("_b", F.floor(F.col("seq") / width))
    least = bucketed.groupBy("follower", "_b").agg(F.min(_target()).alias("_m"))
    after = W.partitionBy("follower").orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    least = least.select("follower", "_b", F.min("_m").over(after).alias("_after"))
    inside = W.partitionBy("follower", "_b").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    own = bucketed.withColumn("_own", F.min(_target()).over(inside)).join(least, ["follower", "_b"])
    limit = F.least("_own", "_after")
    return own.where((F.col("kind") == "forward") & (limit.isNull() | (F.col("slot") <= limit))).drop("_b", "_own", "_after", "back_slot", "kind")


def find_intersection(points: DataFrame, chain: DataFrame) -> DataFrame:
    """(follower, place, slot, block): the first listed point that is on the chain; nulls stand for origin.

    points: follower, place, slot, block; chain: follower, slot, block.
    """
    met = points.join(chain.select("follower", "slot", "block").distinct(), ["follower", "slot", "block"], "left_semi")
    best = met.groupBy("follower").agg(F.min(F.struct("place", "slot", "block")).alias("x"))
    return points.select("follower").distinct().join(best, "follower", "left").select("follower", "x.place", "x.slot", "x.block")


def phases(events: DataFrame) -> DataFrame:
    """(follower, seq, slot, phase, transition): restoring until the first block at the tip, following ever after."""
    rows = fetched(events).withColumn("at_tip", (F.col("tip_slot") > 0) & (F.col("slot") >= F.col("tip_slot")))
    first = rows.where("at_tip").groupBy(F.col("follower").alias("_follower")).agg(F.min("seq").alias("first"))
    rows = rows.join(first, rows["follower"].eqNullSafe(first["_follower"]), "left")
    phase = F.when(F.col("seq") >= F.col("first"), "following").otherwise("restoration")
    return rows.select("follower", "seq", "slot", phase.alias("phase"), F.coalesce(F.col("at_tip") & (F.col("seq") == F.col("first")), F.lit(False)).alias("transition"))


def block_txs(chain: DataFrame) -> DataFrame:
    """A row for each tx of each block, in order. chain: follower, slot, txs (array)."""
    out = chain.select("follower", "slot", F.posexplode("txs").alias("place", "tx_id"))
    return out.withColumn("place", F.col("place").cast("long"))


def take_blocks(chain: DataFrame, n: int) -> DataFrame:
    """The first n blocks of each follower, numbered from 1.

    A few blocks are picked before they travel; many are numbered in ranges.
    """
    if n > 1000:  # up to here Spark keeps the first rows of each task only
        return _numbered(chain).where(F.col("n") <= n)
    place = F.row_number().over(W.partitionBy("follower").orderBy("seq"))
    return chain.withColumn("n", place).where(F.col("n") <= n).withColumn("n", F.col("n").cast("long"))


def block_batches(chain: DataFrame, n: int) -> DataFrame:
    """Blocks with the number of their batch of n blocks."""
    return _numbered(chain).withColumn("batch", F.call_function("div", F.col("n") - 1, F.lit(n)))


def _numbered(chain: DataFrame) -> DataFrame:
    return numbered(chain, ["seq"], ["follower"]).withColumn("n", F.col("pos") + 1).drop("pos", "size")


def audit_order(submitted: DataFrame, chain_txs: DataFrame) -> DataFrame:
    """(chain, n, tx_id, pos, problem): submitted txs that are missing from the chain or not after the one before.

    submitted: chain, n, tx_id; chain_txs: tx_id, pos.
    """
    first = chain_txs.groupBy("tx_id").agg(F.min("pos").alias("pos"))
    rows = submitted.join(first, "tx_id", "left")
    rows = with_earlier(in_ranges(rows, ["chain"], ["n"]), ["chain"], F.max(F.struct("n", "pos")), _last=one_before)
    order = within(["chain"]).orderBy("n")
    before = F.when(F.row_number().over(order) == 1, F.col("_last.pos")).otherwise(F.lag("pos").over(order))
    problem = F.when(F.col("pos").isNull(), "missing").when(F.col("pos") <= before, "out of order")
    return rows.withColumn("problem", problem).where("problem is not null").select("chain", "n", "tx_id", "pos", "problem")


def _slots(df: DataFrame, era: DataFrame, ms: str, up: bool) -> DataFrame:
    """Era table: a handful of rows, broadcast. Times before the start count as the start, times past the horizon are errors."""
    first = F.col("era_start_ms") == F.min("era_start_ms").over(W.partitionBy(F.lit(0)))
    eras = era.withColumn("_first", first)
    inside = (F.col(ms) < F.col("era_end_ms")) & ((F.col(ms) >= F.col("era_start_ms")) | F.col("_first"))
    joined = df.join(F.broadcast(eras), inside, "left").withColumn("_past", F.greatest(F.lit(0), F.col(ms) - F.col("era_start_ms")))
    slot = F.col("slot_start") + F.expr("_past div slot_len_ms")
    if up:
        slot = slot + F.when(F.col("_past") % F.col("slot_len_ms") != 0, 1).otherwise(0)
    error = F.when(F.col("era_start_ms").isNull(), "PastHorizon")
    return joined.select(*df.columns, F.when(error.isNull(), slot).alias("slot"), error.alias("error"))


def to_slot_floor(df: DataFrame, era: DataFrame, ms: str = "posix_ms") -> DataFrame:
    """Slot in which a time falls, for upper bounds."""
    return _slots(df, era, ms, up=False)


def to_slot_ceil(df: DataFrame, era: DataFrame, ms: str = "posix_ms") -> DataFrame:
    """First slot that begins at or after a time, for lower bounds."""
    return _slots(df, era, ms, up=True)
