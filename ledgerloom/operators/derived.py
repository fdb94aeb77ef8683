"""Values of transactions that depend on each other: computed in the order of their needs, and again only where those changed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.pinned import pinned

#: Names of tables, and the tables; each has a tx_id.
Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Derived:
    """A table made from others: of the assembled transactions, from the user or derived itself.

    make gets the tables named in needs, in that order, and gives rows with a tx_id; what it gives
    for a tx may depend on that tx's rows alone. A table without tx_id, such as prices, belongs
    into make's closure.
    """

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]


def in_order(values: Sequence[Derived], given: Sequence[str]) -> list[Derived]:
    """values so that each follows what it needs; a need that nothing gives, or a circle, is an error."""
    known, left, out = set(given), list(values), []
    while left:
        ready = [v for v in left if set(v.needs) <= known]
        if not ready:
            raise ValueError(f"circular or unknown needs: {sorted({n for v in left for n in v.needs} - known)}")
        out += ready
        known |= {v.name for v in ready}
        left = [v for v in left if v.name not in known]
    return out


def derive(values: Sequence[Derived], tables: Tables) -> dict[str, DataFrame]:
    """All derived tables; each is written once."""
    made: dict[str, DataFrame] = {}
    for v in in_order(values, list(tables)):
        made[v.name] = pinned(v.make(*({**tables, **made}[n] for n in v.needs)))
    return made


def refresh(values: Sequence[Derived], tables: Tables, old: Tables, changed: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The derived tables after tables changed, and the tx_ids of which each derived table changed.

    tables: as they are now; old: derived before; changed: for each table that changed, the tx_ids.
    A value is made anew for the transactions of which something that it needs changed, and what
    needs it looks only at those where it came out different.
    """
    known = {k: d.select("tx_id").distinct() for k, d in changed.items()}
    made: dict[str, DataFrame] = {}
    moved: dict[str, DataFrame] = {}
    for v in in_order(values, list(tables)):
        touched = [known[n] for n in v.needs if n in known]
        if not touched:
            made[v.name] = old[v.name]
            continue
        ids = touched[0]
        for more in touched[1:]:
            ids = ids.union(more)
        ids = pinned(ids.distinct())
        now = {**tables, **made}
        again = v.make(*(now[n].join(ids, "tx_id", "left_semi") for n in v.needs))
        before = old[v.name].join(ids, "tx_id", "left_semi").select(*again.columns)
        tagged = again.withColumn("_side", F.lit(1)).unionByName(before.withColumn("_side", F.lit(-1)))
        apart = tagged.groupBy(*again.columns).agg(F.sum("_side").alias("_n")).where("_n <> 0")
        known[v.name] = moved[v.name] = pinned(apart.select("tx_id").distinct())
        made[v.name] = pinned(old[v.name].join(moved[v.name], "tx_id", "left_anti").unionByName(again.join(moved[v.name], "tx_id", "left_semi").select(*old[v.name].columns)))
    return made, moved
