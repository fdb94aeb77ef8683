"""Bytes of assembled transactions in canonical CBOR, as folds over their nested arrays; no bytes are made.

Ids count as the hashes they stand for; lengths of the ledger's map keys, tags and headers are
those of its public format. A field without rows takes no bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .fees import cbor_length

# Bytes of a hash, a key hash or policy, an address, a signature and its key.
HASH, KEY, ADDRESS, SIGNATURE, PUBLIC = 32, 28, 57, 64, 32
#: Fields of the body with a number above 23 would take two bytes; all used ones take one.
FIELD = 1


def integer(n: Column) -> Column:
    return cbor_length(F.when(n < 0, -1 - n).otherwise(n))


def string(length: Column | int) -> Column:
    """A byte or text string: its head and its bytes."""
    n = length if isinstance(length, Column) else F.lit(length)
    return cbor_length(n) + n


def listed(items: Column, each: Callable[[Column], Column]) -> Column:
    """An array or map: its head and its items; 0 for null."""
    total = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + each(x).cast("long"))
    return F.when(items.isNull(), 0).otherwise(cbor_length(F.size(items)) + total)


def _field(items: Column, each: Callable[[Column], Column]) -> Column:
    return F.when(items.isNull(), 0).otherwise(FIELD + listed(items, each))


def _key(x: Column) -> Column:
    return 1 + string(HASH) + integer(x["src_ix"])


def _name(x: Column) -> Column:
    return string(F.length(x["asset_name"].cast("string")))


def _output(x: Column) -> Column:
    """Address and value, a pair of coin and assets where it holds any; a datum is a hash with its tag."""
    bundle = 1 + 1 + string(KEY) + 1 + _name(x) + integer(x["qty"])
    value = integer(x["lovelace"]) + F.when(x["policy_id"].isNotNull(), bundle).otherwise(0)
    datum = F.when(x["has_datum"], 1 + 1 + 1 + string(HASH)).otherwise(0)
    return 1 + 1 + string(ADDRESS) + 1 + value + datum


def _mint(x: Column) -> Column:
    return string(KEY) + 1 + _name(x) + integer(x["qty"])


def tx_sizes(tx: DataFrame) -> DataFrame:
    """(tx_id, base_size) of assembled transactions, without fee and change, whose lengths balancing adds.

    Signers sign; redeemers carry their data as text and their units; attached scripts count as
    their hashes.
    """
    c = F.col
    body = (
        1 + FIELD + _field(c("inputs"), _key) + _field(c("outputs"), _output) + F.when(c("valid_to").isNotNull(), FIELD + integer(c("valid_to"))).otherwise(0)
        + _field(c("withdrawals"), lambda x: string(KEY + 1) + integer(x["amount"])) + F.when(c("metadata").isNotNull(), FIELD + string(HASH)).otherwise(0)
        + F.when(c("valid_from").isNotNull(), FIELD + integer(c("valid_from"))).otherwise(0) + _field(c("mint"), _mint) + F.when(c("redeemers").isNotNull(), FIELD + string(HASH)).otherwise(0)
        + _field(c("collateral"), _key) + _field(c("signers"), lambda x: string(KEY)) + _field(c("reference_inputs"), _key)
    )
    witnesses = (
        1 + _field(c("signers"), lambda x: 1 + string(PUBLIC) + string(SIGNATURE)) + _field(c("scripts"), lambda x: string(HASH))
        + _field(c("redeemers"), lambda x: 1 + 1 + integer(x["ix"]) + string(F.length(x["data"])) + 1 + integer(x["mem"]) + integer(x["steps"]))
    )
    data = F.when(c("metadata").isNull(), 1).otherwise(listed(c("metadata"), lambda x: integer(x["label"]) + string(F.length(x["value"]))))
    return tx.select("tx_id", (1 + body + witnesses + 1 + data).cast("long").alias("base_size"))
