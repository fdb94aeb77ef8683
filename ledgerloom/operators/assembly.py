"""Transactions from instruction logs and back.

An instruction log has one row an instruction: tx_id, seq, op and the columns of that op.
Child tables stay long; whole transactions are nested only at the end. Wherever the first or
the last instruction counts, seq decides, never the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .indices import policy_index, spending_index, withdrawal_index

LOG = T.StructType([T.StructField(n, t) for n, t in (
    ("tx_id", T.LongType()), ("seq", T.LongType()), ("op", T.StringType()), ("src_tx_id", T.LongType()), ("src_ix", T.LongType()), ("witness", T.StringType()),
    ("address", T.LongType()), ("lovelace", T.LongType()), ("has_datum", T.BooleanType()), ("policy_id", T.LongType()), ("asset_name", T.LongType()), ("qty", T.LongType()),
    ("account", T.LongType()), ("label", T.LongType()), ("value", T.StringType()), ("signer", T.LongType()), ("script_hash", T.LongType()), ("slot", T.LongType()),
)])
#: Sections of a log, in order, and the inputs' roles among them.
SECTIONS = ("spend", "collateral", "reference", "pay", "mint", "withdraw", "metadata", "sign", "attach", "valid_from", "valid_to")
ROLES = ("spend", "collateral", "reference")


def of(log: DataFrame, *ops: str) -> DataFrame:
    return log.where(F.col("op").isin(*ops))


def input_sets(log: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(tx_id, kind, src_tx_id, src_ix): distinct inputs of each role, extra fee inputs among the spent ones."""
    keys = of(log, *ROLES).select("tx_id", F.col("op").alias("kind"), "src_tx_id", "src_ix")
    if extra is not None:
        keys = keys.unionByName(extra.select("tx_id", F.lit("spend").alias("kind"), "src_tx_id", "src_ix"))
    return keys.distinct()


def ordered_outputs(log: DataFrame) -> DataFrame:
    """Outputs with their 0-based place among the pay instructions."""
    ix = (F.row_number().over(W.partitionBy("tx_id").orderBy("seq")) - 1).cast("long")
    return of(log, "pay").select("tx_id", ix.alias("ix"), "address", "lovelace", "has_datum", "policy_id", "asset_name", "qty")


def net_mint(log: DataFrame) -> DataFrame:
    """(tx_id, policy_id, asset_name, qty): sums of the instructions; zero ones and zero sums are dropped, negative ones are burns."""
    sums = of(log, "mint").where("qty <> 0").groupBy("tx_id", "policy_id", "asset_name").agg(F.sum("qty").cast("long").alias("qty"))
    return sums.where("qty <> 0")


def withdrawals(log: DataFrame) -> DataFrame:
    """(tx_id, account, amount, witness): the last instruction of each account."""
    last = of(log, "withdraw").groupBy("tx_id", "account").agg(F.max(F.struct("seq", "lovelace", "witness")).alias("x"))
    return last.select("tx_id", "account", F.col("x.lovelace").alias("amount"), "x.witness")


def metadata(log: DataFrame) -> DataFrame:
    """(tx_id, label, value): the last value of each label."""
    return of(log, "metadata").groupBy("tx_id", "label").agg(F.max_by("value", "seq").alias("value"))


def signers(log: DataFrame) -> DataFrame:
    return of(log, "sign").select("tx_id", "signer").distinct()


def scripts(log: DataFrame) -> DataFrame:
    return of(log, "attach").select("tx_id", "script_hash").distinct()


def validity(log: DataFrame) -> DataFrame:
    """(tx_id, valid_from, valid_to): the last bound of either kind, null where none is set."""
    def last(op: str) -> Column:
        return F.max_by("slot", F.when(F.col("op") == op, F.col("seq")))

    bounds = of(log, "valid_from", "valid_to").groupBy("tx_id")
    return bounds.agg(last("valid_from").alias("valid_from"), last("valid_to").alias("valid_to"))


def redeemers(log: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(tx_id, purpose, ix, data, mem, steps): script spends, the first instruction of each minted policy, script withdrawals.

    Units are 0. data names the instruction that brought the redeemer. Of equal keys the last one in the order
    spend, mint, reward and instruction counts.
    """
    spends = of(log, "spend").where("witness = 'script'").select("tx_id", "src_tx_id", "src_ix", "seq")
    spends = spends.join(spending_index(of(log, "spend").withColumn("kind", F.lit("spend")), extra), ["tx_id", "src_tx_id", "src_ix"])
    minted = of(log, "mint").where("qty <> 0")
    first = minted.groupBy("tx_id", "policy_id").agg(F.min(F.struct("seq", "witness")).alias("x")).where("x.witness = 'script'")
    mints = first.join(policy_index(minted), ["tx_id", "policy_id"])
    last = of(log, "withdraw").groupBy("tx_id", "account").agg(F.max(F.struct("seq", "witness")).alias("x"))
    rewards = last.join(withdrawal_index(last), ["tx_id", "account"]).where("x.witness = 'script'")
    rows = (
        spends.select("tx_id", F.lit("spend").alias("purpose"), "ix", "seq")
        .unionByName(mints.select("tx_id", F.lit("mint").alias("purpose"), "ix", "x.seq"))
        .unionByName(rewards.select("tx_id", F.lit("reward").alias("purpose"), "ix", "x.seq"))
    )
    kept = rows.groupBy("tx_id", "purpose", "ix").agg(F.max("seq").alias("seq"))
    zero = F.lit(0).cast("long")
    return kept.select("tx_id", "purpose", "ix", F.concat(F.lit("r"), "seq").alias("data"), zero.alias("mem"), zero.alias("steps"))


def _some(items: Column) -> Column:
    """The array, null if it is empty; made once, as a condition on it would make it again."""
    return F.get(F.filter(F.array(items), lambda x: F.size(x) > 0), F.lit(0))


def _set(items: Column, *columns: str) -> Column:
    """Sorted distinct structs of some columns. No item is null, so sort_array, which compares natively, gives the order of array_sort."""
    return F.sort_array(F.array_distinct(F.transform(items, lambda x: F.struct(*(x[c].alias(c) for c in columns)))))


def _same(x: Column, key: Column, columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & x[c].eqNullSafe(key[c])
    return out


def _ended(items: Column, columns: tuple[str, ...], end) -> Column:
    """Of each distinct key of items, in order, the first (F.array_min) or last (F.array_max) item; items begin with seq."""
    return F.transform(_set(items, *columns), lambda key: end(F.filter(items, lambda x: _same(x, key, columns))))


def _redeemer(purpose: str, ix: Column, seq: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(F.lit(purpose).alias("purpose"), ix.cast("long").alias("ix"), F.concat(F.lit("r"), seq.cast("string")).alias("data"), zero.alias("mem"), zero.alias("steps"))


def assemble(log: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row a transaction, its children as sorted arrays; null where it has none of a kind. No fee is set.

    The log is grouped once by tx_id; all sections are made from the arrays of a row. Extra
    inputs of transactions that are not in the log are left out.
    """
    rows = log.select(*LOG.names)
    if extra is not None:
        more = extra.select("tx_id", F.lit("extra").alias("op"), "src_tx_id", "src_ix")
        rows = rows.unionByName(more, allowMissingColumns=True)

    def held(name: str, *columns: str) -> Column:
        return F.collect_list(F.when(F.col("op") == name, F.struct(*columns))).alias(f"_{name}")

    key, asset = ("src_tx_id", "src_ix"), ("policy_id", "asset_name")
    held_rows = rows.groupBy("tx_id").agg(
        held("spend", "seq", *key, "witness"), held("extra", *key), held("collateral", *key), held("reference", *key), held("pay", "seq", "address", "lovelace", "has_datum", *asset, "qty"),
        held("mint", "seq", *asset, "qty", "witness"), held("withdraw", "seq", "account", "lovelace", "witness"), held("metadata", "seq", "label", "value"), held("sign", "signer"), held("attach", "script_hash"),
        *(F.max_by("slot", F.when(F.col("op") == b, F.col("seq"))).alias(b) for b in ("valid_from", "valid_to")), F.max((F.col("op") != "extra").cast("int")).alias("_known"),
    ).where("_known = 1")
    pays = F.transform(F.sort_array("_pay"), lambda x, i: F.struct(i.cast("long").alias("ix"), *(x[c].alias(c) for c in ("address", "lovelace", "has_datum", *asset, "qty"))))
    minted = F.filter("_mint", lambda x: x["qty"] != 0)
    held_rows = held_rows.withColumns({
        "inputs": _set(F.concat(F.transform("_spend", lambda x: F.struct(*(x[c].alias(c) for c in key))), F.col("_extra")), *key), "_minted": minted,
        "_last": _ended(F.col("_withdraw"), ("account",), F.array_max), "_notes": _ended(F.col("_metadata"), ("label",), F.array_max), "_first": _ended(minted, ("policy_id",), F.array_min),
    })
    sums = F.transform(_set(F.col("_minted"), *asset), lambda k: F.struct(
        *(k[c].alias(c) for c in asset), F.aggregate(F.filter("_minted", lambda x: _same(x, k, asset)), F.lit(0).cast("long"), lambda a, x: a + x["qty"]).alias("qty")))
    scripted = F.filter("_spend", lambda x: x["witness"] == "script")
    spends = F.transform(_ended(scripted, key, F.array_max), lambda x: _redeemer("spend", F.array_position(F.col("inputs"), F.struct(*(x[c].alias(c) for c in key))) - 1, x["seq"]))

    def placed(items: str, purpose: str) -> Column:  # the first or last instruction of each key, in the keys' order
        every = F.transform(items, lambda x, i: F.struct(i.alias("ix"), x["seq"].alias("seq"), x["witness"].alias("witness")))
        return F.transform(F.filter(every, lambda x: x["witness"] == "script"), lambda x: _redeemer(purpose, x["ix"], x["seq"]))

    out = held_rows.select(
        "tx_id", _some(F.col("inputs")).alias("inputs"), _some(_set(F.col("_collateral"), *key)).alias("collateral"), _some(_set(F.col("_reference"), *key)).alias("reference_inputs"),
        _some(pays).alias("outputs"), _some(F.filter(sums, lambda x: x["qty"] != 0)).alias("mint"),
        _some(F.transform("_last", lambda x: F.struct(x["account"].alias("account"), x["lovelace"].alias("amount")))).alias("withdrawals"),
        _some(F.transform("_notes", lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))).alias("metadata"),
        _some(_set(F.col("_sign"), "signer")).alias("signers"), _some(_set(F.col("_attach"), "script_hash")).alias("scripts"),
        _some(F.sort_array(F.concat(spends, placed("_first", "mint"), placed("_last", "reward")))).alias("redeemers"), "valid_from", "valid_to",
    )
    integrity = _row_digest(F.col("redeemers"), lambda x: [x["purpose"], x["ix"], x["data"], x["mem"], x["steps"], F.lit(LANGUAGE)])
    return out.withColumns({"integrity": integrity, "aux": _row_digest(F.col("metadata"), lambda x: [x["label"], x["value"]])})


#: Of scripts, part of the integrity digest.
LANGUAGE = "v3"


def _text(values: Sequence[Column]) -> Column:
    return F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("")) for v in values))


def _joined(texts: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(texts), ";"), 256)


def _row_digest(items: Column, values: Callable[[Column], Sequence[Column]]) -> Column:
    return _joined(F.transform(items, lambda x: _text(values(x))))


def _digest(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Digest of a tx's rows, the same for any order of them; a tx without rows has none, which is null after a join."""
    return rows.groupBy("tx_id").agg(_joined(F.collect_list(_text([F.col(c) for c in columns]))).alias(name))


def integrity_digest(redeemer: DataFrame) -> DataFrame:
    """Of redeemers and language: deterministic and sensitive to content, but not the ledger's hash."""
    return _digest(redeemer.withColumn("language", F.lit(LANGUAGE)), "integrity", "purpose", "ix", "data", "mem", "steps", "language")


def aux_digest(data: DataFrame) -> DataFrame:
    return _digest(data, "aux", "label", "value")


def explode_to_log(**children: DataFrame) -> DataFrame:
    """An instruction log from child tables named by section; each has tx_id, its own seq and the columns of its op.

    Sections follow each other in their fixed order, rows of a section in the order of their own seq.
    """
    rows = None
    for number, section in enumerate(SECTIONS):
        if section not in children:
            continue
        child = children[section]
        part = child.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in child.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LOG if f.name != "op"), F.lit(section).alias("op"), F.lit(number).alias("section"))
        rows = part if rows is None else rows.unionByName(part)
    order = W.partitionBy("tx_id").orderBy("section", "seq", *(c for c in LOG.names if c not in ("tx_id", "seq", "op")))
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).select(*LOG.names)


def children_of(tx: DataFrame) -> dict[str, DataFrame]:
    """The child tables of assembled transactions, to be exploded to a log again."""
    def child(name: str, **columns: str) -> DataFrame:
        out = tx.select("tx_id", F.posexplode(name).alias("seq", "x"))
        return out.select("tx_id", F.col("seq").cast("long").alias("seq"), *(F.col(f"x.{v}").alias(k) for k, v in columns.items()))

    key = {"src_tx_id": "src_tx_id", "src_ix": "src_ix"}
    asset = {"policy_id": "policy_id", "asset_name": "asset_name", "qty": "qty"}
    bounds = {b: tx.where(F.col(b).isNotNull()).select("tx_id", F.lit(0).cast("long").alias("seq"), F.col(b).alias("slot")) for b in ("valid_from", "valid_to")}
    return {
        "spend": child("inputs", **key), "collateral": child("collateral", **key), "reference": child("reference_inputs", **key),
        "pay": child("outputs", address="address", lovelace="lovelace", has_datum="has_datum", **asset), "mint": child("mint", **asset),
        "withdraw": child("withdrawals", account="account", lovelace="amount"), "metadata": child("metadata", label="label", value="value"),
        "sign": child("signers", signer="signer"), "attach": child("scripts", script_hash="script_hash"), **bounds,
    }
