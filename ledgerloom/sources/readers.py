"""Readers of ledger files into decoded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([T.StructField(n, t) for n, t in (
    ("follower", T.LongType()), ("seq", T.LongType()), ("kind", T.StringType()), ("slot", T.LongType()), ("back_slot", T.LongType()), ("tip_slot", T.LongType()),
)])


def parse_utxo_lines(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """``hash#ix lovelace`` lines (column value) to tx_id, ix, lovelace and error; FAILFAST fails on the first bad line."""
    pattern = r"^\s*([0-9a-fA-F]{64})#(\d+)\s+(\d+)\s*$"
    part = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3)]
    whole = F.col("value").rlike(pattern)
    ix, coin = F.expr("try_cast(_ix as long)"), F.expr("try_cast(_coin as long)")
    out = lines.where(F.trim("value") != "").withColumns({"_id": F.when(whole, F.lower(part[0])), "_ix": F.when(whole, part[1]), "_coin": F.when(whole, part[2])})
    out = out.select(F.col("_id").alias("tx_id"), ix.alias("ix"), coin.alias("lovelace"), "value")
    bad = F.col("tx_id").isNull() | F.col("ix").isNull() | F.col("lovelace").isNull()
    if mode == "FAILFAST":
        return out.select("tx_id", "ix", F.when(bad, F.raise_error(F.concat(F.lit("bad UTxO line: "), "value")).cast("long")).otherwise(F.col("lovelace")).alias("lovelace"))
    return out.select("tx_id", "ix", "lovelace", F.when(bad, F.col("value")).alias("error"))


def read_utxo_lines(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return parse_utxo_lines(spark.read.text(path), mode)


def parse_tx_hex(files: DataFrame) -> DataFrame:
    """Hex texts (columns file, value; white space counts for nothing) to tx_id from the file's name, data, size and error where the text is no hex."""
    data = F.try_to_binary(F.regexp_replace("value", r"\s", ""), F.lit("hex"))
    out = files.select(F.regexp_extract("file", r"^([0-9a-fA-F]+)", 1).alias("tx_id"), data.alias("data"))
    return out.select("tx_id", "data", F.octet_length("data").cast("long").alias("size"), F.when(F.col("data").isNull(), "NotHex").alias("error"))


def read_tx_hex(spark: SparkSession, path: str) -> DataFrame:
    """One serialised transaction a file: tx_id from the file's name, bytes, size; error where the text is no hex."""
    return parse_tx_hex(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")))


# The fields of the genesis files that hold protocol parameters.
SHELLEY = "protocolParams struct<minFeeA:long,minFeeB:long,maxTxSize:long>, slotLength double, epochLength long, securityParam long"
ALONZO = "lovelacePerUTxOWord long, collateralPercentage long, executionPrices struct<prMem:struct<numerator:long,denominator:long>,prSteps:struct<numerator:long,denominator:long>>"
CONWAY = "minFeeRefScriptCostPerByte long"


def parse_params(texts: DataFrame) -> DataFrame:
    """Adds protocol parameters to genesis texts (columns shelley, alonzo, conway); what a text lacks is null."""
    read = {n: F.from_json(n, schema) for n, schema in (("shelley", SHELLEY), ("alonzo", ALONZO), ("conway", CONWAY))}
    kept = [c for c in texts.columns if c not in read]
    return texts.select(*kept, *(x.alias(n) for n, x in read.items())).select(
        *kept, F.col("shelley.protocolParams.minFeeA").alias("fee_per_byte"), F.col("shelley.protocolParams.minFeeB").alias("fee_fixed"),
        F.col("shelley.protocolParams.maxTxSize").alias("max_tx_size"), F.round(F.col("shelley.slotLength") * 1000).cast("long").alias("slot_len_ms"),
        F.col("shelley.epochLength").alias("epoch_length"), F.col("shelley.securityParam").alias("security_param"), F.col("alonzo.collateralPercentage").alias("collateral_percent"),
        F.expr("alonzo.lovelacePerUTxOWord div 8").alias("coins_per_byte"), F.col("conway.minFeeRefScriptCostPerByte").alias("ref_script_per_byte"),
    )


def read_params(spark: SparkSession, directory: str) -> DataFrame:
    """One row of protocol parameters from the genesis files of a directory."""
    one = None
    for name in ("shelley", "alonzo", "conway"):
        text = spark.read.text(f"{directory}/{name}-genesis.json", wholetext=True).select(F.lit(1).alias("one"), F.col("value").alias(name))
        one = text if one is None else one.join(F.broadcast(text), "one", "left")  # one row each
    return parse_params(one.drop("one"))


def parse_genesis_funds(texts: DataFrame) -> DataFrame:
    """Seed outputs of genesis texts (column value): its other columns, address and lovelace of each of its initial funds."""
    kept = [c for c in texts.columns if c != "value"]
    funds = F.from_json(F.get_json_object("value", "$.initialFunds"), "map<string,bigint>")
    return texts.select(*kept, F.explode(funds).alias("address", "lovelace"))


def genesis_utxos(spark: SparkSession, path: str) -> DataFrame:
    """Seed outputs from a genesis file's initial funds: address, lovelace."""
    return parse_genesis_funds(spark.read.text(path, wholetext=True))


def read_chain_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Chain events from Parquet, as a table or as a stream of new files."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENTS).parquet(path)
