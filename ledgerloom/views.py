"""Ledger-shaped tables over the generic test tables, once in Spark and once in SQL.

They are synthetic stand-ins: order lines are outputs, the next order consumes some of them,
events are chain events. All results are integers or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Start and end of an era in ms, and its slot length in ms.
ERAS = ((788_918_400_000, 852_076_800_000, 20_000), (852_076_800_000, 946_684_800_000, 1_000), (946_684_800_000, 1_041_379_200_000, 100))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines with their place in the order; views that get them as lines do not put them in order again."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ix = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1
    return table(spark, sf_dir, "lineitem").withColumn("ix", ix.cast("long")).drop("l_linenumber", "l_shipdate")


def _lines(spark: SparkSession, sf_dir: str, lines: DataFrame | None) -> DataFrame:
    return order_lines(spark, sf_dir) if lines is None else lines


def tx_output(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, sized: bool = True) -> DataFrame:
    """Without sizes there are no script_bytes, and parts are joined only if a key of theirs repeats, as it repeats outputs."""
    rows, part = _lines(spark, sf_dir, lines), table(spark, sf_dir, "part")
    if sized or not part.where("p_partkey is not null").groupBy("p_partkey").count().where("count > 1").isEmpty():
        sizes = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("script_bytes"))
        rows = rows.join(sizes, "l_partkey", "left")
    return rows.select(
        F.col("l_orderkey").alias("tx_id"), "ix", F.col("l_suppkey").alias("address"), cents(F.col("l_extendedprice")).alias("lovelace"),
        (F.col("l_partkey") % 25).alias("policy_id"), F.col("l_partkey").alias("asset_name"), F.col("l_quantity").cast("long").alias("qty"),
        (F.col("l_linestatus") == "O").alias("has_datum"), *(["script_bytes"] if sized else []),
    )


def tx_input(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    closed, returned = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    kind = F.when(closed & ~returned, "spend").when(closed, "reference").when(returned, "collateral")
    return _lines(spark, sf_dir, lines).select(
        (F.col("l_orderkey") + 1).alias("tx_id"), F.col("ix").alias("seq"), kind.alias("kind"),
        F.when(F.col("l_returnflag") == "A", "script").otherwise("key").alias("witness"), F.col("l_orderkey").alias("src_tx_id"), F.col("ix").alias("src_ix"),
    ).where("kind is not null")


def tx(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    spent = tx_input(spark, sf_dir, lines).where("kind = 'spend'").groupBy("tx_id").agg(F.count(F.lit(1)).alias("ins"))
    made = (tx_output(spark, sf_dir, lines) if outputs is None else outputs).groupBy("tx_id").agg(F.count(F.lit(1)).alias("outs"))
    size = 200 + 40 * F.coalesce("ins", F.lit(0)) + 65 * F.coalesce("outs", F.lit(0))
    ms = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(o_orderdate as timestamp_ntz))") * 1000
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("owner"), ms.alias("posix_ms"))
    return orders.join(spent, "tx_id", "left").join(made, "tx_id", "left").select("tx_id", "owner", "posix_ms", size.alias("base_size"))


def tx_mint(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    qty = F.col("l_quantity").cast("long")
    return _lines(spark, sf_dir, lines).where(cents(F.col("l_tax")) == 8).select(
        F.col("l_orderkey").alias("tx_id"), F.col("ix").alias("seq"), (F.col("l_partkey") % 25).alias("policy_id"), F.col("l_partkey").alias("asset_name"),
        F.when(cents(F.col("l_discount")) > 5, -qty).otherwise(qty).alias("qty"),
    )


def tx_withdrawal(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return _lines(spark, sf_dir, lines).where("l_linestatus = 'O' and l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("tx_id"), F.col("ix").alias("seq"), F.col("l_suppkey").alias("account"), cents(F.col("l_extendedprice")).alias("amount")
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    slot = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))").cast("long")
    return table(spark, sf_dir, "events").withColumns({"k": k, "slot": slot})


def tx_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").alias("tx_id"), F.col("event_id").alias("seq"), (F.col("k") % 10).alias("label"), F.col("event_type").alias("value"))


def eval_result(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Of script spends, minted policies and withdrawing accounts; ix is the place among the tx's sorted ones of the kind."""
    closed = _lines(spark, sf_dir, lines).where("l_linestatus = 'F' and l_returnflag <> 'R'")
    place = (F.row_number().over(W.partitionBy("l_orderkey").orderBy("ix")) - 1).cast("long")
    qty = F.col("l_quantity").cast("long")
    spends = closed.withColumn("place", place).where("l_returnflag = 'A'").select(
        (F.col("l_orderkey") + 1).alias("tx_id"), F.lit("spend").alias("purpose"), F.col("place").alias("ix"),
        (cents(F.col("l_discount")) != 10).alias("ok"), (qty * 1000).alias("mem"), (qty * 100_000).alias("steps"),
    )

    def others(df: DataFrame, key: str, purpose: str, bad: int) -> DataFrame:
        rows = df.select("tx_id", key).distinct().withColumn("ix", (F.row_number().over(W.partitionBy("tx_id").orderBy(key)) - 1).cast("long"))
        return rows.select("tx_id", F.lit(purpose).alias("purpose"), "ix", (F.col(key) % 4 != bad).alias("ok"), (1000 * (F.col(key) + 1)).alias("mem"), (100_000 * (F.col(key) + 1)).alias("steps"))

    return spends.unionByName(others(tx_mint(spark, sf_dir, lines), "policy_id", "mint", 1)).unionByName(others(tx_withdrawal(spark, sf_dir, lines), "account", "reward", 2))


def chain_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, slot, back_slot (of roll-backs only) and tip_slot, which is null at the start of a chain."""
    back = F.col("event_type") == "error"
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("follower"), F.col("event_id").alias("seq"), F.when(back, "back").otherwise("forward").alias("kind"), "slot",
        F.when(back, F.greatest(F.lit(0), F.col("slot") - F.col("k") * 3600)).alias("back_slot"),
        F.when(F.col("k") % 7 != 0, F.col("slot") + F.when(F.col("k") > 50, 0).otherwise(F.col("k"))).alias("tip_slot"),
    )


def era_history(spark: SparkSession) -> DataFrame:
    rows, slot = [], 0
    for start, end, length in ERAS:
        rows.append((start, slot, length, end))
        slot += (end - start) // length
    return spark.createDataFrame(rows, "era_start_ms long, slot_start long, slot_len_ms long, era_end_ms long")


def tx_signer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.lit(0).cast("long").alias("seq"), F.col("o_custkey").alias("signer"))


def tx_script(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The policies of script spends, as hashes of attached scripts."""
    return _lines(spark, sf_dir, lines).where("l_linestatus = 'F' and l_returnflag = 'A'").select(
        (F.col("l_orderkey") + 1).alias("tx_id"), F.col("ix").alias("seq"), (F.col("l_partkey") % 25).alias("script_hash")
    )


_SLOT = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) AS BIGINT)"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _eras_sql() -> str:
    rows, slot = [], 0
    for start, end, length in ERAS:
        rows.append(f"({start}, {slot}, {length}, {end})")
        slot += (end - start) // length
    return ", ".join(rows)


#: The same tables as common table expressions; oracles start with them.
SQL = f"""WITH RECURSIVE lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ix,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem
), tx_output AS (
  SELECT l_orderkey AS tx_id, ix, l_suppkey AS address, price AS lovelace, l_partkey % 25 AS policy_id, l_partkey AS asset_name, qty, l_linestatus = 'O' AS has_datum, CAST(p_size AS BIGINT) AS script_bytes
  FROM lines LEFT JOIN part ON p_partkey = l_partkey
), tx_input AS (
  SELECT l_orderkey + 1 AS tx_id, ix AS seq, CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 'spend' WHEN l_linestatus = 'F' THEN 'reference' WHEN l_returnflag = 'R' THEN 'collateral' END AS kind,
         CASE WHEN l_returnflag = 'A' THEN 'script' ELSE 'key' END AS witness, l_orderkey AS src_tx_id, ix AS src_ix
  FROM lines WHERE l_linestatus = 'F' OR l_returnflag = 'R'
), tx AS (
  SELECT o_orderkey AS tx_id, o_custkey AS owner, epoch_ms(o_orderdate) AS posix_ms, 200 + 40 * coalesce(ins, 0) + 65 * coalesce(outs, 0) AS base_size
  FROM orders LEFT JOIN (SELECT tx_id, count(*) AS ins FROM tx_input WHERE kind = 'spend' GROUP BY 1) i ON i.tx_id = o_orderkey
  LEFT JOIN (SELECT tx_id, count(*) AS outs FROM tx_output GROUP BY 1) o ON o.tx_id = o_orderkey
), tx_mint AS (
  SELECT l_orderkey AS tx_id, ix AS seq, l_partkey % 25 AS policy_id, l_partkey AS asset_name, CASE WHEN disc > 5 THEN -qty ELSE qty END AS qty FROM lines WHERE tax = 8
), tx_withdrawal AS (
  SELECT l_orderkey AS tx_id, ix AS seq, l_suppkey AS account, price AS amount FROM lines WHERE l_linestatus = 'O' AND l_returnflag = 'A'
), ev AS (SELECT *, {_K} AS k, {_SLOT} AS slot FROM events
), tx_metadata AS (SELECT user_id AS tx_id, event_id AS seq, k % 10 AS label, event_type AS value FROM ev
), eval_result AS (
  SELECT * EXCLUDE (flag) FROM (
    SELECT l_orderkey + 1 AS tx_id, 'spend' AS purpose, row_number() OVER (PARTITION BY l_orderkey ORDER BY ix) - 1 AS ix, disc <> 10 AS ok, qty * 1000 AS mem, qty * 100000 AS steps, l_returnflag AS flag
    FROM lines WHERE l_linestatus = 'F' AND l_returnflag <> 'R') WHERE flag = 'A'
  UNION ALL SELECT tx_id, 'mint', row_number() OVER (PARTITION BY tx_id ORDER BY policy_id) - 1, policy_id % 4 <> 1, 1000 * (policy_id + 1), 100000 * (policy_id + 1) FROM (SELECT DISTINCT tx_id, policy_id FROM tx_mint)
  UNION ALL SELECT tx_id, 'reward', row_number() OVER (PARTITION BY tx_id ORDER BY account) - 1, account % 4 <> 2, 1000 * (account + 1), 100000 * (account + 1) FROM (SELECT DISTINCT tx_id, account FROM tx_withdrawal)
), chain_event AS (
  SELECT user_id AS follower, event_id AS seq, CASE WHEN event_type = 'error' THEN 'back' ELSE 'forward' END AS kind, slot,
         CASE WHEN event_type = 'error' THEN greatest(0, slot - k * 3600) END AS back_slot, CASE WHEN k % 7 <> 0 THEN slot + CASE WHEN k > 50 THEN 0 ELSE k END END AS tip_slot
  FROM ev
), era_history AS (SELECT * FROM (VALUES {_eras_sql()}) v(era_start_ms, slot_start, slot_len_ms, era_end_ms)
), tx_signer AS (SELECT o_orderkey AS tx_id, CAST(0 AS BIGINT) AS seq, o_custkey AS signer FROM orders
), tx_script AS (SELECT l_orderkey + 1 AS tx_id, ix AS seq, l_partkey % 25 AS script_hash FROM lines WHERE l_linestatus = 'F' AND l_returnflag = 'A'
)"""
