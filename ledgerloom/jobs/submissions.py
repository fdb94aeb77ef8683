"""Routing of submitted transactions: every one is reported, rejected ones with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def route_submissions(tx: DataFrame, failures: DataFrame) -> DataFrame:
    """Adds outcome (Submitted or Rejected) and reason. failures: tx_id, reason; of several the first in text order."""
    first = failures.groupBy("tx_id").agg(F.min(F.coalesce("reason", F.lit("unknown"))).alias("reason"))
    return tx.join(first, "tx_id", "left").withColumn("outcome", F.when(F.col("reason").isNull(), "Submitted").otherwise("Rejected"))


def write_submissions(routed: DataFrame, path: str) -> None:
    routed.write.mode("errorifexists").partitionBy("outcome").parquet(path)


def outcome_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))
