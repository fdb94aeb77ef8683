"""What a user hangs onto a follower: a callback for each batch, and a trace of the stream's progress as a table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.pinned import exists, removed

LEDGER = "epoch long"
TRACE = "query string, epoch long, rows_in long, trigger_ms long, start string, end string"


def on_batches(rows: DataFrame, call: Callable[[DataFrame, int], DataFrame | None], path: str, checkpoint: str):
    """Starts a stream that hands each batch and its epoch to call, and keeps what call returns at path.

    A ledger at path lists the epochs that are done, and an epoch in it is not handed over again,
    so repeating one, as a stream does that was stopped between a batch and its checkpoint, changes
    nothing: its rows are written before it is entered, over what an attempt that ended early left.
    call may run again for an epoch that isn't in the ledger.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark, place = batch.sparkSession, f"{path}/ledger/{epoch}"
        if exists(spark, f"{place}/_SUCCESS"):
            batch.write.format("noop").mode("overwrite").save()  # states of the stream go on all the same
            return
        out = call(batch, epoch)
        if out is not None:
            out.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        elif exists(spark, f"{path}/rows/epoch={epoch}"):
            removed(spark, f"{path}/rows/epoch={epoch}")
        spark.createDataFrame([(epoch,)], LEDGER).coalesce(1).write.mode("overwrite").parquet(place)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What callbacks returned in epochs that are done, with the epoch; none before the first one."""
    if not exists(spark, f"{path}/ledger") or not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"{schema}, epoch long")
    done = spark.read.schema(LEDGER).parquet(f"{path}/ledger/*")
    rows = spark.read.schema(f"{schema}, epoch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(done, "epoch", "left_semi").select(*(c for c in rows.columns if c != "epoch"), "epoch")


class Tracer(StreamingQueryListener):
    """Progress of streams, a line each batch; add it to spark.streams and read it with table()."""

    def __init__(self):
        self.lines: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        for source in p["sources"] or [{}]:
            start, end = (json.dumps(source.get(k)) for k in ("startOffset", "endOffset"))
            self.lines.append((p["name"], p["batchId"], source.get("numInputRows", 0), p["durationMs"].get("triggerExecution"), start, end))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.lines, TRACE)
