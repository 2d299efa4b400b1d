"""Capture as a stream.

The source's rate limit stands for a bounded ring, the checkpoint for the fsynced log: a restart goes on
after the last whole micro-batch. Rows of sealed runs are turned away. Event times must be TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapelark.config import Trigger, Window
from tapelark.operators.gate import in_window, triggered


def rows(spark: SparkSession, path: str, kind, per_trigger: int = 16) -> DataFrame:
    """Token rows of files that arrive in a folder."""
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", per_trigger).parquet(path)


def gated(stream: DataFrame, window: Window, trigger: Trigger) -> DataFrame:
    """What window and trigger let pass; both look at the row alone."""
    return stream.filter(in_window(F.col("token_pos"), window) & triggered(trigger))


def to_log(stream: DataFrame, log: str, checkpoint: str, seals: DataFrame | None = None) -> StreamingQuery:
    """Append the stream to a Parquet log, micro-batch by micro-batch, with ``seq`` (batch, row) in order of arrival.

    A batch that is run again after a crash overwrites its own folder, so that no row is there twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        held = batch if seals is None else batch.join(seals.select("run_id"), "run_id", "left_anti")
        # Batch, then partition and row: 2^33 rows of a partition in the low bits, as Spark numbers them.
        held.withColumn("seq", F.struct(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"))).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_rows(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.option("basePath", log).parquet(f"{log}/batch=*").drop("batch")


def progress(spark: SparkSession, log: str) -> DataFrame:
    """(run_id, rows, last_token): how many rows are safe, and where a run that stopped can go on."""
    return log_rows(spark, log).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.max("token").alias("last_token"))


def finalised(stream: DataFrame, idle: str = "10 minutes", lateness: str = "5 minutes") -> DataFrame:
    """(run_id, tokens, values, n): a run's rows in token order once nothing came for ``idle``.

    ``stream`` has run_id, token, value and ``ts``. A token that comes twice keeps its last value; rows
    later than the watermark are dropped, as their run may be sealed.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            tokens, values = state.get
            state.remove()
            order = sorted(range(len(tokens)), key=tokens.__getitem__)
            yield pd.DataFrame({"run_id": [key[0]], "tokens": [[tokens[k] for k in order]], "values": [[values[k] for k in order]], "n": [len(tokens)]})
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        last = state.getCurrentWatermarkMs()
        for batch in batches:
            held.update(zip(batch.token.tolist(), batch.value.tolist(), strict=True))
            last = max(last, int(batch.ts.max().timestamp() * 1000))
        state.update((list(held), list(held.values())))
        state.setTimeoutTimestamp(last + millis)

    return stream.withWatermark("ts", lateness).groupBy("run_id").applyInPandasWithState(
        run, "run_id string, tokens array<int>, values array<double>, n long", "tokens array<int>, values array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def daily(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(day, event_type, n, total): tumbling windows of a day by event time."""
    held = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = held.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(run_id, started, ended, n): runs cut where nothing came for ``gap``."""
    held = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = held.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return out.select("run_id", F.col("w.start").alias("started"), F.col("last").alias("ended"), "n")


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what its source has now; its result is written by the executors to ``folder`` and read from there.

    In complete mode a micro-batch has the whole result and takes the place of the one before, in append mode
    each has a folder of its own; one that is run again after a crash overwrites its own.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*").drop("batch")
