"""Which token rows are kept: window, trigger, capacity, errors. Frames have (run_id, token_pos, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelark.config import Trigger
from tapelark.config import Window as TokenWindow


def in_window(pos: Column, window: TokenWindow) -> Column:
    """start <= pos < end and every n-th from start."""
    return (pos >= window.start) & (pos < window.end) & (F.pmod(pos - window.start, F.lit(window.every_n)) == 0)


def triggered(trigger: Trigger, pos: str = "token_pos", elapsed: str = "elapsed", flags: str = "flags", address: str = "address", value: str = "value") -> Column:
    """Whether a token row arms the trigger; unknown time, flag or cell does not."""
    if trigger.kind == "always":
        return F.lit(True)
    if trigger.kind == "on_flag":
        found = F.try_element_at(F.col(flags), F.lit(trigger.flag))
    elif trigger.kind == "time_window":
        found = F.col(elapsed).between(trigger.low, trigger.high)
    elif trigger.kind == "token_range":
        found = F.col(pos).between(trigger.low, trigger.high)
    else:
        found = (F.col(address) == trigger.address) & F.col(value).between(trigger.low, trigger.high) & ~F.isnan(F.col(value).cast("double"))
    return F.coalesce(found, F.lit(False))


def armed(cells: DataFrame, window: TokenWindow, trigger: Trigger) -> DataFrame:
    """Cells of the token rows that window and trigger keep.

    An address gate looks at one cell of a row and keeps the whole row, by a semi-join on run and token.
    """
    held = cells.filter(in_window(F.col("token_pos"), window))
    if trigger.kind != "address_gate":
        return held.filter(triggered(trigger))
    rows = held.filter(triggered(trigger)).select("run_id", "token_pos").distinct()
    return held.join(rows, ["run_id", "token_pos"], "left_semi")


def bounded(rows: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The first ``capacity`` token rows of each run, and (run_id, ring_overflow) of all runs."""
    order = Window.partitionBy("run_id").orderBy("token_pos")
    ranked = rows.withColumn("_k", F.row_number().over(order))
    flags = rows.groupBy("run_id").agg((F.count(F.lit(1)) > capacity).alias("ring_overflow"))
    return ranked.filter(F.col("_k") <= capacity).drop("_k"), flags


def until_error(rows: DataFrame, failed: str = "failed") -> DataFrame:
    """Rows of each run before its first failed one, with ``hook_detached`` on runs that have one."""
    first = rows.filter(F.col(failed)).groupBy("run_id").agg(F.min("token_pos").alias("_bad"))
    joined = rows.join(first, "run_id", "left")
    return joined.filter(F.col("_bad").isNull() | (F.col("token_pos") < F.col("_bad"))).withColumn("hook_detached", F.col("_bad").isNotNull()).drop("_bad")


def presence(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """(run_id, triggered, n_tokens): runs that never armed have no data and say so."""
    counts = kept.groupBy("run_id").agg(F.countDistinct("token_pos").alias("n_tokens"))
    out = runs.select("run_id").join(counts, "run_id", "left")
    return out.select("run_id", F.col("n_tokens").isNotNull().alias("triggered"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def dequantised(value: Column, scale: Column) -> Column:
    """An 8-bit value times its scale."""
    return value.cast("float") * scale


def gathered(vector: Column, wanted: Column) -> Column:
    """Watched places (from 0) of an activation vector."""
    return F.transform(wanted, lambda i: F.try_element_at(vector, i.cast("int") + 1))
