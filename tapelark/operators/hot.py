"""The hot table: statistics of every run and address, for skipping and for overviews."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelark.functions import cells

PREFIX = 200


def build(series: DataFrame) -> DataFrame:
    """(run_id, address, kind, layer, idx, n, min, max, mean, p95, firing_rate, win10, n_win10): one row per series, no shuffle."""
    held = series.withColumn("_f", cells.finite_of(F.col("series")))
    f = F.col("_f")
    return held.select(
        "run_id", "address", "kind", "layer", "idx", F.size(f).cast("long").alias("n"),
        F.array_min(f).alias("min"), F.array_max(f).alias("max"), cells.array_mean(f).alias("mean"),
        cells.array_quantile(f, 0.95).alias("p95"), cells.array_firing(f).alias("firing_rate"),
        cells.chunk_maxima(F.col("series")).alias("win10"), F.ceil(F.size("series") / cells.CHUNK).cast("long").alias("n_win10"),
    )


def entries(runs: DataFrame) -> DataFrame:
    """Run-level columns of the index, with the first characters of the prompt."""
    return runs.select("run_id", "model_id", "checkpoint_sha256", F.col("watchlist_ref.watchlist_id").alias("watchlist_id"), "tags", "flags", F.substring("prompt.text", 1, PREFIX).alias("prompt_prefix"))


def refreshed(hot: DataFrame, series: DataFrame) -> DataFrame:
    """The index with the series it lacks; existing rows stay as they are."""
    return hot.unionByName(build(series.join(hot.select("run_id", "address"), ["run_id", "address"], "left_anti")))


def latest(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """Of the lines of a shard log (with ``file`` and ``line``), the last one of each run."""
    order = Window.partitionBy(key).orderBy(F.col("file").desc(), F.col("line").desc())
    return lines.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "file", "line")


def exact(rows: DataFrame, check: Callable[[dict], bool]) -> DataFrame:
    """Rows that a check of the caller's keeps; a row on which it raises is no match."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def good(row: dict) -> bool:
            try:
                return bool(check(row))
            except Exception:
                return False

        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array([good(dict(zip(names, r.values(), strict=True))) for r in batch.to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def scan(hot: DataFrame, predicate) -> DataFrame:
    """Rows that any predicate column keeps, in order of run."""
    return hot.filter(predicate).orderBy("run_id")
