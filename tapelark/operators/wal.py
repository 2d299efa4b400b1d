"""From token rows to series: duplicates, order, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelark.functions import addresses


def settled(rows: DataFrame) -> DataFrame:
    """One row per run and token: of duplicates the last written, by ``seq``."""
    return rows.groupBy("run_id", "token").agg(F.max_by("values", "seq").alias("values"))


def dense(rows: DataFrame) -> DataFrame:
    """(run_id, low, high, n_rows, cells): the rows lowest to highest token; a token without a row has null."""
    held = settled(rows).groupBy("run_id").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.map_from_entries(F.collect_list(F.struct("token", "values"))).alias("m"))
    cells = F.transform(F.sequence("low", "high"), lambda t: F.try_element_at("m", t))
    return held.select("run_id", "low", "high", F.size("m").alias("n_rows"), cells.alias("cells"))


def series(rows: DataFrame, watched: DataFrame) -> DataFrame:
    """Series of sealed runs: ``watched`` is (run_id, watched array) in the order of ``values``; gaps are NaN.

    A run without a watch row (its index was lost) gets made-up neuron addresses.
    """
    held = dense(rows).join(watched, "run_id", "left")
    width = F.size(F.element_at(F.filter("cells", lambda x: x.isNotNull()), F.lit(1)))
    made_up = F.transform(F.sequence(F.lit(1), width), lambda k: F.format_string("N-01-%04d", k))
    held = held.withColumn("watched", F.coalesce("watched", made_up))
    each = held.select("run_id", "cells", F.posexplode("watched").alias("k", "address"))
    value = F.transform("cells", lambda v: F.coalesce(F.try_element_at(v, F.col("k") + 1), F.lit(float("nan"))).cast("float"))
    a = F.col("address")
    return each.select("run_id", "address", addresses.kind_of(a).alias("kind"), addresses.layer_of(a).alias("layer"), addresses.idx_of(a).alias("idx"), value.alias("series"))


def open_rows(rows: DataFrame, seals: DataFrame) -> DataFrame:
    """Rows of runs that are not sealed: a second seal of a run would break its verification."""
    return rows.join(seals.select("run_id"), "run_id", "left_anti")
