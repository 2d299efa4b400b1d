"""Sizes and retention by model and by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelark.config import OVERHEAD, band_column
from tapelark.functions.formats import human_bytes
from tapelark.plans.find import has_tag


def model_key():
    return F.concat_ws("/", "model_id", F.concat(F.lit("C-"), F.substring(F.regexp_replace("checkpoint_sha256", "sha256:", ""), 1, 6)))


def by_run(runs: DataFrame) -> DataFrame:
    """``runs`` has run_id, model_id, checkpoint_sha256, hot_bytes, cold_bytes."""
    size = F.col("hot_bytes") + F.col("cold_bytes")
    return runs.select("run_id", model_key().alias("model"), "hot_bytes", "cold_bytes", band_column(size * OVERHEAD).alias("band"), human_bytes(size).alias("size"))


def by_model(runs: DataFrame) -> DataFrame:
    sums = runs.groupBy(model_key().alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.sum("hot_bytes").alias("hot_bytes"), F.sum("cold_bytes").alias("cold_bytes"))
    return sums.withColumn("band", band_column((F.col("hot_bytes") + F.col("cold_bytes")) * OVERHEAD))


def retention_state(runs: DataFrame) -> DataFrame:
    """(model, runs, gb, level): per model, and the whole store as the row whose model is null."""
    sums = runs.withColumn("model", model_key()).rollup("model").agg(F.count(F.lit(1)).alias("runs"), (F.sum(F.col("hot_bytes") + F.col("cold_bytes")) / 1e9).alias("gb"))
    return sums.withColumn("level", F.lower(band_column(F.col("gb") * 1e9)))


def retention_plan(runs: DataFrame, rules: list[dict]) -> DataFrame:
    """(run_id, keep): what a policy says of each run; nothing is ever deleted here.

    ``rules`` are a policy's, in order: the first that matches decides. ``keep_runs`` keeps the newest
    of its matches and marks the others ``over_limit``; runs that no rule matches are ``unmatched``.
    """
    rule = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules))):
        m = r["match"]
        if "flag" in m:
            hit = F.coalesce(F.try_element_at("flags", F.lit(m["flag"])), F.lit(False))
        else:
            hit = has_tag(F.col("tags"), m["tag"])
        rule = F.when(F.coalesce(hit, F.lit(False)), k).otherwise(rule)
    held = runs.withColumn("_rule", rule).withColumn("_k", F.row_number().over(Window.partitionBy("_rule").orderBy(F.col("run_id").desc())))
    keep = F.lit("unmatched")
    for k, r in enumerate(rules):
        kept = F.lit("keep") if "keep" in r else F.when(F.col("_k") <= r["keep_runs"], "keep").otherwise("over_limit")
        keep = F.when(F.col("_rule") == k, kept).otherwise(keep)
    return held.select("run_id", keep.alias("keep"))
