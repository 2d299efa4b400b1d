"""Any table as runs and series: the views that the registered queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_rows(df: DataFrame, run_id: str, prompt: Column | None = None, tags: Column | None = None, bad: Column | None = None, checkpoint: Column | None = None, model: Column | None = None) -> DataFrame:
    """Rows of runs with the columns that search, frames and reports read."""
    text = F.lit(None).cast("string") if prompt is None else prompt
    none = F.array().cast("array<string>")
    return df.select(
        F.col(run_id).alias("run_id"), (F.lit("M-001") if model is None else model).alias("model_id"),
        (F.lit("sha256:0") if checkpoint is None else checkpoint).alias("checkpoint_sha256"),
        F.struct(text.alias("text")).alias("prompt"), F.struct(F.array().cast("array<int>").alias("tokens")).alias("output"),
        F.filter(none if tags is None else tags, lambda t: t.isNotNull()).alias("tags"),
        F.create_map(F.lit("bad_output"), F.coalesce(F.lit(False) if bad is None else bad, F.lit(False))).alias("flags"),
    )


def cells_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse cells: a user's events in order of time, each a token with one cell, its type's."""
    by_user = Window.partitionBy("user_id")
    order = by_user.orderBy("ts", "event_id")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), (F.row_number().over(order) - 1).alias("token_pos"), F.col("event_type").alias("address"), "value", ts.alias("ts"), "event_id",
        ((F.unix_micros(ts) - F.min(F.unix_micros(ts)).over(by_user)) / F.lit(1e6)).alias("elapsed"),
        F.create_map(F.lit("bad_output"), F.col("event_type") == "error").alias("flags"),
    )


def runs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("bad"))
    side = F.when(F.col("user_id") % 2 == 0, "cohort=good").otherwise("cohort=bad")
    return run_rows(users, "user_id", tags=F.array(side), bad=F.col("bad"))


def series_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per user and type that the user has; tokens of other types are NaN."""
    cells = cells_events(spark, sf_dir)
    row = F.array_sort(F.collect_list(F.struct("token_pos", "address", "value"))).alias("c")
    runs = cells.groupBy("run_id").agg(row)
    each = runs.select("run_id", "c", F.explode(F.array_distinct(F.col("c.address"))).alias("address"))
    values = F.transform("c", lambda x: F.when(x["address"] == F.col("address"), x["value"]).otherwise(F.lit(float("nan"))))
    return each.select("run_id", "address", F.col("address").alias("kind"), F.lit(None).cast("int").alias("layer"), F.lit(None).cast("int").alias("idx"), values.alias("series"))


def long_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cells: a label's vectors in order, each a token with a cell per dimension."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run_id"), (F.row_number().over(order) - 1).alias("token_pos"), "embedding")
    each = rows.select("run_id", "token_pos", F.posexplode("embedding").alias("k", "value"))
    return each.select("run_id", "token_pos", F.format_string("N-01-%04d", F.col("k") + 1).alias("address"), (F.col("k") + 1).alias("idx"), "value")


def series_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("token_pos", "value")))
    held = long_embeddings(spark, sf_dir).groupBy("run_id", "address", "idx").agg(pairs.alias("p"))
    return held.select("run_id", "address", F.lit("N").alias("kind"), F.lit(1).alias("layer"), "idx", F.col("p.value").alias("series"))


def series_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as tokens, their quantities as the values of one cell."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("float").alias("q")))).alias("c"))
    return lines.select("run_id", F.lit("N-01-0001").alias("address"), F.lit("N").alias("kind"), F.lit(1).alias("layer"), F.lit(1).alias("idx"), F.col("c.q").alias("series"))


def runs_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return run_rows(labels, "label", prompt=F.concat(F.lit("label "), F.col("label").cast("string")), tags=F.array(F.when(F.col("label") % 2 == 0, "cohort=good").otherwise("cohort=bad")))


def runs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tags = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"), F.concat(F.lit("quality="), F.col("quality").cast("string")))
    return run_rows(docs, "doc_id", prompt=F.col("text"), tags=tags, bad=F.col("toxic") == 1)


def runs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return run_rows(
        orders, "o_orderkey", prompt=F.col("o_orderpriority"), tags=F.array(F.concat(F.lit("priority="), "o_orderpriority")),
        checkpoint=F.concat(F.lit("sha256:"), "o_orderstatus"), model=F.col("o_orderpriority"),
    )


def sized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, four cells a line: 4 bytes each of matrix, and a document as long as its price in text."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg((F.count(F.lit(1)) * 16).alias("cold_bytes"))
    runs = runs_orders(spark, sf_dir).select("run_id", "model_id", "checkpoint_sha256", F.length("prompt.text").cast("long").alias("hot_bytes"))
    return runs.join(lines, "run_id", "left").withColumn("cold_bytes", F.coalesce("cold_bytes", F.lit(0)))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write-ahead log: a user's events by hour since the first, so that tokens come twice, late and with gaps."""
    cells = cells_events(spark, sf_dir)
    return cells.select("run_id", F.floor(F.col("elapsed") / 3600).cast("int").alias("token"), F.array("value").alias("values"), F.col("event_id").alias("seq"))


def documents_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sealed documents: the first user turn's text hashed as document, the last turn's as matrix."""
    turns = table(spark, sf_dir, "conversations")
    held = turns.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first"), F.max_by("text", "turn").alias("last"), F.count(F.lit(1)).alias("n")
    )
    replay = F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit("}"))
    return held.select(F.col("conv_id").alias("run_id"), F.sha2(F.coalesce("first", F.lit("")), 256).alias("sha_outer"), F.sha2(F.coalesce("last", F.lit("")), 256).alias("sha_deep"), replay.alias("replay"))
