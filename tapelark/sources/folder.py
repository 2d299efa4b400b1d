"""Folders of recorded runs as tables: ``runs/RUN-nnnnnn/`` with outer.json, deep_index.json, deep.bin and
seal.json; ``chain.jsonl``; ``index/shard-*.jsonl``; ``wal/*.jsonl``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelark import schema
from tapelark.functions import addresses
from tapelark.functions.formats import canonical_json, decode_matrix
from tapelark.sources.deepbin import read_series

RUN_ID = r"^RUN-\d{6}$"
#: Where stores lie if nobody says: argument, then this variable, then a folder here.
ROOT_VARIABLE, ROOT_DEFAULT = "TAPELARK_STORE", "./tapelark_store"


def root(path: str | None = None) -> str:
    return (path or os.environ.get(ROOT_VARIABLE) or ROOT_DEFAULT).rstrip("/")


def _run_id():
    return F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)


def _exists(spark: SparkSession, pattern: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _json(spark: SparkSession, pattern: str, kind: T.StructType) -> DataFrame:
    """One document per file with its run id; files that are not JSON are left out."""
    if not _exists(spark, pattern):
        return spark.createDataFrame([], kind.add("_run", "string").add("raw", "string"))
    text = spark.read.text(pattern, wholetext=True).select(F.col("value").alias("raw"), _run_id().alias("_run"))
    parsed = text.withColumn("d", F.from_json("raw", kind, {"mode": "PERMISSIVE"})).filter(F.try_parse_json("raw").isNotNull())
    return parsed.select("d.*", "_run", "raw")


def outer(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a folder, by folder name. ``replay`` and the watch list's ``patch`` keep their spelling."""
    held = _json(spark, f"{path}/runs/*/outer.json", T.StructType(list(schema.RUN.fields)))
    held = held.filter(F.col("_run").rlike(RUN_ID)).withColumn("run_id", F.col("_run"))
    return held.select(*schema.RUN.names)


def one_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return outer(spark, path).filter(F.col("run_id") == run_id)


def deep_index(spark: SparkSession, path: str) -> DataFrame:
    held = _json(spark, f"{path}/runs/*/deep_index.json", T.StructType(list(schema.DEEP_INDEX.fields)))
    return held.withColumn("run_id", F.col("_run")).select(*schema.DEEP_INDEX.names)


def series(spark: SparkSession, path: str, tokens: tuple[int, int] | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Series of the folder's matrices; ``tokens`` and ``wanted`` addresses are cut out while decoding."""
    if not _exists(spark, f"{path}/runs/*/deep.bin"):
        return spark.createDataFrame([], schema.SERIES)
    raw = spark.read.format("binaryFile").load(f"{path}/runs/*/deep.bin").select(_run_id().alias("run_id"), "content")
    index = deep_index(spark, path).filter("triggered").select("run_id", "dtype", "watched", F.try_element_at("dtype_meta", F.lit("source")).alias("source"))
    out = read_series(raw.join(index, "run_id"), decode_matrix, tokens, wanted)
    a = F.col("address")
    return out.select("run_id", "address", addresses.kind_of(a).alias("kind"), addresses.layer_of(a).alias("layer"), addresses.idx_of(a).alias("idx"), "series")


def hot_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the shard log with ``file`` and ``line``; broken lines are left out."""
    if not _exists(spark, f"{path}/index/shard-*.jsonl"):
        return spark.createDataFrame([], T.StructType([*schema.HOT_LINE.fields, T.StructField("file", T.StringType()), T.StructField("line", T.LongType())]))
    text = spark.read.text(f"{path}/index/shard-*.jsonl", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "t"))
    parsed = text.filter(F.try_parse_json("t").isNotNull()).withColumn("d", F.from_json("t", schema.HOT_LINE))
    return parsed.select("d.*", "file", F.col("line").cast("long").alias("line"))


def chain(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the chain in order of lines; a line that is not JSON is a ``bad`` row. None if there is no chain."""
    if not _exists(spark, f"{path}/chain.jsonl"):
        return None
    filled = F.filter(F.split("value", "\n"), lambda t: F.trim(t) != "")
    lines = spark.read.text(f"{path}/chain.jsonl", wholetext=True).select(F.posexplode(filled).alias("pos", "t"))
    parsed = lines.withColumn("d", F.from_json("t", "run_id string, hash string, prev_hash string"))
    return parsed.select(F.col("pos").cast("long").alias("pos"), "d.*", F.try_parse_json("t").isNull().alias("bad"))


def seals(spark: SparkSession, path: str) -> DataFrame:
    held = _json(spark, f"{path}/runs/*/seal.json", T.StructType(list(schema.SEAL.fields)))
    return held.withColumn("run_id", F.col("_run")).select(*schema.SEAL.names)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, sha_outer, sha_deep, replay, hot_bytes, cold_bytes) of the files as they are now."""
    files = spark.read.format("binaryFile")
    outers = files.load(f"{path}/runs/*/outer.json").select(_run_id().alias("run_id"), F.sha2("content", 256).alias("sha_outer"), F.col("length").alias("hot_bytes"))
    docs = outer(spark, path).select("run_id", canonical_json("replay").alias("replay"))
    held = outers.filter(F.col("run_id").rlike(RUN_ID)).join(docs, "run_id", "left")
    if _exists(spark, f"{path}/runs/*/deep.bin"):
        deeps = spark.read.format("binaryFile").load(f"{path}/runs/*/deep.bin").select(_run_id().alias("run_id"), F.sha2("content", 256).alias("sha_deep"), F.col("length").alias("cold_bytes"))
        held = held.join(deeps, "run_id", "left")
    else:
        held = held.withColumn("sha_deep", F.lit(None).cast("string")).withColumn("cold_bytes", F.lit(None).cast("long"))
    return held.select("run_id", "sha_outer", "sha_deep", "replay", "hot_bytes", F.coalesce("cold_bytes", F.lit(0)).alias("cold_bytes"))


def wal(spark: SparkSession, pattern: str) -> DataFrame:
    """Token rows of write-ahead logs, one log per run, in the order they were written; a torn last line is left out."""
    lines = spark.read.text(pattern, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^/.]*)*$", 1).alias("run_id"), F.posexplode(F.split("value", "\n")).alias("seq", "t")
    )
    parsed = lines.withColumn("d", F.from_json("t", "token int, values array<double>")).filter(F.col("d.token").isNotNull() & F.col("d.values").isNotNull())
    return parsed.select("run_id", "d.token", "d.values", F.col("seq").cast("long").alias("seq"))


def hot(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, address, kind, layer, idx, n, ..., n_win10): shard entries, the last of a run, and runs that have none."""
    from tapelark.operators.hot import build, latest

    own = latest(hot_lines(spark, path)).select("run_id", F.explode("addresses").alias("address", "s"))
    a = F.col("address")
    kept = own.select("run_id", "address", addresses.kind_of(a).alias("kind"), addresses.layer_of(a).alias("layer"), addresses.idx_of(a).alias("idx"), "s.*")
    rest = build(series(spark, path).join(latest(hot_lines(spark, path)).select("run_id"), "run_id", "left_anti"))
    return kept.unionByName(rest.select(kept.columns))


def verified(spark: SparkSession, path: str) -> DataFrame:
    from tapelark.operators.seal import verified as check

    return check(fingerprints(spark, path), seals(spark, path), chain(spark, path))
