"""Seals: a SHA-256 hash chain over runs, and its verification.

A run's hash is that of the text of: previous hash, hash of the document, hash of the matrix (of nothing
if there is none), canonical replay object. Sealing is a fold, in order; verification is parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64
ALGORITHM = "sha256"


def digest(previous: Column, sha_outer: Column, sha_deep: Column, replay: Column) -> Column:
    return F.sha2(F.concat(previous, sha_outer, F.coalesce(sha_deep, F.sha2(F.lit(""), 256)), replay), 256)


def sealed(runs: DataFrame, order: str = "run_id", genesis: str = GENESIS) -> DataFrame:
    """(pos, run_id, hash, prev_hash, sha_outer, sha_deep): the runs linked one to another in ``order``.

    ``runs`` has run_id, sha_outer, sha_deep and the canonical ``replay``. The chain is serial by its
    nature: the short rows of one batch of new runs are sorted in one task, which spills, and the fold goes
    over them with nothing but the last hash in hand.
    """
    kind = T.StructType([T.StructField("pos", T.LongType()), T.StructField("run_id", runs.schema["run_id"].dataType), *[T.StructField(c, T.StringType()) for c in ("hash", "prev_hash", "sha_outer", "sha_deep")]])
    rows = runs.select(F.col(order).alias("o"), "run_id", "sha_outer", F.coalesce("sha_deep", F.sha2(F.lit(""), 256)).alias("sha_deep"), "replay")
    line = rows.repartition(1).sortWithinPartitions("o", "run_id", "sha_outer").select("run_id", "sha_outer", "sha_deep", "replay")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, last = 0, genesis
        for batch in batches:
            hashes, before = [], []
            for outer, deep, replay in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                before.append(last)
                # A row without its parts has no hash; the chain goes on from the last one there is.
                whole = None if None in (outer, replay) else hashlib.sha256(f"{last}{outer}{deep}{replay}".encode()).hexdigest()
                last = whole or last
                hashes.append(whole)
            where = pa.array(range(pos, pos + len(hashes)), pa.int64())
            pos += len(hashes)
            yield pa.RecordBatch.from_arrays([where, batch.column(0), pa.array(hashes, pa.string()), pa.array(before, pa.string()), batch.column(1), batch.column(2)], names=kind.names)

    return line.mapInArrow(fold, kind)


def breaks(chain: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """Chain rows with ``broken_before``: whether a bad line or a wrong link stands at or before the row.

    Each row is joined to the one before it; the first broken place is one number, compared with all.
    """
    before = chain.select((F.col("pos") + 1).alias("pos"), F.col("hash").alias("_before"))
    wrong = F.coalesce(F.col("bad"), F.lit(False)) | ~F.col("prev_hash").eqNullSafe(F.when(F.col("pos") == F.col("_low"), genesis).otherwise(F.col("_before")))
    low = chain.agg(F.min("pos").alias("_low"))
    first = chain.crossJoin(F.broadcast(low)).join(before, "pos", "left").filter(wrong).agg(F.min("pos").alias("_first"))  # one row each
    return chain.crossJoin(F.broadcast(first)).withColumn("broken_before", F.coalesce(F.col("pos") >= F.col("_first"), F.lit(False))).drop("_first")


def verified(current: DataFrame, seals: DataFrame, chain: DataFrame | None, genesis: str = GENESIS) -> DataFrame:
    """(run_id, ok) for every run of ``current``.

    ``current`` has run_id, sha_outer, sha_deep and canonical replay as they are now; ``seals`` what was
    sealed. A run is good if both hashes agree, its hash can be made again, and the first chain row of
    the run has that hash with no break up to it. Without a chain, it has to start from ``genesis``.
    """
    s = seals.select("run_id", F.col("hash").alias("_hash"), F.col("prev_hash").alias("_prev"), F.col("sha_outer").alias("_outer"), F.col("sha_deep").alias("_deep"))
    held = current.join(s, "run_id", "left")
    deep = F.coalesce("sha_deep", F.sha2(F.lit(""), 256))
    same = (F.col("sha_outer") == F.col("_outer")) & (deep == F.col("_deep"))
    same = same & (digest(F.col("_prev"), F.col("sha_outer"), F.col("sha_deep"), F.col("replay")) == F.col("_hash"))
    if chain is None:
        return held.select("run_id", F.coalesce(same & (F.col("_prev") == genesis), F.lit(False)).alias("ok"))
    first = breaks(chain, genesis).filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.min_by(F.struct("hash", "broken_before"), "pos").alias("c"))
    held = held.join(first, "run_id", "left")
    return held.select("run_id", F.coalesce(same & (F.col("c.hash") == F.col("_hash")) & ~F.col("c.broken_before"), F.lit(False)).alias("ok"))


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def replay_mode(recorded: Column, now: Column) -> Column:
    """How far a replay can be trusted; both are structs of checkpoint_sha256, versions, gpu, deterministic, temp, seed."""
    same_model = recorded["checkpoint_sha256"] == now["checkpoint_sha256"]
    unseeded = (recorded["temp"] > 0) & recorded["seed"].isNull()
    same_world = (recorded["versions"] == now["versions"]) & (recorded["gpu"] == now["gpu"]) & recorded["deterministic"]
    return F.when(~F.coalesce(same_model, F.lit(False)) | F.coalesce(unseeded, F.lit(False)), "warn").when(F.coalesce(same_world, F.lit(False)), "deterministic").otherwise("reproducible")
