"""The store: Parquet tables under one root, with run numbers, sealing and export."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelark import schema
from tapelark.errors import AlreadyThere, NotFound
from tapelark.functions.formats import canonical_json, json_lines
from tapelark.operators import hot as hot_ops
from tapelark.operators import seal as seal_ops
from tapelark.operators import wal as wal_ops
from tapelark.sources import deepbin, folder, shared

TABLES = {"runs": schema.RUN, "series": schema.SERIES, "seals": schema.SEAL, "manifests": schema.MANIFEST}
HOT_ROWS_PER_FILE = 10_000


class Store:
    """Tables runs, series, hot, seals, chain, manifests. Reading never writes; the index is refreshed on request."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, folder.root(path)

    def where(self, table: str) -> str:
        return f"{self.path}/{table}"

    def has(self, table: str) -> bool:
        return folder._exists(self.spark, f"{self.where(table)}/*.parquet")

    def table(self, name: str) -> DataFrame:
        kind = {**TABLES, "chain": schema.CHAIN}.get(name)
        if not self.has(name):
            if kind is None:
                return hot_ops.build(self.spark.createDataFrame([], schema.SERIES))
            return self.spark.createDataFrame([], kind)
        reader = self.spark.read if kind is None else self.spark.read.schema(kind)
        return reader.parquet(self.where(name))

    def manifest(self, model_id: str, checkpoint_sha256: str = "") -> dict | None:
        """The manifest that a watch file of this model is held against: of its checkpoint if there is one, else of another."""
        own = self.table("manifests").filter((F.col("model_id") == model_id) & F.col("layers").isNotNull())
        row = own.orderBy((F.col("checkpoint_sha256") == checkpoint_sha256).desc(), "checkpoint_sha256").head() if model_id else None
        return row.asDict() if row else None

    def next_numbers(self, rows: DataFrame, order: str) -> DataFrame:
        """``rows`` with new run ids, after the highest of runs and chain, in ``order``."""
        seen = self.table("runs").select("run_id").union(self.table("chain").select("run_id"))
        top = seen.agg(F.max(F.expr("try_cast(substring(run_id, 5) AS INT)"))).first()[0] or 0
        return rows.withColumn("run_id", F.format_string("RUN-%06d", F.row_number().over(Window.orderBy(order)) + F.lit(top)))

    def add_runs(self, runs: DataFrame) -> None:
        clash = runs.select("run_id").join(self.table("runs").select("run_id"), "run_id", "left_semi").head()
        if clash:
            raise AlreadyThere(f"{clash.run_id} is there")
        runs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.RUN]).write.mode("append").parquet(self.where("runs"))

    def add_series(self, series: DataFrame) -> None:
        """Series in order of address, so that scans of an address skip row groups."""
        series.select(*schema.SERIES.names).repartitionByRange("address", "run_id").sortWithinPartitions("address", "run_id").write.mode("append").parquet(self.where("series"))

    def index(self, rebuild: bool = False) -> None:
        """Add what the hot table lacks, or make it anew."""
        if rebuild or not self.has("hot"):
            hot_ops.build(self.table("series")).write.mode("overwrite").option("maxRecordsPerFile", HOT_ROWS_PER_FILE).parquet(self.where("hot"))
            return
        known = self.table("hot").select("run_id", "address")
        hot_ops.build(self.table("series").join(known, ["run_id", "address"], "left_anti")).write.mode("append").option("maxRecordsPerFile", HOT_ROWS_PER_FILE).parquet(self.where("hot"))

    def fingerprints(self, run_id: str | None = None) -> DataFrame:
        """(run_id, sha_outer, sha_deep, replay) of the tables' rows as they are now, of all runs or one.

        The document's hash is that of its JSON with fields in order; a matrix's is that of its addresses
        and values, in order of address.
        """
        own = F.lit(True) if run_id is None else F.col("run_id") == run_id
        runs = self.table("runs").filter(own)
        outer = runs.select("run_id", F.sha2(F.to_json(F.struct(*schema.RUN.names)), 256).alias("sha_outer"), canonical_json("replay").alias("replay"))
        one = F.sha2(F.concat_ws(",", "address", F.concat_ws(",", F.transform("series", lambda x: x.cast("string")))), 256)
        each = self.table("series").filter(own).select("run_id", "address", one.alias("h"))
        deep = each.groupBy("run_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "address", "h"))), ","), 256).alias("sha_deep"))
        return outer.join(deep, "run_id", "left")

    def seal(self, sealed_by: str = "tapelark") -> int:
        """Chain the runs that are not sealed, in order of id; one writer at a time."""
        new = wal_ops.open_rows(self.fingerprints(), self.table("seals"))
        last = self.table("chain").agg(F.max_by("hash", "pos").alias("h"), F.max("pos").alias("p")).first()
        with shared.written(seal_ops.sealed(new, "run_id", last.h or seal_ops.GENESIS), "links") as links:
            n = links.count()
            if n:
                start = 0 if last.p is None else last.p + 1
                now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
                rows = links.select("run_id", "hash", "prev_hash", "sha_outer", "sha_deep", F.lit(seal_ops.ALGORITHM).alias("algorithm"), F.lit(sealed_by).alias("sealed_by"), now.alias("sealed_at_iso"))
                rows.coalesce(1).write.mode("append").parquet(self.where("seals"))
                links.select((F.col("pos") + F.lit(start)).alias("pos"), "run_id", "hash", "prev_hash", F.lit(False).alias("bad")).coalesce(1).write.mode("append").parquet(self.where("chain"))
        return n

    def verified(self, run_id: str | None = None) -> DataFrame:
        return seal_ops.verified(self.fingerprints(run_id), self.table("seals"), self.table("chain") if self.has("chain") else None)

    def ingest(self, path: str) -> None:
        """Take over the runs of a folder of recorded runs that are not here yet."""
        runs = folder.outer(self.spark, path).join(self.table("runs").select("run_id"), "run_id", "left_anti")
        series = folder.series(self.spark, path).join(self.table("series").select("run_id").distinct(), "run_id", "left_anti")
        self.add_runs(runs)
        self.add_series(series)

    def sizes(self) -> DataFrame:
        """(run_id, model_id, checkpoint_sha256, hot_bytes, cold_bytes): bytes of documents and of series values."""
        cold = self.table("series").groupBy("run_id").agg(F.sum(F.size("series").cast("long") * 4).alias("cold_bytes"))
        runs = self.table("runs")
        doc = F.length(F.encode(F.to_json(F.struct(*schema.RUN.names)), "UTF-8")).cast("long")
        return runs.select("run_id", "model_id", "checkpoint_sha256", doc.alias("hot_bytes")).join(cold, "run_id", "left").withColumn("cold_bytes", F.coalesce("cold_bytes", F.lit(0)))

    def verify_run(self, run_id: str) -> bool:
        """Whether one run's seal holds: its own files are hashed, and the chain is read up to it."""
        return not self.verified(run_id).filter("ok").isEmpty()

    def export(self, run_id: str, out: str, with_manifest: bool = False, with_index: bool = False) -> list[str]:
        """A flat zip of one run: outer.json, seal.json, and if it has series deep.bin and deep_index.json.

        ``with_index`` adds the index of a run without series, ``with_manifest`` its model's manifest.
        """
        run = self.table("runs").filter(F.col("run_id") == run_id)
        first = json_lines(run).head()
        if first is None:
            raise NotFound(f"{run_id} not found")
        files: dict[str, bytes] = {"outer.json": pretty(document(first.j))}
        for r in json_lines(self.table("seals").filter(F.col("run_id") == run_id)).take(1):
            files["seal.json"] = pretty(json.loads(r.j))
        deep = deepbin.deep_files(self.table("series").filter(F.col("run_id") == run_id)).head()
        if deep is not None:
            files["deep.bin"] = bytes(deep.content)
        if deep is not None or with_index:
            files["deep_index.json"] = pretty(deepbin.index_document(run_id, list(deep.watched) if deep else [], deep.tokens if deep else 0))
        if with_manifest:
            own = self.table("manifests").join(run.select("model_id", "checkpoint_sha256"), ["model_id", "checkpoint_sha256"])
            files |= {"manifest.json": pretty(json.loads(r.j)) for r in json_lines(own).take(1)}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, raw in files.items():
                z.writestr(name, raw)
        return list(files)


def pretty(doc: dict) -> bytes:
    """JSON as documents of runs are written: sorted keys, two spaces, a line end."""
    return (json.dumps(doc, sort_keys=True, indent=2) + "\n").encode()


def document(line: str) -> dict:
    """A run's document from its row as JSON: what is kept as JSON text becomes what it spells."""
    doc = json.loads(line)
    if isinstance(doc.get("replay"), str):
        doc["replay"] = json.loads(doc["replay"])
    patch = (doc.get("watchlist_ref") or {}).get("patch")
    if isinstance(patch, str):
        doc["watchlist_ref"]["patch"] = json.loads(patch)
    return doc


def write_folder(runs: DataFrame, path: str, series: DataFrame | None = None, dtype: str = "fp16") -> None:
    """Runs as a local folder of recorded runs, one at a time: outer.json, deep_index.json and, where there are series, deep.bin."""
    for row in json_lines(runs).toLocalIterator():
        doc = document(row.j)
        where = Path(path) / "runs" / doc["run_id"]
        where.mkdir(parents=True, exist_ok=True)
        (where / "outer.json").write_bytes(pretty(doc))
        (where / "deep_index.json").write_bytes(pretty(deepbin.index_document(doc["run_id"], [], 0, dtype)))
    if series is not None:
        for row in deepbin.deep_files(series, dtype).toLocalIterator():
            where = Path(path) / "runs" / row.run_id
            (where / "deep.bin").write_bytes(bytes(row.content))
            (where / "deep_index.json").write_bytes(pretty(deepbin.index_document(row.run_id, list(row.watched), row.tokens, dtype)))
