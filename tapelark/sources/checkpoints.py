"""Model checkpoints as manifests: config.json and the header of the first weight file, never the weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelark import schema
from tapelark.errors import AlreadyThere, BadInput

#: Names that configurations use for the same number.
ALIASES = {
    "layers": ("num_hidden_layers", "n_layer"),
    "hidden": ("hidden_size", "n_embd"),
    "heads": ("num_attention_heads", "n_head"),
    "mlp": ("intermediate_size", "n_inner"),
    "vocab": ("vocab_size",),
}
MAX_HEADER = 64 << 20


def header(content: Column) -> Column:
    """The header bytes of a weight file: a little-endian 64-bit length, then that many bytes of JSON; else null."""
    digits = F.array_join(F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda i: F.hex(F.substring(content, i, F.lit(1)))), "")
    size = F.conv(digits, 16, 10).cast("decimal(20,0)")
    return F.when((F.length(content) >= 8) & (size <= MAX_HEADER) & (F.length(content) - 8 >= size), F.substring(content, F.lit(9), size.cast("int")))


def architecture(config: Column) -> dict[str, Column]:
    return {k: F.coalesce(*[F.get_json_object(config, f"$.{n}").try_cast("int") for n in names]) for k, names in ALIASES.items()}


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests of the checkpoint folders that a pattern names; the hash is of config and header bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    folder, name = F.regexp_extract("path", "^(.*)/[^/]+$", 1), F.regexp_extract("path", "([^/]+)$", 1)
    held = files.select(folder.alias("folder"), name.alias("name"), "content")
    configs = held.filter("name = 'config.json'").select("folder", F.col("content").alias("config"))
    first = held.filter("name LIKE '%.safetensors'").groupBy("folder").agg(F.min_by("content", "name").alias("weights"))
    both = configs.join(first, "folder").withColumn("header", header(F.col("weights")))
    text = F.decode("config", "UTF-8")
    arch = architecture(text)
    model = F.coalesce(F.get_json_object(text, "$._name_or_path"), F.regexp_extract("folder", "([^/]+)$", 1))
    out = both.select(
        F.col("folder"), model.alias("model_id"), F.coalesce(F.get_json_object(text, "$.model_type"), model).alias("model_name"),
        F.sha2(F.concat("config", "header"), 256).alias("checkpoint_sha256"), *[c.alias(k) for k, c in arch.items()], F.lit("full").alias("mode"),
        F.try_parse_json(F.decode("header", "UTF-8")).isNotNull().alias("good"),
    )
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One checkpoint's manifest row; raises where config, header or a size is missing."""
    row = scan(spark, path).head()
    if row is None:
        raise BadInput(f"{path} has no config.json with a weight file")
    missing = [k for k in ALIASES if row[k] is None or row[k] < 1]
    if not row.good or missing:
        raise BadInput(f"{path}: " + (f"no {', '.join(missing)}" if missing else "the weight file's header is not readable"))
    return spark.createDataFrame([tuple(row[n] for n in schema.MANIFEST.names)], schema.MANIFEST)


def api_model(spark: SparkSession, model_id: str) -> DataFrame:
    """The stub of a model without weights here: only documents can be recorded."""
    return spark.createDataFrame([(model_id, model_id, "", None, None, None, None, None, "outer_only")], schema.MANIFEST)


def with_manifest(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Runs with their model's sizes; of equal manifests the first by name."""
    keys = ["model_id", "checkpoint_sha256"]
    one = manifests.groupBy(*keys).agg(F.min(F.struct("model_name", "layers", "hidden", "heads", "mlp", "vocab")).alias("m"))
    return runs.join(one.select(*keys, "m.layers", "m.hidden", "m.heads", "m.mlp", "m.vocab"), keys, "left")


def record(store, weights_path: str | None = None, api_model_id: str | None = None, force: bool = False):
    """Scan a checkpoint (or take an API model's name) and add its manifest to a store; the manifest's row."""
    if not api_model_id and not weights_path:
        raise BadInput("a folder of weights or the name of an API model is needed")
    rows = api_model(store.spark, api_model_id) if api_model_id else manifest(store.spark, weights_path)
    row = rows.head()
    known = store.table("manifests").filter((F.col("model_id") == row.model_id) & (F.col("checkpoint_sha256") == row.checkpoint_sha256))
    if not known.isEmpty() and not force:
        raise AlreadyThere(f"{row.model_id} has a manifest; force writes another")
    rows.write.mode("append").parquet(store.where("manifests"))
    return row


def adapters(spark: SparkSession, pattern: str) -> DataFrame:
    """Layout descriptors of model families (JSON files) as a table: how matrices lie, how cells are addressed, sizes of a usual model."""
    size = "layers int, hidden int, heads int, mlp_per_layer int, vocab int"
    naming = "layer string, attention_head string, mlp_neuron string, specials array<string>"
    kind = f"family string, layout string, `order` string, endian string, dtypes array<string>, addressing struct<{naming}>, reference_arch struct<{size}>"
    held = spark.read.text(pattern, wholetext=True).select(F.from_json("value", kind).alias("d")).filter("d.family IS NOT NULL").select("d.*")
    return held.withColumnRenamed("order", "row_order")
