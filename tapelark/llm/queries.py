"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelark.llm import chat, decontaminate, licences, lines, mixing, quality, simhash, spans, tokens, urls
from tapelark.llm.common import table


def tokenizer_path() -> str:
    """Where the byte-level BPE lies; its path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its path holds; that document's label is the page's outcome."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr("try_cast(regexp_extract(url, '^[^#?]*?://[^/?#]*/(?:[^/?#]*/)?([0-9]+)', 1) AS BIGINT)")
    bad = F.expr("CASE WHEN coalesce(quality, toxic) IS NOT NULL THEN CAST((quality <=> 0) OR (toxic <=> 1) AS INT) END")
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    outcomes = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return urls.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("share", 6).alias("share"), F.round("low", 6).alias("low"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_mark().alias("fingerprint"), "component_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(table(spark, sf_dir, "conversations"), TOOLS)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.removed(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("lines").cast("long").alias("n_removed"),
        F.array_join(F.col("lines").cast("array<string>"), ",").alias("removed_lines"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.removed(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", F.size("sentences").cast("long").alias("n_removed"),
        F.array_join(F.col("sentences").cast("array<string>"), ",").alias("removed_sentences"),
    )


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, language and number."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return licences.scan(docs.select("doc_id", "text", path.alias("path")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).withColumn("host_low", F.round("host_low", 6))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_simhash_dedup, op3_chat_format, op4_line_dedup, op5_substring_dedup,
        op6_token_output, op7_decontamination, op8_license_scan, op9_quality_rules, op10_source_mixing,
    )
}
