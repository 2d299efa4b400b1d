"""Runs as frames: the long form, the token table, the view's rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelark.errors import BadInput, NotFound, SealBrokenWarning
from tapelark.functions import cells
from tapelark.functions.addresses import check

COLUMNS = {
    "run_id": "string", "token_pos": "int", "token": "string", "value": "float",
    "address": "string", "layer": "int", "watched": "boolean", "hash_seal_verified": "boolean",
}
TABLE_TOKENS, TABLE_ADDRESSES, MOST_ADDRESSES = 32, 8, 32


def outer_frame(runs: DataFrame, address: str = "") -> DataFrame:
    """One row per run: token 0 with the prompt's text and no value."""
    return runs.select(
        "run_id", F.lit(0).alias("token_pos"), F.col("prompt.text").alias("token"), F.lit(float("nan")).cast("float").alias("value"),
        F.lit(address).alias("address"), F.lit(None).cast("int").alias("layer"), F.lit(False).alias("watched"), F.lit(None).cast("boolean").alias("hash_seal_verified"),
    )


def deep_frame(runs: DataFrame, series: DataFrame, wanted: list[str] | None = None, tokens: tuple[int, int] | None = None, verified: DataFrame | None = None) -> DataFrame:
    """Long form of the wanted addresses (none: all that were watched): a row per token and address, in that order.

    An address that a run did not watch gives rows with ``watched`` false and NaN. The text of a token is
    its id in the output, or else the prompt.
    """
    spark, low, high = runs.sparkSession, *(tokens or (0, 2**31 - 2))
    about = runs.select("run_id", F.col("prompt.text").alias("_prompt"), F.col("output.tokens").alias("_ids"))
    if wanted is None:
        grid = series.select("run_id", "address", "layer", "series", F.struct("kind", "layer", "idx", "address").alias("address_ord")).join(about, "run_id")
        grid = grid.withColumn("n_tokens", F.size("series"))
    else:
        asked = spark.createDataFrame(list(enumerate(wanted)), "address_ord int, address string")
        length = series.groupBy("run_id").agg(F.max(F.size("series")).alias("n_tokens"))
        held = series.join(F.broadcast(asked.select("address")), "address", "left_semi").select("run_id", "address", "layer", "series")  # as many rows as the caller names
        grid = about.join(length, "run_id").crossJoin(F.broadcast(asked)).join(held, ["run_id", "address"], "left")
    last = F.least(F.lit(high), F.col("n_tokens") - 1)
    rows = grid.filter(last >= low).withColumn("token_pos", F.explode(F.sequence(F.lit(low), last)))
    text = F.coalesce(F.try_element_at("_ids", F.col("token_pos") + 1).cast("string"), F.col("_prompt"))
    value = F.coalesce(F.try_element_at("series", F.col("token_pos") + 1), F.lit(float("nan")).cast("float"))
    out = rows.select("run_id", "token_pos", text.alias("token"), value.alias("value"), "address", "layer", F.col("series").isNotNull().alias("watched"), "address_ord")
    if verified is not None:
        out = out.join(verified.select("run_id", F.col("ok").alias("hash_seal_verified")), "run_id", "left").withColumn("hash_seal_verified", F.coalesce("hash_seal_verified", F.lit(False)))
    else:
        out = out.withColumn("hash_seal_verified", F.lit(None).cast("boolean"))
    return out.orderBy("run_id", "token_pos", "address_ord").select(*[F.col(k).cast(v).alias(k) for k, v in COLUMNS.items()])


def to_dataframe(runs: DataFrame, series: DataFrame, run_id: str, what: str = "deep", tokens: tuple[int, int] | None = None, addresses: list[str] | None = None, verified: DataFrame | None = None, manifest: dict | None = None) -> DataFrame:
    """The frame of one run; ``what`` is outer, deep or outer+deep (the same as deep). Addresses are checked against ``manifest`` if there is one."""
    if manifest and addresses:
        check(addresses, {k: manifest[k] for k in ("layers", "heads", "mlp")})
    one = runs.filter(F.col("run_id") == run_id)
    if one.isEmpty():
        raise NotFound(f"{run_id} not found")
    if verified is not None and verified.filter((F.col("run_id") == run_id) & F.col("ok")).isEmpty():
        warnings.warn(f"the seal of {run_id} does not hold", SealBrokenWarning, stacklevel=2)
    if what == "outer":
        return outer_frame(one, (addresses or [""])[0])
    if what not in ("deep", "outer+deep"):
        raise BadInput(f"what is outer, deep or outer+deep, not {what!r}")
    held = series.filter(F.col("run_id") == run_id)
    top = held.agg(F.max(F.size("series"))).first()[0]
    if top is None:
        raise BadInput(f"{run_id} has no recorded cells")
    if tokens is not None and not 0 <= tokens[0] <= tokens[1] < top:
        raise BadInput(f"tokens {tokens[0]}..{tokens[1]} are not in 0..{top - 1}")
    return deep_frame(one, held, addresses, tokens, verified)


def token_table(frame: DataFrame, addresses: list[str], n_tokens: int = TABLE_TOKENS) -> DataFrame:
    """Tokens by addresses of one run's long frame; values that are not finite are null."""
    if len(addresses) > MOST_ADDRESSES:
        raise BadInput(f"{len(addresses)} addresses; at most {MOST_ADDRESSES}")
    value = F.round(cells.known(F.col("value")), 6)
    first = frame.filter(F.col("token_pos") < n_tokens)
    return first.groupBy("run_id", "token_pos").pivot("address", addresses).agg(F.first(value))


def view_rows(frame: DataFrame) -> DataFrame:
    """(run_id, token_pos, text, values, note): each token's values by address; a note where one is not watched."""
    value = F.struct("address", cells.known(F.col("value")).alias("v"))
    grouped = frame.groupBy("run_id", "token_pos").agg(F.map_from_entries(F.array_sort(F.collect_list(value))).alias("values"), F.bool_or(~F.col("watched")).alias("_n"), F.first("token").alias("text"))
    return grouped.select("run_id", "token_pos", "text", "values", F.when(F.col("_n"), "not_watched").alias("note"))
