"""Find queries as plans in two phases: run conditions and hot statistics leave candidates, series decide.

Parquet statistics cannot see into arrays, so the hot table is the data-skipping index: a semi-join with
the rows that may match comes before any series is read. It never drops a match (see ``possible``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelark.errors import BadInput
from tapelark.functions import cells
from tapelark.plans.query import CellCond, Find, RunCond, parse_find

MAX_ROWS = 1000


def has_tag(tags: Column, value: str) -> Column:
    """Whether a tag is the value, or has it after its first equals sign."""
    return F.coalesce(F.exists(tags, lambda t: (t == value) | (F.regexp_replace(t, "(?s)^[^=]*=", "") == value)), F.lit(False))


def run_condition(cond: RunCond) -> Column:
    """A condition on a row of runs; for ``hash_fail`` the row carries ``hash_seal_verified``."""
    if cond.kind == "checkpoint":
        return F.regexp_replace("checkpoint_sha256", "sha256:", "") == cond.value
    if cond.kind == "tag":
        return has_tag(F.col("tags"), cond.value)
    if cond.kind == "prompt":
        return F.coalesce(F.col("prompt.text").contains(cond.value), F.lit(False))
    if cond.value == "hash_fail":
        return ~F.coalesce(F.col("hash_seal_verified"), F.lit(False))
    return F.coalesce(F.try_element_at("flags", F.lit(cond.value)), F.lit(False))


def possible(cond: CellCond) -> Column:
    """Whether a hot row (min, max, win10, n_win10) leaves the condition open; true where statistics are missing."""
    x, high, low = F.lit(cond.value), F.col("max"), F.col("min")
    if cond.op in (">", ">="):
        if cond.aggregate in ("VALUE", "MAX"):
            first = cond.low // cells.CHUNK
            last = F.least(F.col("n_win10") - 1, F.lit(first if cond.aggregate == "VALUE" else MAX_INT if cond.high is None else cond.high // cells.CHUNK)).cast("int")
            chunks = F.slice("win10", F.lit(first + 1), F.greatest(last - first + 1, F.lit(0)))
            # Chunks beyond those kept are judged by the whole series' maximum.
            high = F.when(last < cells.KEPT_CHUNKS, F.array_max(chunks)).otherwise(high)
            return F.coalesce(high >= x, F.col("max").isNull() & F.col("n").isNull(), F.lit(False))
        return F.coalesce(high >= x, F.col("n").isNull())
    if cond.op in ("<", "<="):
        return F.coalesce(low <= x, F.col("n").isNull())
    if cond.op == "=":
        return F.coalesce((low <= x) & (x <= high), F.col("n").isNull())
    return F.lit(True)


MAX_INT = 2**31 - 1


def _narrowed(cond: CellCond, tokens: tuple[int, int] | None) -> CellCond | None:
    """The condition within a token range; null if nothing is left of it."""
    if tokens is None:
        return cond
    low, high = max(cond.low, tokens[0]), min(MAX_INT if cond.high is None else cond.high, tokens[1])
    return None if low > high else CellCond(cond.span, low, high, cond.aggregate, cond.op, cond.value)


def spanned(series: DataFrame, cond: CellCond) -> DataFrame:
    """(run_id, address, s): what the condition reads of the series of its addresses, cut out before anything is joined."""
    held = series.filter(cond.span.holds(F.col("kind"), F.col("layer"), F.col("idx")))
    high = cond.low if cond.aggregate == "VALUE" else MAX_INT - 1 if cond.high is None else cond.high
    return held.select("run_id", "address", cells.tokens(F.col("series"), cond.low, high).alias("s"))


def cell_matches(part: DataFrame, cond: CellCond) -> DataFrame:
    """(run_id, address, token, value) of the best matching address of each run; ``part`` is of ``spanned``."""
    if cond.aggregate == "VALUE":
        got = part.select("run_id", "address", F.lit(cond.low).cast("long").alias("token"), F.try_element_at("s", F.lit(1)).cast("double").alias("value"))
    else:
        part = part.withColumn("f", cells.finite_of(F.col("s")))
        best = F.array_min("f") if cond.aggregate == "MIN" else F.array_max("f")
        value = {"MEAN": cells.array_mean(F.col("f")), "P95": cells.array_quantile(F.col("f"), 0.95)}.get(cond.aggregate, best)
        place = F.array_position(F.transform("s", lambda x: x.cast("double")), best) - 1 + cond.low
        got = part.select("run_id", "address", place.cast("long").alias("token"), value.alias("value"))
    got = got.filter(cells.compares(F.col("value"), cond.op, cond.value))
    if cond.span.low == cond.span.high:
        return got
    # The greatest value (least for MIN); of ties the first address.
    key = F.col("value") if cond.aggregate == "MIN" else -F.col("value")
    return got.groupBy("run_id").agg(F.min_by(F.struct("address", "token", "value"), F.struct(key, F.col("address"))).alias("b")).select("run_id", "b.*")


def find_runs(
    runs: DataFrame, series: DataFrame, hot: DataFrame | None, query: str | Find, limit: int | None = 20,
    tokens: tuple[int, int] | None = None, match: str = "all", verified: DataFrame | None = None,
) -> DataFrame:
    """(run, address, token, value, hash_seal_verified): a row per run and matching cell condition.

    ``match`` "all" wants every cell condition of a run to match, "any" one. Without cell conditions, a row
    per run with nulls. ``verified`` is (run_id, ok); without it that column is null. Rows are in order of
    run and condition; ``limit`` counts rows, none returns all.
    """
    if limit is not None and not 1 <= limit <= MAX_ROWS:
        raise BadInput(f"limit {limit} is not in 1..{MAX_ROWS}")
    q = parse_find(query) if isinstance(query, str) else query
    held = runs
    if verified is not None:
        held = held.join(verified.select("run_id", F.col("ok").alias("hash_seal_verified")), "run_id", "left")
        held = held.withColumn("hash_seal_verified", F.coalesce("hash_seal_verified", F.lit(False)))
    else:
        if RunCond("flag", "hash_fail") in q.runs:
            raise BadInput("flag hash_fail needs verified seals")
        held = held.withColumn("hash_seal_verified", F.lit(None).cast("boolean"))
    held = held.filter(reduce(lambda a, b: a & b, map(run_condition, q.runs), F.lit(True))).select(F.col("run_id"), "hash_seal_verified")
    if q.cells:
        conds = [_narrowed(c, tokens) for c in q.cells]
        ids = held.select("run_id")
        parts = []
        for k, cond in enumerate(conds):
            if cond is None:
                continue
            near = spanned(series, cond)
            near = near.join(ids, "run_id", "left_semi") if q.runs else near
            if hot is not None:
                open_ = hot.filter(cond.span.holds(F.col("kind"), F.col("layer"), F.col("idx")) & possible(cond)).select("run_id", "address")
                near = near.join(open_, ["run_id", "address"], "left_semi")
            parts.append(cell_matches(near, cond).select("run_id", F.lit(k).alias("k"), "address", "token", "value"))
        empty = held.sparkSession.createDataFrame([], "run_id string, k int, address string, token long, value double").withColumn("run_id", F.col("run_id").cast(runs.schema["run_id"].dataType))
        found = reduce(DataFrame.unionByName, parts) if parts else empty
        if match == "all" and len(q.cells) > 1:
            whole = Window.partitionBy("run_id")
            found = found.withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") == len(q.cells)).drop("_n")
        out = found.join(held, "run_id")
    else:
        out = held.select("run_id", F.lit(0).alias("k"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("long").alias("token"), F.lit(None).cast("double").alias("value"), "hash_seal_verified")
    out = out.orderBy("run_id", "k")
    out = out if limit is None else out.limit(limit)
    return out.select(F.col("run_id").alias("run"), "address", "token", "value", "hash_seal_verified")
