"""Cohorts compared by pooled statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelark.errors import BadInput, NotFound
from tapelark.functions import cells
from tapelark.functions.addresses import Span, parse
from tapelark.plans.find import run_condition
from tapelark.plans.query import Compare, RunCond, group, parse_compare

STATS = ("mean", "p95", "max", "min", "firing_rate")


def parse_stats(text: str) -> dict[str, float]:
    """Statistics of a list like ``mean,p95,firing_rate>0.5``; values are firing thresholds, the first one named wins."""
    out: dict[str, float] = {}
    for part in filter(None, map(str.strip, text.split(","))):
        stat, _, above = part.partition(">")
        if stat not in STATS or above and stat != "firing_rate":
            raise BadInput(f"unknown statistic {part!r}; of {', '.join(STATS)}")
        out.setdefault(stat, float(above) if above else cells.FIRING)
    return out


def pooled_by_side(sided: DataFrame, keys: list[str], low: int, high: int, limit: int, above: float = cells.FIRING) -> DataFrame:
    """Statistics over all finite values of a side's first ``limit`` runs, by run id.

    ``sided`` has run_id, ``series`` and the columns ``keys``. Runs without tokens in the range do not
    count. One shuffle ranks runs, one pools values, both on the same keys.
    """
    part = sided.withColumn("s", cells.tokens(F.col("series"), low, high)).filter(F.size("s") > 0)
    first = Window.partitionBy(*keys).orderBy("run_id")
    kept = part.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= limit)
    values = kept.select(*keys, "run_id", F.explode("s").alias("v"))
    return values.groupBy(*keys).agg(F.countDistinct("run_id").alias("n"), *[c.alias(k) for k, c in cells.pooled(F.col("v"), above).items()])


def compare(
    runs: DataFrame, series: DataFrame, good: str | RunCond, bad: str | RunCond, spans: list[str] | list[Span],
    tokens: tuple[int, int] = (15, 20), limit: int = 10_000, stats: str = "mean,p95,firing_rate",
) -> DataFrame:
    """(address, side, n, n_values, <stats>, empty) for each address and side, also those without runs.

    A run may be on both sides. ``spans`` are addresses or ranges of them.
    """
    sides = {"good": group(good) if isinstance(good, str) else good, "bad": group(bad) if isinstance(bad, str) else bad}
    return _compared(runs, series, sides, spans, tokens, limit, stats)


def _compared(runs: DataFrame, series: DataFrame, sides: dict[str, RunCond], spans: list[str] | list[Span], tokens: tuple[int, int], limit: int, stats: str) -> DataFrame:
    if not 1 <= limit <= 100_000:
        raise BadInput(f"limit {limit} is not in 1..100000")
    wanted = parse_stats(stats)
    held = [parse(s) if isinstance(s, str) else s for s in spans]
    marks = F.filter(F.array(*[F.when(run_condition(c), F.lit(k)) for k, c in sides.items()]), lambda x: x.isNotNull())
    members = runs.select("run_id", F.explode(marks).alias("side"))
    inside: Column = F.lit(False)
    for s in held:
        inside = inside | s.holds(F.col("kind"), F.col("layer"), F.col("idx"))
    sided = series.filter(inside).join(members, "run_id").select("address", "side", "run_id", "series")
    got = pooled_by_side(sided, ["address", "side"], *tokens, limit, wanted.get("firing_rate", cells.FIRING))
    spark = runs.sparkSession
    names = spark.createDataFrame([(n,) for s in held for n in s.names()], "address string").distinct()
    grid = names.select("address", F.explode(F.array(*map(F.lit, sides))).alias("side"))
    out = grid.join(got, ["address", "side"], "left")
    return out.select(
        "address", "side", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_values", F.lit(0)).alias("n_values"), *[F.col(s) for s in wanted],
        F.col("n").isNull().alias("empty"),
    )


def compare_query(runs: DataFrame, series: DataFrame, query: str | Compare, limit: int = 10_000) -> DataFrame:
    """``compare`` for the text of a COMPARE GROUPS query, whose groups are named by their conditions; any number of groups."""
    q = parse_compare(query) if isinstance(query, str) else query
    sides = {f"{c.kind}:{c.value}": c for c in q.groups}
    return _compared(runs, series, sides, list(q.spans), (q.low, q.high), limit, ",".join(q.stats))


def require_both(result: DataFrame) -> DataFrame:
    """Raise if every address has a side without runs."""
    if result.groupBy("address").agg(F.max("empty").alias("e")).filter("NOT e").isEmpty():
        raise NotFound("no address has runs on both sides")
    return result


def bar(rate: Column) -> Column:
    """Ten-place bar of a mean firing rate, rounded half to even."""
    k = F.greatest(F.lit(0), F.least(F.lit(10), F.bround(rate * 10).cast("int")))
    return F.concat(F.lit("["), F.repeat(F.lit("#"), k), F.repeat(F.lit("."), F.lit(10) - k), F.lit("]"))
