"""Views of series over token windows: sparklines, sliding maxima, peaks, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelark.functions import cells

GLYPHS = "▁▂▃▄▅▆▇█"


def _along(width: int) -> Window:
    return Window.partitionBy("run_id", "address").orderBy("token_pos").rowsBetween(-(width - 1), 0)


def sparkline(long: DataFrame, width: int = 10) -> DataFrame:
    """Each cell with a glyph for where its value lies between the least and greatest of the last ``width`` tokens."""
    v = cells.known(F.col("value"))
    held = long.withColumn("_v", v).withColumn("_lo", F.min("_v").over(_along(width))).withColumn("_hi", F.max("_v").over(_along(width)))
    span = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    level = F.when(F.col("_v").isNotNull(), F.least(F.lit(7), F.floor((F.col("_v") - F.col("_lo")) / span * 8).cast("int")))
    return held.withColumn("level", level).withColumn("glyph", F.substring(F.lit(GLYPHS), level + 1, F.lit(1))).drop("_v", "_lo", "_hi")


def sliding_max(long: DataFrame, width: int = 10) -> DataFrame:
    return long.withColumn("max_window", F.max(cells.known(F.col("value"))).over(_along(width)))


def peak_token(long: DataFrame) -> DataFrame:
    """(run_id, token_pos, peak): the first token with the greatest absolute value of any cell."""
    size = F.abs(cells.known(F.col("value")))
    best = long.withColumn("_s", size).filter("_s IS NOT NULL").groupBy("run_id").agg(F.max(F.struct(F.col("_s").alias("peak"), (-F.col("token_pos")).alias("p"))).alias("b"))
    return best.select("run_id", (-F.col("b.p")).alias("token_pos"), "b.peak")


def cooccurrence(long: DataFrame, reach: int = 5, least: float = 0.5, top: int | None = 5, centre: DataFrame | None = None) -> DataFrame:
    """(run_id, a, b, r, abs_r): correlated pairs of a run's addresses around its peak token.

    Pairs are of one run and its watched addresses (a bounded list), joined on run and token. ``top`` rows
    per run by |r|, none for all above ``least``; fewer than three pairs of values make no correlation.
    """
    centre = (peak_token(long) if centre is None else centre).select("run_id", F.col("token_pos").alias("_at"))
    near = long.join(centre, "run_id").filter(F.abs(F.col("token_pos") - F.col("_at")) <= reach)
    near = near.select("run_id", "token_pos", "address", cells.known(F.col("value")).alias("v")).filter("v IS NOT NULL")
    pairs = near.alias("x").join(near.alias("y"), ["run_id", "token_pos"]).filter("x.address < y.address")
    pairs = pairs.select("run_id", F.col("x.address").alias("a"), F.col("y.address").alias("b"), F.col("x.v").alias("x"), F.col("y.v").alias("y"))
    means = pairs.groupBy("run_id", "a", "b").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    r = cells.pearson(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))
    out = pairs.join(means, ["run_id", "a", "b"]).groupBy("run_id", "a", "b").agg(r.alias("r")).withColumn("abs_r", F.abs("r")).filter(F.col("abs_r") > least)
    if top is None:
        return out
    best = Window.partitionBy("run_id").orderBy(F.round("abs_r", 6).desc(), F.col("a").desc(), F.col("b").desc())
    return out.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= top).drop("_k")
