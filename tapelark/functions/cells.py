"""Statistics of cell values, as columns.

Spark orders NaN above every number and calls NaN > 1 true, so every comparison here stands behind
``finite``. Array forms work on one row's series, column forms under a GROUP BY.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell fires above this value.
FIRING = 0.8
#: Tokens of a chunk in the hot index, and how many chunks it keeps.
CHUNK, KEPT_CHUNKS = 10, 128


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def known(x: Column) -> Column:
    """The value as a double if it is finite, else null."""
    return F.when(finite(x), x.cast("double"))


def tokens(series: Column, low: Column | int, high: Column | int) -> Column:
    """Token rows low..high, both included; what lies beyond the series is cut off."""
    low = F.greatest(F.lit(low) if isinstance(low, int) else low, F.lit(0))
    high = F.lit(high) if isinstance(high, int) else high
    return F.slice(series, low + 1, F.greatest(high - low + 1, F.lit(0)))


def finite_of(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: x.cast("double")), finite)


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(values).cast("double"))


def array_quantile(values: Column, q: float) -> Column:
    """Quantile with linear interpolation; null of nothing."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")

    def pick(s: Column) -> Column:
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (at - low)

    return F.when(F.size(values) > 0, F.get(F.transform(F.array(F.array_sort(values)), pick), F.lit(0)))


def array_firing(values: Column, above: float = FIRING) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(values, lambda x: x > above)).cast("double"), F.size(values).cast("double")), F.lit(0.0))


def chunk_maxima(series: Column, kept: int = KEPT_CHUNKS, width: int = CHUNK) -> Column:
    """Greatest finite value of each chunk of ``width`` token rows, by place; null where a chunk has none."""
    chunks = F.least(F.ceil(F.size(series) / width).cast("int"), F.lit(kept))
    each = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.array_max(finite_of(F.slice(series, c * width + 1, width))))
    return F.when(chunks > 0, each).otherwise(F.array().cast("array<double>"))


def firing_rate(x: Column, above: float = FIRING) -> Column:
    """Aggregate: share of finite values above a threshold, 0 of nothing."""
    fires = F.when(known(x) > above, F.lit(1.0)).when(known(x).isNotNull(), F.lit(0.0))
    return F.coalesce(F.avg(fires), F.lit(0.0))


def quantile(x: Column, q: float) -> Column:
    """Aggregate: exact quantile of the finite values with linear interpolation."""
    return F.percentile(known(x), q)


def pooled(x: Column, above: float = FIRING) -> dict[str, Column]:
    """Aggregates over all finite values of a cohort."""
    v = known(x)
    return {"n_values": F.count(v), "mean": F.avg(v), "p95": quantile(x, 0.95), "max": F.max(v), "min": F.min(v), "firing_rate": firing_rate(x, above)}


def pearson(x: Column, y: Column, mean_x: Column, mean_y: Column) -> Column:
    """Aggregate: population correlation of pairs, centred first; 0 where one side does not vary."""
    dx, dy = x - mean_x, y - mean_y
    return F.coalesce(F.try_divide(F.sum(dx * dy), F.sqrt(F.sum(dx * dx) * F.sum(dy * dy))), F.lit(0.0))


def compares(value: Column, op: str, other: float) -> Column:
    """A comparison of the query language; a value that is not finite never matches."""
    x, y = value, F.lit(float(other))
    found = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y, "=": x == y, "==": x == y, "!=": x != y}[op]
    return finite(value) & found
