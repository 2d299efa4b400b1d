"""Empirical beta priors for rates of groups, fitted by moments in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the intra-group correlation; a prior's strength is 1 / correlation - 1.
RHO_LOW, RHO_HIGH = 0.0001, 0.9


def correlation(hits: Column, total: Column, mean: Column) -> Column:
    """Aggregate: moment estimate of beta-binomial correlation of groups around their prior means.

    Under a correlation r, E[(hits - total*mean)^2 / (total*mean*(1-mean))] = 1 + (total-1)*r.
    """
    off = hits - total * mean
    chi = F.sum(off * off / (total * mean * (F.lit(1.0) - mean)))
    groups, trials = F.count(F.lit(1)), F.sum(total)
    raw = F.when(trials > groups, (chi - groups) / (trials - groups)).otherwise(F.lit(0.5))
    return F.least(F.lit(RHO_HIGH), F.greatest(F.lit(RHO_LOW), raw))


def strength(rho: Column) -> Column:
    return F.lit(1.0) / rho - F.lit(1.0)


def mean(hits: Column, total: Column, prior: Column, weight: Column) -> Column:
    return (hits + weight * prior) / (total + weight)


def spread(hits: Column, total: Column, prior: Column, weight: Column) -> Column:
    """Standard deviation of the beta posterior."""
    a, n = hits + weight * prior, total + weight
    return F.sqrt(a * (n - a) / (n * n * (n + F.lit(1.0))))
