"""Empirical beta priors as DataFrame expressions (shared by the host operators)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intra-group correlation is kept inside these bounds: 0.5 is a prior of one pseudo-outcome,
# 0.001 one of 999 (groups that do not differ more than chance would give an infinite one).
MIN_RHO, MAX_RHO = 0.001, 0.5


def strength(n: Column, k: Column, mean: Column) -> Column:
    """Aggregate: pseudo-count of the beta prior by moments.

    For a beta-binomial, ``E[(k - n m)^2 - n m (1-m)] = n (n-1) m (1-m) rho``; rho is the
    ratio of the sums over the groups and the pseudo-count is ``1/rho - 1``. No group with
    two outcomes, or all outcomes alike: the weakest correlation allowed.
    """
    spread = F.sum(F.pow(k - n * mean, 2) - n * mean * (1 - mean))
    scale = F.sum(n * (n - 1) * mean * (1 - mean))
    rho = F.when(scale > 0, spread / scale).otherwise(F.lit(MIN_RHO))
    return 1 / F.greatest(F.lit(MIN_RHO), F.least(F.lit(MAX_RHO), rho)) - 1


def posterior_mean(n: Column, k: Column, prior_mean: Column, s: Column) -> Column:
    return (s * prior_mean + k) / (s + n)


def posterior_sd(n: Column, mean: Column, s: Column) -> Column:
    return F.sqrt(mean * (1 - mean) / (s + n + 1))
