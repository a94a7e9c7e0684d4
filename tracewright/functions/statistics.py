"""Exact and interval statistics as closed column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(passes: Column, trials: Column) -> Column:
    """struct(low, high) of the 95 % Wilson interval; null on no trials."""
    n, z2 = trials.cast("double"), Z * Z
    p = passes / n
    scale = 1 + z2 / n
    middle = (p + z2 / (2 * n)) / scale
    margin = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    return F.when(
        trials > 0,
        F.struct(F.greatest(F.lit(0.0), middle - margin).alias("low"), F.least(F.lit(1.0), middle + margin).alias("high")),
    )


def exact_binomial(successes: Column, trials: Column) -> Column:
    """Two-sided exact test against one half, in log space so that thousands of trials do not underflow."""
    n, x = trials.cast("double"), F.least(successes, trials - successes).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), x),
        F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct((a["term"] + F.log((n - k) / (k + 1.0))).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(trials <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_wald(fixed: Column, regressions: Column, pairs: Column) -> Column:
    """struct(low, high) of the paired difference; null under ten discordant pairs."""
    n, d = pairs.cast("double"), (fixed - regressions).cast("double")
    margin = Z * F.sqrt((fixed + regressions - d * d / n) / (n * n))
    return F.when(
        fixed + regressions >= 10,
        F.struct(F.greatest(F.lit(-1.0), d / n - margin).alias("low"), F.least(F.lit(1.0), d / n + margin).alias("high")),
    )
