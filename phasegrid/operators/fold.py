"""Incoherent sums and periodic folding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from phasegrid.functions import numeric as N


def incoherent_sum(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Power summed over receivers."""
    return samples.groupBy(*keys).agg(F.sum(N.power("re", "im")).alias("power"))


def fold_bin(sample, delay, period, n_bins: int):
    """Phase bin of a sample after removing its delay; negatives wrap.

    A whole-number period is handled in integers and is exact.
    """
    n = N._c(sample) - N._c(delay)
    if float(period).is_integer():
        p = int(period)
        return N.idiv(F.pmod(n, F.lit(p)) * n_bins, p).cast("int")
    return F.floor(N.cycle_fraction(n, period) * n_bins).cast("int")


def fold_block(power: np.ndarray, sample: np.ndarray, period: float, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of positive powers by phase bin, for powers ``[...][time]`` at the given samples.

    Bins are those of :func:`fold_bin`, delays already taken off.
    """
    if float(period).is_integer():
        at = sample % int(period) * n_bins // int(period)
    else:
        cycles = sample / period
        at = np.floor((cycles - np.floor(cycles)) * n_bins).astype(np.int64)
    rows = power.reshape(-1, power.shape[-1])
    loud = rows > 0
    cell = np.arange(len(rows))[:, None] * n_bins + at
    total = np.bincount(cell[loud], rows[loud], len(rows) * n_bins)
    hits = np.bincount(cell[loud], minlength=len(rows) * n_bins)
    return total.reshape(*power.shape[:-1], n_bins), hits.reshape(*power.shape[:-1], n_bins)


def fold(powers: DataFrame, keys: list[str], period, n_bins: int,
         sample: str = "sample", delay: str = "delay", power: str = "power") -> DataFrame:
    """Sum and count of positive powers per phase bin.

    ``keys=[]`` merges channels and polarizations; passing them keeps them apart.  A bin
    that was sampled without positive power has no hits and a total of 0.
    """
    d = powers.withColumn("bin", fold_bin(sample, delay, period, n_bins))
    loud = F.when(F.col(power) > 0, F.col(power))
    zero = F.lit(0).cast(dict(powers.dtypes)[power])
    return d.groupBy(*keys, "bin").agg(F.sum(F.coalesce(loud, zero)).alias("total"), F.count(loud).alias("hits"))


def normalise_fold(folded: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Mean per bin on the complete bin axis, 0 for a bin without hits; a silent key is all 0.

    The bins of a key are a bounded map, so the axis is filled without a join.
    """
    per = folded.groupBy(*keys).agg(F.map_from_entries(
        F.collect_list(F.struct("bin", F.try_divide("total", "hits")))).alias("m"))
    d = per.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return d.select(*keys, "bin", F.coalesce(F.element_at("m", F.col("bin")), F.lit(0.0)).alias("profile"))
