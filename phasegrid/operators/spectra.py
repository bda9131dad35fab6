"""Fourier transforms of packets and blocks, detection, trimming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from phasegrid.functions import numeric as N


def fft_rows(series: DataFrame) -> DataFrame:
    """Forward transform (not normalised) of array columns ``re`` and ``im``.

    Row-wise, so nothing shuffles; all series of one length in a batch transform
    in one call.
    """
    cols = [f for f in series.schema if f.name not in ("re", "im")]
    names = [f.name for f in cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols)

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["re"].map(len)):
                x = np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())
                y = np.fft.fft(x, axis=1)
                yield part[names].assign(re=list(y.real), im=list(y.imag))

    return series.mapInPandas(transform, f"{schema}, re array<double>, im array<double>")


def split_frames(frames: DataFrame, pols: int, steps: int) -> DataFrame:
    """Frame rows ``data [step][pol][re, im]`` as one series per polarization, scaled."""
    at = lambda z: F.transform(F.sequence(F.lit(0), F.lit(steps - 1)),
                               lambda t: F.get("data", ((t * pols + F.col("pol")) * 2 + z).cast("int"))
                               * F.col("scale"))
    keys = [c for c in frames.columns if c not in ("data", "scale")]
    return (frames.withColumn("pol", F.explode(F.sequence(F.lit(0), F.lit(pols - 1))))
            .select(*keys, "pol", at(0).alias("re"), at(1).alias("im")))


def block_series(packets: DataFrame, keys: list[str], n_packets: int, steps: int) -> DataFrame:
    """Join the packet series of a block in packet order (bounded by the block length).

    A missing packet is ``steps`` zeros at its place.
    """
    have = packets.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pkt", F.struct("re", "im")))).alias("__m"))
    silent = F.array_repeat(F.lit(0.0), steps)
    part = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_packets - 1)), lambda k: F.coalesce(
        F.try_element_at("__m", k)[c].cast("array<double>"), silent)))
    return have.select(*keys, part("re").alias("re"), part("im").alias("im"))


def bins(spectrum: DataFrame) -> DataFrame:
    """Long spectrum with column ``k``."""
    keys = [c for c in spectrum.columns if c not in ("re", "im")]
    return (spectrum.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
            .select(*keys, "k", F.col("v.re").alias("re"), F.col("v.im").alias("im")))


def downsample_power(spectrum: DataFrame, factor: int) -> DataFrame:
    """Mean power over groups of ``factor`` bins, NaN bins skipped, 0 if none is left.

    Works inside each array row: no explode and no shuffle.  A short last group is the
    mean of the bins it has.
    """
    keys = [c for c in spectrum.columns if c not in ("re", "im")]
    power = F.zip_with("re", "im", lambda a, b: a * a + b * b)

    def mean(start):
        part = F.filter(F.slice("__p", start * factor + 1, factor), lambda x: ~F.isnan(x))
        total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(part) > 0, total / F.size(part)).otherwise(0.0)

    groups = F.sequence(F.lit(0), N.idiv(F.size("__p") - 1, factor).cast("int"))
    return (spectrum.withColumn("__p", power).where(F.size("__p") > 0)
            .select(*keys, F.transform(groups, mean).alias("power")))


def downsample_power_long(spectrum: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """The same mean on long rows ``k, re, im``."""
    p = N.power("re", "im").cast("double")
    return (spectrum.groupBy(*keys, N.floor_div("k", factor).alias("bin"))
            .agg(F.coalesce(F.avg(F.when(~F.isnan(p), p)), F.lit(0.0)).alias("power")))


def shift_and_trim(spectrum: DataFrame, n: int, trim: int) -> DataFrame:
    """Centre zero frequency and drop ``trim`` bins at each band edge."""
    s = N.fft_shift_index("k", n)
    return (spectrum.withColumn("__s", s).where(F.col("__s").between(trim, n - trim - 1))
            .withColumn("bin", (F.col("__s") - trim).cast("int")).drop("__s", "k"))


def sum_magnitude(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of magnitudes (not powers) over packets."""
    return spectrum.groupBy(*keys, "bin").agg(F.sum(F.sqrt(N.power("re", "im"))).alias("magnitude"))


def detect_power(x: DataFrame, keys: list[str]) -> DataFrame:
    """Square root of the power summed over both polarizations."""
    return x.groupBy(*keys).agg(F.sqrt(F.sum(N.power("re", "im"))).alias("detected"))


def bandpass(spectrum: DataFrame, n: int) -> DataFrame:
    """Magnitude on the shifted frequency axis."""
    return (spectrum.withColumn("bin", N.fft_shift_index("k", n).cast("int"))
            .withColumn("magnitude", F.sqrt(N.power("re", "im"))).drop("k", "re", "im"))


def peak_bin(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Bin of the largest power; ties go to the lowest bin."""
    p = N.power("re", "im")
    return spectrum.groupBy(*keys).agg(
        F.max_by("k", F.struct(p, -F.col("k"))).alias("peak"), F.max(p).alias("peak_power"))
