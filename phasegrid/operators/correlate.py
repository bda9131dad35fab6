"""Visibilities: V[i<=j][p][q] = sum over time of x(i,p) * conj(x(j,q)).

Two ways with the same result.  A small array becomes one wide row per time step
and the products are plain columns, so Spark aggregates partially before the
shuffle and no pair rows exist.  A larger array multiplies one bounded matrix per
(block, channel) in NumPy and returns packed triangles.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from phasegrid.config import ArrayConfig
from phasegrid.functions import numeric as N



def wide_samples(samples: DataFrame, cfg: ArrayConfig, time: list[str]) -> DataFrame:
    """One row per time step with columns ``r{i}`` and ``m{i}`` per input.

    Input i = recv * pols + pol.  Repeated cells resolve to the last arrival in
    the same aggregation; absent inputs are zero.
    """
    unit = F.col("recv") * cfg.pols + (F.col("pol") if "pol" in samples.columns else F.lit(0))
    order = F.col("arrival") if "arrival" in samples.columns else F.lit(0)
    integers = all(samples.schema[c].dataType == T.IntegerType() for c in ("re", "im"))
    # A pair of ints travels as one long: with a numeric arrival the aggregation then
    # runs on fixed-width buffers (hash instead of sort).
    pair = (F.shiftleft(F.col("re").cast("long"), 32).bitwiseOR(F.col("im").bitwiseAND(F.lit(0xFFFFFFFF)))
            if integers else F.struct("re", "im"))
    d = samples.withColumns({"__u": unit, "__x": pair})
    inputs = range(cfg.receivers * cfg.pols)
    wide = d.groupBy("block", "channel", *time).agg(
        *[F.max_by("__x", F.when(F.col("__u") == i, order)).alias(f"x{i}") for i in inputs])

    def part(i: int, z: str):
        x = F.col(f"x{i}")
        if not integers:
            return F.coalesce(x[z], F.lit(0.0))
        value = F.shiftright(x, 32) if z == "re" else F.shiftright(F.shiftleft(x, 32), 32)
        return F.coalesce(value, F.lit(0).cast("long"))

    return wide.select("block", "channel", *time, *[
        part(i, z).alias(f"{c}{i}") for i in inputs for z, c in (("re", "r"), ("im", "m"))])


def visibilities_wide(wide: DataFrame, cfg: ArrayConfig, keys: list[str]) -> DataFrame:
    """Sum products over all rows of each key; ``wide`` comes from :func:`wide_samples`."""
    p = cfg.pols
    cells = [(i, j, a, b) for j in range(cfg.receivers) for i in range(j + 1)
             for a in range(p) for b in range(p)]
    aggs = []
    for n, (i, j, a, b) in enumerate(cells):
        x, y = i * p + a, j * p + b
        re, im = N.cmul_conj(f"r{x}", f"m{x}", f"r{y}", f"m{y}")
        aggs.append(F.sum(re).alias(f"re{n}"))
        aggs.append((F.sum(im) if x != y else F.lit(0).cast("long")).alias(f"im{n}"))
    sums = wide.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("p"), F.lit(b).alias("q"),
                              F.col(f"re{n}").alias("re"), F.col(f"im{n}").alias("im"))
                     for n, (i, j, a, b) in enumerate(cells)])
    return sums.select(*keys, F.inline(rows))


def block_matrix(pdf: pd.DataFrame, cfg: ArrayConfig) -> np.ndarray:
    """Samples of one (block, channel) as ``[receiver*pol][time]``, gaps zero."""
    r, p, n, u = cfg.receivers, cfg.pols, cfg.packets, cfg.steps
    raw = np.stack(pdf["data"].to_numpy()).reshape(len(pdf), u, p, 2).astype(float)
    scaled = raw * pdf["scale"].to_numpy(dtype=float)[:, None, None, None]
    x = np.zeros((r, n, u, p), dtype=complex)
    x[pdf["recv"].to_numpy(), pdf["pkt"].to_numpy()] = scaled[..., 0] + 1j * scaled[..., 1]
    return x.transpose(0, 3, 1, 2).reshape(r * p, n * u)


def packed_triangle(x: np.ndarray, receivers: int, pols: int) -> np.ndarray:
    """Gram matrix of the inputs as ``[baseline][p][q]``, triangle packed by column."""
    v = (x @ x.conj().T).reshape(receivers, pols, receivers, pols)
    j, i = np.tril_indices(receivers)
    return v[i, :, j, :]


def visibilities_packed(frames: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Packed visibilities per (block, channel): arrays ``re`` and ``im``.

    ``frames`` holds each packet of a block once (halo removed), so a group is
    bounded by the array shape whatever the size of the input.
    """
    def gram(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        v = packed_triangle(block_matrix(pdf, cfg), cfg.receivers, cfg.pols).ravel()
        return pd.DataFrame({"block": [key[0]], "channel": [key[1]], "re": [v.real], "im": [v.imag]})

    return (frames.select("block", "channel", "pkt", "recv", "scale", "data")
            .groupBy("block", "channel")
            .applyInPandas(gram, "block long, channel int, re array<double>, im array<double>"))


def unpack(packed: DataFrame, cfg: ArrayConfig, keys: list[str] = ("block", "channel")) -> DataFrame:
    """Long visibilities ``keys, i, j, p, q, re, im`` of packed arrays."""
    p2 = cfg.pols * cfg.pols
    d = packed.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("__n", "v"))
    i, j = N.baseline_receivers(N.idiv(F.col("__n"), p2).cast("int"), cfg.receivers)
    return d.select(*keys, i.alias("i"), j.alias("j"),
                    N.idiv(F.pmod("__n", F.lit(p2)), cfg.pols).cast("int").alias("p"),
                    F.pmod("__n", F.lit(cfg.pols)).cast("int").alias("q"),
                    F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def accumulate(vis: DataFrame, blocks: int) -> DataFrame:
    """Sum runs of ``blocks`` blocks; an incomplete last run is emitted too.

    Where rows have packet counters (start_seq, end_seq) and missing packets, so has the
    sum: first, last, and all of them.
    """
    also = [f(c).alias(c) for c, f in (("start_seq", F.min), ("end_seq", F.max), ("missing", F.sum)) if c in vis.columns]
    return (vis.groupBy(N.floor_div("block", blocks).alias("integration"), "channel", "i", "j", "p", "q")
            .agg(F.sum("re").alias("re"), F.sum("im").alias("im"), *also))


#: Blocks whose packed arrays are brought together to be added up; longer integrations add up such sums.
FOLD = 32


def accumulate_packed(packed: DataFrame, cfg: ArrayConfig, blocks: int) -> DataFrame:
    """:func:`accumulate` of packed rows: arrays are added up before they become a row for every pair.

    What moves is one row for each block, and not one for each of its pairs.
    """
    integration, part = N.floor_div("block", blocks), N.floor_div("block", FOLD)
    also = [f(c).alias(c) for c, f in (("start_seq", F.min), ("end_seq", F.max), ("missing", F.sum)) if c in packed.columns]
    parts = packed.groupBy(integration.alias("integration"), "channel", *([part.alias("part")] if blocks > FOLD else [])).agg(
        F.sort_array(F.collect_list(F.struct("block", "re", "im"))).alias("v"), *also)
    total = lambda c: F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", F.lit(0))[c],
                                  lambda a, v: F.zip_with(a, v[c], lambda x, y: x + y))
    keys = ["integration", "channel", *[c for c in ("start_seq", "end_seq", "missing") if c in packed.columns]]
    long = unpack(parts.select(*keys, total("re").alias("re"), total("im").alias("im")), cfg, keys)
    if blocks <= FOLD:
        return long.select("integration", "channel", "i", "j", "p", "q", "re", "im", *keys[2:])
    return long.groupBy("integration", "channel", "i", "j", "p", "q").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), *also)


def mean_visibilities(vis: DataFrame, blocks: int) -> DataFrame:
    """Sum over a run divided by its nominal length."""
    return (accumulate(vis, blocks).withColumn("re", F.col("re") / blocks)
            .withColumn("im", F.col("im") / blocks))


def trim_baselines(vis: DataFrame, receivers: int) -> DataFrame:
    """Drop baselines of padding receivers."""
    return vis.where(N.baseline_index(F.col("i"), F.col("j")) < receivers * (receivers + 1) // 2)


def hermitian_fill(vis: DataFrame) -> DataFrame:
    """Both triangles: V[j][i][q][p] = conj(V[i][j][p][q]).  One pass, no self-union."""
    keys = [c for c in vis.columns if c not in ("i", "j", "p", "q", "re", "im")]
    cell = lambda i, j, p, q, re, im: F.struct(
        F.col(i).alias("i"), F.col(j).alias("j"), F.col(p).alias("p"), F.col(q).alias("q"),
        re.alias("re"), im.alias("im"))
    both = F.array_compact(F.array(
        cell("i", "j", "p", "q", F.col("re"), F.col("im")),
        F.when(F.col("i") != F.col("j"), cell("j", "i", "q", "p", F.col("re"), -F.col("im")))))
    return vis.select(*keys, F.inline(both))


def polar(vis: DataFrame) -> DataFrame:
    """Display columns: magnitude, angle and the autocorrelation flag."""
    return (vis.withColumn("mag", N.magnitude("re", "im")).withColumn("angle", N.angle("re", "im"))
            .withColumn("autocorr", (F.col("i") == F.col("j")) & (F.col("p") == F.col("q"))))
