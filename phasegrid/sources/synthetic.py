"""Synthetic array signals generated by Spark from a row range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.functions import numeric as N


def cells(spark: SparkSession, cfg: ArrayConfig, blocks: int) -> DataFrame:
    """One row per (block, channel, pkt, recv, pol, t), numbered without a join."""
    sizes = [("t", cfg.steps), ("pol", cfg.pols), ("recv", cfg.receivers), ("pkt", cfg.packets),
             ("channel", cfg.channels), ("block", blocks)]
    d = spark.range(math.prod(n for _, n in sizes))
    stride, out = 1, []
    for name, size in sizes:
        value = F.pmod(N.idiv(F.col("id"), stride), F.lit(size))
        out.append((value if name == "block" else value.cast("int")).alias(name))
        stride *= size
    return d.select("id", *out)


def tone_and_noise(spark: SparkSession, cfg: ArrayConfig, blocks: int, tone: float = 0.0, cycles: float = 0.0,
                   common: float = 0.0, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """A tone seen by every receiver, noise common to all of them, and independent noise.

    ``cycles`` is the tone frequency per sample.  Values are rounded half to even
    and clipped to int8.
    """
    d = cells(spark, cfg, blocks)
    n = (F.col("block") * cfg.packets + F.col("pkt")) * cfg.steps + F.col("t")
    phase = n * (2 * math.pi * cycles)
    # common noise: a hash of everything but the receiver, mapped to a normal by Box-Muller
    def shared(tag):
        u = lambda k: (F.pmod(F.xxhash64("block", "channel", "pkt", "pol", "t", F.lit(seed * 10 + k)),
                              F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
        return F.sqrt(-2 * F.log(u(tag))) * F.cos(2 * math.pi * u(tag + 1))
    re = tone * F.cos(phase) + common * shared(1) + noise * F.randn(seed)
    im = tone * F.sin(phase) + common * shared(3) + noise * F.randn(seed + 1)
    return d.select("block", "channel", "pkt", "recv", "pol", "t", N.quantise_int8(re).alias("re"),
                    N.quantise_int8(im).alias("im"))


def single_antenna(spark: SparkSession, cfg: ArrayConfig, blocks: int, values: dict[int, tuple[int, int]]) -> DataFrame:
    """Constant complex values on the listed receivers, zero elsewhere."""
    table = F.create_map(*[x for r, (a, b) in values.items()
                           for x in (F.lit(r), F.struct(F.lit(a).alias("re"), F.lit(b).alias("im")))])
    v = F.element_at(table, F.col("recv"))
    return cells(spark, cfg, blocks).select(
        "block", "channel", "pkt", "recv", "pol", "t", F.coalesce(v["re"], F.lit(0)).alias("re"),
        F.coalesce(v["im"], F.lit(0)).alias("im"))
