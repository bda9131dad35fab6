"""Beam steering and weighted sums over receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phasegrid import scale
from phasegrid.functions import numeric as N
from phasegrid.functions import sky

MAX_WEIGHTS = 1 << 16  # channels x pols x beams x receivers that may be broadcast


def channel_frequencies(channels: DataFrame, min_channel: int, base_hz: float, bandwidth_hz: float) -> DataFrame:
    return channels.withColumn(
        "freq_hz", N.channel_frequency_hz(F.col("channel") + min_channel, base_hz, bandwidth_hz))


def target_directions(targets: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """Direction cosines (l, m, n) of targets at time ``ts``; zenith is (0, 0, 1)."""
    d = targets.withColumn("__d", sky.topocentric(
        F.col("ra_deg"), F.col("dec_deg"), N.mjd_utc("ts"), F.lit(latitude), F.lit(longitude)))
    zenith = F.col("mode") == "zenith"
    pick = lambda name, z: F.when(zenith, F.lit(z)).otherwise(F.col(f"__d.{name}")).alias(name)
    return d.select(*targets.columns, pick("l", 0.0), pick("m", 0.0), pick("n", 1.0))


def steering_weights(receivers: DataFrame, directions: DataFrame, channels: DataFrame,
                     total_receivers: int, pols: int) -> DataFrame:
    """Weights ``channel, pol, beam, recv, re, im``.

    Inputs are dimension tables tied together by ``run``.  A receiver may carry
    ``gain_re, gain_im``.  A null antenna gets exactly zero.
    """
    d = receivers.join(directions, "run").join(channels, "run")
    c, s = N.phasor(N.steering_phase("freq_hz", "l", "m", "n", "east", "north", "up"))
    if "gain_re" in receivers.columns:
        c, s = N.cmul(c, s, "gain_re", "gain_im")
    off = F.col("antenna_id") < 0
    amp = F.lit(1.0 / total_receivers)
    return (d.withColumn("re", F.when(off, 0.0).otherwise(c * amp))
            .withColumn("im", F.when(off, 0.0).otherwise(s * amp))
            .withColumn("pol", F.explode(F.sequence(F.lit(0), F.lit(pols - 1))))
            .select("run", "channel", "pol", "beam", F.col("canonical").alias("recv"), "re", "im"))


def zero_null_antennas(weights: DataFrame, antenna: str = "antenna_id") -> DataFrame:
    """Force the weight of receivers without an antenna to zero."""
    off = F.col(antenna) < 0
    return (weights.withColumn("re", F.when(off, 0).otherwise(F.col("re")))
            .withColumn("im", F.when(off, 0).otherwise(F.col("im"))))


def beamform(samples: DataFrame, weights: DataFrame, time: list[str] = ("pkt", "t")) -> DataFrame:
    """Sum over receivers of weight times sample.

    ``weights`` (channel, pol, beam, recv, re, im) is bounded by the array shape
    and broadcast once its size is counted.
    """
    w = weights.select("channel", "pol", "beam", "recv", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    re, im = N.cmul("w_re", "w_im", "re", "im")
    return (samples.join(scale.broadcast_if_small(w, MAX_WEIGHTS), ["channel", "pol", "recv"])
            .groupBy("block", "channel", "pol", "beam", *time)
            .agg(F.sum(re).alias("re"), F.sum(im).alias("im")))


def stack_variants(original: DataFrame, mitigated: DataFrame, beams: int) -> DataFrame:
    """Original beams 0..m-1 followed by mitigated beams m..2m-1."""
    return original.unionByName(mitigated.withColumn("beam", (F.col("beam") + beams).cast("int")))


def steering_epoch(seconds: Column, interval: float) -> Column:
    """Refresh epoch; the first one is always due."""
    return F.floor(seconds / F.lit(float(interval))).cast("long")


def beam_summary(beams: DataFrame, keys: list[str]) -> DataFrame:
    """Min, max, mean of the real part and the number of non-zero samples."""
    return beams.groupBy(*keys).agg(
        F.min("re").alias("min_re"), F.max("re").alias("max_re"), F.avg("re").alias("mean_re"),
        F.count_if((F.col("re") != 0) | (F.col("im") != 0)).alias("nonzero"))
