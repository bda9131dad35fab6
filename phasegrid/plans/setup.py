"""From configuration files to the calibration of a run.

Wiring, gains, delays and weights are joined as small tables with the operators
of :mod:`phasegrid.operators`; the result has one number per channel,
polarization, beam and receiver and is handed to the block jobs as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.operators import beam, calibrate, wiring
from phasegrid.plans.blocks import Calibration, Tracking
from phasegrid.sources import dims


@dataclass(frozen=True)
class RunFiles:
    """Paths of the JSON files of a run; each of them may be absent."""

    config: str | None = None
    stream_map: str | None = None
    gains: str | None = None
    fine_delays: str | None = None
    beam_weights: str | None = None
    targets: str | None = None


def _positions(cfg: ArrayConfig):
    return F.create_map(*[F.lit(x) for i, f in enumerate(cfg.fpga_ids) for x in (f, i)])


def wired_streams(spark: SparkSession, cfg: ArrayConfig, files: RunFiles) -> DataFrame | None:
    """Stream wiring of the selected sources, with positions instead of ids."""
    if not files.stream_map:
        return None
    d = dims.stream_map(spark, files.stream_map).where(F.col("fpga_id").isin(*cfg.fpga_ids))
    position = F.element_at(_positions(cfg), F.col("fpga_id"))
    inside = F.col("stream").between(0, cfg.recv_per_fpga * cfg.pols - 1)
    _refuse(d.where(~F.coalesce(inside, F.lit(False))), "stream", f"streams outside 0 to {cfg.recv_per_fpga * cfg.pols - 1}")
    return d.select(F.lit(0).cast("long").alias("run"), position.alias("fpga_id"), "stream",
                                  "antenna_id", "polarization")


def _refuse(rows: DataFrame, column: str, what: str) -> None:
    """Dimension rows that the array has no place for are an error, not something to leave out."""
    bad = [r[0] for r in rows.select(column).limit(5).collect()]
    if bad:
        raise ValueError(f"{what}: {bad}")


def beam_targets(targets: DataFrame, beams: int) -> DataFrame:
    """One target a beam; a beam without one points to the zenith."""
    _refuse(targets.where(~F.coalesce(F.col("beam").between(0, beams - 1), F.lit(False))), "beam", f"targets of beams outside 0 to {beams - 1}")
    all_beams = targets.sparkSession.range(beams).select(F.col("id").cast(targets.schema["beam"].dataType).alias("beam"))
    return all_beams.join(targets, "beam", "left").withColumn("mode", F.coalesce("mode", F.lit("zenith")))


def receivers(spark: SparkSession, cfg: ArrayConfig, streams: DataFrame | None) -> DataFrame:
    """Antenna of every receiver: stream map, built-in wiring, or the receiver number."""
    if streams is not None:
        return wiring.canonical_map(streams, cfg)
    known = cfg.recv_per_fpga == 10 and all(f in wiring.BUILT_IN_ANTENNAS for f in cfg.fpga_ids)
    if known:
        d = wiring.built_in_wiring(spark, list(cfg.fpga_ids)).withColumnRenamed("recv", "canonical")
    else:
        d = spark.range(cfg.receivers).select(F.col("id").cast("int").alias("canonical"),
                                              F.col("id").cast("int").alias("antenna_id"))
    return d.withColumn("run", F.lit(0).cast("long"))


def _array(rows: DataFrame, cfg: ArrayConfig, shape: tuple[int, ...], keys: list[str], fill: complex) -> np.ndarray:
    """Complex array of a bounded table."""
    out = np.full(shape, fill, dtype=complex)
    for r in rows.select(*keys, "re", "im").collect():
        out[tuple(r[k] for k in keys)] = complex(r["re"], r["im"])
    return out


def _channels(d: DataFrame, cfg: ArrayConfig) -> DataFrame:
    return (d.withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(cfg.channels - 1))))
            .withColumn("channel", F.col("index") + cfg.min_channel))


def epoch_directions(targets: DataFrame, latitude: float, longitude: float, at: Column, interval_s: float, epochs: int) -> DataFrame:
    """Direction of every target (beam, mode, ra_deg, dec_deg) at the begin of each refresh epoch: epoch, beam, l, m, n.

    ``at`` is the time of the first one.
    """
    d = targets.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))      # targets are one row a beam
    moved = F.unix_micros(at) + F.round(F.col("epoch") * F.lit(float(interval_s) * 1e6)).cast("long")
    d = d.withColumn("ts", F.timestamp_micros(moved))
    return beam.target_directions(d, latitude, longitude).select("epoch", "beam", "l", "m", "n")


def tracking(directions: DataFrame, positions: DataFrame, cfg: ArrayConfig, interval_s: float, rate_hz: float) -> Tracking:
    """Arrays of :func:`epoch_directions` and of the receivers' places (canonical, antenna_id, east, north, up).

    ``rate_hz``: counts of the sample counter in a second.
    """
    rows = directions.collect()         # three numbers a beam and epoch
    epochs = max(r["epoch"] for r in rows) + 1
    found = np.zeros((epochs, cfg.beams, 3))
    for r in rows:
        found[r["epoch"], r["beam"]] = r["l"], r["m"], r["n"]
    places, connected = np.zeros((cfg.receivers, 3)), np.zeros(cfg.receivers, bool)
    for r in positions.collect():
        places[r["canonical"]] = [r[c] or 0.0 for c in ("east", "north", "up")]
        connected[r["canonical"]] = r["antenna_id"] >= 0
    starts = np.round(np.arange(epochs) * interval_s * rate_hz).astype(np.int64)
    return Tracking(starts, found, places, connected)


def load_calibration(spark: SparkSession, cfg: ArrayConfig, files: RunFiles, utc: str | None = None,
                     refresh_s: float | None = None, length_s: float = 0.0) -> Calibration:
    """Everything the block jobs need; ``utc`` is the pointing time of targets.

    With ``refresh_s`` beams follow their targets: directions are worked out anew every so
    many seconds of an observation of ``length_s`` that starts at ``utc``; the last ones
    hold beyond its end.
    """
    streams = wired_streams(spark, cfg, files)
    recv = receivers(spark, cfg, streams)
    site = dims.site(spark, files.config).first() if files.config else None
    base = site["base_frequency_hz"] if site and site["base_frequency_hz"] is not None else 0.0
    width = site["channel_bandwidth_hz"] if site and site["channel_bandwidth_hz"] is not None else 0.0
    pol_name = F.when(F.col("pol") == 0, "XX").otherwise("YY")

    perm = None
    if streams is not None:
        perm = np.full((cfg.receivers, cfg.pols, 2), -1)
        for r in wiring.permutation(streams, cfg).collect():   # one row per slot
            perm[r["slot"] // cfg.pols, r["slot"] % cfg.pols] = r["recv_perm"], r["pol_perm"]

    gains = None
    if files.gains:
        hw = (wiring.forward_table(streams.withColumn("fpga_id", F.element_at(
            F.create_map(*[F.lit(x) for i, f in enumerate(cfg.fpga_ids) for x in (i, f)]), F.col("fpga_id"))), cfg)
              .select((F.col("fpga_input_index") * cfg.recv_per_fpga + F.col("receiver_slot")).alias("recv"),
                      F.col("raw_polarization").alias("raw"), F.col("canonical_polarization").alias("pol"), "antenna_id")
              if streams is not None else
              recv.select(F.col("canonical").alias("recv"), "antenna_id",
                          F.explode(F.sequence(F.lit(0), F.lit(cfg.pols - 1))).alias("pol"))
              .withColumn("raw", F.col("pol")))
        hw = _channels(hw.withColumn("pol_name", pol_name), cfg)
        d = calibrate.gains_for_streams(hw, dims.gains(spark, files.gains), ["channel", "pol_name", "antenna_id"])
        d = d.withColumnsRenamed({"gain_re": "re", "gain_im": "im"})
        gains = _array(d, cfg, (cfg.channels, cfg.pols, cfg.receivers), ["index", "raw", "recv"], 1.0)

    delays = None
    if files.fine_delays:
        table = dims.fine_delays(spark, files.fine_delays).withColumn("run", F.lit(0).cast("long"))
        delays = np.zeros(cfg.receivers)
        for r in calibrate.delays_for_receivers(recv, table).collect():
            delays[r["canonical"]] = r["delay_ns"]

    shape = (cfg.channels, cfg.pols, cfg.beams, cfg.receivers)
    follow = None
    if files.targets:
        at = F.lit(utc).cast("timestamp") if utc else F.current_timestamp()
        run = F.lit(0).cast("long")
        directions = beam.target_directions(
            beam_targets(dims.targets(spark, files.targets), cfg.beams).withColumn("ts", at),
            site["latitude_deg"], site["longitude_deg"]).withColumn("run", run)
        places = dims.antenna_positions(spark, files.config).groupBy("antenna_id").agg(
            *[F.max_by(c, "fpga_id").alias(c) for c in ("east", "north", "up")])
        channels = beam.channel_frequencies(_channels(spark.range(1), cfg).select(
            F.col("index").alias("channel"), run.alias("run")), cfg.min_channel, base, width)
        d = beam.steering_weights(wiring.antenna_positions(recv, places), directions, channels, cfg.receivers, cfg.pols)
        weights = _array(d, cfg, shape, ["channel", "pol", "beam", "recv"], 0.0)
        if refresh_s:
            every = epoch_directions(beam_targets(dims.targets(spark, files.targets), cfg.beams), site["latitude_deg"],
                                     site["longitude_deg"], at, refresh_s, int(length_s // refresh_s) + 1)
            follow = tracking(every, wiring.antenna_positions(recv, places), cfg, refresh_s, width)
    else:
        d = _channels(recv.withColumn("pol", F.explode(F.sequence(F.lit(0), F.lit(cfg.pols - 1)))), cfg)
        d = d.withColumn("pol_name", pol_name).withColumn("beam", F.explode(F.sequence(F.lit(0), F.lit(cfg.beams - 1))))
        if files.beam_weights:
            d = d.join(dims.gains(spark, files.beam_weights), ["channel", "pol_name", "antenna_id"], "left")
            d = d.withColumns({"re": F.coalesce("gain_re", F.lit(1.0)), "im": F.coalesce("gain_im", F.lit(0.0))})
        else:
            d = d.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)})
        weights = _array(beam.zero_null_antennas(d), cfg, shape, ["index", "pol", "beam", "canonical"], 0.0)

    residuals = {i: cfg.split_delays()[f][1] for i, f in enumerate(cfg.fpga_ids)}
    return Calibration(gains=gains, permutation=perm, weights=weights, delays_ns=delays, base_hz=base,
                       bandwidth_hz=width, residuals=residuals, tracking=follow)
