"""Dimension tables from the JSON files that configure a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_GAINS = "weights map<string, map<string, map<string, struct<real: double, imag: double>>>>"
_STREAMS = "fpgas map<string, struct<streams: array<struct<stream: int, antenna_id: int, polarization: int>>>>"
_CONFIG = ("array_location struct<latitude_deg: double, longitude_deg: double, height_m: double>, "
           "frequency_plan struct<base_frequency_hz: double, channel_bandwidth_hz: double>, "
           "antenna_positions map<string, map<string, struct<east: double, north: double, up: double>>>, "
           "network_interfaces map<string, string>")
_TARGETS = "array<struct<mode: string, ra_deg: double, dec_deg: double>>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each file parsed with an explicit schema; an unreadable file fails the job."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))


def stream_map(spark: SparkSession, path: str) -> DataFrame:
    d = _document(spark, path, _STREAMS).select(F.explode("d.fpgas").alias("fpga", "body"))
    d = d.select(F.col("fpga").cast("int").alias("fpga_id"), F.explode("body.streams").alias("s"))
    return d.select("fpga_id", "s.stream", "s.antenna_id", "s.polarization")


def gains(spark: SparkSession, path: str) -> DataFrame:
    """channel, pol_name, antenna_id, gain_re, gain_im; also the format of beam weights."""
    d = _document(spark, path, _GAINS).select(F.explode("d.weights").alias("channel", "by_pol"))
    d = d.select("channel", F.explode("by_pol").alias("pol_name", "by_antenna"))
    d = d.select("channel", "pol_name", F.explode("by_antenna").alias("antenna", "g"))
    return d.select(F.col("channel").cast("int").alias("channel"), "pol_name",
                    F.col("antenna").cast("int").alias("antenna_id"),
                    F.col("g.real").alias("gain_re"), F.col("g.imag").alias("gain_im"))


def fine_delays(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string, double>", {"mode": "FAILFAST"})).alias("k", "delay_ns"))
    return d.select(F.col("k").cast("int").alias("antenna_id"), "delay_ns")


def integer_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Flat JSON object of integers: source delays by id, signal counts by channel."""
    d = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string, bigint>", {"mode": "FAILFAST"})).alias("k", value))
    return d.select(F.col("k").cast("int").alias(key), value)


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Beam targets; a missing mode is zenith, an unknown one fails."""
    d = _document(spark, path, f"targets {_TARGETS}").select(F.posexplode("d.targets").alias("beam", "t"))
    mode = F.coalesce("t.mode", F.lit("zenith"))
    bad = F.concat(F.lit("unknown beam target mode "), mode)
    return d.select("beam", F.when(mode.isin("zenith", "radec"), mode).otherwise(F.raise_error(bad)).alias("mode"),
                    F.coalesce("t.ra_deg", F.lit(0.0)).alias("ra_deg"),
                    F.coalesce("t.dec_deg", F.lit(0.0)).alias("dec_deg"))


def site(spark: SparkSession, path: str) -> DataFrame:
    """One row: site position and frequency plan."""
    return _document(spark, path, _CONFIG).select("d.array_location.*", "d.frequency_plan.*")


def antenna_positions(spark: SparkSession, path: str) -> DataFrame:
    d = _document(spark, path, _CONFIG).select(F.explode("d.antenna_positions").alias("fpga", "m"))
    d = d.select(F.col("fpga").cast("int").alias("fpga_id"), F.explode("m").alias("antenna", "p"))
    return d.select("fpga_id", F.col("antenna").cast("int").alias("antenna_id"), "p.east", "p.north", "p.up")
