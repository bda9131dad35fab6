"""Choosing a packet source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from phasegrid.config import ArrayConfig
from phasegrid.sources import pcap, wire


def open_capture(spark: SparkSession, kind: str, path: str, cfg: ArrayConfig, *, streaming: bool = False,
                 source_from_ip: bool = False, split_bytes: int = pcap.SPLIT_BYTES, seen: Observation | None = None) -> DataFrame:
    """Parsed packets of a capture: ``pcap`` or pcapng files, or ``table`` of stored frames.

    Files are cut every ``split_bytes``.  Frames that cannot be packets are left out (see
    :func:`wire.gate`) and counted in ``seen``, which a stream does not take.

    Sockets and kernel-bypass capture belong to the machine that receives the
    packets; here a recorder drops files and the stream picks them up.
    """
    if kind == "pcap":
        frames = pcap.stream_pcap(spark, path) if streaming else pcap.read_pcap(spark, path, split_bytes=split_bytes)
        frames = pcap.with_arrival(frames).drop("file", "position")
    elif kind == "table":
        if streaming:
            frames = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        else:
            frames = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown capture backend {kind!r}")
    return wire.parse_frames(wire.gate(frames, cfg, None if streaming else seen), cfg, source_from_ip)
