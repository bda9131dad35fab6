"""Wire frames: Ethernet/IP/UDP header, custom header, scales, complex int8 samples.

Layout (little endian custom header): u64 sample counter, u32 source id, u16
frequency channel, 8 bytes padding; then int16 scales ``[recv][pol]`` and int8
pairs ``[step][recv][pol]``.  Header fields are decoded with JVM expressions;
sample bytes stay binary until a task needs the numbers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.functions.numeric import _c, idiv

ETHERNET_BYTES = 42       # Ethernet 14 + IP 20 + UDP 8
HEADER_BYTES = 22
MIN_FRAME = 64            # shorter frames are ignored
SOURCE_IP_OFFSET = 26
SLOT_BYTES = 4096         # a receive slot; longer frames are set aside


def little_endian(binary, offset, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes at ``offset`` (0-based)."""
    b = _c(binary)
    off = _c(offset)
    parts = [F.substring(b, off + 1 + i, 1) for i in reversed(range(size))]
    return F.conv(F.hex(F.concat(*parts)), 16, 10).cast("long")


def to_little_endian(value, size: int) -> Column:
    """Inverse of :func:`little_endian`."""
    v = _c(value).cast("long")
    digits = F.lpad(F.hex(v), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def bytes_of(values, size: int = 1) -> Column:
    """Signed integers of an array packed as little-endian bytes."""
    @F.pandas_udf("binary")
    def pack(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: np.asarray(a).astype(f"<i{size}").tobytes())

    return pack(_c(values))


def encode_frame(sample_count, source_id, channel, scales, samples, ip_octet=0) -> Column:
    """Build a full frame; ``scales`` and ``samples`` are integer arrays in wire order."""
    network = bytearray(ETHERNET_BYTES)
    network[12:15] = b"\x08\x00\x45"                 # IPv4 in Ethernet
    network[23] = 17                                  # UDP
    network[SOURCE_IP_OFFSET:SOURCE_IP_OFFSET + 4] = bytes([10, 0, 0, 1])

    @F.pandas_udf("binary")
    def build(count: pd.Series, source: pd.Series, chan: pd.Series, octet: pd.Series,
              scale: pd.Series, data: pd.Series) -> pd.Series:
        frames = []
        for c, s, f, o, k, x in zip(count, source, chan, octet, scale, data):
            head = bytearray(network)
            head[SOURCE_IP_OFFSET + 2] = o
            frames.append(bytes(head) + struct.pack("<QIH8x", c, s, f)
                          + np.asarray(k).astype("<i2").tobytes() + np.asarray(x).astype("i1").tobytes())
        return pd.Series(frames)

    # marked so that a filter on the frame is not pushed below it, which would build it twice
    return build.asNondeterministic()(_c(sample_count).cast("long"), _c(source_id).cast("int"), _c(channel).cast("int"),
                 _c(ip_octet).cast("int"), _c(scales), _c(samples))


def parse_frames(frames: DataFrame, cfg: ArrayConfig, source_from_ip: bool = False,
                 frame: str = "frame") -> DataFrame:
    """Decode the headers of ``frame`` and keep every other column.

    Frames below 64 bytes are ignored.  A frame longer than a bare payload
    carries the 42 byte network header.  A zero sample counter is an error.
    """
    f = F.col(frame)
    bare = cfg.scale_bytes + cfg.sample_bytes + HEADER_BYTES
    d = (frames.where(F.length(f) >= MIN_FRAME)
         .withColumn("__off", F.when(F.length(f) > bare, ETHERNET_BYTES).otherwise(0)))
    source = little_endian(f, F.col("__off") + 8, 4)
    if source_from_ip:
        octet = little_endian(f, F.lit(SOURCE_IP_OFFSET + 2), 1)
        source = F.when(F.col("__off") > 0, octet).otherwise(source)
    count = little_endian(f, F.col("__off"), 8)
    body = F.col("__off") + HEADER_BYTES
    return (d.withColumn("__count", count)
            .select(*[c for c in frames.columns if c != frame],
                    F.when(F.col("__count") == 0, F.raise_error(F.lit("sample counter is zero")).cast("long"))
                    .otherwise(F.col("__count")).alias("sample_count"),
                    source.cast("int").alias("fpga_id"),
                    little_endian(f, F.col("__off") + 12, 2).cast("int").alias("freq_channel"),
                    F.substring(f, body + 1, F.length(f)).alias("payload"),
                    (F.length(f) - body).alias("payload_size")))


def sequence_and_channel(frame) -> tuple[Column, Column]:
    """Counter and channel of a full frame; null below the 58 bytes that hold them."""
    f = _c(frame)
    ok = F.length(f) >= 58
    off = F.lit(ETHERNET_BYTES)
    return F.when(ok, little_endian(f, off, 8)), F.when(ok, little_endian(f, off + 12, 2).cast("int"))


def oversized(frames: DataFrame, slot_bytes: int, frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Split captured frames into usable ones and ones to warn about.

    A frame is unusable when it was captured longer than its declared length or
    does not fit a receive slot.
    """
    bad = (F.length(frame) > F.col("wire_length")) | (F.length(frame) > slot_bytes)
    return frames.where(~bad), frames.where(bad)


#: What :func:`gate` counts on its way, once a frame.
GATE_COUNTERS = ["short", "oversized", "not_udp"]


def gate(frames: DataFrame, cfg: ArrayConfig, seen: Observation | None = None, slot_bytes: int = SLOT_BYTES,
         frame: str = "frame") -> DataFrame:
    """Frames that can be packets of this array; ``seen`` receives GATE_COUNTERS in the same pass.

    Frames go that are below 64 bytes, that were captured longer than their declared
    length or do not fit a receive slot, or that have a network header other than IPv4 and
    UDP.  A bare payload has none.
    """
    f, length = F.col(frame), F.length(frame)
    bare = HEADER_BYTES + cfg.scale_bytes + cfg.sample_bytes
    declared = F.coalesce(F.col("wire_length"), length) if "wire_length" in frames.columns else length
    short = F.coalesce(length < MIN_FRAME, F.lit(True))
    long = ~short & ((length > declared) | (length > slot_bytes))
    udp = (F.hex(F.substring(f, 13, 2)) == "0800") & (F.hex(F.substring(f, 24, 1)) == "11")
    other = ~short & ~long & (length > bare) & ~udp
    flags = {"__short": short, "__long": long, "__other": other}
    d = frames.withColumns(flags)
    if seen is not None:
        d = d.observe(seen, *[F.count_if(flag).alias(name) for flag, name in zip(flags, GATE_COUNTERS, strict=True)])
    return d.where("not (__short or __long or __other)").drop(*flags)


def udp_payloads(frames: DataFrame, min_bytes: int = 106, frame: str = "frame") -> DataFrame:
    """UDP payload of full frames; frames below 106 bytes or not UDP are dropped."""
    f = F.col(frame)
    return (frames.where((F.length(f) >= min_bytes) & (F.hex(F.substring(f, 24, 1)) == "11"))
            .withColumn("payload", F.substring(f, ETHERNET_BYTES + 1, F.length(f))).drop(frame))


def split_payload(payload: bytes, cfg: ArrayConfig) -> tuple[np.ndarray, np.ndarray]:
    """Scales ``[recv][pol]`` and complex samples ``[step][recv][pol]`` of one payload."""
    n, p, u = cfg.recv_per_fpga, cfg.pols, cfg.steps
    scales = np.frombuffer(payload, dtype="<i2", count=n * p).reshape(n, p)
    raw = np.frombuffer(payload, dtype=np.int8, count=u * n * p * 2, offset=n * p * 2)
    raw = raw.reshape(u, n, p, 2).astype(np.float64)
    return scales, raw[..., 0] + 1j * raw[..., 1]


def payload_samples(packets: DataFrame, cfg: ArrayConfig, keep: list[str]) -> DataFrame:
    """Long form of packet payloads: one row per (step, receiver in packet, pol)."""
    n, p, u = cfg.recv_per_fpga, cfg.pols, cfg.steps
    cells = u * n * p

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            body = pdf.pop("payload")
            raw = np.frombuffer(b"".join(body), dtype=np.int8).reshape(len(pdf), -1)
            scales = np.ascontiguousarray(raw[:, :n * p * 2]).view("<i2")
            pdf["scales"] = list(scales.astype(np.int32))
            pdf["samples"] = list(raw[:, n * p * 2:].astype(np.int32))
            yield pdf

    kept = packets.select(*keep, "payload")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "payload")
    wide = kept.mapInPandas(decode, f"{schema}, scales array<int>, samples array<int>")
    return (wide.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
            .select(*keep, idiv(F.col("__i"), n * p).cast("int").alias("t"),
                    F.pmod(idiv(F.col("__i"), p), F.lit(n)).cast("int").alias("n"),
                    F.pmod(F.col("__i"), F.lit(p)).cast("int").alias("pol"),
                    F.col("samples")[F.col("__i") * 2].alias("re"),
                    F.col("samples")[F.col("__i") * 2 + 1].alias("im"),
                    F.col("scales")[F.pmod(F.col("__i"), F.lit(n * p)).cast("int")].alias("scale")))


# --- the second, beamformer-style packet -----------------------------------------

def beam_packet_header(payload) -> dict[str, Column]:
    """Header columns of the beamformer packet (96 byte header, then weights)."""
    b = _c(payload)
    le = lambda off, size: little_endian(b, F.lit(off), size)
    header = {"seq_no": le(0, 8), "sample_no": le(8, 8), "scale_bits": le(32, 4),
              "first_chan": le(48, 4), "num_chan": le(52, 2).cast("int"),
              "valid_chan": le(54, 2).cast("int"), "num_sample": le(56, 2).cast("int"),
              "beam_id": le(58, 2).cast("int"), "sample_per_weight": le(67, 1).cast("int")}
    weights = F.try_divide(header["num_sample"], header["sample_per_weight"]) * 2 * header["num_chan"]
    header["data_offset"] = (F.lit(96) + F.ceil(weights / 16) * 16).cast("int")
    return header


def beam_packet_power(packets: DataFrame, beam: int) -> DataFrame:
    """Mean power per complex sample for each channel and polarization of one beam."""
    d = packets.select("*", *[c.alias(k) for k, c in beam_packet_header("payload").items()])
    d = d.where(F.col("beam_id") == beam)

    def power(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.payload, dtype=np.int8, offset=row.data_offset,
                                  count=row.valid_chan * row.num_sample * 4).astype(np.int64)
                scale = float(np.array([row.scale_bits], dtype=np.uint32).view(np.float32)[0])
                total = (x * x).reshape(row.valid_chan, 2, -1).sum(axis=2)
                mean = total / (scale * scale) / row.valid_chan / row.num_sample
                out += [(row.seq_no, row.first_chan + c, p, float(mean[c, p]))
                        for c in range(row.valid_chan) for p in range(2)]
            yield pd.DataFrame(out, columns=["seq_no", "channel", "pol", "power"])

    return (d.select("payload", "seq_no", "scale_bits", "first_chan", "valid_chan", "num_sample", "data_offset")
            .mapInPandas(power, "seq_no long, channel long, pol int, power double"))
