"""Shape of a receiver array, validated once when a job is planned."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ArrayConfig:
    """Axis lengths and wiring constants that bound every per-block group.

    One ``(block, channel)`` group never holds more than
    ``fpgas * recv_per_fpga * pols * (packets + 2) * steps`` samples, which is
    what makes it safe to hand such a group to a single task.
    """

    channels: int
    fpgas: int
    recv_per_fpga: int
    steps: int                    # time steps in one packet
    packets: int                  # packets in one correlation block
    pols: int = 2
    beams: int = 1
    min_channel: int = 0
    seq_step: int | None = None   # sample counter increment between packets
    accumulate: int = 1           # blocks per visibility integration
    fpga_ids: tuple[int, ...] = ()
    fpga_delays: dict[int, int] = field(default_factory=dict)  # samples, by fpga id

    def __post_init__(self) -> None:
        for name in ("channels", "fpgas", "recv_per_fpga", "steps", "packets", "pols",
                     "beams", "accumulate"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.fpgas > 256:
            raise ValueError("at most 256 FPGA sources")
        ids = self.fpga_ids or tuple(range(self.fpgas))
        if len(ids) != self.fpgas or len(set(ids)) != self.fpgas:
            raise ValueError("fpga_ids must list each source once")
        object.__setattr__(self, "fpga_ids", tuple(ids))
        unknown = set(self.fpga_delays) - set(ids)
        if unknown:
            raise ValueError(f"delays for unknown FPGA ids {sorted(unknown)}")

    @property
    def step(self) -> int:
        return self.seq_step or self.steps

    @property
    def receivers(self) -> int:
        return self.fpgas * self.recv_per_fpga

    @property
    def baselines(self) -> int:
        return self.receivers * (self.receivers + 1) // 2

    @property
    def block_samples(self) -> int:
        return self.packets * self.steps

    @property
    def scale_bytes(self) -> int:
        return self.recv_per_fpga * self.pols * 2

    @property
    def sample_bytes(self) -> int:
        return self.steps * self.recv_per_fpga * self.pols * 2

    @property
    def packets_per_block(self) -> int:
        """Packets expected in a complete block, halo not counted."""
        return self.channels * self.fpgas * self.packets

    def split_delays(self) -> dict[int, tuple[int, int]]:
        """Delay of each FPGA as (whole packets in samples, remaining samples)."""
        return {f: nearest_multiple(self.fpga_delays.get(f, 0), self.step) for f in self.fpga_ids}


def nearest_multiple(value: int, multiple: int) -> tuple[int, int]:
    """Closest multiple (halves away from zero) and the signed remainder."""
    sign = -1 if value < 0 else 1
    closest = sign * ((2 * abs(value) + multiple) // (2 * multiple)) * multiple
    return closest, value - closest


PACKET_SCHEMA = T.StructType([
    T.StructField("arrival", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("fpga_id", T.IntegerType()),
    T.StructField("freq_channel", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
])

FRAME_SCHEMA = T.StructType([
    T.StructField("arrival", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("wire_length", T.IntegerType()),
    T.StructField("frame", T.BinaryType()),
])
