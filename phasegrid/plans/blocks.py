"""Array work on one assembled block of one channel.

Spark filters, assigns, de-duplicates and groups the packets while payloads stay
binary.  A group holds at most ``fpgas * (packets + 2)`` payloads; these helpers
turn it into a cube and reduce it to the products of the block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.functions.numeric import SPEED_OF_LIGHT
from phasegrid.operators import adaptive, fold, ingest
from phasegrid.operators.correlate import packed_triangle
from phasegrid.session import materialize


@dataclass(frozen=True)
class Tracking:
    """Beams that follow their targets: the direction of every beam in each refresh epoch.

    An epoch holds from ``starts`` on, in samples since the first packet, until the next
    one's.  Weights are worked out where a block is reduced, from three numbers a beam.
    """

    starts: np.ndarray          # [epoch], ascending, the first one 0
    directions: np.ndarray      # [epoch][beam][l, m, n]
    positions: np.ndarray       # [receiver][east, north, up] in metres
    connected: np.ndarray       # [receiver]: false for one without an antenna

    def __post_init__(self) -> None:
        if len(self.starts) != len(self.directions) or not len(self.starts) or self.starts[0] != 0 or (np.diff(self.starts) <= 0).any():
            raise ValueError("epochs must start at 0 and ascend, with directions for each")

    def epoch(self, sample: int) -> int:
        """The last epoch that starts at a sample or before; samples before the first packet are in the first."""
        return max(int(np.searchsorted(self.starts, sample, side="right")) - 1, 0)

    def weights(self, sample: int, freq_hz: float, pols: int) -> np.ndarray:
        """``[pol][beam][receiver]`` for a block that starts at ``sample``; a receiver without antenna gets exactly zero."""
        path = self.directions[self.epoch(sample)] @ self.positions.T
        w = np.exp(-2j * np.pi * freq_hz / SPEED_OF_LIGHT * path) / len(self.positions)
        return np.broadcast_to(np.where(self.connected, w, 0), (pols, *w.shape))


@dataclass(frozen=True)
class Calibration:
    """Dimension data of a run, bounded by the array shape (all optional)."""

    gains: np.ndarray | None = None          # [channel][pol][receiver], already inverted
    permutation: np.ndarray | None = None    # [receiver][pol][2]: hardware receiver (-1) and pol
    weights: np.ndarray | None = None        # [channel][pol][beam][receiver]
    delays_ns: np.ndarray | None = None      # [receiver]
    base_hz: float = 0.0
    bandwidth_hz: float = 0.0
    residuals: dict[int, int] = field(default_factory=dict)   # sample delay by source position
    tracking: Tracking | None = None         # instead of fixed weights

    @property
    def has_beams(self) -> bool:
        return self.weights is not None or self.tracking is not None

    @property
    def beams(self) -> int:
        return self.weights.shape[-2] if self.tracking is None else self.tracking.directions.shape[1]

    def channel_hz(self, cfg: ArrayConfig, channel: int) -> float:
        return self.base_hz + (cfg.min_channel + channel) * self.bandwidth_hz

    def block_weights(self, cfg: ArrayConfig, block: int, channel: int) -> np.ndarray | None:
        """Weights ``[pol][beam][receiver]`` of a block."""
        if self.tracking is not None:
            return self.tracking.weights(block * cfg.packets * cfg.step, self.channel_hz(cfg, channel), cfg.pols)
        return None if self.weights is None else self.weights[channel]


@dataclass(frozen=True)
class Folding:
    """Period in samples, phase bins, and delays in samples by channel."""

    period: float
    bins: int
    delays: dict[int, int] = field(default_factory=dict)


def decode_payloads(payloads: Sequence[bytes], cfg: ArrayConfig) -> np.ndarray:
    """Scaled complex samples ``[packet][step][receiver][pol]`` of binary payloads."""
    n, p, u, head = cfg.recv_per_fpga, cfg.pols, cfg.steps, cfg.scale_bytes
    need = head + cfg.sample_bytes
    raw = np.frombuffer(b"".join(x[:need] for x in payloads), dtype=np.int8).reshape(len(payloads), need)
    scales = np.ascontiguousarray(raw[:, :head]).view("<i2").reshape(-1, 1, n, p).astype(float)
    z = raw[:, head:].reshape(-1, u, n, p, 2)
    x = np.empty(z.shape[:-1], dtype=complex)
    x.real, x.imag = z[..., 0] * scales, z[..., 1] * scales
    return x


def block_cube(source: np.ndarray, pkt: np.ndarray, payloads: np.ndarray, channel: int, cfg: ArrayConfig,
               cal: Calibration) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated, aligned samples ``[receiver][pol][time]`` and the packets its time axis covers.

    Without delays a packet nobody sent is left out; otherwise the axis covers the
    whole block (gaps are zero) because alignment and transforms need it.
    """
    r, n, p, u = cfg.recv_per_fpga, cfg.packets, cfg.pols, cfg.steps
    shifted = any(cal.residuals.values()) or cal.delays_ns is not None
    if not shifted:
        own = np.flatnonzero((pkt >= 0) & (pkt < n))
        source, pkt, payloads = source[own], pkt[own], payloads[own]
    x = decode_payloads(payloads, cfg)
    if cal.gains is not None:
        x *= cal.gains[channel].T.reshape(cfg.fpgas, r, p)[source][:, None]
    slots = np.arange(-1, n + 1) if shifted else np.unique(pkt)
    cube = np.zeros((cfg.fpgas, len(slots), r, p, u), dtype=complex)
    cube[source, np.searchsorted(slots, pkt)] = x.transpose(0, 2, 3, 1)
    cube = cube.transpose(0, 2, 3, 1, 4).reshape(cfg.fpgas, r, p, -1)
    if shifted:
        start = [u + cal.residuals.get(f, 0) for f in range(cfg.fpgas)]
        cube = np.stack([cube[f, ..., s:s + n * u] for f, s in enumerate(start)])
        slots = slots[1:-1]
    cube = cube.reshape(cfg.receivers, p, -1)
    if cal.permutation is not None:
        recv, pol = cal.permutation[..., 0], cal.permutation[..., 1]
        cube = np.where((recv >= 0)[..., None], cube[np.maximum(recv, 0), pol], 0)
    if cal.delays_ns is not None:
        freq = cal.channel_hz(cfg, channel) + np.fft.fftfreq(n * u) * cal.bandwidth_hz
        turn = np.exp(-2j * np.pi * freq[None, :] * cal.delays_ns[:, None] * 1e-9)
        cube = np.fft.ifft(np.fft.fft(cube, axis=2) * turn[:, None, :], axis=2)
    return cube, slots


def whole_block(series: np.ndarray, slots: np.ndarray, cfg: ArrayConfig) -> np.ndarray:
    """Series on the full time axis of a block, zero where no packet arrived."""
    if len(slots) == cfg.packets:
        return series
    full = np.zeros((*series.shape[:-1], cfg.packets, cfg.steps), dtype=complex)
    full[..., slots, :] = series.reshape(*series.shape[:-1], len(slots), cfg.steps)
    return full.reshape(*series.shape[:-1], -1)


def form_beams(cube: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``[pol][beam][time]`` from weights ``[pol][beam][receiver]``."""
    return np.einsum("pbr,rps->pbs", weights, cube)


def packet_spectra_sum(beams: np.ndarray, steps: int, trim: int) -> np.ndarray:
    """Per-packet spectra, shifted and trimmed, magnitudes summed over packets."""
    p, b, s = beams.shape
    spec = np.fft.fft(beams.reshape(p, b, s // steps, steps), axis=3)
    spec = np.fft.fftshift(spec, axes=3)[..., trim:steps - trim]
    return np.abs(spec).sum(axis=2)


def assembled(packets: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Parsed packets to (block, channel, source, pkt, payload), one row per slot."""
    return ingest.assemble_payloads(packets, cfg)


PRODUCT_SCHEMA = ("block long, channel int, missing int, vis_re array<double>, vis_im array<double>, "
                  "beam_re array<double>, beam_im array<double>, spectrum array<double>, "
                  "k array<int>, eigvals array<double>, fold_total array<double>, fold_hits array<long>")
#: Columns of every product row: counters of the first and last packet of the block, and how many packets are missing.
SEQUENCE = ["start_seq", "end_seq", "missing"]
PRODUCT_TYPES = dict(f.split() for f in PRODUCT_SCHEMA.split(", "))


_ARROW = {"long": pa.int64(), "int": pa.int32(), **{f"array<{k}>": pa.list_(t) for k, t in (
    ("double", pa.float64()), ("int", pa.int32()), ("long", pa.int64()))}}


def _cell(value: Any, kind: pa.DataType) -> pa.Array:
    """One value as a column of one row."""
    if value is None or not pa.types.is_list(kind):
        return pa.array([value], kind)
    return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value, kind.value_type))


def _flat(x) -> np.ndarray | None:
    return None if x is None else np.ascontiguousarray(x).ravel()


def reduce_blocks(arrived: DataFrame, cfg: ArrayConfig, cal: Calibration, *, visibilities: bool = True,
                  beams: bool = False, spectra: str | None = None, trim: int = 5, factor: int = 1,
                  mitigation: str | None = None, modes: int | dict[int, int] = 1, delta: float | None = None,
                  folding: Folding | None = None, arrow: bool = False) -> DataFrame:
    """One product row per (block, channel) that holds a packet of its own.

    ``spectra``: ``"packet"`` sums trimmed packet spectra of the beams, ``"block"``
    and ``"antenna"`` take the power spectrum of the whole block (beams or
    receivers) averaged over ``factor`` bins.  ``mitigation``: ``"null"`` or
    ``"shrink"`` adds a projected copy of every beam; ``modes`` is the number of
    signal vectors, or a map by channel where an absent channel has none.  ``folding``
    adds the block's share of a fold of the beam powers, sums and hits by bin.  ``arrow``
    hands blocks over as Arrow tables, at less than half the time for blocks of few packets.
    """
    # A block can be a few packets, and every column of a result has its price: only those made are handed over.
    made = ["block", "channel", "missing"]
    made += ["vis_re", "vis_im"] * visibilities + ["beam_re", "beam_im"] * beams + ["spectrum"] * bool(spectra)
    made += ["k", "eigvals"] * bool(mitigation) + ["fold_total", "fold_hits"] * bool(folding)

    def reduced(block: int, channel: int, source: np.ndarray, pkt: np.ndarray, payloads: np.ndarray) -> dict[str, Any] | None:
        own = int(((pkt >= 0) & (pkt < cfg.packets)).sum())
        if own == 0:   # nothing but halo packets of the neighbours
            return None
        cube, slots = block_cube(source, pkt, payloads, channel, cfg, cal)
        vis = None
        if visibilities or mitigation:
            vis = packed_triangle(cube.reshape(cfg.receivers * cfg.pols, -1), cfg.receivers, cfg.pols)
        out = {"block": block, "channel": channel,
               "missing": cfg.fpgas * cfg.packets - own}
        weights = cal.block_weights(cfg, block, channel)
        counts = lam = y = spec = None
        if mitigation:
            fixed = modes.get(channel, 0) if isinstance(modes, dict) else modes
            same = np.stack([adaptive.hermitian(vis[None, :, p, p], cfg.receivers)[0] for p in range(cfg.pols)])
            lam, _, counts, proj = adaptive.decompose(same, np.full(cfg.pols, fixed), delta, mitigation)
            weights = np.concatenate([weights, weights @ proj], axis=1)
        if weights is not None and (beams or folding or spectra in ("packet", "block")):
            y = form_beams(cube, weights)
        if spectra == "packet":
            spec = packet_spectra_sum(y, cfg.steps, trim)
        elif spectra:
            series = whole_block(y if spectra == "block" else cube, slots, cfg)
            power = np.abs(np.fft.fft(series, axis=-1)) ** 2
            edges = np.arange(0, power.shape[-1], factor)     # a short last group is the mean of the bins it has
            spec = np.add.reduceat(power, edges, axis=-1) / np.diff(edges, append=power.shape[-1])
        if not visibilities:
            vis = None
        y = whole_block(y, slots, cfg) if beams or folding else None
        total = hits = None
        if folding:
            sample = block * cfg.block_samples + np.arange(cfg.block_samples) - folding.delays.get(channel, 0)
            total, hits = fold.fold_block(np.abs(y) ** 2, sample, folding.period, folding.bins)
        y = y if beams else None
        out.update(vis_re=_flat(None if vis is None else vis.real), vis_im=_flat(None if vis is None else vis.imag),
                   beam_re=_flat(None if y is None else y.real), beam_im=_flat(None if y is None else y.imag),
                   spectrum=_flat(spec), k=_flat(None if counts is None else counts.astype(np.int32)),
                   eigvals=_flat(lam), fold_total=_flat(total), fold_hits=_flat(hits))
        return out

    def by_pandas(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        out = reduced(*key, *(pdf[c].to_numpy() for c in ("source", "pkt", "payload")))
        return pd.DataFrame(columns=made) if out is None else pd.DataFrame({c: [out[c]] for c in made})

    def by_arrow(key: tuple[pa.Scalar, ...], packets: pa.Table) -> pa.Table:
        schema = pa.schema([(c, _ARROW[PRODUCT_TYPES[c]]) for c in made])
        payloads = np.array(packets.column("payload").to_pylist(), object)
        out = reduced(*(k.as_py() for k in key), packets.column("source").to_numpy(), packets.column("pkt").to_numpy(), payloads)
        return schema.empty_table() if out is None else pa.table([_cell(out[f.name], f.type) for f in schema], schema)

    groups = arrived.select("block", "channel", "source", "pkt", "payload").groupBy("block", "channel")
    schema = ", ".join(f"{c} {PRODUCT_TYPES[c]}" for c in made)
    rows = groups.applyInArrow(by_arrow, schema) if arrow else groups.applyInPandas(by_pandas, schema)
    return rows.select(*[F.col(c) if c in made else F.lit(None).cast(kind.replace("long", "bigint")).alias(c)
                         for c, kind in PRODUCT_TYPES.items()])


@dataclass(frozen=True)
class BlockProducts:
    """Product rows of a run, written once, without the blocks of stray counters; gaps, and packet counters."""

    rows: DataFrame
    gaps: ingest.BlockGaps
    counters: dict[str, int]


def block_products(packets: DataFrame, cfg: ArrayConfig, cal: Calibration, **what: Any) -> BlockProducts:
    """:func:`reduce_blocks` of packets, with the counters of each block's first and last packet.

    All jobs go through here, so that one rule for stray counters holds for all.  The
    rows are written as they are made, which cuts the lineage after the pass that unpacks
    the payloads; packets are counted in the same pass (an earlier one finds the first packet).
    """
    start, seen = ingest.usable_start(packets, cfg), Observation()
    rows = reduce_blocks(ingest.assemble_payloads(packets, cfg, start, seen), cfg, cal, arrow=True, **what)
    rows = materialize(ingest.block_bounds(rows, cfg, start), "block-products")
    own = rows.groupBy("block").agg(F.sum(F.lit(cfg.fpgas * cfg.packets) - F.col("missing")).alias("n"))
    gaps = ingest.block_gaps(own)
    return BlockProducts(gaps.without_strays(rows), gaps, seen.get)


def unpack_axis(products: DataFrame, column: str, dims: dict[str, int], value: str, keep: list[str] = ()) -> DataFrame:
    """Long rows of a flat product array with the given axes, outermost first, and the columns to ``keep``."""
    from phasegrid.functions.numeric import idiv

    d = products.where(F.col(column).isNotNull()).select("block", "channel", *keep, F.posexplode(column).alias("__n", value))
    out, stride = [], 1
    for name, size in reversed(dims.items()):
        out.append(F.pmod(idiv(F.col("__n"), stride), F.lit(size)).cast("int").alias(name))
        stride *= size
    return d.select("block", "channel", *reversed(out), value, *keep)
