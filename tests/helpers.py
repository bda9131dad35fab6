"""Packets and payloads for fixtures."""

from __future__ import annotations

import numpy as np

SCHEMA = "arrival long, sample_count long, fpga_id int, freq_channel int, payload binary"


def payload(cfg, value, scale=1):
    """Payload bytes; ``value`` and ``scale`` are constants or functions of (t, n, p) and (n, p)."""
    u, n, p = cfg.steps, cfg.recv_per_fpga, cfg.pols
    at = value if callable(value) else (lambda t, r, q: value)
    sc = scale if callable(scale) else (lambda r, q: scale)
    scales = np.array([[sc(r, q) for q in range(p)] for r in range(n)], dtype="<i2")
    x = np.array([[[at(t, r, q) for q in range(p)] for r in range(n)] for t in range(u)], dtype=complex)
    data = np.stack([x.real, x.imag], axis=-1).astype("i1")
    return scales.tobytes() + data.tobytes()


def packets(spark, rows):
    """DataFrame of (sample_count, fpga, channel, payload) in list order."""
    data = [(i, int(s), int(f), int(c), p if p is not None else b"") for i, (s, f, c, p) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def full_block(cfg, start, value, scale=1, blocks=1, halo=False, channels=None, fpga_value=None):
    """All packets of ``blocks`` blocks, optionally with the packet before and after."""
    lo, hi = (-1, cfg.packets * blocks + 1) if halo else (0, cfg.packets * blocks)
    order = [k for k in range(hi) if k >= 0] + ([-1] if lo < 0 else [])   # the earliest one arrives last
    rows = []
    for k in order:
        for c in channels or range(cfg.channels):
            for f in cfg.fpga_ids:
                v = fpga_value(f, c, k) if fpga_value else value
                rows.append((start + k * cfg.step, f, cfg.min_channel + c, payload(cfg, v, scale)))
    return rows
