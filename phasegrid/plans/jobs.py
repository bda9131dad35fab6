"""The jobs a user runs: observe, adaptive spectra, antenna spectra, projections, folding."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.operators import adaptive, correlate, fold, ingest
from phasegrid.plans import blocks
from phasegrid.plans.blocks import SEQUENCE, Calibration, Folding


class Products(Mapping[str, DataFrame]):
    """Results of a job by name; each is planned when it is first asked for."""

    def __init__(self, **plans: Callable[[], DataFrame]) -> None:
        self._plans, self._made = plans, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._plans[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def packed_rows(products: DataFrame) -> DataFrame:
    return products.select("block", "channel", *SEQUENCE, F.col("vis_re").alias("re"), F.col("vis_im").alias("im"))


def counter_row(made: blocks.BlockProducts, packets: DataFrame) -> DataFrame:
    """Packets of a run by what became of them, as counted while blocks were formed, and the strays among them."""
    counts = packets.sparkSession.createDataFrame([tuple(made.counters[c] for c in ingest.COUNTERS)],
                                                  ", ".join(f"{c} long" for c in ingest.COUNTERS))
    strays = 0 if made.gaps.strays is None else made.gaps.strays.count()
    return counts.withColumn("stray_blocks", F.lit(strays).cast("long"))


def _wanted(plans: dict[str, Callable[[], DataFrame]], only: Collection[str] | None) -> Products:
    unknown = set(only or ()) - set(plans)
    if unknown:
        raise ValueError(f"no products {sorted(unknown)}")
    return Products(**{name: plan for name, plan in plans.items() if only is None or name in only})


def observe(packets: DataFrame, cfg: ArrayConfig, cal: Calibration, only: Collection[str] | None = None) -> Products:
    """Correlate, integrate and beamform: visibilities, gaps, outages, beams, block spectra, arrivals, counters.

    Payloads are unpacked once, before this returns; every result comes from what was
    written then.  All carry the counters of their blocks' first and last packet and how
    many packets are missing.  Stray counters are counted in ``stray_counters``.  With
    ``only``, no other results are made, and what they alone need is not written.
    """
    wanted = lambda *names: only is None or any(n in only for n in names)
    made = blocks.block_products(packets, cfg, cal, visibilities=wanted("visibilities", "eigen"), beams=cal.has_beams and wanted("beams"),
                                 spectra="block" if cal.has_beams and wanted("spectra") else None)
    packed = packed_rows(made.rows)
    plans = {"visibilities": lambda: correlate.accumulate_packed(packed, cfg, cfg.accumulate),
             "eigen": lambda: adaptive.eigen(packed, cfg),
             "missing": lambda: ingest.missing_by_integration(made.gaps, cfg),
             "outages": lambda: made.gaps.outages(cfg),
             "stray_counters": lambda: ingest.stray_packets(packets, cfg, made.gaps),
             "counters": lambda: counter_row(made, packets),
             "arrivals": lambda: ingest.arrival_flags(ingest.arrived_slots(packets, cfg), cfg, made.gaps)}
    if cal.has_beams:
        shape = {"pol": cfg.pols, "beam": cal.beams, "bin": cfg.block_samples}
        plans["beams"] = lambda: beam_rows(made.rows, cfg, cal.beams)
        plans["spectra"] = lambda: blocks.unpack_axis(made.rows, "spectrum", shape, "value", SEQUENCE)
    return _wanted(plans, only)


def beam_rows(products: DataFrame, cfg: ArrayConfig, beams: int) -> DataFrame:
    axes = {"pol": cfg.pols, "beam": beams, "s": cfg.block_samples}
    both = products.withColumn("z", F.arrays_zip("beam_re", "beam_im"))
    d = blocks.unpack_axis(both, "z", axes, "v", SEQUENCE)
    return d.select("block", "channel", "pol", "beam", "s", F.col("v.beam_re").alias("re"),
                    F.col("v.beam_im").alias("im"), *SEQUENCE)


def adaptive_spectra(packets: DataFrame, cfg: ArrayConfig, cal: Calibration, mode: str = "null",
                     modes: int | dict[int, int] = 1, delta: float | None = None, trim: int = 5,
                     only: Collection[str] | None = None) -> Products:
    """Original and interference-mitigated beams, their packet spectra and mode counts.

    With ``only``, no other results are made.  Beams are by far the longest: a whole block
    of samples, however few packets of it arrived.
    """
    wanted = lambda name: only is None or name in only
    made = blocks.block_products(packets, cfg, cal, visibilities=False, beams=wanted("beams"), spectra="packet" if wanted("spectra") else None,
                                 trim=trim, mitigation=mode, modes=modes, delta=delta)
    m = 2 * cal.beams
    counts = blocks.unpack_axis(made.rows, "k", {"pol": cfg.pols}, "k")
    shape = {"pol": cfg.pols, "beam": m, "bin": cfg.steps - 2 * trim}
    modes_axis = {"pol": cfg.pols, "mode": cfg.receivers}
    plans = {"beams": lambda: beam_rows(made.rows, cfg, m),
             "spectra": lambda: blocks.unpack_axis(made.rows, "spectrum", shape, "value", SEQUENCE),
             "counts": lambda: counts,
             "eigenvalues": lambda: blocks.unpack_axis(made.rows, "eigvals", modes_axis, "value", SEQUENCE),
             "statistics": lambda: adaptive.mode_statistics(counts, ["channel", "pol"]),
             "counters": lambda: counter_row(made, packets)}
    return _wanted(plans, only)


def antenna_spectra(packets: DataFrame, cfg: ArrayConfig, cal: Calibration, factor: int) -> DataFrame:
    """Power spectrum of every receiver over the block, averaged over ``factor`` bins (a short last group over its own)."""
    made = blocks.block_products(packets, cfg, cal, visibilities=False, spectra="antenna", factor=factor)
    axes = {"recv": cfg.receivers, "pol": cfg.pols, "bin": -(-cfg.block_samples // factor)}
    return blocks.unpack_axis(made.rows, "spectrum", axes, "value", SEQUENCE)


def beamformed_bandpass(packets: DataFrame, cfg: ArrayConfig, cal: Calibration, factor: int) -> DataFrame:
    """Power spectrum of every beam over the block, averaged over ``factor`` bins."""
    made = blocks.block_products(packets, cfg, cal, visibilities=False, spectra="block", factor=factor)
    axes = {"pol": cfg.pols, "beam": cal.beams, "bin": -(-cfg.block_samples // factor)}
    return blocks.unpack_axis(made.rows, "spectrum", axes, "value", SEQUENCE)


def projection_matrix(packets: DataFrame, cfg: ArrayConfig, cal: Calibration, k: int = 3,
                      runs: int = 4) -> DataFrame:
    """The k dominant vectors of the projection averaged over ``runs`` blocks."""
    packed = packed_rows(blocks.block_products(packets, cfg, cal).rows).drop(*SEQUENCE)
    mean = adaptive.mean_projection(adaptive.eigen(packed, cfg), cfg.receivers, k, runs)
    return adaptive.top_vectors(mean, cfg.receivers, k)


def project_beam(cal: Calibration, vectors: DataFrame, window: int, beam: int, k: int = 3) -> Calibration:
    """Calibration whose ``beam`` has the k strongest stored vectors removed: w - U (U^H w).

    ``vectors`` is the product of :func:`projection_matrix`; one window of it holds
    channels x pols x k vectors, so it is read like any other dimension table.
    """
    rows = vectors.where((F.col("window") == window) & (F.col("p") == F.col("q")) & (F.col("rank") < k)).select(
        "channel", "p", "rank", "u_re", "u_im").collect()
    if not rows:
        raise ValueError(f"no vectors for window {window}")
    if not 0 <= beam < cal.weights.shape[2]:
        raise ValueError(f"no beam {beam}")
    weights = cal.weights.copy()
    original = cal.weights[:, :, beam]
    for r in rows:
        u = np.array(r["u_re"]) + 1j * np.array(r["u_im"])
        weights[r["channel"], r["p"], beam] -= u * (u.conj() @ original[r["channel"], r["p"]])
    return replace(cal, weights=weights)


def pulsar_fold(packets: DataFrame, cfg: ArrayConfig, cal: Calibration, period: float, n_bins: int,
                delays: dict[int, int] | None = None) -> DataFrame:
    """Fold the beam power of every channel, polarization and beam at a period in samples.

    A block is folded where its beams are formed; what moves is sums by phase bin, so
    the shuffle does not grow with the samples of a block.
    """
    made = blocks.block_products(packets, cfg, cal, visibilities=False, folding=Folding(period, n_bins, delays or {}))
    both = made.rows.withColumn("z", F.arrays_zip("fold_total", "fold_hits"))
    shape = {"pol": cfg.pols, "beam": cal.beams, "bin": n_bins}
    keys = ["channel", "pol", "beam"]
    folded = blocks.unpack_axis(both, "z", shape, "v").groupBy(*keys, "bin").agg(
        F.sum("v.fold_total").alias("total"), F.sum("v.fold_hits").alias("hits"))
    return fold.normalise_fold(folded, keys, n_bins)


def offline_correlation(packets: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Decode a capture, scale it and correlate every pair over the whole capture."""
    packed = packed_rows(blocks.block_products(packets, cfg, Calibration()).rows).drop(*SEQUENCE)
    return (correlate.unpack(packed, cfg).groupBy("channel", "i", "j", "p", "q")
            .agg(F.sum("re").alias("re"), F.sum("im").alias("im")))
