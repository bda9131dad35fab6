"""Scales, gains and delays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from phasegrid.functions import numeric as N


def scale_and_gain(samples: DataFrame) -> DataFrame:
    """(re, im) * scale * gain, each receiver with its own scale."""
    re, im = N.cmul(F.col("re") * F.col("scale"), F.col("im") * F.col("scale"), "gain_re", "gain_im")
    return samples.withColumns({"re": re, "im": im})


def gains_for_streams(streams: DataFrame, gains: DataFrame, keys: list[str], keep_tiny: bool = False) -> DataFrame:
    """Inverted gain of every stream; identity where none is configured."""
    d = streams.join(gains, keys, "left")
    re, im = N.inverse_gain(F.coalesce("gain_re", F.lit(1)), F.coalesce("gain_im", F.lit(0)), keep_tiny)
    return d.withColumns({"gain_re": re, "gain_im": im})


def delays_for_receivers(receivers: DataFrame, delays: DataFrame) -> DataFrame:
    """Fine delay of every receiver by antenna; 0 for absent antennas."""
    d = receivers.join(delays, ["run", "antenna_id"], "left")
    delay = F.when(F.col("antenna_id") >= 0, F.col("delay_ns"))
    return d.withColumn("delay_ns", F.coalesce(delay, F.lit(0.0)))


def align_samples(samples: DataFrame, residual, steps: int, packets: int) -> DataFrame:
    """Shift a source by its residual delay and keep the block without its halo.

    ``pkt`` runs from -1 to ``packets``; the result has ``s`` in
    0..packets*steps-1.  A positive residual reads later samples.
    """
    s = F.col("pkt") * steps + F.col("t") - residual
    return samples.withColumn("s", s).where((F.col("s") >= 0) & (F.col("s") < packets * steps))


def fine_delay(series: DataFrame, coarse_hz, bandwidth_hz: float) -> DataFrame:
    """Delay correction of whole series in the frequency domain.

    ``series`` has array columns ``re`` and ``im`` of one length and a
    ``delay_ns`` column; all rows of a batch of equal length transform at once.
    """
    d = series.withColumn("__hz", coarse_hz)
    cols = [f for f in d.schema if f.name not in ("re", "im", "__hz")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols)

    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["re"].map(len)):
                x = np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())
                n = x.shape[1]
                freq = part["__hz"].to_numpy()[:, None] + np.fft.fftfreq(n)[None, :] * bandwidth_hz
                phase = -2.0 * np.pi * freq * part["delay_ns"].to_numpy(dtype=float)[:, None] * 1e-9
                y = np.fft.ifft(np.fft.fft(x, axis=1) * np.exp(1j * phase), axis=1)
                yield part[[f.name for f in cols]].assign(re=list(y.real), im=list(y.imag))

    return d.mapInPandas(correct, f"{schema}, re array<double>, im array<double>")
