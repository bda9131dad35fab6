"""Eigen-based interference removal on packed visibilities.

A packed row is one (block, channel), so the decomposition is row-wise and does
not shuffle; NumPy decomposes all matrices of a batch in one call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from phasegrid import scale
from phasegrid.config import ArrayConfig
from phasegrid.functions import numeric as N

# Normal quantile used to turn the 20-80 percentile spread into a sigma (fixed value).
SPREAD_QUANTILE = 0.8416


# --- small helpers on stacks of matrices (B, N, N) --------------------------------

def hermitian(packed: np.ndarray, n: int) -> np.ndarray:
    """Full matrices from packed upper triangles ``[B][baseline]``."""
    j, i = np.tril_indices(n)
    v = np.zeros((len(packed), n, n), dtype=complex)
    v[:, j, i] = packed.conj()
    v[:, i, j] = packed
    d = np.arange(n)
    v[:, d, d] = v[:, d, d].real
    return v


def whiten(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V_ij / sqrt(V_ii V_jj) and the square roots; the diagonal is floored."""
    d = np.sqrt(np.maximum(np.einsum("bii->bi", v).real, 1e-10))
    return v / (d[:, :, None] * d[:, None, :]), d


def unwhiten(u: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Scale rows back and renormalise columns."""
    u = u * d[:, :, None]
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    return np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)


def detect_modes(lam: np.ndarray, delta: float) -> np.ndarray:
    """Eigenvalues strictly above median + delta * sigma."""
    p20, p50, p80 = np.percentile(lam, [20, 50, 80], axis=1)
    threshold = p50 + delta * (p80 - p20) / (2.0 * SPREAD_QUANTILE)
    return (lam > threshold[:, None]).sum(axis=1)


def null_projection(u: np.ndarray, k: np.ndarray) -> np.ndarray:
    """I - U U^H of the last k columns."""
    n = u.shape[1]
    keep = np.arange(n)[None, :] >= n - k[:, None]
    return np.eye(n) - (u * keep[:, None, :]) @ u.conj().transpose(0, 2, 1)


def shrink_factors(lam: np.ndarray, k: np.ndarray) -> np.ndarray:
    """1 for noise modes, mean noise / eigenvalue for the last k (0 if not positive)."""
    n = lam.shape[1]
    noise = np.arange(n)[None, :] < n - k[:, None]
    count = noise.sum(axis=1)
    floor = np.divide((lam * noise).sum(axis=1), count, out=np.zeros(len(lam)), where=count > 0)
    ratio = np.divide(floor[:, None], lam, out=np.zeros_like(lam), where=lam > 0)
    return np.where(noise, 1.0, ratio)


def shrink_projection(u: np.ndarray, lam: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (u * shrink_factors(lam, k)[:, None, :]) @ u.conj().transpose(0, 2, 1)


def decompose(v: np.ndarray, k, delta: float | None, mode: str) -> tuple[np.ndarray, ...]:
    """Eigenvalues, vectors, mode counts and projection of whitened matrices.

    Null mode un-whitens the vectors before projecting, shrink mode does not.
    """
    white, d = whiten(v)
    lam, u = np.linalg.eigh(white)
    n = v.shape[1]
    counts = detect_modes(lam, delta) if delta is not None else np.asarray(k)
    counts = np.clip(counts, 0, n)
    if mode == "shrink":
        return lam, u, counts, shrink_projection(u, lam, counts)
    u = unwhiten(u, d)
    return lam, u, counts, null_projection(u, counts)


# --- Spark operators -----------------------------------------------------------

EIGEN_FIELDS = ("p int, q int, eigvals array<double>, vec_re array<double>, vec_im array<double>")


#: Matrices decomposed at once; a batch of Spark's holds any number, and each takes many times its size on the way.
MATRICES = 512


def bounded_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in batches of ``MATRICES`` at most."""
    for pdf in batches:
        for at in range(0, len(pdf), MATRICES):
            yield pdf.iloc[at:at + MATRICES]


def _key_schema(df: DataFrame, drop: set[str]) -> tuple[list[str], str]:
    fields = [f for f in df.schema if f.name not in drop]
    return [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _stack(pdf: pd.DataFrame, baselines: int, pols: int) -> np.ndarray:
    flat = np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy())
    return flat.reshape(len(pdf), baselines, pols, pols)


def eigen(packed: DataFrame, cfg: ArrayConfig, cross: bool = True) -> DataFrame:
    """Eigenvalues (ascending) and vectors of every (p, q) matrix of packed rows.

    Vectors are flat, row by row; ``cross=False`` keeps p == q only.
    """
    names, schema = _key_schema(packed, {"re", "im"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in bounded_rows(batches):
            v = _stack(pdf, cfg.baselines, cfg.pols)
            for p in range(cfg.pols):
                for q in range(cfg.pols):
                    if p == q or cross:
                        lam, u = np.linalg.eigh(hermitian(v[:, :, p, q], cfg.receivers))
                        flat = u.reshape(len(pdf), -1)
                        yield pdf[names].assign(p=p, q=q, eigvals=list(lam), vec_re=list(flat.real),
                                                vec_im=list(flat.imag))

    return packed.mapInPandas(run, f"{schema}, {EIGEN_FIELDS}")


def mitigate(packed: DataFrame, cfg: ArrayConfig, delta: float | None = None, mode: str = "null") -> DataFrame:
    """Mode counts and projection matrices per polarization.

    The fixed count comes from an optional column ``k`` (default 1); ``delta``
    detects it from the spectrum.  ``proj_*`` are flat N x N arrays, row by row.
    """
    names, schema = _key_schema(packed, {"re", "im", "k"})
    fixed = "k" in packed.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in bounded_rows(batches):
            v = _stack(pdf, cfg.baselines, cfg.pols)
            k = pdf["k"].to_numpy() if fixed else np.ones(len(pdf), dtype=int)
            for p in range(cfg.pols):
                lam, u, counts, proj = decompose(hermitian(v[:, :, p, p], cfg.receivers), k, delta, mode)
                flat, vec = proj.reshape(len(pdf), -1), u.reshape(len(pdf), -1)
                yield pdf[names].assign(
                    pol=p, k=counts.astype(np.int32), eigvals=list(lam), vec_re=list(vec.real),
                    vec_im=list(vec.imag), proj_re=list(flat.real), proj_im=list(flat.imag))

    return packed.mapInPandas(run, f"{schema}, pol int, k int, eigvals array<double>, vec_re array<double>, "
                                   "vec_im array<double>, proj_re array<double>, proj_im array<double>")


def whiten_visibilities(vis: DataFrame) -> DataFrame:
    """V_ij / sqrt(V_ii V_jj) of long visibilities, p == q only.

    The diagonal of a matrix is a bounded map of receivers, joined once per matrix.
    """
    same = vis.where(F.col("p") == F.col("q"))
    diag = (same.where(F.col("i") == F.col("j")).groupBy("block", "channel", "p")
            .agg(F.map_from_entries(F.collect_list(F.struct(
                "i", F.sqrt(F.greatest("re", F.lit(1e-10)))))).alias("d")))
    norm = F.element_at("d", F.col("i")) * F.element_at("d", F.col("j"))
    return (same.join(diag, ["block", "channel", "p"])
            .withColumns({"re": F.col("re") / norm, "im": F.col("im") / norm}).drop("d"))


def project_weights(projections: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """Adapted weights w' = w P for every (block, channel, pol, beam).

    ``weights`` has arrays ``w_re, w_im`` per (channel, pol, beam).  The product is
    array arithmetic on the joined row: n x n numbers, nothing exploded.
    """
    d = projections.join(scale.broadcast_if_small(weights, 1 << 16), ["channel", "pol"])
    rows = F.sequence(F.lit(0), F.lit(n - 1))

    def column(part):
        def at(c):
            terms = F.transform(rows, lambda r: part(
                F.get("w_re", r), F.get("w_im", r), F.get("proj_re", r * n + c), F.get("proj_im", r * n + c)))
            return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
        return F.transform(rows, at)

    return (d.withColumn("a_re", column(lambda a, b, c, e: a * c - b * e))
            .withColumn("a_im", column(lambda a, b, c, e: a * e + b * c)))


def signal_counts(channels: DataFrame, configured: DataFrame, default: int = 1) -> DataFrame:
    """Number of signal vectors of each channel, with a default where none is set."""
    return channels.join(scale.broadcast_if_small(configured, 100_000), "channel", "left").withColumn("k", F.coalesce("k", F.lit(default)))


def detect_spectra(values: DataFrame, keys: list[str], value: str, delta: float) -> DataFrame:
    """Mode counts of long spectra: values strictly above median + delta * sigma.

    A spectrum has at most one value per receiver and is kept as one bounded array.
    """
    d = values.groupBy(*keys).agg(
        F.percentile(value, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("q"),
        F.collect_list(value).alias("v"))
    threshold = F.col("q")[1] + F.lit(delta) * (F.col("q")[2] - F.col("q")[0]) / (2.0 * SPREAD_QUANTILE)
    d = d.withColumn("threshold", threshold)
    return d.select(*keys, "threshold", F.size("v").alias("modes"), F.size(
        F.filter("v", lambda x: x > F.col("threshold"))).alias("k"))


def noise_floor(spectra: DataFrame) -> DataFrame:
    """Mean of the N-k smallest eigenvalues of array rows ``eigvals, k``; 0 if none is left."""
    count = F.size("eigvals") - F.col("k")
    kept = F.slice(F.array_sort("eigvals"), 1, F.greatest(count, F.lit(0)))
    total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b)
    return spectra.withColumn("noise_floor", F.when(count > 0, total / count).otherwise(0.0))


def mode_statistics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Min, max, median and mean of mode counts.

    Counts are small integers; they are tallied first so that the median works on
    a handful of weighted values.
    """
    tally = counts.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("__n"))
    return tally.groupBy(*keys).agg(
        F.min("k").alias("min_k"), F.max("k").alias("max_k"),
        F.percentile("k", F.lit(0.5), F.col("__n")).alias("median_k"),
        (F.sum(F.col("k") * F.col("__n")) / F.sum("__n")).alias("mean_k"))


def dominant_vector(eig: DataFrame, n: int) -> DataFrame:
    """Vector of the largest eigenvalue as arrays ``u_re, u_im``."""
    last = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.get(c, r * n + (n - 1)))
    return eig.withColumn("u_re", last("vec_re")).withColumn("u_im", last("vec_im"))


def top_vectors(eig: DataFrame, n: int, k: int) -> DataFrame:
    """The k largest eigenvectors, one row each, largest first."""
    d = eig.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    col = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                lambda r: F.get(c, r * n + (n - 1) - F.col("rank")))
    return (d.withColumn("u_re", col("vec_re")).withColumn("u_im", col("vec_im"))
            .withColumn("eigval", F.get("eigvals", F.lit(n - 1) - F.col("rank")))
            .drop("eigvals", "vec_re", "vec_im"))


def vector_similarity(vectors: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """|u^H v| between the dominant vectors of channels c and c + step."""
    other = vectors.select(*keys, (F.col("channel") - step).alias("channel"),
                           F.col("u_re").alias("v_re"), F.col("u_im").alias("v_im"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    re = dot("u_re", "v_re") + dot("u_im", "v_im")
    im = dot("u_re", "v_im") - dot("u_im", "v_re")
    return (vectors.join(other, keys + ["channel"])
            .select(*keys, "channel", F.hypot(re, im).alias("similarity")))


def mean_projection(eig: DataFrame, n: int, k: int, runs: int) -> DataFrame:
    """Average U U^H of the top k vectors over ``runs`` blocks and decompose the mean.

    Row-wise products, a distributed average of matrix cells, then a row-wise
    decomposition.  Result: the k dominant vectors per (window, channel, p, q).
    """
    names = ["block", "channel", "p", "q"]

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in bounded_rows(batches):
            u = np.stack(pdf["vec_re"].to_numpy()) + 1j * np.stack(pdf["vec_im"].to_numpy())
            top = u.reshape(len(pdf), n, n)[:, :, n - k:]
            flat = (top @ top.conj().transpose(0, 2, 1)).reshape(len(pdf), -1)
            yield pdf[names].assign(re=list(flat.real), im=list(flat.imag))

    cells = (eig.select(*names, "vec_re", "vec_im")
             .mapInPandas(outer, "block long, channel int, p int, q int, re array<double>, im array<double>")
             .select(N.floor_div("block", runs).alias("window"), "channel", "p", "q",
                     F.posexplode(F.arrays_zip("re", "im")).alias("cell", "v")))
    keys = ["window", "channel", "p", "q"]
    mean = cells.groupBy(*keys, "cell").agg(F.avg("v.re").alias("re"), F.avg("v.im").alias("im"))
    rows = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "re", "im"))).alias("m"))
    rows = rows.select(*keys, F.col("m.re").alias("re"), F.col("m.im").alias("im"))

    def decompose_mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in bounded_rows(batches):
            m = (np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy())).reshape(len(pdf), n, n)
            lam, u = np.linalg.eigh(m)
            flat = u.reshape(len(pdf), -1)
            yield pdf[keys].assign(eigvals=list(lam), vec_re=list(flat.real), vec_im=list(flat.imag))

    return rows.mapInPandas(decompose_mean, "window long, channel int, p int, q int, eigvals array<double>, "
                                            "vec_re array<double>, vec_im array<double>")
