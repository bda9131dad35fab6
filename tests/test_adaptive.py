"""Eigen-based mitigation against a direct computation and known limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import full_block, packets
from phasegrid.config import ArrayConfig
from phasegrid.operators import adaptive
from phasegrid.plans import jobs
from phasegrid.plans.blocks import Calibration

CFG = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=4, pols=2, steps=64, packets=1)
ONES = Calibration(weights=np.ones((1, 2, 1, 4), dtype=complex))


def matrix(rng, n=5, t=40):
    x = rng.normal(size=(n, t)) + 1j * rng.normal(size=(n, t)) + 3 * rng.normal(size=(n, 1)) * rng.normal(size=(1, t))
    return x @ x.conj().T


def run(spark, value, **kw):
    out = jobs.adaptive_spectra(packets(spark, full_block(CFG, 6400, value)), CFG, ONES, **kw)
    return out


def beams(out):
    return {(r.pol, r.beam, r.s): complex(r.re, r.im) for r in out["beams"].collect()}


def test_threshold_is_strict_and_interpolated():
    lam = np.array([[0.0, 0.0, 100.0, 100.0]])
    assert adaptive.detect_modes(lam, 0.8416).tolist() == [0]
    assert adaptive.detect_modes(lam, 0.5).tolist() == [2]
    assert adaptive.detect_modes(np.array([[1.0, 2.0, 3.0, 100.0]]), 1.0).tolist() == [1]


def test_detection_in_sql_equals_numpy(spark):
    rng = np.random.default_rng(5)
    lam = np.sort(rng.exponential(10, size=(6, 9)), axis=1)
    d = spark.createDataFrame([(i, float(v)) for i, row in enumerate(lam) for v in row], "g int, v double")
    got = {r.g: r.k for r in adaptive.detect_spectra(d, ["g"], "v", 1.0).collect()}
    assert got == dict(enumerate(adaptive.detect_modes(lam, 1.0).tolist()))


def test_whitening_identities():
    v = matrix(np.random.default_rng(1))[None]
    white, d = adaptive.whiten(v)
    assert np.allclose(np.einsum("bii->bi", white), 1)
    lam, u = np.linalg.eigh(white)
    back = adaptive.unwhiten(u, d)
    assert np.allclose(np.linalg.norm(back, axis=1), 1)
    zero, floor = adaptive.whiten(np.zeros((1, 3, 3), dtype=complex))
    assert np.allclose(floor, 1e-5) and np.isfinite(zero).all()


def test_projections():
    v = matrix(np.random.default_rng(2))[None]
    lam, u = np.linalg.eigh(v)
    for k in range(6):
        p = adaptive.null_projection(u, np.array([k]))[0]
        assert np.allclose(p @ p, p) and np.trace(p).real == pytest.approx(5 - k)
        assert np.allclose(p @ u[0][:, 5 - k:], 0)
        s = adaptive.shrink_projection(u, lam, np.array([k]))[0]
        floor = lam[0][:5 - k].mean() if k < 5 else 0
        if k:
            assert np.allclose(s @ u[0][:, 5 - k:], u[0][:, 5 - k:] * (floor / lam[0][5 - k:]))
    assert np.allclose(adaptive.shrink_projection(u, lam, np.array([0]))[0], np.eye(5))


def test_no_modes_leave_the_beam_alone(spark):
    b = beams(run(spark, lambda t, n, p: complex(n + t % 5, p), modes=0))
    assert all(abs(b[p, 0, s] - b[p, 1, s]) < 1e-9 for p in range(2) for s in range(64))


def test_rank_one_interference_vanishes(spark):
    b = beams(run(spark, 2 - 2j, modes=1))
    assert all(abs(b[p, 0, s] - (8 - 8j)) < 1e-9 and abs(b[p, 1, s]) < 0.25 for p in range(2) for s in range(64))


def two_modes(t, n, p):
    if p:
        return 0
    a = 1 if (t // 8) % 2 else -1
    b = 1 if (t // 4) % 2 else -1
    return complex((20 * a if n < 2 else 0) + (20 * b if n >= 2 else 0))


def test_detected_counts(spark):
    out = run(spark, two_modes, delta=0.5)
    assert {r.pol: r.k for r in out["counts"].collect()} == {0: 2, 1: 0}
    r = out["statistics"].where("pol = 0").first()
    assert (r.min_k, r.max_k, r.median_k, r.mean_k) == (2, 2, 2.0, 2.0)


def test_shrinking_keeps_more_than_nulling(spark):
    value = lambda t, n, p: complex(two_modes(t, n, 0).real + (t * (n + 3)) % 7 - 3, (t * n) % 3 - 1)
    power = lambda b: sum(abs(v) ** 2 for (p, m, s), v in b.items() if m == 1)
    nulled, shrunk = power(beams(run(spark, value, modes=2))), power(beams(run(spark, value, modes=2, mode="shrink")))
    original = sum(abs(v) ** 2 for (p, m, s), v in beams(run(spark, value, modes=2)).items() if m == 0)
    assert nulled < shrunk < original


def test_spectra_drop_edges_and_centre(spark):
    value = lambda t, n, p: complex(np.round(40 * np.exp(2j * np.pi * 7 * t / 64)))
    out = run(spark, value, modes=0)["spectra"].where("pol = 0 and beam = 0").orderBy(F.desc("value"))
    top = out.first()
    assert top.bin == 7 + 32 - 5 and out.count() == 54
    assert top.value == pytest.approx(4 * 40 * 64, rel=0.01)


def packed(spark, mats, pols=2):
    """Packed rows from matrices ``[row][p][q]`` of size n."""
    n = mats.shape[-1]
    j, i = np.tril_indices(n)
    rows = []
    for b, m in enumerate(mats):
        flat = m[:, :, i, j].transpose(2, 0, 1).ravel()
        rows.append((b, b % 2, flat.real.tolist(), flat.imag.tolist()))
    return spark.createDataFrame(rows, "block long, channel int, re array<double>, im array<double>")


SHAPE = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=5, pols=2, steps=8, packets=1)


@pytest.fixture(scope="module")
def mats():
    rng = np.random.default_rng(9)
    return np.array([[[matrix(rng) for _ in range(2)] for _ in range(2)] for _ in range(4)])


def test_eigen_reconstructs_the_matrix(spark, mats):
    rows = adaptive.eigen(packed(spark, mats), SHAPE).collect()
    assert len(rows) == 4 * 4
    for r in rows:
        u = (np.array(r.vec_re) + 1j * np.array(r.vec_im)).reshape(5, 5)
        lam = np.array(r.eigvals)
        assert (np.diff(lam) >= 0).all()
        assert np.allclose(u @ np.diag(lam) @ u.conj().T, mats[r.block, r.p, r.q])


def test_mitigation_rows_equal_direct_computation(spark, mats):
    d = packed(spark, mats).withColumn("k", (F.col("block") % 3).cast("int"))
    for mode in ("null", "shrink"):
        for r in adaptive.mitigate(d, SHAPE, mode=mode).collect():
            v = mats[r.block, r.pol, r.pol][None]
            _, _, counts, want = adaptive.decompose(v, np.array([r.block % 3]), None, mode)
            got = (np.array(r.proj_re) + 1j * np.array(r.proj_im)).reshape(5, 5)
            assert r.k == r.block % 3 and np.allclose(got, want[0])


def test_project_weights_and_similarity(spark, mats):
    p = adaptive.mitigate(packed(spark, mats), SHAPE, delta=0.8)
    w = np.arange(5) + 1j
    weights = spark.createDataFrame([(c, q, 0, w.real.tolist(), w.imag.tolist()) for c in range(2) for q in range(2)],
                                    "channel int, pol int, beam int, w_re array<double>, w_im array<double>")
    for r in adaptive.project_weights(p, weights, 5).collect():
        proj = (np.array(r.proj_re) + 1j * np.array(r.proj_im)).reshape(5, 5)
        assert np.allclose(np.array(r.a_re) + 1j * np.array(r.a_im), w @ proj)
    eig = adaptive.dominant_vector(adaptive.eigen(packed(spark, mats), SHAPE, cross=False), 5)
    vec = {(r.block, r.p): np.array(r.u_re) + 1j * np.array(r.u_im) for r in eig.collect()}
    same_window = eig.withColumn("window", F.expr("block div 2"))
    for r in adaptive.vector_similarity(same_window, ["window", "p"]).collect():
        assert r.similarity == pytest.approx(abs(vec[2 * r.window, r.p].conj() @ vec[2 * r.window + 1, r.p]))
    top = adaptive.top_vectors(adaptive.eigen(packed(spark, mats), SHAPE), 5, 2).where("rank = 0 and p = q").collect()
    for r in top:
        assert abs(abs(np.vdot(np.array(r.u_re) + 1j * np.array(r.u_im), vec[r.block, r.p])) - 1) < 1e-9


def test_mean_projection(spark, mats):
    same = mats.copy()
    same[:] = mats[0]
    d = packed(spark, same).withColumn("channel", F.lit(0))
    eig = adaptive.eigen(d, SHAPE)
    for r in adaptive.mean_projection(eig, 5, 2, 4).collect():
        assert np.allclose(r.eigvals, [0, 0, 0, 1, 1], atol=1e-9)
    mixed = adaptive.mean_projection(adaptive.eigen(packed(spark, mats).withColumn("channel", F.lit(0)), SHAPE), 5, 2, 4)
    u = [np.linalg.eigh(m[0, 0])[1][:, 3:] for m in mats]
    want = np.linalg.eigvalsh(sum(x @ x.conj().T for x in u) / 4)
    assert np.allclose(mixed.where("p = 0 and q = 0").first().eigvals, want)


def test_noise_floor_and_counts(spark):
    d = spark.createDataFrame([([4.0, 1.0, 3.0, 100.0], 1), ([1.0, 2.0], 2)], "eigvals array<double>, k int")
    assert [round(r.noise_floor, 6) for r in adaptive.noise_floor(d).collect()] == [round(8 / 3, 6), 0.0]
    ch = spark.createDataFrame([(0,), (1,)], "channel int")
    conf = spark.createDataFrame([(1, 4)], "channel int, k int")
    assert {r.channel: r.k for r in adaptive.signal_counts(ch, conf).collect()} == {0: 1, 1: 4}
    stats = adaptive.mode_statistics(spark.createDataFrame([(0, k) for k in [1, 1, 2, 5]], "c int, k int"), ["c"]).first()
    assert (stats.min_k, stats.max_k, stats.median_k, stats.mean_k) == (1, 5, 1.5, 2.25)


def test_batches_of_matrices_are_bounded():
    """A batch of 10,000 rows, as Spark makes them, is decomposed in parts of bounded size, whole and in order."""
    import pandas as pd
    from pyspark.sql import types as T

    class Rows:
        schema = T.StructType().add("block", T.LongType()).add("re", T.ArrayType(T.DoubleType())).add("im", T.ArrayType(T.DoubleType()))

        def mapInPandas(self, run, schema):
            return run

    n = 2 * adaptive.MATRICES + 3
    flat = np.random.default_rng(3).normal(size=(n, 10 * 4))
    batch = pd.DataFrame({"block": range(n), "re": list(flat), "im": list(0 * flat)})
    parts = list(adaptive.eigen(Rows(), CFG, cross=False)(iter([batch])))
    assert max(map(len, parts)) <= adaptive.MATRICES
    for p in (0, 1):
        assert [b for x in parts if x["p"].iloc[0] == p for b in x["block"]] == list(range(n))
