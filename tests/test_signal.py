"""Correlation, beams, calibration, spectra and folding against hand-derived values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import full_block, packets
from phasegrid.config import ArrayConfig
from phasegrid.functions import numeric as N, sky
from phasegrid.operators import beam, calibrate, correlate, fold, reports, spectra, wiring
from phasegrid.plans import blocks, jobs
from phasegrid.plans.blocks import Calibration
from phasegrid.sources import synthetic

ONE = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=4, pols=2, steps=8, packets=1)
THREE = ArrayConfig(channels=1, fpgas=3, recv_per_fpga=2, pols=2, steps=8, packets=1)


def unit_weights(cfg):
    return np.ones((cfg.channels, cfg.pols, cfg.beams, cfg.receivers), dtype=complex)


def run(spark, cfg, rows, **cal):
    cal.setdefault("weights", unit_weights(cfg))
    return jobs.observe(packets(spark, rows), cfg, Calibration(**cal))


def vis_of(out):
    return {(r.channel, r.i, r.j, r.p, r.q): (r.re, r.im) for r in out["visibilities"].collect()}


def beams_of(out):
    return {(r.pol, round(r.re, 6), round(r.im, 6)) for r in out["beams"].collect()}


def test_constant_input(spark):
    out = run(spark, ONE, full_block(ONE, 800, 2 - 2j))
    assert set(vis_of(out).values()) == {(64.0, 0.0)} and len(vis_of(out)) == 10 * 4
    assert beams_of(out) == {(0, 8.0, -8.0), (1, 8.0, -8.0)}
    m = out["missing"].first()
    assert (m.missing, m.total, m.pct) == (0, 1, 0.0)
    eig = [r.eigvals for r in out["eigen"].where("p = q").collect()]
    for lam in eig:
        assert np.allclose(lam, [0, 0, 0, 256], atol=1e-9)


def test_one_polarization_silent(spark):
    out = run(spark, ONE, full_block(ONE, 800, lambda t, n, p: 0 if p else 2 - 2j))
    for (c, i, j, p, q), v in vis_of(out).items():
        assert v == ((0.0, 0.0) if p or q else (64.0, 0.0))
    assert beams_of(out) == {(0, 8.0, -8.0), (1, 0.0, 0.0)}


def test_scale(spark):
    out = run(spark, ONE, full_block(ONE, 800, 2 - 2j, scale=2))
    assert set(vis_of(out).values()) == {(256.0, 0.0)}
    assert beams_of(out) == {(0, 16.0, -16.0), (1, 16.0, -16.0)}


def test_scale_per_receiver(spark):
    out = run(spark, ONE, full_block(ONE, 800, lambda t, n, p: n - n * 1j, scale=lambda n, p: n))
    v = vis_of(out)
    by_baseline = [v[0, i, j, 0, 0][0] for j in range(4) for i in range(j + 1)]
    assert by_baseline == [0, 0, 16, 0, 64, 256, 0, 144, 576, 1296]
    assert beams_of(out) == {(0, 14.0, -14.0), (1, 14.0, -14.0)}


def test_scales_belong_to_their_source(spark):
    """Every source keeps its own scales (the first source's must not be used for all)."""
    rows = full_block(THREE, 800, 1 + 0j)
    rows = [(s, f, c, full_block(THREE, 800, 1 + 0j, scale=f + 1)[0][3]) for s, f, c, _ in rows]
    v = vis_of(run(spark, THREE, rows))
    assert [v[0, r, r, 0, 0][0] for r in range(6)] == [8, 8, 32, 32, 72, 72]


def test_residual_delays_read_the_halo(spark):
    value = lambda f, c, k: (lambda t, n, p: 2 - 2j if 0 <= k * 8 + t - {0: 0, 1: 3, 2: -4}[f] < 8 else 0)
    rows = full_block(THREE, 800, 0, halo=True, fpga_value=value)
    out = run(spark, THREE, rows, residuals={0: 0, 1: 3, 2: -4})
    beams = {"beams": out["beams"].where("block = 0")}   # the packet after it opens a block of its own
    assert beams_of(beams) == {(0, 12.0, -12.0), (1, 12.0, -12.0)}


def test_gains(spark):
    gains = np.array([[[(r * 2 + p) * (1 + 1j) for r in range(6)] for p in range(2)]])
    out = run(spark, THREE, full_block(THREE, 800, 2 - 2j), gains=gains)
    assert beams_of(out) == {(0, 120.0, 0.0), (1, 144.0, 0.0)}


def test_permutation_restores_antenna_order(spark):
    """Receivers arrive shuffled and with swapped polarizations."""
    order = [3, 1, 0, 2]
    value = lambda t, n, p: (order[n] + 1) * (1 - 1j) * (1 if p == 1 else 2)
    perm = np.array([[[order.index(r), 1], [order.index(r), 0]] for r in range(4)])
    v = vis_of(run(spark, ONE, full_block(ONE, 800, value), permutation=perm))
    for (c, i, j, p, q), (re, im) in v.items():
        want = 16 * (i + 1) * (j + 1) * (2 if p else 1) * (2 if q else 1)
        assert (re, im) == (want, 0.0)
    perm[2] = -1
    v = vis_of(run(spark, ONE, full_block(ONE, 800, value), permutation=perm))
    assert all((x == (0.0, 0.0)) == (2 in (k[1], k[2])) for k, x in v.items())


def test_two_packets_accumulate_and_channels_stay_apart(spark):
    two = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=4, pols=2, steps=8, packets=2)
    out = run(spark, two, full_block(two, 800, 0, fpga_value=lambda f, c, k: (2 - 2j) * (1 - c)))
    assert {k[0]: v for k, v in vis_of(out).items()} == {0: (128.0, 0.0), 1: (0.0, 0.0)}


def test_integrations_span_blocks(spark):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=1, steps=8, packets=1, accumulate=2)
    out = run(spark, cfg, full_block(cfg, 800, 2 - 2j, blocks=5))
    rows = out["visibilities"].where("i = 0 and j = 1").orderBy("integration").collect()
    assert [(r.integration, r.re) for r in rows] == [(0, 128.0), (1, 128.0), (2, 64.0)]
    assert jobs.observe(packets(spark, full_block(cfg, 800, 1, blocks=2)), cfg, Calibration())[
        "visibilities"].count() == 3


def test_conjugation_and_polarization_order(spark):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=2, steps=4, packets=1)
    x = {(0, 0): 1 + 2j, (0, 1): 3 - 1j, (1, 0): -2 + 1j, (1, 1): 2 + 2j}
    v = vis_of(run(spark, cfg, full_block(cfg, 400, lambda t, n, p: x[n, p])))
    for (c, i, j, p, q), (re, im) in v.items():
        want = 4 * x[i, p] * np.conj(x[j, q])
        assert (re, im) == (want.real, want.imag)


@pytest.fixture(scope="module")
def noise(spark):
    cfg = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=3, pols=2, steps=8, packets=2)
    s = synthetic.tone_and_noise(spark, cfg, 2, tone=20, cycles=0.125, common=10, noise=15, seed=3).persist()
    return cfg, s


def frames_of(s):
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("t", "pol", "re", "im"))),
                                    lambda x: F.array(x["re"], x["im"])))
    return s.groupBy("block", "channel", "pkt", "recv").agg(ordered.alias("data")).withColumn("scale", F.lit(1))


def test_wide_packed_and_brute_force_agree(spark, noise):
    cfg, s = noise
    wide = correlate.visibilities_wide(correlate.wide_samples(s, cfg, ["pkt", "t"]), cfg, ["block", "channel"])
    packed = correlate.unpack(correlate.visibilities_packed(frames_of(s), cfg), cfg)
    a = {tuple(r[:6]): (float(r.re), float(r.im)) for r in wide.collect()}
    b = {tuple(r[:6]): (r.re, r.im) for r in packed.collect()}
    x = {}
    for r in s.collect():
        x[r.block, r.channel, r.recv, r.pol, r.pkt * 8 + r.t] = complex(r.re, r.im)
    for (blk, c, i, j, p, q), v in a.items():
        want = sum(x[blk, c, i, p, t] * x[blk, c, j, q, t].conjugate() for t in range(16))
        assert v == (want.real, want.imag) == b[blk, c, i, j, p, q]
    assert len(a) == len(b) == 2 * 2 * 6 * 4


def test_hermitian_fill_and_autocorrelations(spark, noise):
    cfg, s = noise
    vis = correlate.unpack(correlate.visibilities_packed(frames_of(s), cfg), cfg)
    full = {tuple(r[:6]): complex(r.re, r.im) for r in correlate.hermitian_fill(vis).collect()}
    assert len(full) == 2 * 2 * 9 * 4
    for (b, c, i, j, p, q), v in full.items():
        assert full[b, c, j, i, q, p] == v.conjugate()
        if i == j and p == q:
            assert v.imag == 0 and v.real >= 0
    assert correlate.polar(vis).where("autocorr and angle != 0").count() == 0
    assert correlate.trim_baselines(vis, 2).where("j = 2").count() == 0


def test_long_calibration_chain_equals_block_path(spark):
    """Scale, gain, align and beamform on long rows give the block job's beams."""
    cfg = ArrayConfig(channels=1, fpgas=2, recv_per_fpga=2, pols=2, steps=4, packets=2)
    value = lambda f, c, k: (lambda t, n, p: complex(3 * k + t - n, f + p - t))
    rows = full_block(cfg, 400, 0, scale=lambda n, p: n + 2 * p + 1, halo=True, fpga_value=value)
    gains = np.arange(8).reshape(1, 2, 4) * (1 - 0.5j) + 1
    weights = (np.arange(16).reshape(1, 2, 2, 4) - 7) * (1 + 1j)
    cal = Calibration(gains=gains, weights=weights, residuals={0: 0, 1: -2})
    want = {(r.pol, r.beam, r.s): complex(r.re, r.im) for r in jobs.observe(packets(spark, rows), cfg, cal)["beams"]
            .where("block = 0").collect()}
    from phasegrid.sources import wire
    arrived = blocks.assembled(packets(spark, rows), cfg).where("block = 0")
    s = wire.payload_samples(arrived, cfg, ["block", "channel", "source", "pkt"])
    s = s.withColumn("recv", F.col("source") * 2 + F.col("n"))
    g = spark.createDataFrame([(p, r, float(gains[0, p, r].real), float(gains[0, p, r].imag))
                               for p in range(2) for r in range(4)], "pol int, recv int, gain_re double, gain_im double")
    s = calibrate.scale_and_gain(s.join(g, ["pol", "recv"]))
    s = calibrate.align_samples(s, F.when(F.col("source") == 1, -2).otherwise(0), 4, 2)
    w = spark.createDataFrame([(0, p, m, r, float(weights[0, p, m, r].real), float(weights[0, p, m, r].imag))
                               for p in range(2) for m in range(2) for r in range(4)],
                              "channel int, pol int, beam int, recv int, re double, im double")
    got = {(r.pol, r.beam, r.s): complex(r.re, r.im) for r in beam.beamform(s, w, ["s"]).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


# --- steering and pointing ------------------------------------------------------------------

def test_steering_phase_null_antenna_and_gain(spark):
    receivers = spark.createDataFrame([(0, 0, 7, 10.0, -4.0, 1.0, 0.0, 1.0), (0, 1, -1, 5.0, 5.0, 0.0, 1.0, 0.0)],
                                      "run int, canonical int, antenna_id int, east double, north double, up double, "
                                      "gain_re double, gain_im double")
    direction = spark.createDataFrame([(0, 0, 0.3, 0.4, 0.866)], "run int, beam int, l double, m double, n double")
    channels = beam.channel_frequencies(spark.createDataFrame([(0, 2)], "run int, channel int"), 190, 0.0, 781250.0)
    rows = beam.steering_weights(receivers, direction, channels, 2, 2).collect()
    phase = -2 * np.pi * 192 * 781250.0 / 299792458.0 * (0.3 * 10 - 0.4 * 4 + 0.866)
    want = 1j * np.exp(1j * phase) / 2
    for r in rows:
        assert complex(r.re, r.im) == (0 if r.recv == 1 else pytest.approx(want))
    assert len(rows) == 4


def test_zenith_and_dates(spark):
    t = spark.createDataFrame([(0, "zenith", 10.0, 20.0, "1970-01-01"), (1, "radec", 0.0, 90.0, "2000-01-01 12:00:00")],
                              "beam int, mode string, ra_deg double, dec_deg double, d string")
    t = t.withColumn("ts", F.to_timestamp("d"))
    rows = {r.beam: r for r in beam.target_directions(t, 40.0, 15.0).collect()}
    assert (rows[0].l, rows[0].m, rows[0].n) == (0, 0, 1)
    assert rows[1].l == pytest.approx(0, abs=0.01)
    assert rows[1].m == pytest.approx(np.cos(np.radians(40)), abs=0.01)
    assert rows[1].n == pytest.approx(np.sin(np.radians(40)), abs=0.01)
    mjd = [r[0] for r in t.orderBy("beam").select(N.mjd_utc("ts")).collect()]
    assert mjd == [40587.0, 51544.5]


def test_directions_are_unit_vectors_and_move_with_time(spark):
    t = spark.range(200).select(((F.col("id") * 37) % 360).cast("double").alias("ra"),
                                ((F.col("id") * 13) % 180 - 90).cast("double").alias("de"),
                                (F.lit(59000.0) + F.col("id") / 100).alias("mjd"))
    d = t.withColumn("d", sky.topocentric(F.col("ra"), F.col("de"), F.col("mjd"), F.lit(-30.3), F.lit(149.5)))
    norm = d.select(F.abs(F.col("d.l") ** 2 + F.col("d.m") ** 2 + F.col("d.n") ** 2 - 1).alias("e"))
    assert norm.where("e > 1e-9").count() == 0
    # a source on the meridian is due north or south: hour angle zero at lst = ra
    lst = F.pmod(sky.sidereal_degrees(F.col("mjd")) + 149.5, F.lit(360.0))
    m = t.withColumn("d", sky.topocentric(lst, F.lit(-60.0), F.col("mjd"), F.lit(-30.3), F.lit(149.5)))
    assert m.where("abs(d.l) > 0.01").count() == 0


def test_steering_epochs(spark):
    d = spark.createDataFrame([(0.0,), (59.9,), (60.0,), (185.0,)], "s double")
    assert [r[0] for r in d.select(beam.steering_epoch(F.col("s"), 60)).collect()] == [0, 0, 1, 3]


# --- spectra -----------------------------------------------------------------------------------

def series(spark, x, **cols):
    data = [(*cols.values(), [float(v.real) for v in r], [float(v.imag) for v in r]) for r in x]
    names = ", ".join(f"{k} double" for k in cols)
    return spark.createDataFrame(data, f"{names}{', ' if names else ''}re array<double>, im array<double>")


def test_tone_lands_in_its_bin(spark):
    t = np.arange(64)
    d = series(spark, [np.exp(2j * np.pi * 5 * t / 64)], id=1.0)
    long = spectra.bins(spectra.fft_rows(d))
    r = spectra.peak_bin(long, ["id"]).first()
    assert r.peak == 5 and r.peak_power == pytest.approx(64 ** 2)
    kept = spectra.shift_and_trim(long, 64, 5)
    assert kept.agg(F.min("bin"), F.max("bin"), F.count("*")).first()[:] == (0, 53, 54)
    top = kept.orderBy(F.desc(N.power("re", "im"))).first()
    assert top.bin == (5 + 32) - 5


def test_mean_power_skips_nan(spark):
    x = np.array([[1, 2, np.nan, 3, np.nan, np.nan, 4, 4j, 9]], dtype=complex)
    d = series(spark, x, id=1.0)
    assert [round(v, 6) for v in spectra.downsample_power(d, 2).first().power] == [2.5, 9.0, 0.0, 16.0, 81.0]
    long = spectra.bins(d)
    rows = spectra.downsample_power_long(long, ["id"], 2).orderBy("bin").collect()
    assert [round(r.power, 6) for r in rows] == [2.5, 9.0, 0.0, 16.0, 81.0]


def test_antenna_spectrum_of_a_tone(spark):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=1, steps=8, packets=2)
    value = lambda f, c, k: (lambda t, n, p: complex(np.round(100 * np.exp(2j * np.pi * 4 * (k * 8 + t) / 16))))
    out = jobs.antenna_spectra(packets(spark, full_block(cfg, 800, 0, fpga_value=value)), cfg, Calibration(), 2)
    best = out.where("recv = 0").orderBy(F.desc("value")).first()
    assert best.bin == 2 and out.count() == 16


def test_fine_delay(spark):
    t = np.arange(8)
    tone = np.exp(2j * np.pi * 2 * t / 8)
    # a delay that turns bin 2 by +45 degrees when the coarse frequency is zero
    tau_ns = -1 / 8 / (2 / 8 * 1e6) * 1e9
    d = series(spark, [tone, tone], delay_ns=0.0).withColumn("delay_ns", F.lit(tau_ns))
    r = calibrate.fine_delay(d, F.lit(0.0), 1e6).first()
    got = np.array(r.re) + 1j * np.array(r.im)
    assert np.allclose(got, tone * np.exp(1j * np.pi / 4), atol=1e-9)
    same = calibrate.fine_delay(series(spark, [tone], delay_ns=0.0), F.lit(1e8), 1e6).first()
    assert np.allclose(np.array(same.re) + 1j * np.array(same.im), tone)
    x = np.random.default_rng(1).normal(size=(3, 16)) + 0j
    there = calibrate.fine_delay(series(spark, x, delay_ns=12.5), F.lit(1.5e8), 781250.0)
    back = calibrate.fine_delay(there.withColumn("delay_ns", F.lit(-12.5)), F.lit(1.5e8), 781250.0).collect()
    assert np.allclose(sorted(b.re[0] for b in back), sorted(x[:, 0].real))
    phi = N.fine_delay_phase(F.lit(6), 8, F.lit(1e8), 1e6, F.lit(3.0))
    assert spark.range(1).select(phi).first()[0] == pytest.approx(-2 * np.pi * (1e8 - 2 / 8 * 1e6) * 3e-9, abs=1e-6)


def test_block_job_applies_fine_delays(spark):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=1, steps=8, packets=1)
    value = lambda t, n, p: complex(np.round(64 * np.exp(2j * np.pi * 2 * t / 8)))
    tau_ns = -1 / 8 / (2 / 8 * 1e6) * 1e9
    cal = dict(delays_ns=np.array([0.0, tau_ns]), bandwidth_hz=1e6)
    v = vis_of(run(spark, cfg, full_block(cfg, 800, value), **cal))
    turned = complex(*v[0, 0, 1, 0, 0])
    assert np.angle(turned) == pytest.approx(-np.pi / 4, abs=1e-6)


# --- folding -----------------------------------------------------------------------------------

def test_fold_bins_and_profile(spark):
    d = spark.createDataFrame([(0, 0, 5), (9, 0, 7), (10, 0, 3), (3, 5, 11), (4, 0, 0), (5, 0, -2)],
                              "sample long, delay long, power long")
    rows = {r.bin: (r.total, r.hits) for r in fold.fold(d, [], 10, 5).collect()}
    assert rows == {0: (8, 2), 2: (0, 0), 4: (18, 2)}
    profile = fold.normalise_fold(fold.fold(d, [], 10, 5).withColumn("g", F.lit(1)), ["g"], 5).orderBy("bin").collect()
    assert [r.profile for r in profile] == [4.0, 0.0, 0.0, 0.0, 9.0]
    # a fractional period agrees with the definition
    frac = fold.fold(d, [], 7.5, 4).collect()
    want = {}
    for n, dl, p in [(0, 0, 5), (9, 0, 7), (10, 0, 3), (3, 5, 11)]:
        b = int(((n - dl) / 7.5 % 1.0) * 4)
        want[b] = want.get(b, 0) + p
    assert {r.bin: r.total for r in frac if r.hits} == want
    # a silent key keeps its row of zeros
    quiet = d.withColumn("g", F.lit(1)).unionByName(d.withColumn("g", F.lit(2)).withColumn("power", F.lit(-1).cast("long")))
    got = fold.normalise_fold(fold.fold(quiet, ["g"], 10, 5), ["g"], 5).where("g = 2").collect()
    assert len(got) == 5 and {r.profile for r in got} == {0.0}


def test_pulsar_job(spark):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=1, steps=8, packets=2)
    value = lambda f, c, k: (lambda t, n, p: 3 + 0j if (k * 8 + t) % 4 == 1 else 0)
    rows = full_block(cfg, 800, 0, blocks=2, fpga_value=value)
    out = jobs.pulsar_fold(packets(spark, rows), cfg, Calibration(weights=unit_weights(cfg)), 4, 4).orderBy("bin").collect()
    assert [r.profile for r in out] == [0.0, 36.0, 0.0, 0.0]
    silent = jobs.pulsar_fold(packets(spark, rows), cfg, Calibration(weights=0 * unit_weights(cfg)), 4, 4)
    assert [r.profile for r in silent.collect()] == [0.0] * 4      # a silent beam keeps its rows


# --- wiring ------------------------------------------------------------------------------------

WIRED = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=4, pols=2, steps=8, packets=1, fpga_ids=(9,))


def wired(spark, rows):
    return spark.createDataFrame([(0, 9, *r) for r in rows], "run long, fpga_id int, stream int, antenna_id int, polarization int")


def test_permutation_of_swapped_antennas(spark):
    streams = wired(spark, [(0, 42, 0), (1, 42, 1), (2, -1, 0), (3, -1, 1), (4, 7, 1), (5, 7, 0), (6, -1, 0), (7, -1, 1)])
    streams = streams.withColumn("fpga_id", F.lit(0))
    rows = wiring.permutation(streams, WIRED).orderBy("slot").collect()
    assert [r.recv_perm for r in rows] == [2, 2, 0, 0, -1, -1, -1, -1]
    assert [r.pol_perm for r in rows] == [1, 0, 0, 1, 0, 0, 0, 0]


def test_missing_polarization_fails(spark):
    with pytest.raises(Exception, match="antenna 42 is missing a polarization"):
        wiring.permutation(wired(spark, [(0, 42, 0), (2, 7, 0), (3, 7, 1)]), WIRED).collect()


def test_audit_tables(spark):
    streams = wired(spark, [(0, 42, 0), (1, 42, 1), (2, -1, 0), (3, -1, 1), (4, 7, 1), (5, 7, 0)])
    fwd = {r.fpga_stream_id: r for r in wiring.forward_table(streams, WIRED).collect()}
    assert len(fwd) == 8 and len(wiring.forward_table(streams, WIRED).columns) == 13
    assert (fwd[4].antenna_id, fwd[4].canonical_polarization, fwd[4].canonical_receiver_index, fwd[4].receiver_slot) == (7, 1, 0, 2)
    assert (fwd[2].antenna_id, fwd[2].configured_disconnected, fwd[2].zeroed_after_reorder) == (-1, 1, 1)
    assert (fwd[7].antenna_id, fwd[7].canonical_polarization) == (-1, 1)
    rev = {(r.canonical_receiver_index, r.canonical_polarization): r for r in wiring.reverse_table(streams, WIRED).collect()}
    assert len(rev) == 8
    assert rev[0, 0].global_datastream_id == 5 and rev[0, 1].fpga_stream_id == 4 and rev[1, 0].antenna_id == 42
    assert rev[3, 1].global_datastream_id == -1 and rev[3, 1].zeroed_after_reorder == 1
    legacy = wiring.forward_table(streams, WIRED, authoritative=False).where("fpga_stream_id = 2").first()
    assert (legacy.canonical_receiver_index, legacy.zeroed_after_reorder) == (1, 0)


def test_baseline_identities(spark):
    r = spark.createDataFrame([(0, 0, 1), (0, 1, 35), (0, 2, -1)], "run int, canonical int, antenna_id int")
    rows = {(b.i, b.j): b for b in wiring.baseline_table(r).collect()}
    assert rows[0, 0].baseline_id == 257 and rows[1, 1].baseline_id == 8995 and rows[0, 1].baseline_id == 291
    assert rows[0, 2].baseline_id == -2 ** 31 and rows[0, 2].zeroed == 1 and rows[1, 2].baseline == 4


def test_built_in_wiring(spark):
    m = {r.recv: r.antenna_id for r in wiring.built_in_wiring(spark, [3, 0]).collect()}
    assert m[0] == 19 and m[11] == 35 and m[10] < 0 and len(m) == 20
    with pytest.raises(ValueError):
        wiring.built_in_wiring(spark, [4])


def test_timing_report(spark):
    d = spark.createDataFrame([(float(x),) for x in [0, 4, 1, 3, 2, 5]], "time double").withColumn("g", F.lit(1))
    r = reports.timing_summary(d, ["g"], "time", 1.0).first()
    assert (r.n, r.mean, r.max, r.p50, r.p90, r.p99) == (5, 3.0, 5.0, 3.0, 5.0, 5.0)
    c = reports.capacity(spark.createDataFrame([(4.0,)], "mean double"), 8192, 3, 2e6).first()
    assert (c.serial, c.serial_verdict) == (250.0, "MARGINAL") and c.overlapped_verdict == "OK"


def test_apparent_place_of_a_published_example(spark):
    """Theta Persei on 2028 November 13.19: mean place of date and apparent place of a textbook example."""
    d = spark.createDataFrame([(41.5472, 49.3485, 62088.19)], "ra double, de double, mjd double")
    x, y, z = sky.apparent(F.radians("ra"), F.radians("de"), F.col("mjd"))
    r = d.select(F.degrees(F.atan2(y, x)).alias("ra"), F.degrees(F.asin(z)).alias("de")).first()
    assert abs(r.ra - 41.5599646) * 3600 * np.cos(np.radians(49.35)) < 1 and abs(r.de - 49.3520685) * 3600 < 1
    longitude, obliquity, _ = sky.nutation(F.lit(46895.0))      # 1987 April 10, 0h: -3.788 and +9.443 arc seconds
    r = spark.range(1).select(F.degrees(longitude).alias("psi"), F.degrees(obliquity).alias("eps")).first()
    assert abs(r.psi * 3600 + 3.788) < 0.5 and abs(r.eps * 3600 - 9.443) < 0.1


def test_only_wanted_products_are_made(spark):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=4, pols=2, steps=16, packets=4)
    d, cal = packets(spark, full_block(cfg, 800, lambda t, n, p: (n + 1) * (1 + p) - 2j)), Calibration(weights=unit_weights(cfg))
    rows = lambda out, name: sorted(map(tuple, out[name].collect()))
    for job, names in ((jobs.observe, ["visibilities", "spectra", "missing"]), (jobs.adaptive_spectra, ["spectra", "counts"])):
        every = job(d, cfg, cal)
        for name in names:
            some = job(d, cfg, cal, only=[name])
            assert list(some) == [name] and "beams" in every
            assert rows(some, name) == rows(every, name)
    with pytest.raises(ValueError, match="nothing"):
        jobs.observe(d, cfg, cal, only=["nothing"])
    made = blocks.block_products(d, cfg, cal, visibilities=False, spectra="packet", trim=2).rows.first()
    assert made["spectrum"] and made["beam_re"] is None and made["vis_re"] is None


def test_blocks_by_arrow_and_by_pandas(spark):
    d = packets(spark, full_block(ONE, 800, lambda t, n, p: (n + 1) * (1 + p) - 2j, blocks=3))
    arrived = blocks.assembled(d, ONE)
    got, want = (blocks.reduce_blocks(arrived, ONE, Calibration(weights=unit_weights(ONE)), beams=True, spectra="packet", trim=1,
                                      mitigation="null", arrow=a).orderBy("block", "channel") for a in (True, False))
    assert got.schema.simpleString() == want.schema.simpleString() and got.collect() == want.collect() != []


def test_packed_arrays_are_added_before_their_rows_move(spark):
    rows = [(b, 0, [float(b + n) for n in range(40)], [float(b * n) for n in range(40)], b, b + 1, 1) for b in [*range(5), 70, 71, 200]]
    packed = spark.createDataFrame(rows, "block long, channel int, re array<double>, im array<double>, start_seq long, end_seq long, missing int")
    keys = ["block", "channel", "start_seq", "end_seq", "missing"]
    for n in (4, 100):      # below and above the number of blocks that are brought together
        got = correlate.accumulate_packed(packed, ONE, n)
        want = correlate.accumulate(correlate.unpack(packed, ONE, keys), n)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = correlate.accumulate_packed(packed, ONE, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")      # the tree is printed from the result down
