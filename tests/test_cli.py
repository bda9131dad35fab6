"""Jobs from files: captures and JSON in, products out."""

import json
import struct

import numpy as np
import pytest

from helpers import payload
from phasegrid.__main__ import main
from phasegrid.config import ArrayConfig
from phasegrid.plans import jobs
from phasegrid.plans.setup import RunFiles, load_calibration
from phasegrid.sources import pcap

CFG = ArrayConfig(channels=2, fpgas=2, recv_per_fpga=2, pols=2, steps=8, packets=2, min_channel=190, fpga_ids=(4, 6))
SHAPE = ["--channels", "2", "--min-channel", "190", "--fpga-ids", "4,6", "--receivers-per-fpga", "2", "--steps", "8",
         "--packets", "2", "--accumulation-length", "2"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    frames = []
    for k in range(8):
        for f in (4, 6):
            for c in (190, 191):
                body = payload(CFG, lambda t, n, p: complex(f + n, p), 2)
                network = bytearray(42)
                network[12:15], network[23] = b"\x08\x00\x45", 17
                frames.append((10 ** 12 + len(frames), bytes(network) + struct.pack("<QIH8x", 800 + 8 * k, f, c) + body))
    (root / "captures").mkdir()
    for part in range(2):
        half = frames[part * 16:(part + 1) * 16]
        (root / "captures" / f"{part}.pcap").write_bytes(pcap.pcap_bytes(half))
    streams = lambda *ids: {"streams": [{"stream": s, "antenna_id": a, "polarization": s % 2}
                                        for s, a in enumerate(x for a in ids for x in (a, a))]}
    docs = {"map": {"fpgas": {"4": streams(9, 3), "6": streams(-1, 5), "7": streams(1, 2)}},
            "gains": {"weights": {"191": {"YY": {"3": {"real": 0.0, "imag": 2.0}}}}},
            "delays": {"5": 1.5},
            "config": {"array_location": {"latitude_deg": -30.0, "longitude_deg": 149.0, "height_m": 237},
                       "frequency_plan": {"base_frequency_hz": 0, "channel_bandwidth_hz": 781250},
                       "antenna_positions": {"4": {"3": {"east": 10.0, "north": 0.0, "up": 0}}}},
            "targets": {"targets": [{"mode": "zenith"}, {"mode": "radec", "ra_deg": 10, "dec_deg": -30}]}}
    for name, doc in docs.items():
        (root / f"{name}.json").write_text(json.dumps(doc))
    return root


def test_calibration_from_files(spark, files):
    at = lambda n: str(files / f"{n}.json")
    cal = load_calibration(spark, CFG, RunFiles(at("config"), at("map"), at("gains"), at("delays")))
    # canonical order 3, 5, 9, unused; antenna 3 is receiver 1 of source 4, antenna 5 receiver 1 of source 6
    assert cal.permutation[:, 0, 0].tolist() == [1, 3, 0, -1] and cal.permutation[:3, 1, 1].tolist() == [1, 1, 1]
    assert cal.gains[1, 1, 1] == pytest.approx(-0.5j) and cal.gains[0, 1, 1] == 1 and cal.gains[1, 0, 1] == 1
    assert cal.delays_ns.tolist() == [0, 1.5, 0, 0]
    assert cal.weights[0, 0, 0].tolist() == [1, 1, 1, 0]
    two = ArrayConfig(**{**CFG.__dict__, "beams": 2})
    steer = load_calibration(spark, two, RunFiles(config=at("config"), stream_map=at("map"), targets=at("targets")),
                             "2024-06-01 00:00:00")
    assert steer.weights[0, 0, 0, :3] == pytest.approx([0.25] * 3) and steer.weights[0, 0, 0, 3] == 0
    assert abs(steer.weights[0, 0, 1, 0]) == pytest.approx(0.25) and steer.weights[0, 0, 1, 1] == pytest.approx(0.25)
    plain = load_calibration(spark, CFG, RunFiles())
    assert plain.permutation is None and plain.gains is None and plain.weights.shape == (2, 2, 1, 4)


def test_observe_from_files(spark, files, tmp_path):
    out = str(tmp_path)
    main(["observe", "--input", str(files / "captures"), "--output", out, *SHAPE,
          "--stream-antenna-map", str(files / "map.json")])
    vis = spark.read.parquet(f"{out}/visibilities")
    v = {(r.integration, r.channel, r.i, r.j, r.p, r.q): complex(r.re, r.im) for r in vis.collect()}
    # antenna 3: source 4 receiver 1 -> value 5, antenna 5: source 6 receiver 1 -> 7, antenna 9 -> 4; scale 2
    x = {0: 5, 1: 7, 2: 4}
    for (n, c, i, j, p, q), got in v.items():
        want = 0 if 3 in (i, j) else 4 * 32 * (x[i] + 1j * p) * (x[j] - 1j * q)
        assert got == want
    assert spark.read.parquet(f"{out}/baselines").where("zeroed = 1").count() == 4
    assert spark.read.parquet(f"{out}/missing").agg({"missing": "sum"}).first()[0] == 0
    main(["observe-stream", "--input", str(files / "captures"), "--output", f"{out}/s", *SHAPE,
          "--stream-antenna-map", str(files / "map.json")])
    s = spark.read.parquet(f"{out}/s/visibilities").where("integration = 0")
    assert s.exceptAll(vis.where("integration = 0").select(*s.columns)).count() == 0 and s.count() == 80


@pytest.mark.parametrize("job, product", [("antenna-spectra", "spectra"), ("projection", "projection"),
                                          ("pulsar-fold", "profile"), ("offline", "visibilities"), ("bandpass", "spectra")])
def test_other_jobs_write_products(spark, files, tmp_path, job, product):
    main([job, "--input", str(files / "captures"), "--output", str(tmp_path), *SHAPE,
          "--downsample", "4", "--period", "4", "--phase-bins", "4"])
    assert spark.read.parquet(f"{tmp_path}/{product}").count() > 0


def test_adaptive_job_writes_products(spark, files, tmp_path):
    """Sixteen steps per packet: read the same bytes with half the receivers."""
    shape = [*SHAPE, "--receivers-per-fpga", "1", "--steps", "16"]
    main(["adaptive", "--input", str(files / "captures"), "--output", str(tmp_path), *shape, "--detect-signal-eigenmodes"])
    assert spark.read.parquet(f"{tmp_path}/spectra").count() > 0
    assert spark.read.parquet(f"{tmp_path}/counts").count() > 0


def test_stored_vectors_are_removed_from_a_beam(spark):
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.normal(size=(4, 4)) + 1j * rng.normal(size=(4, 4)))[0][:, :2]
    w = rng.normal(size=(1, 1, 2, 4)) + 0j
    rows = [(0, 0, 0, 0, k, u[:, k].real.tolist(), u[:, k].imag.tolist()) for k in range(2)]
    d = spark.createDataFrame(rows, "window long, channel int, p int, q int, rank int, u_re array<double>, u_im array<double>")
    got = jobs.project_beam(jobs.Calibration(weights=w), d, 0, 1, 2).weights
    assert np.allclose(got[0, 0, 1], w[0, 0, 1] - u @ (u.conj().T @ w[0, 0, 1])) and np.allclose(got[0, 0, 0], w[0, 0, 0])
    with pytest.raises(ValueError):
        jobs.project_beam(jobs.Calibration(weights=w), d, 5, 1)
