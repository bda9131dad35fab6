"""Product sinks, dimension files, logs and reports."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import full_block, packets
from phasegrid.config import ArrayConfig
from phasegrid.operators import adaptive, correlate, reports, wiring
from phasegrid.plans import jobs
from phasegrid.plans.blocks import Calibration
from phasegrid.session import materialize, scratch_root
from phasegrid.sinks import products
from phasegrid.sinks.series import SeriesStore, eigen_points
from phasegrid.sources import dims, logs

CFG = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=2, pols=2, steps=4, packets=2)


@pytest.fixture(scope="module")
def visibilities(spark):
    return jobs.observe(packets(spark, full_block(CFG, 400, 1 - 1j)), CFG, Calibration())["visibilities"].persist()


def test_visibility_round_trip(spark, visibilities, tmp_path):
    out = str(tmp_path)
    products.write_product(visibilities, out, "visibilities")
    plain = products.read_visibilities(spark, out)
    assert plain.where("i = 0 and j = 1").first().baseline_id == 1
    receivers = spark.createDataFrame([(0, 0, 35), (0, 1, -1)], "run int, canonical int, antenna_id int")
    products.write_baselines(receivers, out)
    d = products.read_visibilities(spark, out)
    assert d.count() == visibilities.count() and d.where("j = 1 and zeroed = 0").count() == 0
    assert {r.baseline_id for r in d.where("j = 0").collect()} == {256 * 35 + 35}
    plan = products.read_product(spark, out, "visibilities").where("channel = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan


def test_fan_out_and_batches(spark, visibilities, tmp_path):
    seen = []
    n = products.fan_out(visibilities, [lambda d: seen.append(d.count()), None, lambda d: seen.append(d.count())])
    assert n == 2 and seen == [visibilities.count()] * 2
    for _ in range(2):
        products.write_batch(visibilities, str(tmp_path), "vis", 3)
    assert products.read_product(spark, str(tmp_path), "vis").count() == visibilities.count()


def test_mapping_csv_and_manifest(spark, tmp_path):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=2, steps=4, packets=2)
    w = spark.createDataFrame([(0, 0, 0, 5, 0), (0, 0, 1, 5, 1)],
                              "run long, fpga_id int, stream int, antenna_id int, polarization int")
    products.write_stream_mapping(wiring.stream_mapping(w, cfg, ["eth1"]), str(tmp_path / "map"))
    back = spark.read.csv(str(tmp_path / "map"), header=True)
    assert len(back.columns) == 13 and back.count() == 4
    assert {r.network_interface for r in back.collect()} == {"eth1"}
    (tmp_path / "config.json").write_text('{"a": 1}')
    doc = products.run_manifest(spark, {"config": str(tmp_path / "config.json"), "gains": str(tmp_path / "none.json")},
                                {"build": {"version": "1"}}, w, cfg).first().manifest
    m = json.loads(doc)
    assert m["schema_version"] == 1 and m["build"]["version"] == "1"
    assert m["input_files"]["config"] == {"path": str(tmp_path / "config.json"), "present": True, "content": '{"a": 1}'}
    assert m["input_files"]["gains"]["present"] is False
    assert len(m["forward_mapping"]) == 4 and len(m["reverse_mapping"]) == 4


def test_series_retention_and_timings(spark):
    d = spark.createDataFrame([(b, c, 0, 0, [1.0, 2.0]) for b in range(4) for c in range(4)],
                              "block long, channel int, p int, q int, eigvals array<double>")
    s = products.eigen_series(d, 2, 4)
    assert s.count() == 4 * 2 * 2
    assert {r.key for r in s.where("block = 1").collect()} == {f"ts:eig:ch:{c}:p:0:q:0:k:{k}" for c in (2, 3) for k in (0, 1)}
    t = spark.range(100).select(F.timestamp_seconds(F.col("id")).alias("ts"))
    assert products.expire(t, "ts", 60, F.timestamp_seconds(F.lit(99))).count() == 60
    rows = products.timing_rows(spark, list(range(150))).collect()
    assert len(rows) == 100 and tuple(rows[0]) == (0, 50.0)
    h = products.header_row(spark, CFG, telescope="array").first().header
    assert h["receivers"] == "2" and h["telescope"] == "array"
    r = products.channel_range(d, 192, 60000.5).first()
    assert (r.min_channel, r.max_channel, r.mjd) == (192, 195, 60000.5)


def test_scratch_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    d = materialize(spark.range(5), "t")
    assert d.count() == 5 and scratch_root(spark) in d.inputFiles()[0]


def test_dimension_files(spark, tmp_path):
    files = {
        "map": {"fpgas": {"0": {"board": "A", "streams": [{"stream": 2, "antenna_id": 35, "polarization": 0}]}}},
        "gains": {"weights": {"192": {"XX": {"7": {"real": 2.0, "imag": -1.0}}}}},
        "delays": {"1": 2.5, "2": 0.0}, "ints": {"3": 133},
        "targets": {"targets": [{"mode": "radec", "ra_deg": 1.5, "dec_deg": -2.0}, {}]},
        "config": {"array_location": {"latitude_deg": -30.0, "longitude_deg": 149.0, "height_m": 237},
                   "frequency_plan": {"base_frequency_hz": 0, "channel_bandwidth_hz": 781250},
                   "antenna_positions": {"1": {"35": {"east": 1.0, "north": 2.0, "up": 0}}}}}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    at = lambda n: str(tmp_path / f"{n}.json")
    assert dims.stream_map(spark, at("map")).first()[:] == (0, 2, 35, 0)
    assert dims.gains(spark, at("gains")).first()[:] == (192, "XX", 7, 2.0, -1.0)
    assert {tuple(r) for r in dims.fine_delays(spark, at("delays")).collect()} == {(1, 2.5), (2, 0.0)}
    assert dims.integer_map(spark, at("ints"), "fpga_id", "samples").first()[:] == (3, 133)
    t = dims.targets(spark, at("targets")).orderBy("beam").collect()
    assert [tuple(r) for r in t] == [(0, "radec", 1.5, -2.0), (1, "zenith", 0.0, 0.0)]
    assert dims.site(spark, at("config")).first().channel_bandwidth_hz == 781250
    assert dims.antenna_positions(spark, at("config")).first()[:] == (1, 35, 1.0, 2.0, 0.0)
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception):
        dims.gains(spark, at("bad")).collect()


def test_benchmark_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "noise\n[CorrBeam ch=8 fpga=4 rx=40] runs/sec=321.5 GB/sec=6.78 realtime=531%\n"
        "=== corr-packet sweep ===\n[CorrBeam ch=8 fpga=4 rx=40] corr=64 runs/sec=1418\n"
        "=== channel sweep\n[Lambda GPU ch=16 fpga=1 rx=10] runs/sec=1e2\n")
    rows = logs.benchmark_log(spark, str(tmp_path / "log.txt")).collect()
    assert [(r.tag, r.ch, r.sweep, r.metrics.get("runs/sec")) for r in rows] == [
        ("CorrBeam", 8, "channel", 321.5), ("CorrBeam", 8, "corr", 1418.0), ("Lambda GPU", 16, "channel", 100.0)]
    assert rows[0].metrics["realtime"] == 531.0


def test_long_benchmark_lines_are_read_whole(spark):
    pad = " pad=1" + " " * (1 << 20)
    lines = [("[CorrBeam ch=8 fpga=4 rx=40] runs/sec=1" + pad + "GB/sec=2",), ("[CorrBeam" + " " * (1 << 20) + " ch=8 fpga=4 rx=40] runs/sec=3",)]
    rows = reports.parse_benchmark_log(spark.createDataFrame(lines, "line string")).collect()
    assert [(r.tag, r.rx, r.metrics["runs/sec"], r.metrics.get("GB/sec")) for r in sorted(rows, key=lambda r: r.metrics["runs/sec"])] == [
        ("CorrBeam", 40, 1.0, 2.0), ("CorrBeam", 40, 3.0, None)]


def test_profiler_exports(spark, tmp_path):
    (tmp_path / "long.csv").write_text(
        '==PROF== junk, "x"\n"ID","Kernel Name","Metric Name","Metric Unit","Metric Value"\n'
        '"0","void a::k1<int>(float*, int)","Duration","ms","1.5"\n"0","void a::k1<int>(float*, int)","Cycles","","6,655"\n'
        '"1","k2","Duration","ms","oops"\n')
    rows = {(r.launch, r.metric): r for r in logs.profiler_csv(spark, str(tmp_path / "long.csv")).collect()}
    assert rows["0", "Duration"].kernel == "k1" and rows["0", "Cycles"].value == 6655.0 and rows["1", "Duration"].value is None
    (tmp_path / "wide.csv").write_text('"ID","Kernel Name","gpu.time","sm.pct"\n"","","us","%"\n'
                                       '"0","k1","1,000.5","7"\n"1","k2","2",""\n')
    wide = logs.profiler_csv(spark, str(tmp_path / "wide.csv"))
    got = {(r.kernel, r.metric): r.value for r in wide.collect()}
    assert got == {("k1", "gpu.time"): 1000.5, ("k1", "sm.pct"): 7.0, ("k2", "gpu.time"): 2.0, ("k2", "sm.pct"): None}
    # files of other columns in one read, each by its own header
    (tmp_path / "more.csv").write_text('chatter\nID,Metric Value,Kernel Name,Metric Name\n7,"1,5","k ""q"", x",Cycles\n')
    (tmp_path / "none.csv").write_text("no header here\n")
    both = {(r.launch, r.kernel, r.metric): (r.unit, r.value) for r in logs.profiler_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert both["7", 'k "q", x', "Cycles"] == (None, 15.0) and both["0", "k1", "Duration"] == ("ms", 1.5) and both["0", "k1", "sm.pct"] == (None, 7.0)
    assert len(both) == 3 + 4 + 1
    (tmp_path / "bad").write_text('"ID","Metric Name"\n"1","x"\n')
    with pytest.raises(PySparkException, match="lacks required columns"):
        logs.profiler_csv(spark, str(tmp_path / "bad")).collect()
    launches = reports.profile_wide(wide.withColumn("launch", F.col("launch").cast("int")), ["launch", "kernel"],
                                    {"gpu.time": "duration_us", "sm.pct": "sm_pct"})
    means = reports.kernel_means(launches, ["duration_us", "sm_pct"])
    assert [r.kernel for r in reports.top_kernels(means, 1).collect()] == ["k1"]


def test_comparison_keeps_both_sides(spark):
    b = spark.createDataFrame([(8, 100.0), (16, 50.0), (32, 0.0)], "ch int, r double")
    c = spark.createDataFrame([(8, 94.0), (24, 7.0), (32, 5.0)], "ch int, r double")
    rows = {r.ch: r for r in reports.compare(b, c, ["ch"], "r").collect()}
    assert rows[8].regression and rows[8].change == pytest.approx(-0.06)
    assert rows[16].current is None and not rows[16].regression and rows[32].change == 0.0 and len(rows) == 4


def test_histogram_and_latest(spark):
    d = spark.createDataFrame([(0, v) for v in [0, 0, 1, 5, 10]] + [(1, 3)], "g int, v int")
    rows = {(r.g, r.bin): r.n for r in reports.histogram(d, ["g"], "v", 10).collect()}
    assert rows == {(0, 0): 2, (0, 1): 1, (0, 5): 1, (0, 9): 1, (1, 0): 1}
    assert {(r.g, r.v) for r in reports.latest_block(d, ["g"], "v").collect()} == {(0, 10), (1, 3)}
    assert {r.column: r.type for r in reports.inventory(d, "x").collect()} == {"g": "int", "v": "int"}


def test_series_store_merges_and_compacts(spark, tmp_path):
    schema = "key string, block long, value double"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    got = lambda s: sorted(tuple(r) for r in s.read(spark).select("key", "block", "value").collect())
    store = SeriesStore(str(tmp_path / "s"), files=2)
    with pytest.raises(FileNotFoundError):
        store.read(spark)
    store.compact(spark, 5)
    store.upsert(rows(("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)), 0)
    store.upsert(rows(("a", 2, 20.0), ("a", 3, 3.0), ("a", 3, 4.0)), 1)
    want = [("a", 1, 1.0), ("a", 2, 20.0), ("a", 3, 4.0), ("b", 1, 5.0)]
    assert got(store) == want
    store.upsert(rows(("a", 2, 20.0), ("a", 3, 3.0), ("a", 3, 4.0)), 1)       # repeated
    store.compact(spark, 0)
    assert got(store) == want
    (tmp_path / "s" / "base" / "1").mkdir()         # a compaction that died
    (tmp_path / "s" / "base" / "1" / "part-0.parquet").write_bytes(b"rest")
    assert got(store) == want
    store.compact(spark, 1)
    store.compact(spark, 1)
    assert got(store) == want and spark.read.parquet(str(tmp_path / "s" / "base" / "1")).count() == 4
    store.upsert(rows(("b", 1, 6.0)), 2)
    assert got(store) == want[:3] + [("b", 1, 6.0)]
    assert got(SeriesStore(str(tmp_path / "s"), keep=2)) == [("a", 2, 20.0), ("a", 3, 4.0), ("b", 1, 6.0)]


def test_eigen_points(spark):
    cfg = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=3, pols=2, steps=8, packets=2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 40)) + 1j * rng.normal(size=(6, 40))
    v = correlate.packed_triangle(x, 3, 2).ravel()
    rows = [(b, c, v.real.tolist(), v.imag.tolist()) for b in (0, 1) for c in (0, 1)]
    eig = adaptive.eigen(spark.createDataFrame(rows, "block long, channel int, re array<double>, im array<double>"), cfg)
    got = {r.key: r.value for r in eigen_points(eig, 3, 1, 2).where("block = 1").collect()}
    assert all(k.startswith("ts:ch:1:") for k in got) and len(got) == 2 * (3 + 3 * 3 * 2)
    for p in (0, 1):
        m = x.reshape(3, 2, 40)[:, p] @ x.reshape(3, 2, 40)[:, p].conj().T
        for k in range(3):
            name = f"ts:ch:1:p:{p}-{p}:k:{k}"
            u = np.array([got[f"{name}:vec:j:{j}:re"] + 1j * got[f"{name}:vec:j:{j}:im"] for j in range(3)])
            assert np.allclose(m @ u, got[f"{name}:val"] * u)
