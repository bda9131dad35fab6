"""Wire frames, captures and capture files."""

import io
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation, functions as F

from helpers import payload
from phasegrid.config import ArrayConfig
from phasegrid.sources import capture, packet_files, pcap, synthetic, wire
from phasegrid.streaming import rollup

CFG = ArrayConfig(channels=2, fpgas=2, recv_per_fpga=10, pols=2, steps=64, packets=4)


def frame(count, fpga, channel, body, octet=0):
    network = bytearray(42)
    network[12:15], network[23] = b"\x08\x00\x45", 17
    network[26:30] = bytes([10, 0, octet, 1])
    return bytes(network) + struct.pack("<QIH8x", count, fpga, channel) + body


BODY = payload(CFG, lambda t, n, p: complex(t - 32, n), lambda n, p: 100 * n + p)


def test_header_fields(spark):
    d = spark.createDataFrame([(frame(123456789012, 7, 300, BODY, 9),)], "frame binary")
    r = wire.parse_frames(d, CFG).first()
    assert (r.sample_count, r.fpga_id, r.freq_channel) == (123456789012, 7, 300)
    assert bytes(r.payload) == BODY and r.payload_size == len(BODY)
    assert wire.parse_frames(d, CFG, source_from_ip=True).first().fpga_id == 9


def test_bare_payload_has_no_network_header(spark):
    d = spark.createDataFrame([(struct.pack("<QIH8x", 55, 1, 2) + BODY,)], "frame binary")
    r = wire.parse_frames(d, CFG).first()
    assert (r.sample_count, r.fpga_id, r.freq_channel) == (55, 1, 2) and bytes(r.payload) == BODY


def test_short_frames_vanish_and_zero_counter_fails(spark):
    assert wire.parse_frames(spark.createDataFrame([(b"x" * 63,)], "frame binary"), CFG).count() == 0
    bad = spark.createDataFrame([(frame(0, 0, 0, BODY),)], "frame binary")
    with pytest.raises(PySparkException, match="sample counter is zero"):
        wire.parse_frames(bad, CFG).collect()


def test_payload_positions(spark):
    scales, x = wire.split_payload(BODY, CFG)
    assert x[63, 9, 1] == complex(31, 9) and scales[3, 1] == 301
    d = spark.createDataFrame([(1, BODY)], "id int, payload binary")
    rows = {(r.t, r.n, r.pol): r for r in wire.payload_samples(d, CFG, ["id"]).collect()}
    assert len(rows) == 64 * 10 * 2
    assert (rows[63, 9, 1].re, rows[63, 9, 1].im, rows[0, 4, 0].scale) == (31, 9, 400)


def test_encode_then_parse(spark):
    d = spark.createDataFrame([(77, 1, 5, list(range(20)), list(range(-64, 64)) * 20)],
                              "c long, f int, ch int, s array<int>, x array<int>")
    f = d.select(wire.encode_frame("c", "f", "ch", "s", "x", F.lit(200)).alias("frame"))
    r = wire.parse_frames(f, CFG, source_from_ip=True).first()
    assert (r.sample_count, r.fpga_id, r.freq_channel) == (77, 200, 5)
    assert np.frombuffer(bytes(r.payload), dtype="<i2", count=20).tolist() == list(range(20))


def test_beam_packet(spark):
    head = bytearray(96)
    head[0:16] = struct.pack("<QQ", 5, 50)
    head[32:36] = struct.pack("<f", 2.0)
    head[48:60] = struct.pack("<IHHHH", 100, 2, 2, 4, 3)
    head[67] = 4
    data = np.arange(32, dtype="i1")
    d = spark.createDataFrame([(bytes(head) + bytes(16) + data.tobytes(),), (bytes(head[:58]) + b"\x04\x00" + bytes(200),)],
                              "payload binary")
    rows = {(r.channel, r.pol): r.power for r in wire.beam_packet_power(d.limit(1), 3).collect()}
    x = data.astype(float).reshape(2, 2, 8)
    want = (x ** 2).sum(axis=2) / 4 / 2 / 4
    assert rows == {(100 + c, p): pytest.approx(want[c, p]) for c in range(2) for p in range(2)}
    assert wire.beam_packet_power(d.limit(1), 1).count() == 0


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    frames = [frame(1000 + 64 * k, k % 2, k % 3, BODY) for k in range(25)]
    for part in range(2):
        rows = [(10 ** 15 + k, f) for k, f in enumerate(frames) if k % 2 == part]
        (root / f"part{part}.pcap").write_bytes(pcap.pcap_bytes(rows))
    return str(root), frames


def test_pcap_source_splits_exactly(spark, captures):
    root, frames = captures
    whole = pcap.read_pcap(spark, root)
    assert sorted(bytes(r.frame) for r in whole.collect()) == sorted(frames)
    size = len(frames[0])
    split = pcap.read_pcap(spark, root, frame_length=size, split_bytes=3 * (size + 16) + 5)
    assert split.rdd.getNumPartitions() > 8
    assert split.exceptAll(whole).count() == 0 and split.count() == 25
    with pytest.raises(PySparkException, match="holds"):
        pcap.read_pcap(spark, root, frame_length=size - 16).count()


def test_pcap_formats_and_truncation(spark, tmp_path):
    good = pcap.pcap_bytes([(5_000_001, b"a" * 70), (6_000_002, b"b" * 80)])
    swapped = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 5, 7000, 3, 9) + b"xyz"
    (tmp_path / "a.pcap").write_bytes(good[:-5])
    (tmp_path / "b.pcap").write_bytes(swapped)
    rows = sorted(pcap.read_pcap(spark, str(tmp_path)).collect(), key=lambda r: r.file)
    assert [bytes(r.frame) for r in rows] == [b"a" * 70, b"xyz"] and rows[1].wire_length == 9
    stream = io.BytesIO(swapped)
    assert [r[1] for r in packet_files.layout(stream).walk(stream, 24, len(swapped), bodies=True)] == [5_000_007]
    usable, bad = wire.oversized(pcap.read_pcap(spark, str(tmp_path)), slot_bytes=50)
    assert usable.count() == 1 and bad.count() == 1


def varied(n=40):
    """Records of many lengths, a few that hold records themselves."""
    inner = pcap.pcap_bytes([(10 ** 15 + k, b"i" * 50) for k in range(6)])[24:]
    return [(10 ** 15 + k, bytes([k]) * (64 + 7 * k % 90) + (inner + b"zz" if k % 9 == 4 else b"")) for k in range(n)]


@pytest.mark.parametrize("make", [pcap.pcap_bytes, pcap.pcapng_bytes, lambda f: pcap.pcapng_bytes(f, ">", 9, 7)])
@pytest.mark.parametrize("cut_off", [0, 5])
def test_every_cut_gives_each_record_once(make, cut_off):
    """A file cut at any byte: the part before and the part after have all records, found by looks alone."""
    content = make(varied())
    content = content[:len(content) - cut_off]
    stream = io.BytesIO(content)
    kind = packet_files.layout(stream)
    whole = [r[0] for r in kind.walk(stream, kind.begin, len(content), bodies=True)]
    assert len(whole) == 40 - (cut_off > 0)
    surveyed = packet_files.survey(stream, 0, len(content))
    for at in range(kind.begin, len(content)):
        left, right = packet_files.survey(stream, 0, at, kind.begin), packet_files.survey(stream, at, len(content))
        if isinstance(kind, packet_files.Classic):
            assert left.stop == right.start == min([p for p in whole if p >= at], default=len(content))
        else:
            assert left.stop == right.start or right.start == len(content) and cut_off
            scope = [(a, b) for a, b in surveyed.scope if a < right.start]
            again = packet_files.layout(stream, scope)
            assert [r[0] for r in again.walk(stream, right.start, len(content), bodies=True)] == [p for p in whole if p >= at]


@pytest.mark.parametrize("name,make", [("a.pcap", pcap.pcap_bytes), ("b.pcapng", lambda f: pcap.pcapng_bytes(f, "<", 9, 11))])
def test_split_reading_equals_whole(spark, tmp_path, name, make):
    frames = varied(60)
    (tmp_path / name).write_bytes(make(frames))
    want = sorted(frames)
    rows = lambda d: sorted((r.us, bytes(r.frame)) for r in d.selectExpr("unix_micros(ts) as us", "frame").collect())
    assert rows(pcap.read_pcap(spark, str(tmp_path))) == want
    for split in (97, 1000):
        assert rows(pcap.read_pcap(spark, str(tmp_path), split_bytes=split, index=True)) == want
    assert rows(pcap.read_pcap(spark, str(tmp_path), split_bytes=1500)) == want
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    assert rows(pcap.frames_of_files(binary)) == want


def test_content_that_looks_like_records(spark, tmp_path):
    """Frames with whole captures inside: looks alone are refused, the index is exact."""
    inner = pcap.pcap_bytes([(10 ** 15 + k, b"i" * 50) for k in range(40)])[24:]
    frames = [(10 ** 15 + k, inner + bytes([k])) for k in range(5)]
    (tmp_path / "a.pcap").write_bytes(pcap.pcap_bytes(frames))
    split = len(inner) // 2
    got = pcap.read_pcap(spark, str(tmp_path), split_bytes=split, index=True)
    assert sorted(bytes(r.frame) for r in got.collect()) == sorted(f for _, f in frames)
    with pytest.raises(PySparkException, match="index=True"):
        pcap.read_pcap(spark, str(tmp_path), split_bytes=split).count()


def test_both_formats_give_the_same_packets(spark, captures, tmp_path):
    root, frames = captures
    rows = [(10 ** 15 + k, f) for k, f in enumerate(frames)]
    (tmp_path / "all.pcapng").write_bytes(pcap.pcapng_bytes(rows, resolution=9, section_every=10))
    a = capture.open_capture(spark, "pcap", root, CFG).drop("arrival")
    for split in (pcap.SPLIT_BYTES, 5000):
        b = capture.open_capture(spark, "pcap", str(tmp_path), CFG, split_bytes=split).drop("arrival")
        assert b.exceptAll(a).count() == 0 and b.count() == 25


def test_gate_counts_in_the_same_pass(spark):
    good = frame(1000, 0, 0, BODY)
    tcp, arp = bytearray(good), bytearray(good)
    tcp[23], arp[12:14] = 6, b"\x08\x06"
    rows = [(good, len(good)), (good, len(good) - 1), (good + b"x", len(good) + 1), (bytes(tcp), 9000), (bytes(arp), 9000), (b"x" * 63, 63),
            (None, 5), (good[42:], len(good) - 42), (good, None)]
    seen = Observation()
    d = wire.gate(spark.createDataFrame(rows, "frame binary, wire_length int"), CFG, seen, len(good))
    assert d.count() == 3 and seen.get == {"short": 2, "oversized": 2, "not_udp": 2}
    assert wire.gate(spark.createDataFrame([(good,)], "frame binary"), CFG).count() == 1


def test_capture_backends_and_stream(spark, captures, tmp_path):
    root, frames = captures
    batch = capture.open_capture(spark, "pcap", root, CFG)
    assert batch.count() == 25 and batch.select("sample_count").distinct().count() == 25
    stream = capture.open_capture(spark, "pcap", root, CFG, streaming=True)
    out = rollup.run_to_table(stream.select("sample_count", "fpga_id"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.exceptAll(batch.select("sample_count", "fpga_id")).count() == 0 and out.count() == 25
    with pytest.raises(ValueError):
        capture.open_capture(spark, "rdma", root, CFG)


def test_synthetic_signals(spark):
    cfg = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=3, pols=1, steps=16, packets=2)
    d = synthetic.tone_and_noise(spark, cfg, 2, tone=50, cycles=0.25)
    assert d.count() == 2 * 2 * 16 * 3
    assert {(r.re, r.im) for r in d.where("t % 4 = 1").collect()} == {(0, 50)}
    common = synthetic.tone_and_noise(spark, cfg, 2, common=30)
    per_cell = common.groupBy("block", "pkt", "t").agg(F.count_distinct("re", "im").alias("n"))
    assert per_cell.where("n > 1").count() == 0 and common.select("re").distinct().count() > 5
    one = synthetic.single_antenna(spark, cfg, 1, {1: (4, 0)})
    assert {(r.recv, r.re) for r in one.collect()} == {(0, 0), (1, 4), (2, 0)}
