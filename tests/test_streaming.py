"""Continuous assembly, rollups and stopping rules."""

import random

from pyspark.sql import functions as F

from helpers import full_block, packets
from phasegrid.config import ArrayConfig
from phasegrid.operators import ingest
from phasegrid.plans import jobs
from phasegrid.plans.blocks import Calibration
from phasegrid.streaming import rollup
from phasegrid.streaming.assembler import BlockAssembler, missing_in, native_progress
from phasegrid.streaming.monitor import RunMonitor, StopRule, watch

CFG = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=1, pols=1, steps=8, packets=10)


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def feed(spark, assembler, *batches):
    """Run batches of (sample_count, fpga, channel); arrival counts on across them."""
    n = 0
    for b, rows in enumerate(batches):
        data = [(n + i, s, f, c, n + i) for i, (s, f, c) in enumerate(rows)]
        n += len(rows)
        assembler(spark.createDataFrame(data, "arrival long, sample_count long, fpga_id int, freq_channel int, value long"), b)


def grid(ks, channels=(0, 1), start=1000):
    return [(start + 8 * k, 0, c) for k in ks for c in channels]


def emitted(spark, assembler):
    return {(r.block, r.channel, r.pkt): r.value for r in assembler.blocks(spark).collect()}


def test_batches_give_the_same_blocks_as_one_batch_job(spark, tmp_path):
    rows = grid(range(64))
    rng = random.Random(4)
    body = rows[1:]
    for i in range(0, len(body) - 6, 6):   # local reordering only
        part = body[i:i + 6]
        rng.shuffle(part)
        body[i:i + 6] = part
    rows = rows[:1] + body
    cuts = [rows[:37], rows[37:38], rows[38:90], rows[90:]]
    a = BlockAssembler(CFG, str(tmp_path), ["value"])
    feed(spark, a, *cuts)
    got = emitted(spark, a)
    whole = spark.createDataFrame([(i, s, f, c, i) for i, (s, f, c) in enumerate(rows)],
                                  "arrival long, sample_count long, fpga_id int, freq_channel int, value long")
    want = {(r.block, r.channel, r.pkt): r.value for r in ingest.assemble(whole, CFG, ["value"]).collect()}
    assert {k[0] for k in got} == set(range(6))
    assert got == {k: v for k, v in want.items() if k[0] < 6}
    rest = a.finish(spark)
    assert {(r.block, r.channel, r.pkt): r.value for r in rest.collect()} == {k: v for k, v in want.items() if k[0] == 6}
    assert missing_in(a.blocks(spark).where("block < 6"), CFG).where("missing > 0").count() == 0


def test_block_waits_for_every_stream(spark, tmp_path):
    a = BlockAssembler(CFG, str(tmp_path), ["value"])
    head = grid(range(11), channels=(1,)) + grid(range(5), channels=(0,))
    feed(spark, a, head)
    assert emitted(spark, a) == {}
    feed(spark, BlockAssembler(CFG, str(tmp_path / "b"), ["value"]), head)
    # a far-future packet is held back and must not complete the block
    late = grid(range(5, 11), channels=(0,)) + [(992, 0, 0), (992, 0, 1)]
    b = BlockAssembler(CFG, str(tmp_path / "c"), ["value"], clock=Clock())
    feed(spark, b, head, [(1000 + 500 * 8, 0, 0)], late)
    counts = {r.batch: r for r in b.counters(spark).collect()}
    assert [counts[i].emitted_blocks for i in range(3)] == [0, 0, 1]
    assert counts[1].deferred == 1
    done = b.blocks(spark).where("block = 0")
    assert done.count() == 24 and missing_in(done, CFG).first().missing == 0


def test_stalled_streams_jump(spark, tmp_path):
    clock = Clock()
    a = BlockAssembler(CFG, str(tmp_path), ["value"], horizon=3, stall_ms=100, clock=clock)
    feed(spark, a, grid(range(30)))
    assert {k[0] for k in emitted(spark, a)} == {0, 1}
    jump = spark.createDataFrame([(60, 20000, 0, 0, 1), (61, 20000, 0, 1, 2)],
                                 "arrival long, sample_count long, fpga_id int, freq_channel int, value long")
    a(jump, 1)
    assert {k[0] for k in emitted(spark, a)} == {0, 1}
    clock.now += 0.5
    a(jump.limit(0), 2)
    assert {k[0] for k in emitted(spark, a)} == {0, 1, 2, 3}   # block 3 only as halo of block 2
    last = a.counters(spark).where("batch = 2").first()
    assert last.next_block == (20000 - 1000) // 80 and last.emitted_blocks == 237 - 2
    # the jumped packets are still there and complete later
    more = spark.createDataFrame([(70 + i, s, f, c, i) for i, (s, f, c) in
                                  enumerate(grid(range(2376, 2382)))],
                                 "arrival long, sample_count long, fpga_id int, freq_channel int, value long")
    a(more, 3)
    got = {k for k in emitted(spark, a) if k[0] == 237}
    assert (237, 0, 5) in got and len([k for k in got if 0 <= k[2] < 10]) == 10


def test_repeated_batch_replaces_itself_and_old_packets_count(spark, tmp_path):
    a = BlockAssembler(CFG, str(tmp_path), ["value"])
    second = grid(range(12, 24)) + [(1000, 0, 0)]
    feed(spark, a, grid(range(12)), second)
    before = emitted(spark, a)
    again = spark.createDataFrame([(24 + i, s, f, c, 24 + i) for i, (s, f, c) in enumerate(second)],
                                  "arrival long, sample_count long, fpga_id int, freq_channel int, value long")
    BlockAssembler(CFG, str(tmp_path), ["value"])(again, 1)
    assert emitted(spark, a) == before
    assert a.counters(spark).where("batch = 1").first().discarded_old == 1


def test_end_of_stream_emits_everything_once(spark, tmp_path):
    """Open blocks, short ones and held packets come out; done again, or overtaken by more data, nothing is there twice."""
    rows = grid(range(25)) + [(1000 + 8 * 900, 0, 0)]
    a = BlockAssembler(CFG, str(tmp_path), ["value"], clock=Clock())
    feed(spark, a, rows)
    assert {k[0] for k in emitted(spark, a)} == {0, 1}
    whole = lambda rows: {(r.block, r.channel, r.pkt): r.value for r in ingest.assemble(spark.createDataFrame(
        [(i, s, f, c, i) for i, (s, f, c) in enumerate(rows)],
        "arrival long, sample_count long, fpga_id int, freq_channel int, value long"), CFG, ["value"]).collect()}
    a.finish(spark)
    assert emitted(spark, a) == whole(rows) and a.blocks(spark).count() == len(whole(rows))
    BlockAssembler(CFG, str(tmp_path), ["value"]).finish(spark)
    assert emitted(spark, a) == whole(rows) and a.blocks(spark).count() == len(whole(rows))
    assert a.counters(spark).count() == 1
    # the stream goes on after all
    more = grid(range(25, 45))
    data = [(len(rows) + i, s, f, c, len(rows) + i) for i, (s, f, c) in enumerate(more)]
    a(spark.createDataFrame(data, "arrival long, sample_count long, fpga_id int, freq_channel int, value long"), 1)
    a.finish(spark)
    assert emitted(spark, a) == whole(rows + more) and a.blocks(spark).count() == len(whole(rows + more))


def test_duplicate_across_batches_keeps_the_last(spark, tmp_path):
    a = BlockAssembler(CFG, str(tmp_path), ["value"])
    feed(spark, a, grid(range(5)), [(1016, 0, 1)] + grid(range(5, 12)))
    assert emitted(spark, a)[0, 1, 2] == 10


def test_stream_before_any_accepted_packet(spark, tmp_path):
    a = BlockAssembler(CFG, str(tmp_path), ["value"])
    feed(spark, a, [(1000, 0, 9)], grid(range(12)))
    assert {k[0] for k in a.blocks(spark).select("block").collect()} == {0}
    assert a.counters(spark).where("batch = 0").first().discarded_channel == 1


WIRE = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=1, steps=4, packets=3, accumulate=2)


def test_file_stream_to_integrations(spark, tmp_path):
    rows = full_block(WIRE, 400, 0, blocks=7, fpga_value=lambda f, c, k: complex(k + 1, 1))
    d = packets(spark, rows)
    for part in range(3):
        d.where(F.floor(F.col("arrival") / 7) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    sums = rollup.Integrator(WIRE, Calibration(), str(tmp_path / "vis"))
    a = BlockAssembler(WIRE, str(tmp_path / "blocks"), ["payload"], on_blocks=sums)
    rollup.run_batches(stream, a, str(tmp_path / "cp"), end=True)
    assert a.counters(spark).count() == 3
    got = {(r.integration, r.i, r.j): r.re for r in sums.integrations(spark).collect()}
    want = {(r.integration, r.i, r.j): r.re for r in jobs.observe(d, WIRE, Calibration())["visibilities"].collect()}
    assert got == want and len(got) == 4 * 3


def test_rollup_counts_and_first_wins(spark, tmp_path):
    d = spark.createDataFrame([("a", f"2024-01-01 00:00:0{i}", float(i % 3), i) for i in range(10)],
                              "k string, t string, v double, sample_count long").withColumn("ts", F.to_timestamp("t"))
    d.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    out = rollup.run_to_table(rollup.rollup_max(stream(), ["k"], "ts", "v", "2 seconds", "3 seconds"),
                              str(tmp_path / "o"), str(tmp_path / "c"))
    assert {r.window_start.second: r.max_value for r in out.collect()} == {0: 1.0, 2: 2.0, 4: 2.0}
    counts = rollup.RunningCounts(["k"], str(tmp_path / "n"))
    rollup.run_batches(stream(), counts, str(tmp_path / "c2"))
    r = counts.totals(spark).first()
    assert (r.packets, r.latest) == (10, 9)
    one = rollup.run_to_table(rollup.first_wins(stream(), ["k", "v"], "ts", "1 minute"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert one.count() == 3


def test_native_progress_closes_windows(spark, tmp_path):
    d = spark.createDataFrame([(1000 + 8 * k, 0, 0, f"2024-01-01 00:{k:02d}:00") for k in range(20)],
                              "sample_count long, fpga_id int, freq_channel int, t string").withColumn("ts", F.to_timestamp("t"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    out = rollup.run_to_table(native_progress(stream, CFG, 1000), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.groupBy("block").agg(F.sum("packets").alias("n")).where("block = 0").first().n == 10


def test_stop_rules():
    clock = Clock()
    r = StopRule(max_packets=100, clock=clock)
    assert r.reason(10) is None and r.reason(100) == "packet limit"
    r = StopRule(max_seconds=5, clock=clock)
    assert r.reason(1) is None
    clock.now += 6
    assert r.reason(2) == "duration"
    r = StopRule(clock=clock)
    assert [r.reason(7) for _ in range(6)] == [None] * 5 + ["stagnant"]


def test_monitor_stops_a_query(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    monitor = RunMonitor()
    spark.streams.addListener(monitor)
    try:
        q = (spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop")
             .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start())
        assert watch(q, monitor, StopRule(max_packets=10), poll_seconds=0.3) == "packet limit"
        assert monitor.rows == 10 and len(monitor.timings) >= 1
    finally:
        spark.streams.removeListener(monitor)
