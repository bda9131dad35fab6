"""Assembly of packets into blocks against hand-derived results."""

import random
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import full_block, packets, payload
from phasegrid.config import ArrayConfig
from phasegrid.operators import ingest
from phasegrid.plans import blocks, jobs

ONE = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=32, pols=2, steps=8, packets=10)
TWO = ArrayConfig(channels=2, fpgas=2, recv_per_fpga=10, pols=2, steps=8, packets=10, fpga_delays={1: 16})
FOUR = ArrayConfig(channels=2, fpgas=4, recv_per_fpga=10, pols=2, steps=8, packets=10, fpga_ids=(10, 11, 12, 13),
                   fpga_delays={11: 16, 12: 24, 13: 8})


def thin(spark, rows):
    return packets(spark, [(s, f, c, None) for s, f, c in rows])


def grid(cfg, start, ks, channels=None, fpgas=None):
    return [(start + k * cfg.step, f, c) for c in channels or range(cfg.channels)
            for f in fpgas or cfg.fpga_ids for k in ks]


def test_complete_block_has_nothing_missing(spark):
    rows = grid(ONE, 1000, [*range(11), -1])
    arrived = ingest.assemble(thin(spark, rows), ONE, ["sample_count"])
    own = arrived.where("block = 0")
    assert own.count() == 24
    gone = ingest.missing_packets(arrived, ONE)
    assert gone.where("block = 0").count() == 0
    flags = ingest.arrival_flags(own, ONE)
    assert flags.count() == 24 and flags.where("not arrived").count() == 0


def test_block_bounds_follow_the_first_source(spark):
    d = thin(spark, grid(ONE, 1000, range(10)))
    rows = ingest.block_bounds(spark.createDataFrame([(0,), (1,)], "block long"), ONE, ingest.stream_start(d, ONE)).collect()
    assert [(r.start_seq, r.end_seq) for r in rows] == [(1000, 1072), (1080, 1152)]


def test_old_packets_are_discarded(spark):
    d = thin(spark, [(1000, 0, 0), (500, 0, 0), (992, 0, 1)])
    r = ingest.counters(d, ONE).first()
    assert (r.received, r.discarded_old, r.processed) == (3, 1, 2)
    arrived = ingest.assemble(d, ONE, ["sample_count"]).collect()
    assert sorted((a.block, a.channel, a.pkt) for a in arrived) == [(0, 0, 0), (0, 1, -1)]


def test_first_arrival_anchors_not_the_earliest(spark):
    d = thin(spark, [(1008, 0, 0), (1000, 0, 0)])
    got = {(a.block, a.pkt, a.sample_count) for a in ingest.assemble(d, ONE, ["sample_count"]).collect()}
    assert got == {(0, 0, 1008), (0, -1, 1000)}


def test_channel_window(spark):
    cfg = ArrayConfig(channels=2, fpgas=1, recv_per_fpga=1, steps=8, packets=10, min_channel=3)
    r = ingest.counters(thin(spark, [(1000, 0, c) for c in (2, 5, 3, 4)]), cfg).first()
    assert (r.discarded_channel, r.processed) == (2, 2)


@pytest.mark.parametrize("cfg, missing, last", [(TWO, 4, {1: 8}), (FOUR, 12, {1: 8, 2: 7, 3: 9})])
def test_delayed_sources_lose_the_tail(spark, cfg, missing, last):
    arrived = ingest.assemble(thin(spark, grid(cfg, 1000, range(10))), cfg, ["sample_count"]).where("block = 0")
    gone = ingest.missing_packets(arrived, cfg).collect()
    assert len(gone) == missing
    for source, first_gap in last.items():
        assert min(g.pkt for g in gone if g.source == source) == first_gap
    assert arrived.where("source = 1 and pkt = -1").count() == 2


def test_edge_packets_belong_to_two_blocks(spark):
    arrived = ingest.assemble(thin(spark, grid(ONE, 1000, range(30), channels=[0])), ONE, ["sample_count"])
    got = {(r.block, r.pkt): r.sample_count for r in arrived.collect()}
    assert got[0, 10] == got[1, 0] == 1080 and got[1, -1] == got[0, 9] == 1072
    assert (0, -1) not in got and max(b for b, _ in got) == 3


def test_missing_packets_are_zeroed_including_whole_blocks(spark):
    rows = grid(ONE, 1000, [0, 1, 2]) + grid(ONE, 1000, [25])
    arrived = ingest.assemble(thin(spark, rows), ONE, ["sample_count"])
    d = ingest.impute_missing(arrived, ONE, ["sample_count"])
    assert d.count() == 3 * 2 * 12
    assert d.where("not arrived and sample_count != 0").count() == 0
    per = {r.block: r.n for r in ingest.missing_packets(arrived, ONE).groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert per == {0: 14, 1: 20, 2: 18}


def test_unknown_source_fails(spark):
    with pytest.raises(PySparkException, match="unknown FPGA id 5"):
        ingest.assemble(thin(spark, [(1000, 5, 0)]), ONE, ["sample_count"]).collect()


def test_gap_and_watermark_follow_arrival(spark):
    d = thin(spark, [(64, 0, 0), (128, 0, 0), (256, 0, 0), (192, 0, 0), (64, 0, 1)])
    gaps = ingest.sequence_gaps(d, ["freq_channel"], 64, width=2).collect()
    assert sorted((g.previous, g.sample_count, g.gap) for g in gaps) == [(128, 256, 128), (256, 192, -64)]
    marks = ingest.watermarks(d, ["freq_channel", "fpga_id"], width=2).orderBy("arrival").collect()
    assert [m.watermark for m in marks] == [64, 128, 256, 256, 64]


def test_replay_continues_the_counter(spark):
    d = thin(spark, [(1000, 0, 0), (1128, 0, 0), (5000, 1, 0)])
    cfg_rows = {(r.fpga_id, r.loop, r.sample_count) for r in ingest.replay(d, 2).collect()}
    assert cfg_rows == {(0, 0, 1000), (0, 0, 1128), (0, 1, 1192), (0, 1, 1320), (1, 0, 5000), (1, 1, 5064)}
    assert ingest.replicate_sources(d, 3).count() == 9


def test_hot_copies_fold_before_the_shuffle(spark):
    rows = [(1000, 0, 0)] * 400 + grid(ONE, 1000, range(10), channels=[0])
    d = packets(spark, [(s, f, c, None) for s, f, c in rows]).withColumn("value", F.col("arrival"))
    arrived = ingest.assemble(d, ONE, ["value"])
    assert arrived.where("block = 0 and pkt = 0").first().value == 400
    plan = arrived._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_payloads_move_once(spark):
    rows = full_block(SMALL, 400, 1 + 1j, blocks=2)
    rows += [(400, 0, 0, payload(SMALL, 5 + 0j)), (404, 0, 0, payload(SMALL, 6 + 0j)), (404, 0, 0, payload(SMALL, 7 + 0j))]
    d = packets(spark, rows)
    got = ingest.assemble_payloads(d, SMALL)
    want = ingest.assemble(d, SMALL, ["payload"])
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    plan = blocks.reduce_blocks(got, SMALL, blocks.Calibration())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1   # payloads shuffle once, by block
    assert plan.count("FlatMapGroupsInPandas") >= 1


def test_truncated_payloads_are_set_aside(spark):
    rows = full_block(SMALL, 400, 1 + 1j)
    d = packets(spark, rows)
    short = d.withColumn("payload", F.substring("payload", F.lit(1), F.length("payload") - 1))
    none = d.withColumn("payload", F.lit(None).cast("binary"))
    both = d.unionByName(short).unionByName(none)
    good, bad = ingest.usable_payloads(both, SMALL)
    assert (good.count(), bad.count()) == (len(rows), 2 * len(rows))
    got, want = ingest.assemble_payloads(both, SMALL), ingest.assemble_payloads(d, SMALL)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert blocks.reduce_blocks(got, SMALL, blocks.Calibration()).count() == blocks.reduce_blocks(want, SMALL, blocks.Calibration()).count()


def cells(cfg, *blocks):
    return [(b, 0, 0, k) for b in blocks for k in range(cfg.packets)]


SLOTS = "block long, channel int, source int, pkt int"


def test_far_counter_does_not_fill_the_gap(spark):
    d = spark.createDataFrame(cells(SMALL, 3, 5) + [(10 ** 15, 0, 0, 0)], SLOTS)
    gaps = ingest.gaps_of(d, SMALL)
    assert [r.block for r in gaps.axis().orderBy("block").collect()] == [3, 4, 5]
    assert [r.block for r in gaps.strays.collect()] == [10 ** 15] and gaps.outages(SMALL).count() == 0
    gone = ingest.missing_packets(d, SMALL).collect()
    assert {r.block for r in gone} == {4}
    # what is listed and what is counted agree
    assert sum(r.missing for r in ingest.missing_by_integration(gaps, SMALL).collect()) == len(gone)
    flags = ingest.arrival_flags(d, SMALL).where("pkt between 0 and 2")
    assert flags.where("not arrived").count() == len(gone) and flags.count() == 9


def test_strays_between_parts_of_a_stream(spark):
    """The gap from part to part is one outage, whatever lone counters lie in it."""
    far = ingest.HORIZON + 1
    d = spark.createDataFrame(cells(SMALL, 0, 6 * far) + [(2 * far, 0, 0, 1), (4 * far, 0, 0, 2)], SLOTS)
    gaps = ingest.gaps_of(d, SMALL)
    assert sorted(r.block for r in gaps.strays.collect()) == [2 * far, 4 * far]
    assert [tuple(r) for r in gaps.outages(SMALL).collect()] == [(1, 6 * far - 1, 6 * far - 1, 3 * (6 * far - 1))]
    lone = ingest.gaps_of(spark.createDataFrame([(0, 0, 0, 1), (2 * far, 0, 0, 1)], SLOTS), SMALL)
    assert lone.strays is None and lone.blocks.count() == 2       # where all are alone, none is stray


@pytest.mark.parametrize("gap", [ingest.HORIZON, ingest.HORIZON + 1, 10 ** 12])
def test_outages_count_at_any_length(spark, gap):
    cfg = replace(SMALL, accumulate=56)
    d = spark.createDataFrame(cells(cfg, 3, 5, 5 + gap + 1), SLOTS)
    gaps = ingest.gaps_of(d, cfg)
    rows = ingest.missing_by_integration(gaps, cfg).collect()
    assert sum(r.total for r in rows) == 3 * (gap + 4) and sum(r.missing for r in rows) == 3 * (gap + 1)
    assert sum(r.integrations for r in rows) == (gap + 6) // 56 + 1
    out = [tuple(r) for r in gaps.outages(cfg).collect()]
    assert out == ([(6, gap + 5, gap, 3 * gap)] if gap + 1 > ingest.HORIZON else [])
    if gap <= ingest.HORIZON + 1:
        singles = ingest.single_integrations(ingest.missing_by_integration(gaps, cfg))
        assert [(r.n, r.m, r.t) for r in singles.selectExpr("count(distinct integration) n", "sum(missing) m", "sum(total) t").collect()] == [
            ((gap + 6) // 56 + 1, 3 * (gap + 1), 3 * (gap + 4))]
        listed = ingest.missing_packets(d, cfg).count()
        assert listed + sum(r[3] for r in out) == 3 * (gap + 1)


def test_gap_plans_read_once(spark, tmp_path):
    spark.createDataFrame(cells(SMALL, 3, 5, 9), SLOTS).write.parquet(str(tmp_path / "slots"))
    d = spark.read.parquet(str(tmp_path / "slots"))
    gaps = ingest.gaps_of(d, SMALL)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(ingest.single_integrations(ingest.missing_by_integration(gaps, SMALL))) == 1
    assert scans(gaps.axis()) == scans(gaps.outages(SMALL)) == 1
    assert scans(ingest.missing_packets(d, SMALL, gaps)) == 2


def test_stray_counters_are_set_aside_and_counted(spark):
    far = 400 + 4 * 3 * (ingest.HORIZON + 10)
    rows = full_block(SMALL, 400, 1 + 1j, blocks=2)
    d = packets(spark, rows + [(far, 0, 0, payload(SMALL, 1 + 0j))] * 2)
    out = jobs.observe(d, SMALL, blocks.Calibration())
    assert [tuple(r) for r in out["stray_counters"].collect()] == [(0, 0, far, 2)]
    assert {r.block for r in out["arrivals"].collect()} == {0, 1} and out["outages"].count() == 0
    assert {r.missing for r in out["missing"].collect()} == {0}
    assert {r.integration for r in out["visibilities"].collect()} == {0, 1} and out["counters"].first().stray_blocks == 1
    assert {r.channel: r.re for r in jobs.offline_correlation(d, SMALL).where("i = 0 and j = 0").collect()} == {0: 48.0}
    back = packets(spark, rows + full_block(SMALL, far, 1 + 1j))     # a stream that comes back is no stray
    out = jobs.observe(back, SMALL, blocks.Calibration())
    assert out["stray_counters"].count() == 0 and out["outages"].count() == 1 and out["visibilities"].select("integration").distinct().count() == 3


def test_packets_are_counted_while_blocks_are_formed(spark):
    rows = full_block(SMALL, 400, 1 + 1j, blocks=2)
    bad = [(400, 0, 5, payload(SMALL, 1)), (100, 0, 0, payload(SMALL, 1)), (404, 0, 0, b"short"), (404, 0, 0, None)]
    got = jobs.observe(packets(spark, rows + bad), SMALL, blocks.Calibration())["counters"].first()
    assert got.asDict() == {"received": len(rows) + 4, "discarded_channel": 1, "truncated": 2, "discarded_old": 1,
                            "processed": len(rows), "stray_blocks": 0}
    none = jobs.observe(packets(spark, rows).limit(0), SMALL, blocks.Calibration())
    assert none["counters"].first().received == 0 and none["missing"].count() == none["arrivals"].count() == 0


def test_products_carry_their_counters(spark):
    cfg = replace(SMALL, accumulate=2)
    rows = full_block(SMALL, 400, 1 + 1j, blocks=3)[:-2]     # the last block lacks two packets
    out = jobs.observe(packets(spark, rows), cfg, blocks.Calibration(weights=np.ones((1, 1, 1, 2), complex)))
    want = {0: (400, 420, 0), 1: (424, 432, 2)}
    assert {r.integration: (r.start_seq, r.end_seq, r.missing) for r in out["visibilities"].collect()} == want
    for name in ("beams", "spectra", "eigen"):
        got = {r.block: (r.start_seq, r.end_seq, r.missing) for r in out[name].collect()}
        assert got == {0: (400, 408, 0), 1: (412, 420, 0), 2: (424, 432, 2)}


def test_struct_arrivals_are_numbered(spark):
    rows = [(0, "a", 0, 100), (0, "a", 1, 104), (0, "b", 0, 112), (1, "a", 2, 116)]
    d = spark.createDataFrame(rows, "ts long, file string, pos long, sample_count long").repartition(3)
    d = d.select(F.struct("ts", "file", "pos").alias("arrival"), "sample_count", F.lit(1).alias("k"))
    gaps = ingest.sequence_gaps(d, ["k"], 4).collect()
    assert [(r.sample_count, r.gap) for r in gaps] == [(112, 8)]
    assert sorted(r.watermark for r in ingest.watermarks(d, ["k"]).collect()) == [100, 104, 112, 116]


def test_tied_arrivals_leave_one_row(spark):
    rows = full_block(SMALL, 400, 1 + 1j)
    d = packets(spark, rows)
    again = d.withColumn("payload", F.reverse("payload"))
    for parts in (1, 3):
        both = d.unionByName(again).repartition(parts)
        got = ingest.assemble_payloads(both, SMALL)
        want = ingest.assemble(both, SMALL, ["payload"])
        assert got.count() == want.count() == ingest.assemble_payloads(d, SMALL).count()
        assert got.exceptAll(want).count() == 0


SMALL = ArrayConfig(channels=1, fpgas=1, recv_per_fpga=2, pols=1, steps=4, packets=3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 1000), drop=st.integers(0, 5), copies=st.integers(0, 4))
def test_order_and_copies_do_not_change_the_visibilities(spark, seed, drop, copies):
    rng = random.Random(seed)
    rows = [(400 + 4 * k, 0, 0, payload(SMALL, complex(k + 1, -k))) for k in range(9)]
    first, rest = rows[0], rows[1:]
    rng.shuffle(rest)
    kept = [first] + rest[:len(rest) - drop]
    want = brute(kept)
    noisy = kept + [rng.choice(kept) for _ in range(copies)]
    got = jobs.offline_correlation(packets(spark, noisy), SMALL).collect()
    assert {(r.i, r.j): (r.re, r.im) for r in got} == want


def brute(rows):
    total = sum((r[0] // 4 - 100 + 1) ** 2 + (r[0] // 4 - 100) ** 2 for r in rows) * SMALL.steps
    return {(i, j): (float(total), 0.0) for j in range(2) for i in range(j + 1)}


def test_halo_only_blocks_produce_nothing(spark):
    d = packets(spark, full_block(SMALL, 400, 1 + 1j))
    products = blocks.reduce_blocks(blocks.assembled(d, SMALL), SMALL, blocks.Calibration())
    assert [r.block for r in products.collect()] == [0]
