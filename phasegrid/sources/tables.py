"""Bindings that read relational tables as array data.

``events`` are packets, ``embeddings`` are packet payloads, ``lineitem`` rows are
single samples, ``customer`` rows are wired streams and ``orders`` are benchmark
results.  Receiver counts are fixed by the array shape, so more rows mean more
packets and blocks, never a wider array.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.functions.numeric import idiv


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# Packets: two sources, four accepted channels 1..4 of six, 16 packets a block.
EVENT_CFG = ArrayConfig(channels=4, fpgas=2, recv_per_fpga=1, pols=1, steps=64, packets=16,
                        min_channel=1, accumulate=4, fpga_delays={1: 133})


def packets_of_events(events: DataFrame, extra: list | tuple = ()) -> DataFrame:
    """Packets in arrival order with duplicates, gaps, reordering and a delayed source."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(64000) + 64 * (idiv(F.col("event_id"), 8) + F.pmod(k, F.lit(3)))
         + 128 * F.pmod("user_id", F.lit(2))).cast("long").alias("sample_count"),
        F.pmod("user_id", F.lit(2)).cast("int").alias("fpga_id"),
        F.pmod(k, F.lit(6)).cast("int").alias("freq_channel"),
        F.rint(F.col("value") * 100).cast("long").alias("value"), *extra)


def event_packets(spark: SparkSession, root: str) -> DataFrame:
    return packets_of_events(table(spark, root, "events"))


# Payloads: eight receivers in two sources, two channels, 16 steps x 2 pols x (re, im).
FRAME_CFG = ArrayConfig(channels=2, fpgas=2, recv_per_fpga=4, pols=2, steps=16, packets=8,
                        accumulate=2)


def embedding_frames(spark: SparkSession, root: str) -> DataFrame:
    """One row per (block, channel, packet, receiver) holding 64 quantised numbers."""
    r, n, c = FRAME_CFG.receivers, FRAME_CFG.packets, FRAME_CFG.channels
    frame = idiv(F.col("vec_id"), r)
    pkt = idiv(frame, c)
    return table(spark, root, "embeddings").select(
        idiv(pkt, n).alias("block"), F.pmod(frame, F.lit(c)).cast("int").alias("channel"),
        F.pmod(pkt, F.lit(n)).cast("int").alias("pkt"), F.pmod("vec_id", F.lit(r)).cast("int").alias("recv"),
        (F.col("label") + 1).alias("scale"),
        F.transform("embedding", lambda v: F.round(v.cast("double") * 127).cast("int")).alias("data"))


def samples_of_frames(frames: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Long samples of frame rows whose ``data`` is ``[step][pol][re, im]``."""
    p = cfg.pols
    return (frames.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(cfg.steps * p - 1))))
            .select("block", "channel", "pkt", "recv", idiv(F.col("__i"), p).cast("int").alias("t"),
                    F.pmod(F.col("__i"), F.lit(p)).cast("int").alias("pol"),
                    F.col("data")[F.col("__i") * 2].alias("re"),
                    F.col("data")[F.col("__i") * 2 + 1].alias("im"), "scale"))


def embedding_samples(spark: SparkSession, root: str) -> DataFrame:
    return samples_of_frames(embedding_frames(spark, root), FRAME_CFG)


# Samples: seven receivers, four channels, 64 time steps a block.
SAMPLE_CFG = ArrayConfig(channels=4, fpgas=1, recv_per_fpga=7, pols=1, steps=64, packets=1, accumulate=8)


def lineitem_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples with repeated cells; the row shipped last is the one that counts."""
    t = idiv(F.col("l_orderkey"), 4)
    # (ship date, part, supplier) as one number: ordered like the triple, fixed width
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("decimal(6,0)")
    arrival = (day * F.lit(Decimal(10) ** 25) + F.col("l_partkey").cast("decimal(13,0)") * F.lit(Decimal(10) ** 12)
               + F.col("l_suppkey").cast("decimal(12,0)"))
    return table(spark, root, "lineitem").select(
        idiv(t, 64).alias("block"), F.pmod("l_orderkey", F.lit(4)).cast("int").alias("channel"),
        F.pmod(t, F.lit(64)).cast("int").alias("t"), (F.col("l_linenumber") - 1).alias("recv"),
        (F.col("l_quantity").cast("int") - 25).alias("re"),
        (F.rint(F.col("l_discount") * 100).cast("int") - 5).alias("im"),
        arrival.alias("arrival"))


# Wiring: every 40 customers are one run of two sources x ten receivers x two pols.
WIRING_CFG = ArrayConfig(channels=1, fpgas=2, recv_per_fpga=10, pols=2, steps=64, packets=256)
STREAMS_PER_FPGA = WIRING_CFG.recv_per_fpga * WIRING_CFG.pols


def wiring_of_customers(customers: DataFrame) -> DataFrame:
    """Stream wiring by run: antennas rotate over slots, some slots are not connected."""
    key = F.col("c_custkey")
    run, flat = idiv(key, 40), F.pmod(key, F.lit(40)).cast("int")
    slot = idiv(flat, 2)
    stream = F.pmod(flat, F.lit(STREAMS_PER_FPGA)).cast("int")
    off = F.pmod(slot + run, F.lit(6)) == 0
    swapped = F.pmod(slot + run, F.lit(3)) == 1
    pol = F.pmod(flat, F.lit(2))
    return customers.select(
        run.alias("run"), idiv(flat, STREAMS_PER_FPGA).cast("int").alias("fpga_id"), stream.alias("stream"),
        F.when(off, F.lit(-1)).otherwise(F.pmod(slot * 7 + run, F.lit(20)) + 1).cast("int").alias("antenna_id"),
        F.when(swapped, 1 - pol).otherwise(pol).cast("int").alias("polarization"))


def customer_wiring(spark: SparkSession, root: str) -> DataFrame:
    return wiring_of_customers(table(spark, root, "customer"))


def customer_gains(spark: SparkSession, root: str) -> DataFrame:
    """Calibration gains by (run, antenna, pol); one market segment has none."""
    key = F.col("c_custkey")
    flat = F.pmod(key, F.lit(40))
    return (table(spark, root, "customer").where(F.col("c_mktsegment") != "BUILDING")
            .select(idiv(key, 40).alias("run"), (idiv(flat, 2) + 1).cast("int").alias("antenna_id"),
                    F.when(F.pmod(flat, F.lit(2)) == 0, "XX").otherwise("YY").alias("pol_name"),
                    (F.pmod(key, F.lit(7)) - 3).cast("int").alias("gain_re"),
                    (F.pmod(key, F.lit(5)) - 2).cast("int").alias("gain_im")))


def order_benchmarks(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark results: a rate for a stage at (channels, sources), by day and status."""
    key = F.col("o_orderkey")
    return table(spark, root, "orders").select(
        F.col("o_orderpriority").alias("stage"), (8 * (1 + F.pmod(key, F.lit(4)))).cast("int").alias("channels"),
        (1 + F.pmod("o_custkey", F.lit(5))).cast("int").alias("fpgas"), F.rint(F.col("o_totalprice") * 100)
        .cast("long").alias("rate"), F.col("o_orderstatus").alias("campaign"))


def embedding_packets(spark: SparkSession, root: str) -> DataFrame:
    """Parsed packets with binary payloads: four receivers of one source in each."""
    cfg = FRAME_CFG
    n = cfg.recv_per_fpga

    @F.pandas_udf("binary")
    def payload(receivers: pd.Series, scales: pd.Series, data: pd.Series) -> pd.Series:
        def build(r, s, x):     # absent receivers are zero
            at = np.asarray(r) % n
            scale, cube = np.zeros(n), np.zeros((n, cfg.steps, cfg.pols, 2))
            scale[at] = s
            cube[at] = np.stack(x).reshape(-1, cfg.steps, cfg.pols, 2)
            return np.repeat(scale, cfg.pols).astype("<i2").tobytes() + cube.transpose(1, 0, 2, 3).astype("i1").tobytes()
        return pd.Series([build(r, s, x) for r, s, x in zip(receivers, scales, data)])

    rows = embedding_frames(spark, root).withColumn("fpga_id", idiv(F.col("recv"), n).cast("int"))
    entry = F.struct("recv", "scale", "data")
    groups = rows.groupBy("block", "channel", "pkt", "fpga_id").agg(
        F.array_sort(F.collect_list(entry)).alias("g"))
    seq = F.col("block") * cfg.packets + F.col("pkt")
    return groups.select((seq * cfg.channels * cfg.fpgas + F.col("channel") * cfg.fpgas + F.col("fpga_id"))
                         .alias("arrival"), (seq * cfg.step + 16000).alias("sample_count"), "fpga_id",
                         F.col("channel").alias("freq_channel"),
                         payload(F.col("g.recv"), F.col("g.scale"), F.col("g.data")).alias("payload"))


# Captured bytes: texts are cut into payloads of the production packet shape.
TEXT_CFG = ArrayConfig(channels=8, fpgas=1, recv_per_fpga=10, pols=2, steps=64, packets=256, accumulate=4)


def document_packets(spark: SparkSession, root: str) -> DataFrame:
    """The bytes of every whole text as samples of consecutive packets.

    A text continues over as many packets as it needs; the last one is filled with
    zeros.  Texts of one channel follow each other at the length of the longest.
    """
    cfg = TEXT_CFG
    size = cfg.sample_bytes
    scales = "".join(f"{1 + (n + p) % 3:02x}00" for n in range(cfg.recv_per_fpga) for p in range(cfg.pols))
    docs = table(spark, root, "documents")
    parts = F.ceil(F.octet_length("text") / size)
    stride = docs.select(F.max(parts)).scalar()
    d = (docs.withColumn("parts", parts).where(F.col("parts") > 0)
         .select("doc_id", F.encode("text", "UTF-8").alias("bytes"),
                 F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    body = F.substring("bytes", (F.col("part") * size + 1).cast("int"), F.lit(size))
    filled = F.concat(body, F.unhex(F.repeat(F.lit("00"), F.lit(size) - F.length(body))))
    index = idiv(F.col("doc_id"), cfg.channels) * stride + F.col("part")
    return d.select((F.col("doc_id") * stride + F.col("part")).alias("arrival"),
                    ((index + 1) * cfg.step).alias("sample_count"), F.lit(0).alias("fpga_id"),
                    F.pmod("doc_id", F.lit(cfg.channels)).cast("int").alias("freq_channel"),
                    F.concat(F.unhex(F.lit(scales)), filled).alias("payload"))
