"""Packet parsing, filtering and block assembly on ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.operators import ingest as op
from phasegrid.sources import tables as tb
from phasegrid.sources import wire
from phasegrid.workloads import query
from phasegrid.workloads.bindings import ACCEPTED, ARRIVED, GRID, MEMBERS, PACKETS, SAMPLES

CFG = tb.EVENT_CFG
WIRE_CFG = ArrayConfig(channels=8, fpgas=2, recv_per_fpga=2, pols=2, steps=4, packets=16)


def event_frames(spark: SparkSession, root: str) -> DataFrame:
    """Full wire frames built from events: scales and samples derive from the row."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = tb.table(spark, root, "events")
    d = tb.packets_of_events(events, extra=[k.alias("k"), F.col("user_id")])
    scales = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("k") - 50) * (i + 1))
    samples = F.transform(F.sequence(F.lit(0), F.lit(31)),
                          lambda i: F.pmod(F.col("arrival") * 7 + i * 13 + F.col("k"), F.lit(255)) - 127)
    frame = wire.encode_frame("sample_count", "fpga_id", "freq_channel", scales, samples,
                              F.pmod("user_id", F.lit(200)))
    return d.select("arrival", "ts", "k", "fpga_id", frame.alias("frame"))


@query(f"""WITH {PACKETS} SELECT arrival, sample_count, fpga_id, freq_channel, 40 AS payload_size FROM packets""")
def parse_packets(spark, root):
    d = wire.parse_frames(event_frames(spark, root).select("arrival", "frame"), WIRE_CFG)
    return d.select("arrival", "sample_count", "fpga_id", "freq_channel", "payload_size")


@query(f"""SELECT event_id AS arrival, CAST(user_id % 200 AS INTEGER) AS fpga_id FROM events""")
def parse_source_octet(spark, root):
    d = wire.parse_frames(event_frames(spark, root).select("arrival", "frame"), WIRE_CFG, source_from_ip=True)
    return d.select("arrival", "fpga_id")


@query(f"""WITH {PACKETS} SELECT arrival, CASE WHEN k % 4 = 0 THEN NULL ELSE sample_count END AS sample_count,
CASE WHEN k % 4 = 0 THEN NULL ELSE freq_channel END AS freq_channel FROM packets""")
def packet_info(spark, root):
    cut = F.when(F.pmod("k", F.lit(4)) == 0, F.substring("frame", 1, 57)).otherwise(F.col("frame"))
    seq, channel = wire.sequence_and_channel(cut)
    return event_frames(spark, root).select("arrival", seq.alias("sample_count"), channel.alias("freq_channel"))


@query(f"""WITH {PACKETS} SELECT arrival, sample_count FROM packets WHERE k % 5 <> 0""")
def short_frame_reject(spark, root):
    cut = F.when(F.pmod("k", F.lit(5)) == 0, F.substring("frame", 1, 63)).otherwise(F.col("frame"))
    frames = event_frames(spark, root).select("arrival", cut.alias("frame"))
    return wire.parse_frames(frames, WIRE_CFG).select("arrival", "sample_count")


@query(f"""WITH {PACKETS} SELECT fpga_id, count(*) AS skipped FROM packets WHERE k % 9 = 0 OR k % 7 = 3
GROUP BY fpga_id""")
def oversized_frames(spark, root):
    k = F.col("k")
    frames = event_frames(spark, root).select(
        "fpga_id", (F.length("frame") - (F.pmod(k, F.lit(9)) == 0).cast("int")).alias("wire_length"),
        F.when(F.pmod(k, F.lit(7)) == 3, F.concat("frame", F.unhex(F.lit("00")))).otherwise(F.col("frame"))
        .alias("frame"))
    frames = frames.withColumn("wire_length", F.when(F.length("frame") > 104, F.length("frame"))
                               .otherwise(F.col("wire_length")))
    _, bad = wire.oversized(frames, slot_bytes=104)
    return bad.groupBy("fpga_id").agg(F.count(F.lit(1)).alias("skipped"))


@query("""SELECT event_id AS arrival, CAST(62 AS INTEGER) AS payload_bytes FROM events
WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 6 <> 5""")
def udp_payloads(spark, root):
    # frames of another protocol, and truncated ones of a third of them, must vanish
    k = F.col("k")
    tcp = F.concat(F.substring("frame", 1, 23), F.unhex(F.lit("06")), F.substring("frame", 25, 200))
    frames = event_frames(spark, root).select(
        "arrival", F.when(F.pmod(k, F.lit(6)) == 5, tcp).otherwise(F.col("frame")).alias("frame"))
    d = wire.udp_payloads(frames, min_bytes=104)
    return d.select("arrival", F.length("payload").alias("payload_bytes"))


@query("""WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, unnest(range(16)) AS c
FROM events),
s AS (SELECT k, c, (event_id * 7 + (2 * c) * 13 + k) % 255 - 127 AS re,
             (event_id * 7 + (2 * c + 1) * 13 + k) % 255 - 127 AS im FROM e)
SELECT CAST(c // 4 AS INTEGER) AS t, CAST((c // 2) % 2 AS INTEGER) AS n, CAST(c % 2 AS INTEGER) AS pol,
       CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im,
       CAST(sum((k - 50) * (c % 4 + 1)) AS BIGINT) AS scale
FROM s GROUP BY 1, 2, 3""")
def payload_samples(spark, root):
    packets = wire.parse_frames(event_frames(spark, root).select("arrival", "frame"), WIRE_CFG)
    d = wire.payload_samples(packets, WIRE_CFG, ["arrival"])
    return d.groupBy("t", "n", "pol").agg(F.sum("re").alias("re"), F.sum("im").alias("im"),
                                          F.sum("scale").alias("scale"))


@query(f"""WITH {SAMPLES} SELECT block * 8 + pkt AS seq_no, CAST(t AS BIGINT) + 100 AS channel, pol,
CAST(re * re + im * im AS DOUBLE) / 4 / 16 AS power FROM samples WHERE channel = 1""")
def beam_packet_power(spark, root):
    """Beamformer packets of 16 channels x 2 pols x 1 sample, one per receiver row."""
    le = wire.to_little_endian
    zeros = lambda n: F.unhex(F.lit("00" * n))
    seq = F.col("block") * tb.FRAME_CFG.packets + F.col("pkt")
    header = F.concat(le(seq, 8), le(seq * 16, 8), zeros(16), le(F.lit(0x40000000), 4), zeros(12),
                      le(F.lit(100), 4), le(F.lit(16), 2), le(F.lit(16), 2), le(F.lit(1), 2),
                      le(F.col("channel"), 2), zeros(7), le(F.lit(1), 1), zeros(28))
    payload = F.concat(header, zeros(32), wire.bytes_of("data", 1))
    packets = tb.embedding_frames(spark, root).select(payload.alias("payload"))
    return wire.beam_packet_power(packets, beam=1)


@query(f"""WITH {ACCEPTED} SELECT channel, source, count(*) AS packets, CAST(sum(value) AS BIGINT) AS value
FROM accepted GROUP BY channel, source""")
def channel_filter(spark, root):
    d = op.channel_window(tb.event_packets(spark, root), CFG).withColumn("source", op.source_index(CFG))
    return d.groupBy("channel", "source").agg(F.count(F.lit(1)).alias("packets"), F.sum("value").alias("value"))


@query(f"""WITH {ACCEPTED} SELECT (SELECT count(*) FROM packets) AS received,
(SELECT count(*) FROM packets WHERE freq_channel NOT BETWEEN 1 AND 4) AS discarded_channel,
count(*) FILTER (idx < -1) AS discarded_old, count(*) FILTER (idx >= -1) AS processed FROM indexed""")
def packet_counters(spark, root):
    return op.counters(tb.event_packets(spark, root), CFG)


@query(f"""WITH {ACCEPTED} SELECT arrival, sample_count, 128 * fpga_id AS packet_delay, 5 * fpga_id AS residual,
idx AS "index" FROM indexed""")
def delay_alignment(spark, root):
    d = op.channel_window(tb.event_packets(spark, root), CFG)
    rest = {f: r for f, (_, r) in CFG.split_delays().items()}
    return op.packet_index(d, CFG, op.stream_start(d, CFG)).select(
        "arrival", "sample_count", op.packet_delay(CFG).cast("int").alias("packet_delay"),
        op._lookup(rest, F.col("fpga_id")).cast("int").alias("residual"), "index")


@query(f"""WITH {MEMBERS} SELECT arrival, channel, source, block, pkt, value FROM members""")
def block_windows(spark, root):
    d = op.channel_window(tb.event_packets(spark, root), CFG).withColumn("source", op.source_index(CFG))
    d = op.packet_index(d, CFG, op.stream_start(d, CFG))
    return op.block_members(d, CFG).select("arrival", "channel", "source", "block", "pkt", "value")


def arrived(spark, root) -> DataFrame:
    return op.assemble(tb.event_packets(spark, root), CFG, ["value"])


@query(f"""WITH {ARRIVED} SELECT * FROM arrived""")
def last_wins(spark, root):
    return arrived(spark, root)


@query(f"""WITH {ARRIVED} SELECT block, start + block * 1024 AS start_seq, start + block * 1024 + 960 AS end_seq,
count(*) AS packets FROM arrived, anchor GROUP BY block, start""")
def block_bounds(spark, root):
    packets = op.channel_window(tb.event_packets(spark, root), CFG)
    blocks = arrived(spark, root).groupBy("block").agg(F.count(F.lit(1)).alias("packets"))
    return op.block_bounds(blocks, CFG, op.stream_start(packets, CFG))


@query(f"""WITH {GRID} SELECT c.block, c.channel, c.source, p.pkt FROM cells c,
(SELECT CAST(unnest(range(16)) AS INTEGER) AS pkt) p
WHERE NOT EXISTS (SELECT 1 FROM arrived a WHERE a.block = c.block AND a.channel = c.channel
                  AND a.source = c.source AND a.pkt = p.pkt)""")
def missing_packets(spark, root):
    return op.missing_packets(arrived(spark, root), CFG)


@query(f"""WITH {GRID} SELECT c.block, c.channel, c.source, p.pkt, a.value IS NOT NULL AS arrived FROM cells c
CROSS JOIN (SELECT CAST(unnest(range(-1, 17)) AS INTEGER) AS pkt) p
LEFT JOIN arrived a ON a.block = c.block AND a.channel = c.channel AND a.source = c.source AND a.pkt = p.pkt""")
def arrival_flags(spark, root):
    return op.arrival_flags(arrived(spark, root), CFG)


@query(f"""WITH {GRID} SELECT c.block, c.channel, c.source, p.pkt, a.value IS NOT NULL AS arrived,
coalesce(a.value, 0) AS value FROM cells c
CROSS JOIN (SELECT CAST(unnest(range(-1, 17)) AS INTEGER) AS pkt) p
LEFT JOIN arrived a ON a.block = c.block AND a.channel = c.channel AND a.source = c.source AND a.pkt = p.pkt""")
def impute_missing(spark, root):
    return op.impute_missing(arrived(spark, root), CFG, ["value"])


@query(f"""WITH {GRID}, per AS (
  SELECT c.block // 4 AS integration, count(DISTINCT c.block) AS blocks,
         count(DISTINCT c.block) * 128 - count(a.pkt) AS missing
  FROM cells c LEFT JOIN arrived a ON a.block = c.block AND a.channel = c.channel AND a.source = c.source
       AND a.pkt BETWEEN 0 AND 15 GROUP BY 1)
SELECT integration, missing, blocks * 128 AS total, 100.0::DOUBLE * missing / (blocks * 128) AS pct FROM per""")
def missing_percent(spark, root):
    """Missing, expected and percentage of every integration; holes count as missing."""
    return op.single_integrations(op.missing_by_integration(op.gaps_of(arrived(spark, root), CFG), CFG))


@query(f"""WITH {PACKETS} SELECT arrival, fpga_id, freq_channel, sample_count,
max(sample_count) OVER (PARTITION BY freq_channel, fpga_id ORDER BY arrival) AS watermark FROM packets""")
def stream_watermark(spark, root):
    d = tb.event_packets(spark, root).select("arrival", "fpga_id", "freq_channel", "sample_count")
    return op.watermarks(d, ["freq_channel", "fpga_id"], width=256)


@query(f"""WITH {PACKETS}, g AS (SELECT arrival, freq_channel, sample_count,
lag(sample_count) OVER (PARTITION BY freq_channel ORDER BY arrival) AS previous FROM packets)
SELECT *, sample_count - previous AS gap FROM g WHERE sample_count - previous <> 64""")
def sequence_gaps(spark, root):
    d = tb.event_packets(spark, root).select("arrival", "freq_channel", "sample_count")
    return op.sequence_gaps(d, ["freq_channel"], 64, width=256)


@query(f"""WITH {PACKETS} SELECT min(sample_count) AS first_seq, max(sample_count) AS last_seq,
min(freq_channel) AS first_channel, max(freq_channel) AS last_channel, count(*) AS packets,
(max(freq_channel) - min(freq_channel) + 1) * ((max(sample_count) - min(sample_count) + 1) // 64) AS expected
FROM packets""")
def capture_extent(spark, root):
    return op.capture_extent(tb.event_packets(spark, root))


@query(f"""WITH {PACKETS}, span AS (SELECT fpga_id, max(sample_count) - min(sample_count) + 64 AS span FROM packets
GROUP BY fpga_id)
SELECT arrival, p.fpga_id, CAST(l.loop AS INTEGER) AS loop, sample_count + l.loop * span AS sample_count
FROM packets p JOIN span USING (fpga_id) CROSS JOIN (SELECT unnest(range(3)) AS loop) l""")
def replay_capture(spark, root):
    d = tb.event_packets(spark, root).select("arrival", "fpga_id", "sample_count")
    return op.replay(d, loops=3)


@query(f"""WITH {PACKETS} SELECT CAST(f.f AS INTEGER) AS fpga_id, freq_channel, count(*) AS packets,
CAST(sum(sample_count) AS BIGINT) AS seq_sum FROM packets CROSS JOIN (SELECT unnest(range(4)) AS f) f GROUP BY 1, 2""")
def replicate_sources(spark, root):
    d = op.replicate_sources(tb.event_packets(spark, root), 4)
    return d.groupBy("fpga_id", "freq_channel").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("sample_count").alias("seq_sum"))


@query(f"""WITH {ARRIVED}, per AS (SELECT block, channel, source, bool_or(pkt >= 15) AS done FROM arrived
GROUP BY 1, 2, 3) SELECT block, bool_and(done) AND count(*) = 8 AS complete FROM per GROUP BY block""")
def channels_complete(spark, root):
    return op.channels_complete(arrived(spark, root), CFG)
