"""Stream wiring, gains and baseline identities on ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid import scale
from phasegrid.operators import calibrate, wiring as op
from phasegrid.sources import tables as tb
from phasegrid.workloads import query
from phasegrid.workloads.bindings import SAMPLES, WIRING

CFG = tb.WIRING_CFG


@query(f"WITH {WIRING} SELECT * FROM canonical")
def canonical_receivers(spark, root):
    return op.canonical_receivers(tb.customer_wiring(spark, root))


@query(f"WITH {WIRING} SELECT * FROM canonical_map")
def canonical_map(spark, root):
    return op.canonical_map(tb.customer_wiring(spark, root), CFG)


@query(f"""WITH {WIRING}, src AS (
  SELECT w.run, c.canonical * 2 + w.polarization AS slot, w.fpga_id * 10 + w.stream // 2 AS recv, w.stream % 2 AS pol
  FROM wiring w JOIN canonical c ON c.run = w.run AND c.antenna_id = w.antenna_id),
slots AS (SELECT run, s.slot FROM runs CROSS JOIN (SELECT CAST(unnest(range(40)) AS INTEGER) AS slot) s)
SELECT slots.run, slots.slot, coalesce(recv, -1) AS recv_perm, coalesce(pol, 0) AS pol_perm
FROM slots LEFT JOIN src ON src.run = slots.run AND src.slot = slots.slot""")
def wiring_permutation(spark, root):
    return op.permutation(tb.customer_wiring(spark, root), CFG)


@query(f"""WITH {WIRING} SELECT run, global_datastream_id, fpga_input_index, fpga_id, fpga_stream_id, receiver_slot,
raw_polarization, canonical_polarization, antenna_id, canonical_receiver_index, configured_disconnected,
zeroed_after_reorder, stream_map_authoritative FROM forward""")
def forward_mapping(spark, root):
    return op.forward_table(tb.customer_wiring(spark, root), CFG)


@query(f"""WITH {WIRING} SELECT m.run, m.canonical AS canonical_receiver_index, m.antenna_id,
p.pol AS canonical_polarization, coalesce(f.global_datastream_id, -1) AS global_datastream_id,
coalesce(f.fpga_input_index, -1) AS fpga_input_index, coalesce(f.fpga_id, -1) AS fpga_id,
coalesce(f.fpga_stream_id, -1) AS fpga_stream_id, CASE WHEN m.antenna_id < 0 THEN 1 ELSE 0 END AS zeroed_after_reorder
FROM canonical_map m CROSS JOIN (SELECT CAST(unnest(range(2)) AS INTEGER) AS pol) p
LEFT JOIN (SELECT * FROM forward WHERE antenna_id >= 0) f ON f.run = m.run
  AND f.canonical_receiver_index = m.canonical AND f.canonical_polarization = p.pol""")
def reverse_mapping(spark, root):
    return op.reverse_table(tb.customer_wiring(spark, root), CFG)


@query(f"""WITH {WIRING} SELECT run, global_datastream_id, fpga_input_index, fpga_id,
CASE fpga_input_index WHEN 0 THEN 'eth0' ELSE '' END AS network_interface, fpga_stream_id, receiver_slot,
raw_polarization, canonical_polarization, antenna_id, canonical_receiver_index, configured_disconnected,
zeroed_after_reorder, 'stream_antenna_map' AS mapping_source FROM forward""")
def stream_mapping(spark, root):
    return op.stream_mapping(tb.customer_wiring(spark, root), CFG, ["eth0"])


@query(f"""WITH {WIRING} SELECT a.run, b.canonical * (b.canonical + 1) // 2 + a.canonical AS baseline,
a.canonical AS i, b.canonical AS j, a.antenna_id AS ant_i, b.antenna_id AS ant_j,
CASE WHEN a.antenna_id < 0 OR b.antenna_id < 0 THEN -2147483648 ELSE 256 * a.antenna_id + b.antenna_id END::INTEGER
  AS baseline_id, CASE WHEN a.antenna_id < 0 OR b.antenna_id < 0 THEN 1 ELSE 0 END AS zeroed
FROM canonical_map a JOIN canonical_map b ON a.run = b.run AND a.canonical <= b.canonical""")
def baseline_table(spark, root):
    return op.baseline_table(op.canonical_map(tb.customer_wiring(spark, root), CFG))


GAINS = """,
gains AS (SELECT run, slot + 1 AS antenna_id, CASE WHEN flat % 2 = 0 THEN 'XX' ELSE 'YY' END AS pol_name,
CAST(c_custkey % 7 - 3 AS INTEGER) AS gre, CAST(c_custkey % 5 - 2 AS INTEGER) AS gim FROM w0 WHERE c_mktsegment <> 'BUILDING'),
wired AS (SELECT w.run, w.fpga_id, w.stream, w.antenna_id, w.polarization, coalesce(gre, 1)::DOUBLE AS gre,
coalesce(gim, 0)::DOUBLE AS gim FROM wiring w LEFT JOIN gains g ON g.run = w.run AND g.antenna_id = w.antenna_id
AND g.pol_name = CASE WHEN w.polarization = 0 THEN 'XX' ELSE 'YY' END)"""


def streams_with_gains(spark, root, keep_tiny=False):
    w = tb.customer_wiring(spark, root).withColumn(
        "pol_name", F.when(F.col("polarization") == 0, "XX").otherwise("YY"))
    return calibrate.gains_for_streams(w, tb.customer_gains(spark, root), ["run", "antenna_id", "pol_name"], keep_tiny)


@query(f"""WITH {WIRING} {GAINS} SELECT run, fpga_id, stream,
round(CASE WHEN gre * gre + gim * gim < 1e-12 THEN 1 ELSE gre / (gre * gre + gim * gim) END, 9) + 0.0 AS gain_re,
round(CASE WHEN gre * gre + gim * gim < 1e-12 THEN 0 ELSE -gim / (gre * gre + gim * gim) END, 9) + 0.0 AS gain_im
FROM wired""")
def gain_default_join(spark, root):
    d = streams_with_gains(spark, root)
    return d.select("run", "fpga_id", "stream", F.round("gain_re", 9).alias("gain_re"),
                    F.round("gain_im", 9).alias("gain_im"))


@query(f"""WITH {WIRING} {GAINS} SELECT run, fpga_id, stream,
round(gre / greatest(gre * gre + gim * gim, CASE WHEN gre * gre + gim * gim < 1e-12 THEN 1 ELSE 0 END), 9) + 0.0
  AS gain_re,
round(-gim / greatest(gre * gre + gim * gim, CASE WHEN gre * gre + gim * gim < 1e-12 THEN 1 ELSE 0 END), 9) + 0.0
  AS gain_im FROM wired""")
def gain_canonical_rule(spark, root):
    d = streams_with_gains(spark, root, keep_tiny=True)
    return d.select("run", "fpga_id", "stream", F.round("gain_re", 9).alias("gain_re"),
                    (F.round("gain_im", 9) + 0.0).alias("gain_im"))


def delay_table(spark, root):
    """Fine delays per run and antenna; antennas up to 8 have none."""
    c = tb.customer_wiring(spark, root).where(F.col("antenna_id") > 8)
    return c.select("run", "antenna_id").distinct().withColumn(
        "delay_ns", (F.col("antenna_id") * 10 + F.pmod("run", F.lit(10))).cast("double") / 4)


@query(f"""WITH {WIRING} SELECT run, canonical, antenna_id, CASE WHEN antenna_id > 8
THEN (antenna_id * 10 + run % 10)::DOUBLE / 4 ELSE 0 END::DOUBLE AS delay_ns FROM canonical_map""")
def fine_delay_defaults(spark, root):
    receivers = op.canonical_map(tb.customer_wiring(spark, root), CFG)
    return calibrate.delays_for_receivers(receivers, delay_table(spark, root))


def position_table(spark, root):
    """Positions of the antennas whose supplier has a balance above 2000."""
    s = tb.table(spark, root, "supplier").where(F.col("s_acctbal") > 2000)
    return s.select(F.col("s_suppkey").cast("int").alias("antenna_id"),
                    (F.col("s_suppkey") * 3 - 20).cast("double").alias("east"),
                    (F.lit(15) - F.col("s_nationkey")).cast("double").alias("north"),
                    F.lit(0.5).alias("up"))


POSITIONS = """
pos AS (SELECT CAST(s_suppkey AS INTEGER) AS antenna_id, CAST(s_suppkey * 3 - 20 AS DOUBLE) AS east,
CAST(15 - s_nationkey AS DOUBLE) AS north, CAST(0.5 AS DOUBLE) AS up FROM supplier WHERE s_acctbal > 2000)"""


@query(f"""WITH {WIRING}, {POSITIONS} SELECT run, canonical, m.antenna_id, coalesce(east, 0) AS east,
coalesce(north, 0) AS north, coalesce(up, 0) AS up FROM canonical_map m LEFT JOIN pos USING (antenna_id)""")
def antenna_positions(spark, root):
    return op.antenna_positions(op.canonical_map(tb.customer_wiring(spark, root), CFG), position_table(spark, root))


@query(f"""WITH {WIRING}, first AS (SELECT run, antenna_id, arg_max(fpga_id, global_datastream_id) AS fpga_id FROM forward
WHERE raw_polarization = 0 AND antenna_id >= 0 GROUP BY 1, 2)
SELECT m.run, m.canonical, m.antenna_id, coalesce(f.fpga_id, -1) AS fpga_id FROM canonical_map m
LEFT JOIN first f ON f.run = m.run AND f.antenna_id = m.antenna_id""")
def antenna_sources(spark, root):
    return op.antenna_sources(tb.customer_wiring(spark, root), CFG)


@query(f"WITH {WIRING} SELECT antenna_id, count(DISTINCT run) AS runs FROM wiring WHERE antenna_id >= 0 GROUP BY 1")
def connected_antennas(spark, root):
    d = op.connected(tb.customer_wiring(spark, root)).select("run", "antenna_id").distinct()
    return d.groupBy("antenna_id").agg(F.count(F.lit(1)).alias("runs"))


@query(f"""WITH {WIRING} SELECT run, fpga_id, receiver_slot, antenna_id, canonical_receiver_index,
configured_disconnected = 1 AS masked FROM forward WHERE raw_polarization = 0""")
def wiring_grid(spark, root):
    d = op.forward_table(tb.customer_wiring(spark, root), CFG).where(F.col("raw_polarization") == 0)
    return d.select("run", "fpga_id", "receiver_slot", "antenna_id", "canonical_receiver_index",
                    (F.col("configured_disconnected") == 1).alias("masked"))


@query("""SELECT c_nationkey, c_custkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey
ORDER BY CAST(round(c_acctbal * 100) AS BIGINT)) - 1 AS BIGINT) AS rank FROM customer""")
def large_key_rank(spark, root):
    """Dense rank within keys of any size (no task sorts a whole key)."""
    d = tb.table(spark, root, "customer").select(
        "c_nationkey", "c_custkey", F.rint(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return scale.dense_rank(d, ["c_nationkey"], "cents", "rank", width=20000).drop("cents")


@query(f"""WITH {SAMPLES}, perm AS (SELECT DISTINCT recv, pol, ((recv * 3 + 1) % 8) AS c, 1 - pol AS cp FROM samples
WHERE recv <> 5)
SELECT block, channel, pkt, t, c AS recv, cp AS pol, re, im FROM samples s JOIN perm USING (recv, pol)
UNION ALL SELECT DISTINCT block, channel, pkt, t, 0, p, 0, 0 FROM samples, (SELECT unnest([0, 1]) AS p)""")
def reorder_streams(spark, root):
    x = tb.embedding_samples(spark, root)
    used = x.select("recv", "pol").distinct()
    slot = (F.pmod(F.col("recv") * 3 + 1, F.lit(8)) * 2 + 1 - F.col("pol")).cast("int")
    off = F.col("recv") == 5
    perm = used.select(slot.alias("slot"), F.when(off, -1).otherwise(F.col("recv")).alias("recv_perm"),
                       F.when(off, 0).otherwise(F.col("pol")).alias("pol_perm"))
    return op.reorder_streams(x, perm, 2)
