"""SQL text of the table bindings, shared by the checks of the registered queries."""

from __future__ import annotations

PACKETS = """
packets AS (
  SELECT event_id AS arrival, ts,
         64000 + 64 * ((event_id // 8) + k % 3) + 128 * (user_id % 2) AS sample_count,
         CAST(user_id % 2 AS INTEGER) AS fpga_id, CAST(k % 6 AS INTEGER) AS freq_channel,
         CAST(round(value * 100) AS BIGINT) AS value, k
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""

ACCEPTED = PACKETS + """,
accepted AS (
  SELECT *, freq_channel - 1 AS channel, fpga_id AS source FROM packets WHERE freq_channel BETWEEN 1 AND 4),
anchor AS (SELECT arg_min(sample_count - 128 * fpga_id, arrival) AS start FROM accepted),
indexed AS (
  SELECT a.*, CAST(floor((sample_count - 128 * fpga_id - start) / 64.0) AS BIGINT) AS idx
  FROM accepted a, anchor)"""

MEMBERS = ACCEPTED + """,
placed AS (SELECT *, CAST(floor(idx / 16.0) AS BIGINT) AS b FROM indexed),
members AS (
  SELECT * FROM (
    SELECT *, b AS block, CAST(idx - 16 * b AS INTEGER) AS pkt FROM placed
    UNION ALL SELECT *, b - 1, 16 FROM placed WHERE idx = 16 * b
    UNION ALL SELECT *, b + 1, -1 FROM placed WHERE idx = 16 * b + 15)
  WHERE block >= 0)"""

ARRIVED = MEMBERS + """,
arrived AS (
  SELECT block, channel, source, pkt, arg_max(value, arrival) AS value FROM members
  GROUP BY block, channel, source, pkt)"""

GRID = ARRIVED + """,
cells AS (
  SELECT b.block, c.channel, s.source
  FROM (SELECT unnest(range((SELECT min(block) FROM arrived WHERE pkt BETWEEN 0 AND 15),
               (SELECT max(block) FROM arrived WHERE pkt BETWEEN 0 AND 15) + 1)) AS block) b,
       (SELECT CAST(unnest(range(4)) AS INTEGER) AS channel) c,
       (SELECT CAST(unnest(range(2)) AS INTEGER) AS source) s)"""

SAMPLES = """
samples AS (
  SELECT (f // 2) // 8 AS block, CAST(f % 2 AS INTEGER) AS channel, CAST((f // 2) % 8 AS INTEGER) AS pkt,
         CAST(vec_id % 8 AS INTEGER) AS recv, scale, CAST(i // 2 AS INTEGER) AS t, CAST(i % 2 AS INTEGER) AS pol,
         q[2 * i + 1] AS re, q[2 * i + 2] AS im
  FROM (SELECT vec_id, vec_id // 8 AS f, label + 1 AS scale, unnest(range(32)) AS i,
               list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 127) AS INTEGER)) AS q
        FROM embeddings))"""

SCALED = SAMPLES + """,
x AS (SELECT block, channel, pkt, recv, t, pol, re * scale AS re, im * scale AS im FROM samples)"""

VIS = SCALED + """,
vis AS (
  SELECT a.block, a.channel, a.recv AS i, b.recv AS j, a.pol AS p, b.pol AS q,
         CAST(sum(a.re * b.re + a.im * b.im) AS DOUBLE) AS re, CAST(sum(a.im * b.re - a.re * b.im) AS DOUBLE) AS im
  FROM x a JOIN x b ON a.block = b.block AND a.channel = b.channel AND a.pkt = b.pkt AND a.t = b.t
       AND a.recv <= b.recv
  GROUP BY a.block, a.channel, a.recv, b.recv, a.pol, b.pol)"""

LINE_SAMPLES = """
ls AS (
  SELECT (l_orderkey // 4) // 64 AS block, CAST(l_orderkey % 4 AS INTEGER) AS channel,
         CAST((l_orderkey // 4) % 64 AS INTEGER) AS t, l_linenumber - 1 AS recv,
         CAST(l_quantity AS INTEGER) - 25 AS re, CAST(round(l_discount * 100) AS INTEGER) - 5 AS im
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                             ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1)"""

WIRING = """
w0 AS (SELECT c_custkey // 40 AS run, CAST(c_custkey % 40 AS INTEGER) AS flat, CAST((c_custkey % 40) // 2 AS INTEGER)
       AS slot, c_custkey, c_mktsegment FROM customer),
wiring AS (
  SELECT run, flat // 20 AS fpga_id, flat % 20 AS stream,
         CAST(CASE WHEN (slot + run) % 6 = 0 THEN -1 ELSE (slot * 7 + run) % 20 + 1 END AS INTEGER) AS antenna_id,
         CASE WHEN (slot + run) % 3 = 1 THEN 1 - flat % 2 ELSE flat % 2 END AS polarization FROM w0),
canonical AS (
  SELECT run, antenna_id, CAST(dense_rank() OVER (PARTITION BY run ORDER BY antenna_id) - 1 AS INTEGER) AS canonical
  FROM (SELECT DISTINCT run, antenna_id FROM wiring WHERE antenna_id >= 0)),
runs AS (SELECT DISTINCT run FROM wiring),
canonical_map AS (
  SELECT r.run, n.canonical, coalesce(c.antenna_id, -1) AS antenna_id
  FROM runs r CROSS JOIN (SELECT CAST(unnest(range(20)) AS INTEGER) AS canonical) n
  LEFT JOIN canonical c ON c.run = r.run AND c.canonical = n.canonical),
streams AS (
  SELECT r.run, g.g AS global_datastream_id, g.g // 20 AS fpga_input_index, g.g // 20 AS fpga_id,
         g.g % 20 AS fpga_stream_id, (g.g % 20) // 2 AS receiver_slot, g.g % 2 AS raw_polarization
  FROM runs r CROSS JOIN (SELECT CAST(unnest(range(40)) AS INTEGER) AS g) g),
forward AS (
  SELECT s.*, coalesce(w.polarization, raw_polarization) AS canonical_polarization,
         coalesce(w.antenna_id, -1) AS antenna_id, coalesce(c.canonical, -1) AS canonical_receiver_index,
         CASE WHEN coalesce(w.antenna_id, -1) < 0 THEN 1 ELSE 0 END AS configured_disconnected,
         CASE WHEN coalesce(w.antenna_id, -1) < 0 THEN 1 ELSE 0 END AS zeroed_after_reorder,
         1 AS stream_map_authoritative
  FROM streams s LEFT JOIN wiring w ON w.run = s.run AND w.fpga_id = s.fpga_id AND w.stream = s.fpga_stream_id
  LEFT JOIN canonical c ON c.run = s.run AND c.antenna_id = w.antenna_id)"""

BENCH = """
bench AS (
  SELECT o_orderpriority AS stage, CAST(8 * (1 + o_orderkey % 4) AS INTEGER) AS channels,
         CAST(1 + o_custkey % 5 AS INTEGER) AS fpgas, CAST(round(o_totalprice * 100) AS BIGINT) AS rate,
         o_orderstatus AS campaign FROM orders)"""
