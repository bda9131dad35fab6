"""The jobs at production packet shape, on the bytes of ``documents``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from phasegrid.plans import jobs
from phasegrid.plans.blocks import SEQUENCE, Calibration
from phasegrid.sources import tables as tb
from phasegrid.workloads import query

CFG = tb.TEXT_CFG

BYTES = """
b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE strlen(text) > 0),
k AS (SELECT max(CAST(ceil(len(h) / 2560.0) AS BIGINT)) AS stride, min(doc_id) AS first FROM b),
v AS (SELECT doc_id, unnest(range(len(h))) AS i, CAST('0x' || unnest(h) AS INTEGER) AS u FROM b),
s AS (SELECT doc_id, i // 2560 AS part, (i % 2560) // 2 AS c,
             sum(CASE WHEN i % 2 = 0 THEN CASE WHEN u > 127 THEN u - 256 ELSE u END ELSE 0 END) AS re,
             sum(CASE WHEN i % 2 = 1 THEN CASE WHEN u > 127 THEN u - 256 ELSE u END ELSE 0 END) AS im
      FROM v GROUP BY ALL),
x AS (SELECT CAST(doc_id % 8 AS INTEGER) AS channel, (doc_id // 8 - first // 8) * stride + part AS idx,
             CAST(c // 20 AS INTEGER) AS t, CAST((c // 2) % 10 AS INTEGER) AS n, CAST(c % 2 AS INTEGER) AS p,
             CAST(re AS BIGINT) * (1 + ((c // 2) % 10 + c % 2) % 3) AS re,
             CAST(im AS BIGINT) * (1 + ((c // 2) % 10 + c % 2) % 3) AS im FROM s, k)"""


@query(f"""WITH {BYTES}, vis AS (
  SELECT (a.idx // 256) // 4 AS integration, a.channel, a.n AS i, b.n AS j, a.p AS p, b.p AS q,
         CAST(sum(a.re * b.re + a.im * b.im) AS DOUBLE) AS re, CAST(sum(a.im * b.re - a.re * b.im) AS DOUBLE) AS im
  FROM x a JOIN x b ON a.channel = b.channel AND a.idx = b.idx AND a.t = b.t AND a.n <= b.n GROUP BY ALL),
g AS (SELECT DISTINCT idx // 256 // 4 AS integration, channel FROM x),
r AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q
  FROM (SELECT unnest(range(10)) AS i) JOIN (SELECT unnest(range(10)) AS j) ON i <= j
  CROSS JOIN (SELECT unnest(range(2)) AS p) CROSS JOIN (SELECT unnest(range(2)) AS q))
SELECT g.integration, g.channel, r.i, r.j, r.p, r.q, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM g CROSS JOIN r
LEFT JOIN vis v ON v.integration = g.integration AND v.channel = g.channel AND v.i = r.i AND v.j = r.j AND v.p = r.p
  AND v.q = r.q""")
def capture_visibilities(spark, root):
    """Integrated visibilities of ten receivers from full-size packets."""
    return jobs.observe(tb.document_packets(spark, root), CFG, Calibration(), only=["visibilities"])["visibilities"].drop(*SEQUENCE)


@query(f"""WITH {BYTES}, y AS (SELECT channel, idx, t, p, sum(re) AS re, sum(im) AS im FROM x GROUP BY ALL),
f AS (SELECT idx // 256 AS block, channel, p, idx, k,
        sum(re * cos(2 * pi() * ((k * t) % 64) / 64) + im * sin(2 * pi() * ((k * t) % 64) / 64)) AS re,
        sum(im * cos(2 * pi() * ((k * t) % 64) / 64) - re * sin(2 * pi() * ((k * t) % 64) / 64)) AS im
      FROM y, (SELECT CAST(unnest(range(64)) AS INTEGER) AS k) GROUP BY ALL)
SELECT block, channel, p AS pol, CAST((k + 32) % 64 - 5 AS INTEGER) AS bin, round(sum(sqrt(re * re + im * im)), 3) AS value
FROM f WHERE (k + 32) % 64 BETWEEN 5 AND 58 GROUP BY ALL""")
def capture_spectra(spark, root):
    """Trimmed beam spectra (54 of 64 fine channels) from full-size packets."""
    cal = Calibration(weights=np.ones((CFG.channels, CFG.pols, 1, CFG.receivers), dtype=complex))
    d = jobs.adaptive_spectra(tb.document_packets(spark, root), CFG, cal, only=["spectra"])["spectra"]
    return d.where(F.col("beam") == 0).select("block", "channel", "pol", "bin", F.round("value", 3).alias("value"))
