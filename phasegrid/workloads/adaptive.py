"""Eigen-based mitigation on ``embeddings`` and mode detection on ``events``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from phasegrid.functions import numeric as N
from phasegrid.operators import adaptive as op, ingest
from phasegrid.plans import jobs
from phasegrid.plans.blocks import SEQUENCE, Calibration, Tracking
from phasegrid.session import scratch_path
from phasegrid.sinks import products
from phasegrid.sources import tables as tb
from phasegrid.workloads import eigen_sql as E
from phasegrid.workloads import query
from phasegrid.workloads.bindings import SAMPLES, SCALED, VIS
from phasegrid.workloads.signal import CFG, WEIGHTS, packed, visibilities

SPECTRA = """
s AS (SELECT event_id // 64 AS block, event_type, CAST(round(value * 100) AS DOUBLE) AS v FROM events),
q AS (SELECT block, event_type, quantile_cont(v, 0.2) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.8) AS c,
      count(*) AS modes FROM s GROUP BY ALL),
det AS (SELECT s.block, s.event_type, b + 1.5 * (c - a) / 1.6832 AS threshold, CAST(modes AS INTEGER) AS modes,
        CAST(count(*) FILTER (v > b + 1.5 * (c - a) / 1.6832) AS INTEGER) AS k
        FROM s JOIN q ON s.block = q.block AND s.event_type = q.event_type GROUP BY ALL)"""


def event_spectra(spark, root):
    """At most 64 values per (block, type), standing in for the spectrum of a matrix."""
    return tb.table(spark, root, "events").select(
        N.idiv(F.col("event_id"), 64).alias("block"), "event_type", F.rint(F.col("value") * 100).alias("v"))


def detected(spark, root):
    return op.detect_spectra(event_spectra(spark, root), ["block", "event_type"], "v", 1.5)


@query(f"WITH {SPECTRA} SELECT block, event_type, round(threshold, 6) AS threshold, modes, k FROM det")
def mode_detection(spark, root):
    return detected(spark, root).withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {SPECTRA}, r AS (SELECT s.*, row_number() OVER (PARTITION BY block, event_type ORDER BY v) AS n FROM s)
SELECT r.block, r.event_type, round(coalesce(avg(v) FILTER (n <= modes - k), 0), 6) AS noise_floor
FROM r JOIN det ON r.block = det.block AND r.event_type = det.event_type GROUP BY ALL""")
def noise_floor(spark, root):
    keys = ["block", "event_type"]
    arrays = event_spectra(spark, root).groupBy(*keys).agg(F.collect_list("v").alias("eigvals"))
    d = op.noise_floor(arrays.join(detected(spark, root).select(*keys, "k"), keys))
    return d.select(*keys, F.round("noise_floor", 6).alias("noise_floor"))


@query(f"""WITH {SPECTRA} SELECT event_type, min(k) AS min_k, max(k) AS max_k, median(k) AS median_k,
round(avg(k), 9) AS mean_k FROM det GROUP BY event_type""")
def mode_statistics(spark, root):
    d = op.mode_statistics(detected(spark, root), ["event_type"])
    return d.withColumn("mean_k", F.round("mean_k", 9))


@query("""SELECT l.label AS channel, count(*) AS rows, CAST(coalesce(any_value(c.k), 1) AS INTEGER) AS k FROM embeddings l
LEFT JOIN (SELECT n_nationkey AS channel, n_regionkey AS k FROM nation WHERE n_regionkey > 1) c ON c.channel = l.label
GROUP BY l.label""")
def signal_counts(spark, root):
    channels = tb.table(spark, root, "embeddings").groupBy(F.col("label").alias("channel")).agg(
        F.count(F.lit(1)).alias("rows"))
    configured = tb.table(spark, root, "nation").where(F.col("n_regionkey") > 1).select(
        F.col("n_nationkey").alias("channel"), F.col("n_regionkey").alias("k"))
    return op.signal_counts(channels, configured)


@query(f"""WITH {VIS} SELECT block, channel, p, q,
round(sum(CASE WHEN i = j THEN re ELSE 0 END), 3) AS eigen_sum,
round(sqrt(sum(CASE WHEN i = j THEN re * re ELSE 2 * (re * re + im * im) END)), 3) AS eigen_norm
FROM vis WHERE p = q GROUP BY ALL""")
def eigen_invariants(spark, root):
    """Eigenvalues add up to the trace and their squares to the squared norm."""
    d = op.eigen(packed(spark, root), CFG, cross=False)
    fold = lambda f: F.aggregate(F.transform("eigvals", f), F.lit(0.0), lambda a, b: a + b)
    return d.select("block", "channel", "p", "q", F.round(fold(lambda x: x), 3).alias("eigen_sum"),
                    F.round(F.sqrt(fold(lambda x: x * x)), 3).alias("eigen_norm"))


MATRIX_KEYS = "block, channel, p, q"
EIGEN = f"WITH RECURSIVE {VIS}, {E.matrices('vis', MATRIX_KEYS)}, {E.modes('mat', MATRIX_KEYS, 8)}"
WHITE = f"""WITH RECURSIVE {VIS}, {E.matrices('vis', MATRIX_KEYS, where='p = q')}, {E.whitened()},
{E.modes('wm', 'block, channel, pol', 8)}"""


@query(f"{EIGEN} SELECT {MATRIX_KEYS}, CAST(7 - mode AS INTEGER) AS mode, round(lam, 3) + 0.0 AS eigval FROM modes")
def eigen_decomposition(spark, root):
    """Ascending eigenvalues of every polarization pair."""
    d = op.eigen(packed(spark, root), CFG)
    d = d.select("block", "channel", "p", "q", F.posexplode("eigvals").alias("mode", "eigval"))
    return d.withColumn("eigval", F.round("eigval", 3) + F.lit(0.0))


@query(f"""WITH {VIS}, d AS (SELECT block, channel, p, i, greatest(re, 1e-10) AS d FROM vis WHERE i = j AND p = q)
SELECT v.block, v.channel, v.i, v.j, v.p, v.q, round(v.re / (sqrt(a.d) * sqrt(b.d)), 9) + 0.0 AS re,
round(v.im / (sqrt(a.d) * sqrt(b.d)), 9) + 0.0 AS im
FROM vis v JOIN d a ON a.block = v.block AND a.channel = v.channel AND a.p = v.p AND a.i = v.i
JOIN d b ON b.block = v.block AND b.channel = v.channel AND b.p = v.p AND b.i = v.j WHERE v.p = v.q""")
def whitened_visibilities(spark, root):
    d = op.whiten_visibilities(visibilities(spark, root))
    return d.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("re", "im")})


@query(f"""WITH {SAMPLES} SELECT DISTINCT block, channel, p.pol, 1 + channel AS k,
CAST(7 - channel AS DOUBLE) AS trace FROM samples, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS pol) p""")
def null_projection_trace(spark, root):
    """A null projection of k unit vectors has trace N - k (k differs by channel)."""
    d = op.mitigate(packed(spark, root).withColumn("k", F.col("channel") + 1), CFG, mode="null")
    diag = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.get("proj_re", r * 9))
    trace = F.aggregate(diag, F.lit(0.0), lambda a, b: a + b)
    return d.select("block", "channel", "pol", "k", F.round(trace, 6).alias("trace"))


def _cells(d):
    d = d.select("block", "channel", "pol", "k", F.posexplode(F.arrays_zip("proj_re", "proj_im")).alias("cell", "v"))
    return d.select("block", "channel", "pol", "k", "cell", F.round(F.col("v.proj_re"), 6) + F.lit(0.0), F.round(F.col("v.proj_im"), 6) + F.lit(0.0)) \
        .toDF("block", "channel", "pol", "k", "cell", "re", "im")


NULLED = E.projection("SELECT *, 1 AS factor FROM um WHERE mode <= channel")


@query(f"""{WHITE}, {E.unwhitened()}, {NULLED} SELECT block, channel, pol, 1 + channel AS k, c AS cell, round(re, 6) + 0.0 AS re,
round(im, 6) + 0.0 AS im FROM proj""")
def null_projection(spark, root):
    """Projection matrices without the strongest modes (their number differs by channel), vectors un-whitened."""
    return _cells(op.mitigate(packed(spark, root).withColumn("k", F.col("channel") + 1), CFG, mode="null"))


@query(f"""{WHITE}, {E.detected(0.8416)}, {E.projection(E.SHRINK)} SELECT block, channel, pol, CAST(k AS INTEGER) AS k, c AS cell,
round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM proj JOIN det USING (block, channel, pol)""")
def shrink_projection(spark, root):
    """Projection matrices that shrink detected modes to the noise floor."""
    return _cells(op.mitigate(packed(spark, root), CFG, delta=0.8416, mode="shrink"))


def weight_arrays(spark, root):
    """Integer beam weights as arrays per (channel, pol, beam)."""
    from phasegrid.workloads.signal import integer_weights
    w = integer_weights(spark, root).groupBy("channel", "pol", "beam").agg(
        F.array_sort(F.collect_list(F.struct("recv", "re", "im"))).alias("w"))
    as_double = lambda c: F.transform(F.col(f"w.{c}"), lambda x: x.cast("double"))
    return w.select("channel", "pol", "beam", as_double("re").alias("w_re"), as_double("im").alias("w_im"))


def _weight_rows(d):
    d = d.select("block", "channel", "pol", "beam", F.posexplode(F.arrays_zip("a_re", "a_im")).alias("recv", "v"))
    return d.select("block", "channel", "pol", "beam", "recv", F.col("v.a_re").alias("re"), F.col("v.a_im").alias("im"))


@query(f"""WITH {WEIGHTS} SELECT b.block, w.channel, w.pol, w.beam, w.recv, CAST(wr AS DOUBLE) AS re,
CAST(wi AS DOUBLE) AS im FROM wts w JOIN (SELECT DISTINCT block, channel FROM samples) b ON b.channel = w.channel""")
def identity_projection(spark, root):
    """Without signal modes the projection leaves every weight as it is."""
    proj = op.mitigate(packed(spark, root).withColumn("k", F.lit(0)), CFG, mode="null")
    d = _weight_rows(op.project_weights(proj, weight_arrays(spark, root), 8))
    return d.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("re", "im")})


ONE_OUT = E.projection("SELECT *, 1 AS factor FROM um WHERE mode = 0")


@query(f"""{WHITE}, {E.unwhitened()}, {ONE_OUT}, {WEIGHTS.split(SCALED + ",")[1]}
SELECT block, p.channel, p.pol, w.beam, CAST(c % 8 AS INTEGER) AS recv, round(sum(wr * re - wi * im), 6) + 0.0 AS re,
round(sum(wr * im + wi * re), 6) + 0.0 AS im FROM proj p JOIN wts w ON w.channel = p.channel AND w.pol = p.pol AND w.recv = c // 8
GROUP BY block, p.channel, p.pol, w.beam, c % 8""")
def adapted_weights(spark, root):
    """Weights after nulling the strongest mode."""
    proj = op.mitigate(packed(spark, root), CFG, mode="null")
    d = _weight_rows(op.project_weights(proj, weight_arrays(spark, root), 8))
    return d.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("re", "im")})


@query(f"""{EIGEN} SELECT {MATRIX_KEYS}, CAST(mode AS INTEGER) AS rank, round(lam, 3) + 0.0 AS eigval, r AS recv, round(pr[9 * r + 1], 6) + 0.0 AS power
FROM modes, (SELECT CAST(unnest(range(8)) AS INTEGER) AS r) WHERE mode < 3""")
def top_eigenvectors(spark, root):
    """The three largest modes; of their vectors the power by receiver, which has no phase."""
    d = op.top_vectors(op.eigen(packed(spark, root), CFG), 8, 3)
    power = F.zip_with("u_re", "u_im", lambda a, b: a * a + b * b)
    d = d.select("block", "channel", "p", "q", "rank", F.round("eigval", 3).alias("eigval"), F.posexplode(power).alias("recv", "power"))
    return d.withColumns({"power": F.round("power", 6) + F.lit(0.0), "eigval": F.col("eigval") + F.lit(0.0)})


@query(f"""{EIGEN} SELECT a.block, a.p, a.q, a.channel, round(sqrt(greatest({E.both('a.pr', 'a.pi', 'b.pr', 'b.pi')}, 0)), 5) + 0.0 AS similarity
FROM modes a JOIN modes b ON b.block = a.block AND b.p = a.p AND b.q = a.q AND b.channel = a.channel + 1
WHERE a.mode = 0 AND b.mode = 0 AND a.p = a.q""")
def eigenvector_similarity(spark, root):
    """|u^H v| of the dominant vectors of neighbouring channels."""
    d = op.dominant_vector(op.eigen(packed(spark, root), CFG, cross=False), 8)
    return op.vector_similarity(d, ["block", "p", "q"]).withColumn("similarity", F.round("similarity", 5) + F.lit(0.0))


MEAN_TOP = f"""mean_long AS (SELECT block // 4 AS win, channel, p, q, c, sum(pr[c + 1]) / count(DISTINCT block) AS re, sum(pi[c + 1]) / count(DISTINCT block) AS im
  FROM modes, (SELECT unnest({E.CELLS}) AS c) WHERE mode < 3 GROUP BY ALL),
mean_mat AS (SELECT win, channel, p, q, list(re ORDER BY c) AS re, list(im ORDER BY c) AS im FROM mean_long GROUP BY ALL),
{E.modes('mean_mat', 'win, channel, p, q', 3, 'mean_modes')}"""


@query(f"""{EIGEN}, {MEAN_TOP} SELECT win AS "window", channel, p, q, CAST(mode AS INTEGER) AS rank, round(lam, 6) + 0.0 AS eigval FROM mean_modes""")
def mean_projection(spark, root):
    """Largest eigenvalues of the projection averaged over four blocks."""
    d = op.top_vectors(op.mean_projection(op.eigen(packed(spark, root), CFG), 8, 3, 4), 8, 3)
    return d.select("window", "channel", "p", "q", "rank", (F.round("eigval", 6) + F.lit(0.0)).alias("eigval"))


@query(f"""WITH {SAMPLES} SELECT DISTINCT block // 4 AS "window", channel, p.p, q.q, CAST(3 AS DOUBLE) AS rank_sum
FROM samples, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS p) p, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS q) q""")
def mean_projection_trace(spark, root):
    """Averaged projections of three vectors keep trace three."""
    d = op.mean_projection(op.eigen(packed(spark, root), CFG), 8, 3, 4)
    total = F.aggregate("eigvals", F.lit(0.0), lambda a, b: a + b)
    return d.select("window", "channel", "p", "q", F.round(total, 6).alias("rank_sum"))


# --- end-to-end jobs on binary packets -------------------------------------------------------

def calibration() -> Calibration:
    """Integer weights of the beam queries as arrays (bounded by the array shape)."""
    c, p, b, r = np.meshgrid(range(2), range(2), range(2), range(8), indexing="ij")
    return Calibration(weights=((r * 2 + b) % 5 - 2) + 1j * ((r + p + c) % 3 - 1))


@query(f"""WITH {VIS} SELECT block // 2 AS integration, channel, i, j, p, q, sum(re) AS re, sum(im) AS im FROM vis
GROUP BY ALL""")
def observe_visibilities(spark, root):
    """Binary packets through assembly, correlation and integration."""
    return jobs.observe(tb.embedding_packets(spark, root), CFG, calibration(), only=["visibilities"])["visibilities"].drop(*SEQUENCE)


@query(f"""WITH {SAMPLES}, c AS (SELECT DISTINCT block, channel, pkt, recv // 4 AS source FROM samples),
g AS (SELECT block // 2 AS integration, count(DISTINCT block) * 32 AS total FROM samples GROUP BY 1)
SELECT integration, total - count(*) AS missing, total, 100.0::DOUBLE * (total - count(*)) / total AS pct
FROM c JOIN g ON c.block // 2 = g.integration GROUP BY integration, total""")
def observe_missing(spark, root):
    return ingest.single_integrations(jobs.observe(tb.embedding_packets(spark, root), CFG, calibration(), only=["missing"])["missing"])


@query(f"""WITH {WEIGHTS}, g AS (SELECT DISTINCT block, channel FROM samples)
SELECT g.block, g.channel, p.pol, b.beam, s.s, coalesce(CAST(y.re AS DOUBLE), 0) AS re,
coalesce(CAST(y.im AS DOUBLE), 0) AS im
FROM g CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS pol) p
CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS beam) b CROSS JOIN (SELECT CAST(unnest(range(128)) AS INTEGER) AS s) s
LEFT JOIN beams y ON y.block = g.block AND y.channel = g.channel AND y.pol = p.pol AND y.beam = b.beam
  AND y.pkt * 16 + y.t = s.s""")
def observe_beams(spark, root):
    d = jobs.observe(tb.embedding_packets(spark, root), CFG, calibration(), only=["beams"])["beams"].drop(*SEQUENCE)
    return d.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("re", "im")})


#: Three epochs of two beams on receivers in a row: begin in samples, and direction cosines by beam (any numbers will do).
EPOCHS = [(0, [(0.0, 0.0, 1.0), (0.1, 0.2, 0.97)]), (100, [(0.02, -0.01, 0.99), (0.12, 0.19, 0.96)]), (300, [(0.05, 0.0, 0.98), (0.2, 0.1, 0.9)])]
TRACK_HZ, TRACK_WIDTH_HZ = 1.2e8, 781250.0
TRACKED = SCALED + f""",
dirs AS (SELECT * FROM (VALUES {", ".join(f"({e}, {b}, {l}::DOUBLE, {m}::DOUBLE, {n}::DOUBLE)" for e, (_, beams) in enumerate(EPOCHS) for b, (l, m, n) in enumerate(beams))}) d(epoch, beam, l, m, n)),
tracked AS (
  SELECT block, channel, pol, CAST(beam AS INTEGER) AS beam, CAST(pkt * 16 + t AS INTEGER) AS s,
         -2 * pi() * ({TRACK_HZ}::DOUBLE + channel * {TRACK_WIDTH_HZ}::DOUBLE) / 299792458.0::DOUBLE * (l * 10 * recv + m * 3 * recv + n * 0.5) AS phase, recv, re, im
  FROM x JOIN dirs ON epoch = CASE WHEN block * 128 >= {EPOCHS[2][0]} THEN 2 WHEN block * 128 >= {EPOCHS[1][0]} THEN 1 ELSE 0 END WHERE recv <> 3),
tb AS (SELECT block, channel, pol, beam, s, sum(re * cos(phase) - im * sin(phase)) / 8 AS re, sum(re * sin(phase) + im * cos(phase)) / 8 AS im
  FROM tracked GROUP BY ALL)"""


@query(f"""WITH {TRACKED}, g AS (SELECT DISTINCT block, channel FROM samples)
SELECT g.block, g.channel, p.pol, b.beam, s.s, round(coalesce(re, 0), 5) + 0.0 AS re, round(coalesce(im, 0), 5) + 0.0 AS im
FROM g CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS pol) p
CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS beam) b CROSS JOIN (SELECT CAST(unnest(range(128)) AS INTEGER) AS s) s
LEFT JOIN tb y ON y.block = g.block AND y.channel = g.channel AND y.pol = p.pol AND y.beam = b.beam AND y.s = s.s""")
def observe_tracking(spark, root):
    """Beams that are pointed anew twice; each block uses the epoch it starts in, and receiver 3 has no antenna."""
    places = np.array([[10.0 * r, 3.0 * r, 0.5] for r in range(8)])
    track = Tracking(np.array([e for e, _ in EPOCHS]), np.array([d for _, d in EPOCHS]), places, np.arange(8) != 3)
    cal = Calibration(tracking=track, base_hz=TRACK_HZ, bandwidth_hz=TRACK_WIDTH_HZ)
    d = jobs.observe(tb.embedding_packets(spark, root), CFG, cal, only=["beams"])["beams"].drop(*SEQUENCE)
    return d.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("re", "im")})


@query(f"""WITH {SCALED},
y AS (SELECT channel, recv, pol, block * 128 + pkt * 16 + t - CASE WHEN recv >= 4 THEN 3 ELSE 0 END AS tt,
  re * ((recv + 2 * pol + channel) % 3 + 1) - im * ((recv + pol) % 2) AS re, re * ((recv + pol) % 2) + im * ((recv + 2 * pol + channel) % 3 + 1) AS im FROM x),
perm AS (SELECT c, q, (c * 3 + 1) % 8 AS hw, (q + c) % 2 AS hp FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS c),
  (SELECT CAST(unnest([0, 1]) AS INTEGER) AS q) WHERE c <> 5),
own AS (SELECT DISTINCT block, channel FROM samples),
z AS (SELECT y.channel, c, q, own.block, tt, re, im FROM y JOIN perm ON recv = hw AND pol = hp
  JOIN own ON own.channel = y.channel AND own.block = CAST(floor(tt / 128.0) AS BIGINT)),
vis AS (SELECT a.block // 2 AS integration, a.channel, a.c AS i, b.c AS j, a.q AS p, b.q AS q,
  CAST(sum(a.re * b.re + a.im * b.im) AS DOUBLE) AS re, CAST(sum(a.im * b.re - a.re * b.im) AS DOUBLE) AS im
  FROM z a JOIN z b ON a.channel = b.channel AND a.tt = b.tt AND a.c <= b.c GROUP BY ALL),
g AS (SELECT DISTINCT block // 2 AS integration, channel FROM own),
r AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q
  FROM (SELECT unnest(range(8)) AS i) JOIN (SELECT unnest(range(8)) AS j) ON i <= j
  CROSS JOIN (SELECT unnest(range(2)) AS p) CROSS JOIN (SELECT unnest(range(2)) AS q))
SELECT g.integration, g.channel, r.i, r.j, r.p, r.q, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM g CROSS JOIN r
LEFT JOIN vis v ON v.integration = g.integration AND v.channel = g.channel AND v.i = r.i AND v.j = r.j AND v.p = r.p AND v.q = r.q""")
def observe_calibrated(spark, root):
    """Visibilities with gains, another order of receivers and polarizations, one left out, and a source three samples late."""
    c, p, r = np.meshgrid(range(2), range(2), range(8), indexing="ij")
    gains = ((r + 2 * p + c) % 3 + 1) + 1j * ((r + p) % 2)
    slot, pol = np.meshgrid(range(8), range(2), indexing="ij")
    wired = np.stack([np.where(slot == 5, -1, (slot * 3 + 1) % 8), (pol + slot) % 2], axis=-1)
    cal = Calibration(gains=gains, permutation=wired, residuals={0: 0, 1: 3})
    return jobs.observe(tb.embedding_packets(spark, root), CFG, cal, only=["visibilities"])["visibilities"].drop(*SEQUENCE)


@query(f"""WITH {SAMPLES}, s AS (SELECT DISTINCT block, channel, pkt, recv // 4 AS source FROM samples),
b AS (SELECT block, channel, count(*) AS have FROM s GROUP BY ALL)
SELECT block // 2 AS integration, channel, CAST(min(block) * 128 AS BIGINT) AS start_seq, CAST(max(block) * 128 + 112 AS BIGINT) AS end_seq,
CAST(sum(16 - have) AS BIGINT) AS missing FROM b GROUP BY ALL""")
def observe_sequence(spark, root):
    """Counters of the first and last packet of every integration, counted from the first of all, and its missing packets, as the product has them."""
    packets = tb.embedding_packets(spark, root)
    out = scratch_path(spark, "sequence")
    products.write_product(jobs.observe(packets, CFG, Calibration(), only=["visibilities"])["visibilities"], out, "visibilities")
    zero = packets.agg(F.min("sample_count")).scalar()
    d = products.read_product(spark, out, "visibilities").where("i = 0 and j = 0 and p = 0 and q = 0")
    return d.select("integration", "channel", (F.col("start_seq") - zero).alias("start_seq"), (F.col("end_seq") - zero).alias("end_seq"), "missing")


@query(f"""WITH {WEIGHTS}, spec AS (
  SELECT block, channel, pol, beam, pkt, k,
         sum(re * cos(2 * pi() * ((k * t) % 16) / 16) + im * sin(2 * pi() * ((k * t) % 16) / 16)) AS re,
         sum(im * cos(2 * pi() * ((k * t) % 16) / 16) - re * sin(2 * pi() * ((k * t) % 16) / 16)) AS im
  FROM beams, (SELECT CAST(unnest(range(16)) AS INTEGER) AS k) GROUP BY ALL)
SELECT block, channel, pol, beam, CAST((k + 8) % 16 - 2 AS INTEGER) AS bin,
round(sum(sqrt(re * re + im * im)), 4) AS value FROM spec WHERE (k + 8) % 16 BETWEEN 2 AND 13 GROUP BY ALL""")
def adaptive_original_spectra(spark, root):
    """Spectra of the original beams of the adaptive job."""
    d = jobs.adaptive_spectra(tb.embedding_packets(spark, root), CFG, calibration(), trim=2, only=["spectra"])["spectra"].drop(*SEQUENCE)
    return d.where(F.col("beam") < 2).withColumn("value", F.round("value", 4))


@query(f"""{WHITE}, {E.detected(0.8416)}, {E.projection(E.SHRINK)}, {WEIGHTS.split(SCALED + ",")[1].replace("beams AS", "plain AS")},
pw AS (SELECT p.block, p.channel, p.pol, w.beam, CAST(c % 8 AS INTEGER) AS recv, sum(wr * re - wi * im) AS ar, sum(wr * im + wi * re) AS ai
  FROM proj p JOIN wts w ON w.channel = p.channel AND w.pol = p.pol AND w.recv = c // 8 GROUP BY p.block, p.channel, p.pol, w.beam, c % 8),
y AS (SELECT x.block, x.channel, x.pol, pw.beam, x.pkt, x.t, sum(ar * re - ai * im) AS re, sum(ar * im + ai * re) AS im
  FROM x JOIN pw ON pw.block = x.block AND pw.channel = x.channel AND pw.pol = x.pol AND pw.recv = x.recv GROUP BY ALL),
spec AS (SELECT block, channel, pol, beam, pkt, k,
  sum(re * cos(2 * pi() * ((k * t) % 16) / 16) + im * sin(2 * pi() * ((k * t) % 16) / 16)) AS re,
  sum(im * cos(2 * pi() * ((k * t) % 16) / 16) - re * sin(2 * pi() * ((k * t) % 16) / 16)) AS im
  FROM y, (SELECT CAST(unnest(range(16)) AS INTEGER) AS k) GROUP BY ALL)
SELECT block, channel, pol, CAST(beam + 2 AS INTEGER) AS beam, CAST((k + 8) % 16 - 2 AS INTEGER) AS bin,
round(sum(sqrt(re * re + im * im)), 3) AS value FROM spec WHERE (k + 8) % 16 BETWEEN 2 AND 13 GROUP BY ALL""")
def adaptive_mitigated_spectra(spark, root):
    """Spectra of the projected beams (shrink mode, detected modes)."""
    d = jobs.adaptive_spectra(tb.embedding_packets(spark, root), CFG, calibration(), mode="shrink", delta=0.8416,
                              trim=2, only=["spectra"])["spectra"].drop(*SEQUENCE)
    return d.where(F.col("beam") >= 2).withColumn("value", F.round("value", 3))


@query(f"""{WHITE}, {E.detected(0.8416)} SELECT channel, pol, CAST(min(k) AS INTEGER) AS min_k, CAST(max(k) AS INTEGER) AS max_k,
median(k) AS median_k, avg(k) AS mean_k FROM det GROUP BY ALL""")
def adaptive_mode_statistics(spark, root):
    return jobs.adaptive_spectra(tb.embedding_packets(spark, root), CFG, calibration(), delta=0.8416,
                                 trim=2, only=["statistics"])["statistics"]


@query(f"""WITH {SCALED}, b AS (SELECT DISTINCT block, channel FROM x), spec AS (
  SELECT block, channel, recv, pol, k,
    sum(re * cos(2 * pi() * ((k * n) % 128) / 128) + im * sin(2 * pi() * ((k * n) % 128) / 128)) AS re,
    sum(im * cos(2 * pi() * ((k * n) % 128) / 128) - re * sin(2 * pi() * ((k * n) % 128) / 128)) AS im
  FROM (SELECT *, pkt * 16 + t AS n FROM x), (SELECT CAST(unnest(range(128)) AS INTEGER) AS k) GROUP BY ALL)
SELECT block, channel, recv, pol, CAST(k // 8 AS INTEGER) AS bin, round(avg(re * re + im * im), 2) AS value
FROM spec GROUP BY ALL""")
def antenna_spectra(spark, root):
    d = jobs.antenna_spectra(tb.embedding_packets(spark, root), CFG, Calibration(), 8).drop(*SEQUENCE)
    return d.withColumn("value", F.round("value", 2))


@query(f"""WITH {WEIGHTS}, spec AS (
  SELECT block, channel, pol, beam, k,
    sum(re * cos(2 * pi() * ((k * n) % 128) / 128) + im * sin(2 * pi() * ((k * n) % 128) / 128)) AS re,
    sum(im * cos(2 * pi() * ((k * n) % 128) / 128) - re * sin(2 * pi() * ((k * n) % 128) / 128)) AS im
  FROM (SELECT *, pkt * 16 + t AS n FROM beams), (SELECT CAST(unnest(range(128)) AS INTEGER) AS k) GROUP BY ALL)
SELECT block, channel, pol, beam, CAST(k // 8 AS INTEGER) AS bin, round(avg(re * re + im * im), 2) AS value
FROM spec GROUP BY ALL""")
def beamformed_bandpass(spark, root):
    d = jobs.beamformed_bandpass(tb.embedding_packets(spark, root), CFG, calibration(), 8).drop(*SEQUENCE)
    return d.withColumn("value", F.round("value", 2))


@query(f"""{EIGEN}, {MEAN_TOP} SELECT win AS "window", channel, p, q, CAST(mode AS INTEGER) AS rank, round(lam, 6) + 0.0 AS eigval, r AS recv,
round(pr[9 * r + 1], 5) + 0.0 AS power FROM mean_modes, (SELECT CAST(unnest(range(8)) AS INTEGER) AS r)""")
def projection_matrix(spark, root):
    """The job from packets on: eigenvalues of the averaged projections and their vectors' power by receiver."""
    d = jobs.projection_matrix(tb.embedding_packets(spark, root), CFG, Calibration())
    power = F.zip_with("u_re", "u_im", lambda a, b: a * a + b * b)
    d = d.select("window", "channel", "p", "q", "rank", F.round("eigval", 6).alias("eigval"), F.posexplode(power).alias("recv", "power"))
    return d.withColumns({"power": F.round("power", 5) + F.lit(0.0), "eigval": F.col("eigval") + F.lit(0.0)})


@query(f"""WITH {WEIGHTS}, f AS (SELECT channel, pol, beam,
CAST(((block * 128 + pkt * 16 + t - 9 * channel + 3700) % 37) * 8 // 37 AS INTEGER) AS bin,
re * re + im * im AS power FROM beams),
g AS (SELECT channel, pol, beam, bin, avg(power) AS profile FROM f WHERE power > 0 GROUP BY ALL)
SELECT c.channel, c.pol, c.beam, b.bin, round(coalesce(profile, 0), 6) AS profile
FROM (SELECT DISTINCT channel, pol, beam FROM g) c CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS bin) b
LEFT JOIN g ON g.channel = c.channel AND g.pol = c.pol AND g.beam = c.beam AND g.bin = b.bin""")
def pulsar_fold(spark, root):
    d = jobs.pulsar_fold(tb.embedding_packets(spark, root), CFG, calibration(), 37, 8, {0: 0, 1: 9})
    return d.withColumn("profile", F.round("profile", 6))


@query(f"""WITH {VIS} SELECT channel, i, j, p, q, sum(re) AS re, sum(im) AS im FROM vis GROUP BY ALL""")
def offline_correlation(spark, root):
    return jobs.offline_correlation(tb.embedding_packets(spark, root), CFG)
