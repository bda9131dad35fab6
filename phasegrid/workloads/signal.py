"""Correlation, beams, spectra and folding on ``lineitem``, ``embeddings`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions import numeric as N
from phasegrid.operators import beam, calibrate, correlate, fold, ingest, reports, spectra, wiring
from phasegrid.sources import tables as tb
from phasegrid.workloads import query
from phasegrid.workloads.bindings import LINE_SAMPLES, SAMPLES, SCALED, VIS, WIRING
from phasegrid.workloads.wiring import POSITIONS, position_table

CFG = tb.FRAME_CFG
LINE = tb.SAMPLE_CFG


def scaled_samples(spark, root):
    x = tb.embedding_samples(spark, root)
    return x.withColumns({"re": F.col("re") * F.col("scale"), "im": F.col("im") * F.col("scale")}).drop("scale")


def line_visibilities(spark, root):
    wide = correlate.wide_samples(tb.lineitem_samples(spark, root), LINE, ["t"])
    return correlate.visibilities_wide(wide, LINE, ["block", "channel"])


def packed(spark, root):
    return correlate.visibilities_packed(tb.embedding_frames(spark, root), CFG)


def visibilities(spark, root):
    return correlate.unpack(packed(spark, root), CFG)


LINE_VIS = LINE_SAMPLES + """,
lvis AS (
  SELECT a.block, a.channel, a.recv AS i, b.recv AS j, 0 AS p, 0 AS q,
         CAST(sum(a.re * b.re + a.im * b.im) AS BIGINT) AS re, CAST(sum(a.im * b.re - a.re * b.im) AS BIGINT) AS im
  FROM ls a JOIN ls b ON a.block = b.block AND a.channel = b.channel AND a.t = b.t AND a.recv <= b.recv
  GROUP BY a.block, a.channel, a.recv, b.recv),
lfull AS (
  SELECT g.block, g.channel, r.i, r.j, 0 AS p, 0 AS q, coalesce(v.re, 0) AS re, coalesce(v.im, 0) AS im
  FROM (SELECT DISTINCT block, channel FROM ls) g
  CROSS JOIN (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM (SELECT unnest(range(7)) AS i) a
              JOIN (SELECT unnest(range(7)) AS j) b ON i <= j) r
  LEFT JOIN lvis v ON v.block = g.block AND v.channel = g.channel AND v.i = r.i AND v.j = r.j)"""


@query(f"WITH {LINE_VIS} SELECT * FROM lfull", name="visibilities")
def visibilities_of_samples(spark, root):
    """All baselines of every (block, channel); duplicates resolved, gaps zero."""
    return line_visibilities(spark, root)


@query(f"WITH {VIS} SELECT * FROM vis")
def visibilities_packed(spark, root):
    return visibilities(spark, root)


@query(f"""WITH {LINE_VIS} SELECT block // 8 AS integration, channel, i, j, p, q, CAST(sum(re) AS BIGINT) AS re,
CAST(sum(im) AS BIGINT) AS im FROM lfull GROUP BY ALL""")
def accumulate_visibilities(spark, root):
    """Integrations of eight blocks, summed straight from the samples."""
    wide = correlate.wide_samples(tb.lineitem_samples(spark, root), LINE, ["t"])
    wide = wide.withColumn("integration", N.floor_div("block", LINE.accumulate))
    return correlate.visibilities_wide(wide, LINE, ["integration", "channel"])


@query(f"""WITH {VIS} SELECT block // 2 AS integration, channel, i, j, p, q, sum(re) AS re, sum(im) AS im FROM vis
GROUP BY ALL""")
def accumulate_packed(spark, root):
    return correlate.accumulate_packed(packed(spark, root), CFG, CFG.accumulate)


@query(f"""WITH {VIS} SELECT block // 2 AS integration, channel, i, j, p, q, sum(re) / 2 AS re, sum(im) / 2 AS im
FROM vis GROUP BY ALL""")
def mean_visibilities(spark, root):
    return correlate.mean_visibilities(visibilities(spark, root), 2)


@query(f"WITH {VIS} SELECT * FROM vis WHERE j < 6")
def trim_baselines(spark, root):
    return correlate.trim_baselines(visibilities(spark, root), 6)


@query(f"""WITH {VIS} SELECT * FROM vis UNION ALL
SELECT block, channel, j, i, q, p, re, 0.0 - im FROM vis WHERE i <> j""")
def hermitian_fill(spark, root):
    d = correlate.hermitian_fill(visibilities(spark, root))
    return d.withColumn("im", F.col("im") + F.lit(0.0))


@query(f"""WITH {VIS} SELECT *, round(sqrt(re * re + im * im), 6) AS mag, round(atan2(im, re), 6) + 0.0 AS angle,
i = j AND p = q AS autocorr FROM vis""")
def visibility_table(spark, root):
    d = correlate.polar(visibilities(spark, root))
    return d.withColumns({"mag": F.round("mag", 6), "angle": F.round("angle", 6) + F.lit(0.0)})


@query(f"""WITH {VIS}, acc AS (SELECT block // 2 AS integration, channel, i, j, p, q, sum(re) AS re, sum(im) AS im
FROM vis GROUP BY ALL) SELECT integration, i, j, p, q, round(avg(sqrt(re * re + im * im)), 6) AS amplitude FROM acc
GROUP BY ALL""")
def mean_amplitude(spark, root):
    d = reports.mean_amplitude(correlate.accumulate(visibilities(spark, root), 2))
    return d.withColumn("amplitude", F.round("amplitude", 6))


# --- calibration and beams -------------------------------------------------------------

@query(f"""WITH {SAMPLES} SELECT block, channel, pkt, recv, t, pol,
re * scale * (recv - 3) - im * scale * (pol + 1) AS re, re * scale * (pol + 1) + im * scale * (recv - 3) AS im
FROM samples""")
def scale_and_gain(spark, root):
    x = tb.embedding_samples(spark, root).withColumns({"gain_re": F.col("recv") - 3, "gain_im": F.col("pol") + 1})
    return calibrate.scale_and_gain(x).drop("scale", "gain_re", "gain_im")


@query(f"""WITH {SAMPLES}, h AS (
  SELECT block, channel, pkt, recv, t, pol, re, im FROM samples
  UNION ALL SELECT block + 1, channel, -1, recv, t, pol, re, im FROM samples WHERE pkt = 7
  UNION ALL SELECT block - 1, channel, 8, recv, t, pol, re, im FROM samples WHERE pkt = 0 AND block > 0)
SELECT block, channel, recv, pol, pkt * 16 + t - (recv * 3 - 9) AS s, re, im FROM h
WHERE pkt * 16 + t - (recv * 3 - 9) BETWEEN 0 AND 127""")
def align_samples(spark, root):
    """Receivers shifted by -9..12 samples, reading the halo of the neighbouring blocks."""
    d = tb.embedding_frames(spark, root).withColumn("index", F.col("block") * CFG.packets + F.col("pkt"))
    d = ingest.block_members(d.drop("block", "pkt"), CFG)
    x = tb.samples_of_frames(d, CFG)
    x = calibrate.align_samples(x, F.col("recv") * 3 - 9, CFG.steps, CFG.packets)
    return x.select("block", "channel", "recv", "pol", "s", "re", "im")


def integer_weights(spark, root):
    """Two beams with small integer weights for every (channel, pol, receiver) seen in the data."""
    d = tb.embedding_frames(spark, root).select("channel", "recv").distinct()
    return (d.withColumn("pol", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("beam", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumns({"re": F.pmod(F.col("recv") * 2 + F.col("beam"), F.lit(5)) - 2,
                          "im": F.pmod(F.col("recv") + F.col("pol") + F.col("channel"), F.lit(3)) - 1}))


WEIGHTS = SCALED + """,
wts AS (SELECT channel, recv, pol, beam, (recv * 2 + beam) % 5 - 2 AS wr, (recv + pol + channel) % 3 - 1 AS wi
FROM (SELECT DISTINCT channel, recv FROM samples), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS pol),
     (SELECT CAST(unnest([0, 1]) AS INTEGER) AS beam)),
beams AS (SELECT block, channel, pol, beam, pkt, t, CAST(sum(wr * re - wi * im) AS BIGINT) AS re,
CAST(sum(wr * im + wi * re) AS BIGINT) AS im FROM x JOIN wts USING (channel, pol, recv) GROUP BY ALL)"""


def beams(spark, root):
    return beam.beamform(scaled_samples(spark, root), integer_weights(spark, root))


@query(f"WITH {WEIGHTS} SELECT * FROM beams")
def beamform(spark, root):
    return beams(spark, root)


@query(f"""WITH {WEIGHTS} SELECT * FROM beams UNION ALL
SELECT block, channel, pol, CAST(beam + 2 AS INTEGER), pkt, t, re // 1 * 3, im * 3 FROM beams""")
def beam_variants(spark, root):
    """Original and mitigated beams stacked on the beam axis."""
    b = beams(spark, root)
    return beam.stack_variants(b, b.withColumns({"re": F.col("re") * 3, "im": F.col("im") * 3}), 2)


@query(f"""WITH {WEIGHTS} SELECT block, channel, pol, beam, min(re) AS min_re, max(re) AS max_re,
round(avg(re), 6) + 0.0 AS mean_re, count(*) FILTER (re <> 0 OR im <> 0) AS nonzero FROM beams GROUP BY ALL""")
def beam_summary(spark, root):
    d = beam.beam_summary(beams(spark, root), ["block", "channel", "pol", "beam"])
    return d.withColumn("mean_re", F.round("mean_re", 6) + F.lit(0.0))


@query(f"""WITH {WIRING} SELECT run, canonical, CASE WHEN antenna_id < 0 THEN 0 ELSE canonical + 1 END AS re,
CASE WHEN antenna_id < 0 THEN 0 ELSE antenna_id END AS im FROM canonical_map""")
def null_antenna_weights(spark, root):
    m = wiring.canonical_map(tb.customer_wiring(spark, root), tb.WIRING_CFG)
    d = beam.zero_null_antennas(m.withColumns({"re": F.col("canonical") + 1, "im": F.col("antenna_id")}))
    return d.select("run", "canonical", "re", "im")


# Site and frequency plan of the array (fixed values).
SITE = {"latitude": -30.31288472, "longitude": 149.55013889}
BASE_HZ, BANDWIDTH_HZ = 0.0, 781250.0

TARGETS = """
targets AS (SELECT o_orderkey AS target, o_orderdate AS ts, CASE WHEN o_orderkey % 5 = 0 THEN 'zenith' ELSE 'radec' END
  AS mode, CAST(o_custkey % 360 AS DOUBLE) AS ra_deg, CAST(o_orderkey % 180 - 90 AS DOUBLE) AS dec_deg FROM orders),
t1 AS (SELECT *, 40587.0::DOUBLE + epoch_us(ts) / 86400e6::DOUBLE - 51544.5::DOUBLE AS d FROM targets),
t2 AS (SELECT *, d / 36525.0::DOUBLE AS t, radians(ra_deg) AS ra, radians(dec_deg) AS de, pi() / 648000 AS asec FROM t1),
t3 AS (SELECT *, t * (2306.2181::DOUBLE + t * (0.30188::DOUBLE + t * 0.017998::DOUBLE)) * asec AS zeta,
  t * (2306.2181::DOUBLE + t * (1.09468::DOUBLE + t * 0.018203::DOUBLE)) * asec AS z,
  t * (2004.3109::DOUBLE + t * (-0.42665::DOUBLE + t * -0.041833::DOUBLE)) * asec AS th FROM t2),
t4 AS (SELECT *, atan2(cos(de) * sin(ra + zeta), cos(th) * cos(de) * cos(ra + zeta) - sin(th) * sin(de)) + z AS ra1,
  asin(greatest(-1, least(1, sin(th) * cos(de) * cos(ra + zeta) + cos(th) * sin(de)))) AS de1,
  radians(280.46061837::DOUBLE + d * 360.98564736629::DOUBLE + t * t * 0.000387933::DOUBLE
          - t * t * t / 38710000.0::DOUBLE + 149.55013889::DOUBLE) AS lst, radians(-30.31288472::DOUBLE) AS lat FROM t3),
t5 AS (SELECT *, radians(125.04452::DOUBLE - 1934.136261::DOUBLE * t) AS nd, radians(280.4665::DOUBLE + 36000.7698::DOUBLE * t) AS ls,
  radians(218.3165::DOUBLE + 481267.8813::DOUBLE * t) AS lm, radians(357.52911::DOUBLE + 35999.05029::DOUBLE * t) AS ma,
  radians(102.93735::DOUBLE + 1.71946::DOUBLE * t) AS pe, 0.016708634::DOUBLE - 0.000042037::DOUBLE * t AS ec,
  cos(de1) * cos(ra1) AS x0, cos(de1) * sin(ra1) AS y0, sin(de1) AS z0 FROM t4),
t6 AS (SELECT *, (-17.20::DOUBLE * sin(nd) - 1.32::DOUBLE * sin(2 * ls) - 0.23::DOUBLE * sin(2 * lm) + 0.21::DOUBLE * sin(2 * nd)) * asec AS ps,
  (9.20::DOUBLE * cos(nd) + 0.57::DOUBLE * cos(2 * ls) + 0.10::DOUBLE * cos(2 * lm) - 0.09::DOUBLE * cos(2 * nd)) * asec AS ob,
  radians(280.46646::DOUBLE + 36000.76983::DOUBLE * t) + radians(1.914602::DOUBLE * sin(ma) + 0.019993::DOUBLE * sin(2 * ma) + 0.000289::DOUBLE * sin(3 * ma)) AS su
  FROM t5),
t7 AS (SELECT *, radians(23.43929111::DOUBLE - 0.013004167::DOUBLE * t) + ob AS eps, 20.49552::DOUBLE * asec * (sin(su) - ec * sin(pe)) AS vx,
  20.49552::DOUBLE * asec * (ec * cos(pe) - cos(su)) AS vy FROM t6),
t8 AS (SELECT *, x0 - ps * (y0 * cos(eps) + z0 * sin(eps)) + vx AS x1, y0 + ps * x0 * cos(eps) - ob * z0 + vy * cos(eps) AS y1,
  z0 + ps * x0 * sin(eps) + ob * y0 + vy * sin(eps) AS z1, lst + ps * cos(eps) AS ast FROM t7),
t9 AS (SELECT *, sqrt(x1 * x1 + y1 * y1 + z1 * z1) AS w FROM t8),
directions AS (SELECT target, mode,
  CASE WHEN mode = 'zenith' THEN 0 ELSE -(x1 * sin(ast) - y1 * cos(ast)) / w END AS l,
  CASE WHEN mode = 'zenith' THEN 0 ELSE (z1 * cos(lat) - (x1 * cos(ast) + y1 * sin(ast)) * sin(lat)) / w END AS m,
  CASE WHEN mode = 'zenith' THEN 1 ELSE (z1 * sin(lat) + (x1 * cos(ast) + y1 * sin(ast)) * cos(lat)) / w END AS n FROM t9)"""


@query(f"""WITH {TARGETS} SELECT target, mode, round(l, 6) + 0.0 AS l, round(m, 6) + 0.0 AS m, round(n, 6) + 0.0 AS n
FROM directions""")
def target_directions(spark, root):
    """Every order is an observation of a sky position at its date."""
    o = tb.table(spark, root, "orders").select(
        F.col("o_orderkey").alias("target"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "zenith").otherwise("radec").alias("mode"),
        F.pmod("o_custkey", F.lit(360)).cast("double").alias("ra_deg"),
        (F.pmod("o_orderkey", F.lit(180)) - 90).cast("double").alias("dec_deg"))
    d = beam.target_directions(o, SITE["latitude"], SITE["longitude"])
    return d.select("target", "mode", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("l", "m", "n")])


@query(f"""WITH {WIRING}, {POSITIONS}, r AS (SELECT run, canonical, m.antenna_id, coalesce(east, 0) AS east,
coalesce(north, 0) AS north, coalesce(up, 0) AS up FROM canonical_map m LEFT JOIN pos USING (antenna_id)),
c AS (SELECT run, CAST(run % 3 AS INTEGER) AS channel, (192 + run % 3) * 781250.0::DOUBLE AS hz FROM runs),
ph AS (SELECT r.run, channel, canonical AS recv, antenna_id, hz * (-2 * pi() / 299792458.0::DOUBLE)
       * (0.1::DOUBLE * east + 0.2::DOUBLE * north + 0.97::DOUBLE * up) AS phase FROM r JOIN c USING (run))
SELECT run, channel, pol, 0 AS beam, recv,
round(CASE WHEN antenna_id < 0 THEN 0 ELSE cos(phase) / 20 END, 6) + 0.0 AS re,
round(CASE WHEN antenna_id < 0 THEN 0 ELSE sin(phase) / 20 END, 6) + 0.0 AS im
FROM ph, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS pol)""")
def steering_weights(spark, root):
    """Steering phasors of every receiver of every run towards one direction per run."""
    m = wiring.canonical_map(tb.customer_wiring(spark, root), tb.WIRING_CFG)
    runs = tb.customer_wiring(spark, root).select("run").distinct()
    receivers = wiring.antenna_positions(m, position_table(spark, root))
    directions = runs.select("run", F.lit(0).alias("beam"), F.lit(0.1).alias("l"), F.lit(0.2).alias("m"),
                             F.lit(0.97).alias("n"))
    channels = beam.channel_frequencies(
        runs.withColumn("channel", F.pmod("run", F.lit(3)).cast("int")), 192, BASE_HZ, BANDWIDTH_HZ)
    d = beam.steering_weights(receivers, directions, channels, 20, 2)
    return d.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("re", "im")})


@query("""SELECT CAST(floor((epoch_us(ts) / 1000000 - 1704067200) / 3600.0) AS BIGINT) AS epoch, count(*) AS packets,
min(event_id) AS first_packet FROM events GROUP BY 1""")
def steering_epoch(spark, root):
    """Hourly refresh epochs and the packets that use each of them."""
    e = tb.table(spark, root, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 1704067200
    d = e.withColumn("epoch", beam.steering_epoch(seconds, 3600))
    return d.groupBy("epoch").agg(F.count(F.lit(1)).alias("packets"), F.min("event_id").alias("first_packet"))


# --- spectra ------------------------------------------------------------------------------

DFT = SCALED + """,
spec AS (
  SELECT block, channel, pkt, recv, pol, k,
         sum(re * cos(2 * pi() * ((k * t) % 16) / 16) + im * sin(2 * pi() * ((k * t) % 16) / 16)) AS re,
         sum(im * cos(2 * pi() * ((k * t) % 16) / 16) - re * sin(2 * pi() * ((k * t) % 16) / 16)) AS im
  FROM x, (SELECT CAST(unnest(range(16)) AS INTEGER) AS k) GROUP BY ALL)"""


def packet_spectra(spark, root):
    series = spectra.split_frames(tb.embedding_frames(spark, root), CFG.pols, CFG.steps)
    return spectra.fft_rows(series)


@query(f"""WITH {DFT} SELECT block, channel, pkt, recv, pol, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im
FROM spec""")
def packet_fft(spark, root):
    d = spectra.bins(packet_spectra(spark, root))
    return d.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("re", "im")})


@query(f"""WITH {SCALED}, s AS (SELECT block, channel, recv, pol, pkt * 16 + t AS n, re, im FROM x),
sp AS (SELECT block, channel, recv, pol, k,
  sum(re * cos(2 * pi() * ((k * n) % 128) / 128) + im * sin(2 * pi() * ((k * n) % 128) / 128)) AS re,
  sum(im * cos(2 * pi() * ((k * n) % 128) / 128) - re * sin(2 * pi() * ((k * n) % 128) / 128)) AS im
  FROM s, (SELECT CAST(unnest(range(128)) AS INTEGER) AS k) GROUP BY ALL)
SELECT block, channel, recv, pol, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM sp""")
def block_fft(spark, root):
    """128-point spectra of all blocks; packets that an incomplete block lacks count as zeros in their place."""
    series = spectra.split_frames(tb.embedding_frames(spark, root), CFG.pols, CFG.steps)
    whole = spectra.block_series(series, ["block", "channel", "recv", "pol"], CFG.packets, CFG.steps)
    d = spectra.bins(spectra.fft_rows(whole))
    return d.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("re", "im")})


@query(f"""WITH {DFT} SELECT block, channel, pkt, recv, pol, CAST(k // 4 AS INTEGER) AS bin,
round(avg(re * re + im * im), 3) AS power FROM spec GROUP BY ALL""")
def power_downsample(spark, root):
    d = spectra.downsample_power(packet_spectra(spark, root), 4)
    keys = ["block", "channel", "pkt", "recv", "pol"]
    d = d.select(*keys, F.posexplode("power").alias("bin", "power"))
    return d.withColumn("power", F.round("power", 3))


@query(f"""WITH {SCALED} SELECT block, channel, pkt, recv, CAST((pol * 16 + t) // 5 AS BIGINT) AS bin,
round(coalesce(avg(CASE WHEN im % 3 <> 0 THEN CAST(re * re + im * im AS DOUBLE) END), 0), 6) AS power FROM x GROUP BY ALL""")
def power_downsample_nan(spark, root):
    """Mean over groups of five with NaN bins skipped and empty groups zero."""
    x = scaled_samples(spark, root).withColumn("k", F.col("pol") * 16 + F.col("t"))
    x = x.withColumn("re", F.when(F.pmod("im", F.lit(3)) == 0, F.lit(float("nan"))).otherwise(F.col("re")))
    d = spectra.downsample_power_long(x, ["block", "channel", "pkt", "recv"], 5)
    return d.withColumn("power", F.round("power", 6))


@query(f"""WITH {DFT}, tr AS (SELECT block, channel, pkt, recv, pol, CAST((k + 8) % 16 - 2 AS INTEGER) AS bin, re, im
FROM spec WHERE (k + 8) % 16 BETWEEN 2 AND 13)
SELECT block, channel, recv, pol, bin, round(sum(sqrt(re * re + im * im)), 4) AS magnitude FROM tr GROUP BY ALL""")
def fine_channel_spectrum(spark, root):
    """Shifted, trimmed packet spectra, magnitudes summed over the packets of a block."""
    d = spectra.shift_and_trim(spectra.bins(packet_spectra(spark, root)), CFG.steps, 2)
    d = spectra.sum_magnitude(d, ["block", "channel", "recv", "pol"])
    return d.withColumn("magnitude", F.round("magnitude", 4))


@query("""WITH e AS (SELECT vec_id, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 127) AS INTEGER) AS x,
unnest(range(64)) AS k FROM embeddings)
SELECT CAST((k + 32) % 64 - 5 AS INTEGER) AS bin, count(*) AS n, CAST(sum(x * x) AS BIGINT) AS energy FROM e
WHERE (k + 32) % 64 BETWEEN 5 AND 58 GROUP BY 1""")
def fft_shift_trim(spark, root):
    """The production trim: 64 fine channels, five dropped at each edge."""
    d = tb.embedding_frames(spark, root).select(F.posexplode("data").alias("k", "x"))
    d = spectra.shift_and_trim(d, 64, 5)
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("energy"))


@query(f"""WITH {DFT} SELECT block, channel, pkt, recv, pol, CAST((k + 8) % 16 AS INTEGER) AS bin,
round(sqrt(re * re + im * im), 4) AS magnitude FROM spec""")
def bandpass(spark, root):
    d = spectra.bandpass(spectra.bins(packet_spectra(spark, root)), CFG.steps)
    return d.withColumn("magnitude", F.round("magnitude", 4))


@query(f"""WITH {SCALED} SELECT block, channel, recv, pol, arg_max(n, (re * re + im * im) * 1000 - n) AS peak,
max(re * re + im * im) AS peak_power FROM (SELECT *, pkt * 16 + t AS n FROM x) GROUP BY ALL""")
def peak_bin(spark, root):
    x = scaled_samples(spark, root).withColumn("k", F.col("pkt") * 16 + F.col("t"))
    return spectra.peak_bin(x, ["block", "channel", "recv", "pol"])


@query(f"""WITH {SCALED} SELECT block, channel, pkt, recv, t, round(sqrt(sum(re * re + im * im)), 6) AS detected
FROM x GROUP BY ALL""")
def detect_power(spark, root):
    d = spectra.detect_power(scaled_samples(spark, root), ["block", "channel", "pkt", "recv", "t"])
    return d.withColumn("detected", F.round("detected", 6))


@query(f"""WITH {SCALED}, spec AS (
  SELECT block, channel, pkt, recv, pol, k,
         sum(re * cos(2 * pi() * ((k * t) % 16) / 16) + im * sin(2 * pi() * ((k * t) % 16) / 16)) AS re,
         sum(im * cos(2 * pi() * ((k * t) % 16) / 16) - re * sin(2 * pi() * ((k * t) % 16) / 16)) AS im
  FROM x, (SELECT CAST(unnest(range(16)) AS INTEGER) AS k) GROUP BY ALL),
ph AS (SELECT *, -2 * pi() * ((192 + channel) * 781250.0::DOUBLE
  + (CASE WHEN k < 8 THEN k ELSE k - 16 END) / 16.0::DOUBLE * 781250.0::DOUBLE)
  * (recv * 1.5::DOUBLE - 4) * 1e-9::DOUBLE AS phi FROM spec),
y AS (SELECT block, channel, pkt, recv, pol, k, re * cos(phi) - im * sin(phi) AS re, re * sin(phi) + im * cos(phi) AS im
  FROM ph)
SELECT block, channel, pkt, recv, pol, t,
round(sum(re * cos(2 * pi() * ((k * t) % 16) / 16) - im * sin(2 * pi() * ((k * t) % 16) / 16)) / 16, 4) + 0.0 AS re,
round(sum(im * cos(2 * pi() * ((k * t) % 16) / 16) + re * sin(2 * pi() * ((k * t) % 16) / 16)) / 16, 4) + 0.0 AS im
FROM y, (SELECT CAST(unnest(range(16)) AS INTEGER) AS t) GROUP BY ALL""")
def fine_delay(spark, root):
    """Per-receiver delay correction in the frequency domain (nanosecond delays)."""
    series = spectra.split_frames(tb.embedding_frames(spark, root), CFG.pols, CFG.steps)
    series = series.withColumn("delay_ns", F.col("recv") * 1.5 - 4)
    hz = N.channel_frequency_hz(F.col("channel") + 192, BASE_HZ, BANDWIDTH_HZ)
    d = calibrate.fine_delay(series, hz, BANDWIDTH_HZ).drop("delay_ns")
    d = spectra.bins(d).withColumnRenamed("k", "t")
    return d.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("re", "im")})


# --- incoherent sums and folding -------------------------------------------------------------

@query(f"""WITH {SCALED} SELECT block, channel, pkt, t, pol, CAST(sum(re * re + im * im) AS BIGINT) AS power FROM x
GROUP BY ALL""")
def incoherent_sum(spark, root):
    return fold.incoherent_sum(scaled_samples(spark, root), ["block", "channel", "pkt", "t", "pol"])


EVENT_POWER = """
pw AS (SELECT event_id AS sample, 37 * (user_id % 5) AS delay, CAST(user_id % 4 AS INTEGER) AS channel,
CAST(round(value * 100) AS BIGINT) - 500 AS power FROM events),
folded AS (SELECT channel, CAST(((((sample - delay) % 113) + 113) % 113 * 16) // 113 AS INTEGER) AS bin,
CAST(sum(greatest(power, 0)) AS BIGINT) AS total, count(*) FILTER (power > 0) AS hits FROM pw GROUP BY ALL)"""


def event_power(spark, root):
    return tb.table(spark, root, "events").select(
        F.col("event_id").alias("sample"), (F.pmod("user_id", F.lit(5)) * 37).alias("delay"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("channel"),
        (F.rint(F.col("value") * 100).cast("long") - 500).alias("power"))


@query(f"""WITH {EVENT_POWER} SELECT bin, CAST(sum(total) AS BIGINT) AS total, CAST(sum(hits) AS BIGINT) AS hits
FROM folded GROUP BY bin""")
def phase_fold(spark, root):
    """All channels folded together; only positive powers count."""
    return fold.fold(event_power(spark, root), [], 113, 16)


@query(f"WITH {EVENT_POWER} SELECT * FROM folded")
def phase_fold_by_channel(spark, root):
    return fold.fold(event_power(spark, root), ["channel"], 113, 16)


@query(f"""WITH {EVENT_POWER}, quiet AS (SELECT * REPLACE (CASE WHEN channel = 2 THEN -1 ELSE power END AS power) FROM pw), fine AS (
SELECT channel, CAST(((((sample - delay) % 113) + 113) % 113 * 256) // 113 AS INTEGER) AS bin, avg(power) AS profile
FROM quiet WHERE power > 0 GROUP BY ALL)
SELECT c.channel, b.bin, round(coalesce(profile, 0), 6) AS profile FROM (SELECT DISTINCT channel FROM quiet) c
CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) b
LEFT JOIN fine f ON f.channel = c.channel AND f.bin = b.bin""")
def fold_profile(spark, root):
    """Normalised profile on the full bin axis, one channel silent; more bins than phases leaves some empty."""
    quiet = event_power(spark, root).withColumn("power", F.when(F.col("channel") == 2, F.lit(-1).cast("long")).otherwise(F.col("power")))
    d = fold.normalise_fold(fold.fold(quiet, ["channel"], 113, 256), ["channel"], 256)
    return d.withColumn("profile", F.round("profile", 6))
