"""Structured Streaming over the given tables, run until all input is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.operators import adaptive as eig
from phasegrid.session import materialize, scratch_path
from phasegrid.sinks import products
from phasegrid.sinks.series import SeriesStore
from phasegrid.sources import tables as tb
from phasegrid.streaming import rollup
from phasegrid.streaming.assembler import BlockAssembler, missing_in
from phasegrid.plans import jobs
from phasegrid.plans.blocks import SEQUENCE, Calibration
from phasegrid.workloads import query
from phasegrid.workloads.adaptive import calibration
from phasegrid.workloads.bindings import ARRIVED, PACKETS, SAMPLES, VIS
from phasegrid.workloads.signal import CFG, WEIGHTS, packed

EVENTS = tb.EVENT_CFG


def event_stream(spark, root):
    """``events`` as a stream of one file per trigger."""
    schema = tb.table(spark, root, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
            .option("maxFilesPerTrigger", 1).parquet(root))


def assembled(spark, root):
    base = scratch_path(spark, "assembler")
    assembler = BlockAssembler(EVENTS, f"{base}/out", ["value"])
    rollup.run_batches(tb.packets_of_events(event_stream(spark, root)), assembler, f"{base}/checkpoint", end=True)
    return assembler


@query(f"WITH {ARRIVED} SELECT * FROM arrived")
def stream_blocks(spark, root):
    """Blocks completed by per-stream progress, then those the end of the stream completes; last copy of each packet."""
    return assembled(spark, root).blocks(spark)


@query(f"""WITH {ARRIVED} SELECT block, 128 - count(*) AS missing FROM arrived WHERE pkt BETWEEN 0 AND 15 GROUP BY block""")
def stream_missing(spark, root):
    return missing_in(assembled(spark, root).blocks(spark), EVENTS)


@query("""SELECT * FROM (SELECT event_type, time_bucket(INTERVAL '1 second', ts) AS window_start, max(value) AS max_value
FROM events GROUP BY 1, 2) WHERE epoch_ms(window_start) + 1000 <= (SELECT epoch_ms(max(ts)) FROM events) - 10000""")
def stream_rollup_max(spark, root):
    """One-second maxima, emitted behind a ten second watermark."""
    s = event_stream(spark, root).withColumn("ts", F.col("ts").cast("timestamp"))
    s = rollup.rollup_max(s, ["event_type"], "ts", "value", "1 second", "10 seconds")
    base = scratch_path(spark, "rollup")
    d = rollup.run_to_table(s, f"{base}/out", f"{base}/checkpoint")
    return d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""WITH {PACKETS} SELECT fpga_id, freq_channel, count(*) AS packets, max(sample_count) AS latest FROM packets
GROUP BY ALL""")
def stream_counters(spark, root):
    base = scratch_path(spark, "counters")
    counts = rollup.RunningCounts(["fpga_id", "freq_channel"], f"{base}/out")
    rollup.run_batches(tb.packets_of_events(event_stream(spark, root)), counts, f"{base}/checkpoint")
    return counts.totals(spark)


@query(f"""WITH {VIS} SELECT block // 2 AS integration, channel, i, j, p, q, sum(re) AS re, sum(im) AS im FROM vis GROUP BY ALL""")
def stream_visibilities(spark, root):
    """Stored packets streamed through assembly and integration, the last short integration included."""
    base = scratch_path(spark, "stream-vis")
    tb.embedding_packets(spark, root).write.parquet(f"{base}/packets")
    packets = spark.readStream.schema(spark.read.parquet(f"{base}/packets").schema).parquet(f"{base}/packets")
    sums = rollup.Integrator(CFG, Calibration(), f"{base}/vis")
    assembler = BlockAssembler(CFG, f"{base}/out", ["payload"], on_blocks=sums)
    rollup.run_batches(packets, assembler, f"{base}/checkpoint", end=True)
    return sums.integrations(spark)


# --- sinks ---------------------------------------------------------------------------------

@query(f"""WITH {VIS}, acc AS (SELECT block // 2 AS integration, channel, i, j, p, q, sum(re) AS re, sum(im) AS im
FROM vis GROUP BY ALL) SELECT *, i AS ant_i, j AS ant_j, CAST(256 * i + j AS INTEGER) AS baseline_id, 0 AS zeroed FROM acc""")
def visibility_product(spark, root):
    """Visibilities written as a product and read back with receiver identities."""
    out = scratch_path(spark, "products")
    d = jobs.observe(tb.embedding_packets(spark, root), CFG, Calibration())["visibilities"].drop(*SEQUENCE)
    products.write_product(d, out, "visibilities")
    return products.read_visibilities(spark, out)


@query(f"""WITH {SAMPLES} SELECT DISTINCT 'ts:fft:ch:' || channel || ':p:' || pol || ':b:' || b.b || ':f:' || ((k.k + 6) % 12) AS key,
block FROM samples, (SELECT unnest(range(4)) AS b) b, (SELECT unnest(range(12)) AS k) k""")
def spectrum_series(spark, root):
    """Keys and blocks of the spectrum time series."""
    d = jobs.adaptive_spectra(tb.embedding_packets(spark, root), CFG, calibration(), trim=2, only=["spectra"])["spectra"].drop(*SEQUENCE)
    return products.spectrum_series(d, 12).select("key", "block")


@query(f"""WITH {WEIGHTS}, spec AS (
  SELECT block, channel, pol, beam, pkt, k,
         sum(re * cos(2 * pi() * ((k * t) % 16) / 16) + im * sin(2 * pi() * ((k * t) % 16) / 16)) AS re,
         sum(im * cos(2 * pi() * ((k * t) % 16) / 16) - re * sin(2 * pi() * ((k * t) % 16) / 16)) AS im
  FROM beams, (SELECT CAST(unnest(range(16)) AS INTEGER) AS k) GROUP BY ALL),
v AS (SELECT block, channel, pol, beam, (k + 8) % 16 - 2 AS bin, round(sum(sqrt(re * re + im * im)), 4) AS value
  FROM spec WHERE (k + 8) % 16 BETWEEN 2 AND 13 GROUP BY ALL)
SELECT 'ts:fft:ch:' || channel || ':p:' || pol || ':b:' || beam || ':f:' || ((bin + 6) % 12) AS key, block, value FROM v""")
def spectrum_store(spark, root):
    """Spectrum points added in three batches that correct each other, compacted in between, and read back."""
    d = jobs.adaptive_spectra(tb.embedding_packets(spark, root), CFG, calibration(), trim=2, only=["spectra"])["spectra"].where("beam < 2")
    points = materialize(products.spectrum_series(d.drop(*SEQUENCE), 12).withColumn("value", F.round("value", 4)), "spectrum-points")
    store = SeriesStore(scratch_path(spark, "series"))
    store.upsert(points.withColumn("value", F.lit(-1.0)), 0)
    store.upsert(points.where("block % 2 = 0"), 1)
    store.compact(spark, 1)
    store.upsert(points.where("block % 2 = 1"), 2)
    return store.read(spark)


@query(f"""WITH {SAMPLES} SELECT DISTINCT 'ts:eig:ch:' || channel || ':p:' || p.p || ':q:' || q.q || ':k:' || k.k AS key, block
FROM samples, (SELECT unnest(range(2)) AS p) p, (SELECT unnest(range(2)) AS q) q, (SELECT unnest(range(8)) AS k) k
WHERE channel = block % 2""")
def eigen_series(spark, root):
    """Round-robin eigenvalue series: one of two channels per block."""
    return products.eigen_series(eig.eigen(packed(spark, root), CFG), 1, 2).select("key", "block")
