"""Timing, profile, benchmark and capture reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid import scale
from phasegrid.functions import numeric as N
from phasegrid.operators import reports as op
from phasegrid.sources import tables as tb
from phasegrid.workloads import query
from phasegrid.workloads.bindings import BENCH, LINE_SAMPLES, PACKETS, SAMPLES

TIMINGS = """
t AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS "max"
FROM events WHERE value > 0 GROUP BY event_type),
summary AS (SELECT event_type, n, mean, "max", v[CAST(least(n - 1, floor(0.5 * n)) AS BIGINT) + 1] AS p50,
v[CAST(least(n - 1, floor(0.9 * n)) AS BIGINT) + 1] AS p90, v[CAST(least(n - 1, floor(0.99 * n)) AS BIGINT) + 1] AS p99
FROM t)"""


def timings(spark, root):
    d = op.timing_summary(tb.table(spark, root, "events"), ["event_type"], "value", 0.01)
    return d.withColumn("mean", F.round("mean", 6))


@query(f"WITH {TIMINGS} SELECT * FROM summary")
def timing_summary(spark, root):
    return timings(spark, root)


@query(f"""WITH {TIMINGS}, c AS (SELECT event_type, 1000.0::DOUBLE / mean AS serial, 3 * 1000.0::DOUBLE / mean AS overlapped
FROM summary)
SELECT event_type, round(serial, 6) AS serial, round(overlapped, 6) AS overlapped,
CASE WHEN serial / (400000 / 8192.0::DOUBLE) >= 1.2 THEN 'OK' WHEN serial / (400000 / 8192.0::DOUBLE) >= 1 THEN 'MARGINAL'
ELSE 'TOO SLOW' END AS serial_verdict,
CASE WHEN overlapped / (400000 / 8192.0::DOUBLE) >= 1.2 THEN 'OK' WHEN overlapped / (400000 / 8192.0::DOUBLE) >= 1
THEN 'MARGINAL' ELSE 'TOO SLOW' END AS overlapped_verdict FROM c""")
def timing_capacity(spark, root):
    d = op.capacity(timings(spark, root), 8192, 3, 400000.0)
    return d.select("event_type", F.round("serial", 6).alias("serial"), F.round("overlapped", 6).alias("overlapped"),
                    "serial_verdict", "overlapped_verdict")


@query("""SELECT run, value, CAST(row_number() OVER (ORDER BY run) - 1 AS INTEGER) AS slot
FROM (SELECT event_id + event_id // 3 AS run, value FROM events ORDER BY event_id DESC LIMIT 100)""")
def last_runs(spark, root):
    """Run numbers with gaps, one after every third event: still the last hundred runs."""
    run = F.col("event_id") + N.idiv(F.col("event_id"), 3)
    return op.last_runs(tb.table(spark, root, "events").select(run.alias("run"), "value"), "run", 100)


# --- profiles -------------------------------------------------------------------------------

PROFILE = """
m AS (SELECT event_id // 5 AS launch, event_type AS metric, round(value * 100)::BIGINT AS value FROM events),
w AS (SELECT launch, 'k' || (launch * 7 % 11) AS kernel, avg(value) FILTER (metric = 'view') AS duration_us,
avg(value) FILTER (metric = 'click') AS sm_pct, avg(value) FILTER (metric = 'error') AS dram_pct,
avg(value) FILTER (metric = 'absent') AS tensor_pct FROM m GROUP BY launch),
means AS (SELECT kernel, min(launch) AS first_launch, round(avg(duration_us), 6) AS duration_us,
round(avg(sm_pct), 6) AS sm_pct, round(avg(dram_pct), 6) AS dram_pct FROM w GROUP BY kernel)"""

METRICS = {"view": "duration_us", "click": "sm_pct", "error": "dram_pct", "absent": "tensor_pct"}


def launches(spark, root):
    """Long (launch, metric, value) rows pivoted to one row per launch."""
    m = tb.table(spark, root, "events").select(
        N.idiv(F.col("event_id"), 5).alias("launch"), F.col("event_type").alias("metric"),
        F.rint(F.col("value") * 100).cast("long").alias("value"))
    d = op.profile_wide(m, ["launch"], METRICS)
    return d.withColumn("kernel", F.concat(F.lit("k"), F.pmod(F.col("launch") * 7, F.lit(11)).cast("string")))


def means(spark, root):
    d = op.kernel_means(launches(spark, root), ["duration_us", "sm_pct", "dram_pct"])
    return d.withColumns({c: F.round(c, 6) for c in ("duration_us", "sm_pct", "dram_pct")})


@query(f"WITH {PROFILE} SELECT * FROM means")
def kernel_profile(spark, root):
    return means(spark, root)


@query(f"WITH {PROFILE} SELECT * FROM means ORDER BY duration_us DESC NULLS LAST, first_launch LIMIT 6")
def top_kernels(spark, root):
    return op.top_kernels(means(spark, root), 6)


@query(f"""WITH {PROFILE} SELECT bool_or(duration_us IS NOT NULL) AS has_duration_us,
bool_or(sm_pct IS NOT NULL) AS has_sm_pct, bool_or(tensor_pct IS NOT NULL) AS has_tensor_pct FROM w""")
def metric_presence(spark, root):
    return op.metric_presence(launches(spark, root), ["duration_us", "sm_pct", "tensor_pct"])


@query(f"""WITH {PROFILE} SELECT count(DISTINCT kernel) AS kernels,
(SELECT array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') FROM supplier) AS sources FROM w""")
def distinct_names(spark, root):
    """Number of distinct kernels and the sorted list of distinct source ids."""
    ids = tb.table(spark, root, "supplier").agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_set("s_nationkey")), lambda x: x.cast("string")))).scalar()
    return launches(spark, root).agg(F.count_distinct("kernel").alias("kernels")).withColumn("sources", ids)


# --- benchmarks ----------------------------------------------------------------------------

@query(f"""WITH {BENCH} SELECT o_orderkey, 'CorrBeam' AS tag, CAST(8 * (1 + o_orderkey % 4) AS INTEGER) AS ch,
CAST(1 + o_custkey % 5 AS INTEGER) AS fpga, CAST(10 * (1 + o_custkey % 5) AS INTEGER) AS rx,
CAST(o_custkey AS DOUBLE) AS runs, CAST(round(o_totalprice * 100) AS BIGINT) / 4.0::DOUBLE AS gb,
CAST(2 AS BIGINT) AS pairs FROM orders WHERE o_orderkey % 10 <> 9""")
def benchmark_log(spark, root):
    """Result lines of a benchmark log, built from orders and parsed back."""
    key, f = F.col("o_orderkey"), 1 + F.pmod("o_custkey", F.lit(5))
    good = F.concat(F.lit("[CorrBeam ch="), (8 * (1 + F.pmod(key, F.lit(4)))).cast("string"), F.lit(" fpga="),
                    f.cast("string"), F.lit(" rx="), (f * 10).cast("string"), F.lit("] runs/sec=1.5 runs/sec="),
                    F.col("o_custkey").cast("string"), F.lit(" bad=-. GB/sec="),
                    (F.rint(F.col("o_totalprice") * 100).cast("long") / 4).cast("decimal(20,2)").cast("string"),
                    F.lit("%"))
    line = F.when(F.pmod(key, F.lit(10)) == 9, F.lit("=== corr-packet sweep")).otherwise(good)
    d = op.parse_benchmark_log(tb.table(spark, root, "orders").select("o_orderkey", line.alias("line")))
    return d.select("o_orderkey", "tag", "ch", "fpga", "rx", F.col("metrics")["runs/sec"].alias("runs"),
                    F.col("metrics")["GB/sec"].alias("gb"), F.size("metrics").cast("long").alias("pairs"))


@query(f"""WITH {BENCH}, r AS (SELECT channels, stage || '[' || fpgas || ']' AS stage, rate FROM bench)
SELECT channels, arg_min(stage, (rate, stage)) AS stage, min(rate) AS rate FROM r GROUP BY channels""")
def stage_bottleneck(spark, root):
    b = tb.order_benchmarks(spark, root).withColumn(
        "stage", F.concat("stage", F.lit("["), F.col("fpgas").cast("string"), F.lit("]")))
    return op.bottleneck(b, ["channels"], "stage", "rate")


@query(f"WITH {BENCH} SELECT channels, round(avg(rate), 4) AS mean_rate FROM bench GROUP BY channels")
def mean_rate_by_channels(spark, root):
    d = op.mean_by(tb.order_benchmarks(spark, root), ["channels"], "rate", "mean_rate")
    return d.withColumn("mean_rate", F.round("mean_rate", 4))


@query(f"""WITH {BENCH},
b AS (SELECT stage, channels, fpgas, sum(rate)::BIGINT AS rate FROM bench WHERE campaign = 'F' AND fpgas <> 5 GROUP BY ALL),
c AS (SELECT stage, channels, fpgas, sum(rate)::BIGINT AS rate FROM bench WHERE campaign = 'O' AND fpgas <> 1 GROUP BY ALL)
SELECT coalesce(b.stage, c.stage) AS stage, coalesce(b.channels, c.channels) AS channels,
coalesce(b.fpgas, c.fpgas) AS fpgas, b.rate AS base, c.rate AS current,
round((c.rate - b.rate) / b.rate, 9) + 0.0 AS change, coalesce((c.rate - b.rate) / b.rate < -0.05, false) AS regression
FROM b FULL JOIN c ON b.stage = c.stage AND b.channels = c.channels AND b.fpgas = c.fpgas""")
def benchmark_compare(spark, root):
    """Two campaigns side by side; configurations of only one of them are kept."""
    b = tb.order_benchmarks(spark, root)
    keys = ["stage", "channels", "fpgas"]
    side = lambda campaign, missing: (b.where((F.col("campaign") == campaign) & (F.col("fpgas") != missing))
                                      .groupBy(*keys).agg(F.sum("rate").alias("rate")))
    d = op.compare(side("F", 5), side("O", 1), keys, "rate")
    return d.withColumn("change", F.round("change", 9) + F.lit(0.0))


@query(f"""WITH {BENCH} SELECT DISTINCT stage, channels, fpgas FROM bench WHERE campaign = 'F'
UNION SELECT DISTINCT stage, channels, fpgas FROM bench WHERE campaign = 'P'""")
def configuration_union(spark, root):
    b, keys = tb.order_benchmarks(spark, root), ["stage", "channels", "fpgas"]
    return (b.where(F.col("campaign") == "F").select(*keys)
            .union(b.where(F.col("campaign") == "P").select(*keys)).distinct())


# --- captures -------------------------------------------------------------------------------

@query(f"""WITH {LINE_SAMPLES}, span AS (SELECT min(re)::DOUBLE AS lo, max(re)::DOUBLE AS hi FROM ls)
SELECT CAST(least(floor((re - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, count(*) AS n FROM ls, span GROUP BY 1""")
def sample_histogram(spark, root):
    """100 equal bins over the values of all samples."""
    from phasegrid.operators.ingest import last_wins
    s = last_wins(tb.lineitem_samples(spark, root), ["block", "channel", "t", "recv"], ["re", "im"])
    return op.histogram(s, [], "re", 100)


@query(f"""WITH {SAMPLES} SELECT block, channel, recv, pol,
round(sum(CAST(re * re + im * im AS DOUBLE) / (scale * scale)) / 2 / 16, 6) AS power FROM samples GROUP BY ALL""")
def channel_power(spark, root):
    d = op.channel_power(tb.embedding_samples(spark, root), ["block", "channel", "recv", "pol"], "scale", 2, 16)
    return d.withColumn("power", F.round("power", 6))


@query("""SELECT 'events' AS dataset, c.column, c.type, (SELECT count(*) FROM events) AS rows FROM (VALUES
('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'),
('props', 'string')) c("column", type)""")
def dataset_inventory(spark, root):
    return op.inventory(tb.table(spark, root, "events"), "events")


@query(f"""WITH {SAMPLES}, l AS (SELECT channel, max(block) AS block FROM samples GROUP BY channel)
SELECT s.block, s.channel, pkt, recv, t, pol, re, im FROM samples s JOIN l ON l.channel = s.channel AND l.block = s.block""")
def latest_block(spark, root):
    d = op.latest_block(tb.embedding_samples(spark, root), ["channel"])
    return d.select("block", "channel", "pkt", "recv", "t", "pol", "re", "im")


@query("""SELECT event_type, time_bucket(INTERVAL '1 second', ts) AS window_start, max(value) AS max_value
FROM events GROUP BY ALL""")
def rollup_max_second(spark, root):
    return op.rollup_max(tb.table(spark, root, "events"), ["event_type"], "ts", "value", "1 second")


@query("""SELECT event_type, make_timestamp((epoch_us(ts) // 100000) * 100000) AS window_start, max(value) AS max_value
FROM events GROUP BY ALL""")
def rollup_max_tenth(spark, root):
    return op.rollup_max(tb.table(spark, root, "events"), ["event_type"], "ts", "value", "100 milliseconds")


@query("""SELECT event_id, ts, value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '60 seconds' * 1440""")
def retention(spark, root):
    """Rows of the retention period that ends at the newest row (one day here)."""
    e = tb.table(spark, root, "events").select("event_id", "ts", "value")
    newest = e.select(F.max("ts")).scalar()
    return e.where(F.col("ts") > newest - F.expr("INTERVAL '1' DAY"))


@query("""SELECT slot, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM (
SELECT event_id, (event_id // 64) % 3 AS slot, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 24 AS channel
FROM events) WHERE channel // 8 = slot GROUP BY slot""")
def round_robin_channels(spark, root):
    """24 channels, 8 of them written per block in turn."""
    k = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(24))
    slot = F.pmod(N.idiv(F.col("event_id"), 64), F.lit(3))
    d = tb.table(spark, root, "events").select("event_id", slot.alias("slot"), k.alias("channel"))
    return (d.where(N.idiv(F.col("channel"), 8) == F.col("slot")).groupBy("slot")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids")))


@query("""SELECT 0 AS part, event_id AS segment, value FROM events WHERE event_type = 'click'
QUALIFY row_number() OVER (ORDER BY event_id) <= 60
UNION ALL SELECT 1, event_id, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (ORDER BY event_id) <= 60""")
def concatenate_captures(spark, root):
    """First 60 time segments of each capture, joined on the time axis (60 is the feature)."""
    e = tb.table(spark, root, "events")
    head = lambda n, kind: (e.where(F.col("event_type") == kind).orderBy("event_id").limit(60)
                            .select(F.lit(n).alias("part"), F.col("event_id").alias("segment"), "value"))
    return scale.union_all([head(0, "click"), head(1, "view")])


@query(f"""WITH {PACKETS} SELECT arrival, sample_count FROM packets ORDER BY sample_count, arrival LIMIT 200""")
def capture_preview(spark, root):
    """The preview of a capture: the first 200 packets by counter."""
    d = tb.event_packets(spark, root).select("arrival", "sample_count")
    return d.orderBy("sample_count", "arrival").limit(200)
