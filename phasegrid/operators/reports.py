"""Summaries of timings, profiles, benchmarks and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from phasegrid import scale
from phasegrid.functions import numeric as N
from phasegrid.functions import text


# --- timings ------------------------------------------------------------------

def nearest_rank(values: DataFrame, keys: list[str], value: str, quantiles: list[float],
                 resolution: float) -> DataFrame:
    """Sorted value at position int(q * n) for each quantile (not interpolated)."""
    hist = scale.histogram_positions(values, keys, value, resolution)
    total = hist.groupBy(*keys).agg(F.sum("hits").alias("n"))
    wanted = total.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles]))).withColumn(
        "at", F.least(F.col("n") - 1, F.floor(F.col("q") * F.col("n"))))
    # each key has len(quantiles) positions, so they travel as one small array
    per = wanted.groupBy(*keys).agg(F.collect_list(F.struct("q", "at")).alias("w"))
    hits = F.filter("w", lambda x: (x["at"] >= F.col("smaller"))
                    & (x["at"] < F.col("smaller") + F.col("hits")))
    joined = hist.join(scale.broadcast_if_small(per, 100_000), keys) if keys else hist.withColumn("w", per.select("w").scalar())
    return (joined.select(*keys, value, F.explode(hits).alias("x"))
            .select(*keys, F.col("x.q").alias("q"), F.col(value)))


def timing_summary(runs: DataFrame, keys: list[str], time: str, resolution: float) -> DataFrame:
    """Count, mean, max and nearest-rank p50, p90, p99 of positive timings."""
    good = runs.where(F.col(time) > 0)
    basic = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(time).alias("mean"),
                                    F.max(time).alias("max"))
    ranks = nearest_rank(good, keys, time, [0.5, 0.9, 0.99], resolution)
    at = lambda q: F.max(F.when(F.col("q") == q, F.col(time)))
    ranks = ranks.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    return basic.join(ranks, keys)


# A rate is labelled by the largest share of the needed rate that it reaches.
GRADES = [(1.2, "OK"), (1.0, "MARGINAL"), (0.0, "TOO SLOW")]


def graded(rate, needed: float):
    """Label of a rate from the table of grades."""
    shares = F.filter(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(g).alias("grade")) for s, g in GRADES]),
                      lambda row: F.col(rate) >= row["share"] * needed)
    return shares[0]["grade"]


def capacity(summary: DataFrame, packets_per_buffer: int, buffers: int, target: float) -> DataFrame:
    """Rates that a mean run time (ms) allows, one buffer after the other or all at once, and their grades.

    A rate counts buffers per second; ``target`` is a packet rate.
    """
    rates = summary.selectExpr("*", "1000D / mean AS serial", f"1000D / mean * {buffers} AS overlapped")
    needed = target / packets_per_buffer
    return rates.select("*", *[graded(rate, needed).alias(f"{rate}_verdict") for rate in ("serial", "overlapped")])


def last_runs(runs: DataFrame, order: str, keep: int = 100) -> DataFrame:
    """The last ``keep`` runs, whatever gaps their numbers have.

    ``slot`` counts them from the oldest kept.  Only ``keep`` rows reach the final sort.
    """
    kept = runs.orderBy(F.col(order).desc()).limit(keep)
    return kept.withColumn("slot", (F.row_number().over(W.orderBy(order)) - 1).cast("int"))


# --- profiles -----------------------------------------------------------------

def profile_wide(metrics: DataFrame, ids: list[str], names: dict[str, str]) -> DataFrame:
    """Long (id, metric, value) rows to one row per launch, averaging repeats."""
    return metrics.groupBy(*ids).agg(*[
        F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in names.items()])


def kernel_means(launches: DataFrame, columns: list[str], first: str = "launch") -> DataFrame:
    """Mean of every metric per kernel, with the position of the first launch."""
    return launches.groupBy("kernel").agg(
        F.min(first).alias("first_launch"), *[F.avg(c).alias(c) for c in columns])


def top_kernels(means: DataFrame, n: int, by: str = "duration_us") -> DataFrame:
    """The n slowest kernels, in order of first occurrence."""
    return means.orderBy(F.col(by).desc_nulls_last(), "first_launch").limit(n).orderBy("first_launch")


def metric_presence(launches: DataFrame, columns: list[str]) -> DataFrame:
    """Which metrics carry any data."""
    return launches.agg(*[F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in columns])


# --- benchmarks ------------------------------------------------------------------

def parse_benchmark_log(lines: DataFrame) -> DataFrame:
    """Tagged result lines: tag, ch, fpga, rx and the map of their numbers.

    Such a line begins with a bracket that names its tag and then its three dimensions as
    key=value pairs; the numbers follow the bracket, also as pairs.
    """
    keep = [c for c in lines.columns if c != "line"]
    head = F.substring_index(F.substring(F.col("line"), F.lit(2), F.length("line")), "]", 1)
    rest = F.substring(F.col("line"), F.length("head") + 3, F.length("line"))
    d = (lines.where(F.col("line").startswith("[") & F.col("line").contains("]"))
         .withColumn("head", head).withColumn("rest", rest).where(F.length("rest") > 0))
    d = d.withColumn("dims", text.key_values("head"))
    for name in ("ch", "fpga", "rx"):
        d = d.where(F.map_contains_key("dims", name))
    tag = F.trim(F.regexp_replace("head", "(?:^| )[^ ]*=[^ ]*", ""))
    dims = [F.col("dims")[k].cast("int").alias(k) for k in ("ch", "fpga", "rx")]
    return d.where(F.length(tag) > 1).select(*keep, tag.alias("tag"), *dims, text.key_values("rest").alias("metrics"))


def bottleneck(results: DataFrame, keys: list[str], label: str, rate: str) -> DataFrame:
    """Stage with the lowest rate."""
    return results.groupBy(*keys).agg(
        F.min_by(label, F.struct(rate, label)).alias(label), F.min(rate).alias(rate))


def mean_by(results: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(value).alias(out))


def compare(base: DataFrame, current: DataFrame, keys: list[str], value: str,
            threshold: float = 0.05) -> DataFrame:
    """Baseline against current by configuration, both sides kept, drops flagged."""
    b = base.select(*keys, F.col(value).alias("base"))
    c = current.select(*keys, F.col(value).alias("current"))
    d = b.join(c, keys, "full_outer").withColumn("change", N.relative_change("base", "current"))
    return d.withColumn("regression", N.is_regression("change", threshold))


# --- captures and samples -----------------------------------------------------------

def histogram(samples: DataFrame, keys: list[str], value: str, bins: int = 100) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and largest value.

    The last bin includes the maximum.  Values are counted before the range is
    joined, so the data is read once for the counts and once for the range.
    """
    span = samples.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    d = counts.join(scale.broadcast_if_small(span, 100_000), keys) if keys else counts.select(
        "*", samples.select(F.min(value).cast("double")).scalar().alias("lo"),
        samples.select(F.max(value).cast("double")).scalar().alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return d.withColumn("bin", at).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def mean_amplitude(vis: DataFrame) -> DataFrame:
    """Mean magnitude over channels for each integration and baseline product."""
    return vis.groupBy("integration", "i", "j", "p", "q").agg(F.avg(N.magnitude("re", "im")).alias("amplitude"))


def channel_power(samples: DataFrame, keys: list[str], scale_col: str, channels: int, steps: int) -> DataFrame:
    """Sum of |x|^2 / scale^2 / channels / steps."""
    x = N.power("re", "im").cast("double") / (F.col(scale_col) * F.col(scale_col))
    return samples.groupBy(*keys).agg((F.sum(x) / channels / steps).alias("power"))


def inventory(df: DataFrame, name: str) -> DataFrame:
    """Name, type and row count of every column of a product."""
    types = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
                      for f in df.schema])
    return (df.agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(name).alias("dataset"), F.inline(types), "rows"))


def latest_block(rows: DataFrame, keys: list[str], block: str = "block") -> DataFrame:
    """Rows of the newest block of each key."""
    newest = rows.groupBy(*keys).agg(F.max(block).alias(block))
    return rows.join(scale.broadcast_if_small(newest, 100_000), keys + [block], "left_semi")


def rollup_max(rows: DataFrame, keys: list[str], ts: str, value: str, width: str) -> DataFrame:
    """Maximum per tumbling window."""
    return (rows.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.max(value).alias("max_value"))
            .select(*keys, F.col("w.start").alias("window_start"), "max_value"))
