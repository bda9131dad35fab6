"""Writing and reading products: parquet folders, metadata, manifest, mapping CSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.functions import numeric as N, text
from phasegrid.operators import wiring

# Partition column of each product: readers prune by it, writers create one folder per value.
PARTITION = {"visibilities": "channel", "beams": "channel", "spectra": "channel", "eigen": "channel",
             "arrivals": "channel", "projection": "channel"}


def write_product(df: DataFrame, root: str, product: str, mode: str = "append") -> str:
    """Write one product below ``root``; rows of a partition folder are written together."""
    path, part = f"{root}/{product}", PARTITION.get(product)
    if part and part in df.columns:
        df.write.mode(mode).partitionBy(part).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def write_batch(df: DataFrame, root: str, product: str, batch_id: int) -> None:
    """Write one micro-batch of a product; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{root}/{product}/batch={batch_id}")


def read_product(spark: SparkSession, root: str, product: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{product}")


def read_visibilities(spark: SparkSession, root: str) -> DataFrame:
    """Visibilities with identities; without a baseline table receivers stand for antennas."""
    vis = read_product(spark, root, "visibilities")
    if not path_exists(spark, f"{root}/baselines"):      # an old product folder without the table
        return vis.withColumns({"ant_i": F.col("i"), "ant_j": F.col("j"), "baseline_id": N.baseline_id("i", "j"), "zeroed": F.lit(0)})
    base = read_product(spark, root, "baselines").select("i", "j", "ant_i", "ant_j", "baseline_id", "zeroed")
    return vis.join(base, ["i", "j"], "left")


def write_baselines(receivers: DataFrame, root: str) -> str:
    return write_product(wiring.baseline_table(receivers), root, "baselines", "overwrite")


def fan_out(df: DataFrame, writers: list[Callable[[DataFrame], None] | None]) -> int:
    """Hand one result to several writers; ``None`` entries are skipped.

    The result is computed once.
    """
    active = [w for w in writers if w is not None]
    if len(active) > 4:
        raise ValueError("at most four writers")
    kept = df.persist() if len(active) > 1 else df
    try:
        for write in active:
            write(kept)
    finally:
        if kept is not df or len(active) > 1:
            kept.unpersist()
    return len(active)


def header_row(spark: SparkSession, cfg: ArrayConfig, **values: str) -> DataFrame:
    """Header of a beam stream: shape and free text values as one row."""
    shape = {k: str(getattr(cfg, k)) for k in ("channels", "receivers", "pols", "beams", "block_samples", "min_channel")}
    return spark.createDataFrame([({**shape, **values},)], "header map<string, string>")


def channel_range(df: DataFrame, min_channel: int, start_mjd: float) -> DataFrame:
    """Attributes of a spectrum product: start date and absolute channel range."""
    return df.agg((F.min("channel") + min_channel).alias("min_channel"),
                  (F.max("channel") + min_channel).alias("max_channel"), F.lit(start_mjd).alias("mjd"))


def write_stream_mapping(mapping: DataFrame, path: str) -> None:
    """The 13 column stream mapping as CSV with a header."""
    columns = [c for c in mapping.columns if c != "run"]
    mapping.orderBy("run", "global_datastream_id").select(*columns).write.mode("overwrite").csv(path, header=True)


def run_manifest(spark: SparkSession, files: dict[str, str], facts: dict[str, dict], wired: DataFrame,
                 cfg: ArrayConfig) -> DataFrame:
    """Manifest of each run as one JSON document with both mapping tables.

    ``files`` are configuration files to embed; a missing one is recorded as such.
    A run has a bounded number of streams, so its rows fit one document.
    """
    rows = []
    for name, path in files.items():
        found = spark.read.text(path, wholetext=True).first() if path and path_exists(spark, path) else None
        rows.append((name, path, found is not None, found["value"] if found else ""))
    inputs = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.struct(
        F.lit(p).alias("path"), F.lit(ok).alias("present"), F.lit(c).alias("content"))) for n, p, ok, c in rows]))
    fact_columns = [F.to_json(F.lit(None)).alias(k) if not v else F.create_map(
        *[F.lit(str(x)) for kv in v.items() for x in kv]).alias(k) for k, v in facts.items()]
    collect = lambda t, order: t.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(
        order, *[c for c in t.columns if c not in ("run", order)]))).alias("rows"))
    forward = collect(wiring.forward_table(wired, cfg), "global_datastream_id").withColumnRenamed("rows", "forward")
    reverse = collect(wiring.reverse_table(wired, cfg), "canonical_receiver_index").withColumnRenamed("rows", "reverse")
    doc = F.struct(F.lit(1).alias("schema_version"), *fact_columns, inputs.alias("input_files"),
                   F.col("forward").alias("forward_mapping"), F.col("reverse").alias("reverse_mapping"))
    return forward.join(reverse, "run").select("run", F.to_json(doc).alias("manifest"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# --- time series kept by key -------------------------------------------------------------

def eigen_series(eigen: DataFrame, channels_per_write: int, channels: int, block: str = "block") -> DataFrame:
    """Eigenvalue points by key; each block only contributes the channels of its turn."""
    slots = -(-channels // channels_per_write)
    turn = N.idiv(F.col("channel"), channels_per_write) == F.pmod(block, F.lit(slots))
    d = eigen.where(turn).select(block, "channel", "p", "q", F.posexplode("eigvals").alias("mode", "value"))
    key = F.concat(F.lit("ts:eig:ch:"), F.col("channel").cast("string"), F.lit(":p:"), F.col("p").cast("string"),
                   F.lit(":q:"), F.col("q").cast("string"), F.lit(":k:"), F.col("mode").cast("string"))
    return d.select(key.alias("key"), block, "value")


def spectrum_series(spectra: DataFrame, bins: int, prefix: str = "ts:fft") -> DataFrame:
    """Spectrum points by key, the frequency index shifted to the band centre."""
    key = text.series_key(F.lit(prefix), "channel", "pol", "beam", N.fft_shift_index("bin", bins))
    keep = [c for c in spectra.columns if c not in ("channel", "pol", "beam", "bin")]
    return spectra.select(key.alias("key"), *keep)


def expire(series: DataFrame, ts: str, seconds: int, now: Column) -> DataFrame:
    """Raw points within the retention period."""
    return series.where(F.col(ts) > now - F.make_interval(secs=F.lit(seconds)))


def timing_rows(spark: SparkSession, timings: list[float], keep: int = 100) -> DataFrame:
    """Index and time of the last runs, as the timing CSV holds them."""
    last = timings[-keep:]
    return spark.createDataFrame(list(enumerate(map(float, last))), "index int, time double")


