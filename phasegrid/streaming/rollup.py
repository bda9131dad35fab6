"""Streaming rollups, integrations and the helpers that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from phasegrid.config import ArrayConfig
from phasegrid.functions.numeric import floor_div
from phasegrid.operators import correlate
from phasegrid.plans import blocks as plan
from phasegrid.plans.blocks import Calibration


def rollup_max(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, delay: str) -> DataFrame:
    """Maximum per tumbling window, emitted once the watermark has passed it."""
    return (stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width).alias("w"))
            .agg(F.max(value).alias("max_value"))
            .select(*keys, F.col("w.start").alias("window_start"), "max_value"))


def first_wins(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop later copies within the watermark (block assembly keeps the last copy instead)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available into parquet and return the table."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handler, checkpoint: str, end: bool = False) -> StreamingQuery:
    """Process everything available through a ``foreachBatch`` function.

    ``end``: nothing comes after it, so the handler's ``finish`` emits what is still open.
    """
    query = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if end:
        handler.finish(stream.sparkSession)
    return query


class Integrator:
    """Visibility sums of emitted blocks, for use as ``on_blocks`` of the assembler.

    Every batch adds partial sums per integration; reading adds them up, so an
    integration may span batches and the last one may be incomplete.
    """

    def __init__(self, cfg: ArrayConfig, cal: Calibration, root: str):
        self.cfg, self.cal, self.root = cfg, cal, root.rstrip("/")

    def __call__(self, emitted: DataFrame, batch_id: int) -> None:
        products = plan.reduce_blocks(emitted, self.cfg, self.cal)
        packed = products.select("block", "channel", F.col("vis_re").alias("re"), F.col("vis_im").alias("im"))
        sums = correlate.accumulate_packed(packed, self.cfg, self.cfg.accumulate)
        sums.write.mode("overwrite").parquet(f"{self.root}/partial/batch={batch_id}")

    def integrations(self, spark: SparkSession) -> DataFrame:
        keys = ["integration", "channel", "i", "j", "p", "q"]
        return (spark.read.parquet(f"{self.root}/partial").groupBy(*keys)
                .agg(F.sum("re").alias("re"), F.sum("im").alias("im")))


class RunningCounts:
    """Counts by key over a whole stream: one partial table per batch, added on reading."""

    def __init__(self, keys: list[str], root: str):
        self.keys, self.root = keys, root.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("packets"), F.max("sample_count").alias("latest"))
         .write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}"))

    def totals(self, spark: SparkSession) -> DataFrame:
        return (spark.read.parquet(self.root).groupBy(*self.keys)
                .agg(F.sum("packets").alias("packets"), F.max("latest").alias("latest")))


def epoch_of(column, seconds: int):
    """Whole refresh intervals since the Unix epoch."""
    return floor_div(F.unix_seconds(F.col(column).cast("timestamp")), seconds)
