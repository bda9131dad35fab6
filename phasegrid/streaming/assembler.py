"""Continuous block assembly as a micro-batch job.

Every micro-batch merges the new packets with the packets of blocks that are
still open, decides which blocks are complete, emits those and keeps the rest.
The decision needs one number per (channel, source): how far that stream has
come.  That table is bounded by the array, while packets are only filtered,
joined and aggregated by Spark, whatever their distribution over blocks.

State and output of batch ``n`` are folders named after ``n`` and depend only on
the state of ``n - 1`` and the batch, so a repeated batch replaces itself.  The end of
a stream is such a step as well: :meth:`BlockAssembler.finish` writes what is still open
in the place of the batch that would come next.  Done again it replaces itself, and if
the stream goes on after all, the next batch replaces it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from phasegrid.config import ArrayConfig
from phasegrid.functions.numeric import floor_div
from phasegrid.operators import ingest

META = ("start long, next_block long, stalled_ms long, received long, discarded_channel long, "
        "discarded_old long, deferred long, emitted_blocks long, final boolean, "
        "marks array<struct<channel: int, source: int, mark: long>>")


class BlockAssembler:
    """``foreachBatch`` function: packets in, complete blocks out.

    A block is complete when every (channel, source) has come half a packet past
    its last packet.  Packets more than ``horizon`` blocks ahead are held back and
    do not count as progress.  When held packets make no progress for
    ``stall_ms``, their streams are taken to have jumped and the holes are left
    missing.  Discards are judged against the blocks emitted before the batch.
    """

    def __init__(self, cfg: ArrayConfig, root: str, values: list[str], horizon: int = 24, stall_ms: int = 100,
                 on_blocks: Callable[[DataFrame, int], None] | None = None,
                 clock: Callable[[], float] = time.time):
        self.cfg, self.root, self.values = cfg, root.rstrip("/"), values
        self.horizon, self.stall_ms, self.on_blocks, self.clock = horizon, stall_ms, on_blocks, clock

    # --- state ------------------------------------------------------------------

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch={batch_id}"

    def _load(self, spark: SparkSession, batch_id: int):
        """State left by the previous batch, or None at the start of the stream."""
        if batch_id == 0:
            return None
        meta = spark.read.schema(META).parquet(self._folder("meta", batch_id - 1)).first()
        if meta["start"] is None:
            return None
        marks = {(m["channel"], m["source"]): m["mark"] for m in meta["marks"]}
        return meta, marks, spark.read.parquet(self._folder("open", batch_id - 1))

    # --- progress ---------------------------------------------------------------

    def _done(self, position):
        """Blocks passed at a position: half a packet beyond their last packet."""
        cfg = self.cfg
        return (position + cfg.step - cfg.step // 2, cfg.packets * cfg.step)

    def _completed(self, marks: dict) -> int:
        """Number of blocks, from the first one, that every stream has passed."""
        if len(marks) < self.cfg.channels * self.cfg.fpgas:
            return 0
        top, size = self._done(min(marks.values()))
        return max(top // size, 0)

    def _reach(self, progress: DataFrame, marks: dict, next_block: int) -> int:
        """Block up to which every stream runs without a jump beyond the horizon.

        A stream stops at its end, or before a packet that lies a horizon or more
        ahead of what the stream has completed.  The slowest stream decides.
        ``progress`` has one row per (channel, source, block).
        """
        cfg = self.cfg
        size = cfg.packets * cfg.step
        origin = next_block * size - cfg.step
        known = [(c, s, m // size, m) for (c, s), m in
                 {(c, s): max(marks.get((c, s), origin), origin)
                  for c in range(cfg.channels) for s in range(cfg.fpgas)}.items()]
        rows = progress.select("channel", "source", "block", "position").unionByName(
            progress.sparkSession.createDataFrame(known, "channel int, source int, block long, position long"))
        rows = rows.groupBy("channel", "source", "block").agg(F.max("position").alias("position"))
        top, size = self._done(F.col("position"))
        rows = rows.withColumn("done", floor_div(top, size))
        after = F.lead("block").over(W.partitionBy("channel", "source").orderBy("block"))
        rows = rows.withColumn("stops", after.isNull() | (after >= F.col("done") + self.horizon))
        stops = rows.where("stops").groupBy("channel", "source").agg(F.min("done").alias("stop"))
        slowest = stops.agg(F.min("stop")).first()[0]
        return max(next_block, slowest)

    def _split(self, progress: DataFrame, limit: int) -> tuple[dict, dict, int]:
        """Furthest position per stream before and beyond ``limit``, and packets held back."""
        ahead = F.col("block") >= limit
        per = progress.groupBy("channel", "source").agg(
            F.max(F.when(~ahead, F.col("position"))).alias("near"),
            F.max(F.when(ahead, F.col("position"))).alias("far"),
            F.sum(F.when(ahead, F.col("n")).otherwise(0)).alias("held")).collect()   # bounded by the array
        pick = lambda name: {(r["channel"], r["source"]): r[name] for r in per if r[name] is not None}
        return pick("near"), pick("far"), sum(r["held"] for r in per)

    def _advance(self, pending: DataFrame, marks: dict, next_block: int,
                 stalled_ms: int | None) -> tuple[dict, int, int | None, int]:
        """Admit packets up to the horizon until nothing more completes."""
        now = int(self.clock() * 1000)
        block = floor_div("index", self.cfg.packets)
        progress = (pending.groupBy("channel", "source", block.alias("block"))
                    .agg(F.max("position").alias("position"), F.count(F.lit(1)).alias("n")).persist())
        try:
            while True:
                reached = self._reach(progress, marks, next_block)
                if reached > next_block:
                    stalled_ms = None
                next_block = reached
                near, far, held = self._split(progress, next_block + self.horizon)
                _raise(marks, near)
                if not held:
                    return marks, next_block, None, 0
                if stalled_ms is None:
                    stalled_ms = now
                if now - stalled_ms < self.stall_ms:
                    return marks, next_block, stalled_ms, held
                _raise(marks, far)
                if self._completed(marks) <= next_block:
                    return marks, next_block, stalled_ms, held
                next_block = self._completed(marks)
        finally:
            progress.unpersist()

    # --- one micro-batch -----------------------------------------------------------

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()     # counted, judged, emitted and kept: read once from its source
        try:
            self._step(batch, batch_id)
        finally:
            batch.unpersist()

    def _step(self, batch: DataFrame, batch_id: int) -> None:
        spark, cfg = batch.sparkSession, self.cfg
        accepted = ingest.channel_window(batch, cfg).withColumn("source", ingest.source_index(cfg))
        state = self._load(spark, batch_id)
        if state is None:
            start = accepted.select(F.min_by(F.col("sample_count") - ingest.packet_delay(cfg), "arrival")).first()[0]
            marks, opened, next_block, stalled = {}, None, 0, None
        else:
            meta, marks, opened = state
            start, next_block, stalled = meta["start"], meta["next_block"], meta["stalled_ms"]
        inside = F.col("freq_channel").between(cfg.min_channel, cfg.min_channel + cfg.channels - 1)
        position = F.col("sample_count") - ingest.packet_delay(cfg) - F.lit(start).cast("long")
        too_old = floor_div(position, cfg.step) < next_block * cfg.packets - 1
        counts = batch.agg(F.count(F.lit(1)).alias("received"), F.count_if(~inside).alias("other"),
                           F.count_if(inside & too_old).alias("old")).first()
        if start is None:   # nothing accepted yet
            self._save(spark, batch_id, None, {}, (None, 0, None, counts["received"], counts["other"], 0, 0, 0))
            return
        columns = ["index", "position", "channel", "source", "arrival", *self.values]
        fresh = ingest.packet_index(accepted, cfg, F.lit(start)).withColumn("position", position).select(*columns)
        pending = fresh.where(F.col("index") >= next_block * cfg.packets - 1)
        if opened is not None:
            pending = pending.unionByName(opened.select(*columns))
        first = next_block
        marks, next_block, stalled, held = self._advance(pending, marks, next_block, stalled)
        limit = (next_block + self.horizon) * cfg.packets - 1
        self._emit(self._blocks(pending.where(F.col("index") <= limit), first, next_block), batch_id)
        keep = pending.where(F.col("index") >= next_block * cfg.packets - 1)
        self._save(spark, batch_id, keep, marks, (
            start, next_block, stalled, counts["received"], counts["other"], counts["old"], held, next_block - first))

    def _blocks(self, packets: DataFrame, first: int, last: int | None) -> DataFrame:
        members = ingest.block_members(packets, self.cfg).where(F.col("block") >= first)
        if last is not None:
            members = members.where(F.col("block") < last)
        return ingest.last_wins(members, ["block", "channel", "source", "pkt"], self.values)

    def _emit(self, blocks: DataFrame, batch_id: int) -> None:
        path = self._folder("blocks", batch_id)
        blocks.write.mode("overwrite").parquet(path)
        if self.on_blocks is not None:
            self.on_blocks(blocks.sparkSession.read.schema(blocks.schema).parquet(path), batch_id)

    def _save(self, spark, batch_id, keep, marks, meta, final: bool = False) -> None:
        if keep is not None:
            keep.write.mode("overwrite").parquet(self._folder("open", batch_id))
        rows = [(c, s, m) for (c, s), m in marks.items()]
        spark.createDataFrame([(*meta, final, rows)], META).coalesce(1).write.mode("overwrite").parquet(
            self._folder("meta", batch_id))

    def finish(self, spark: SparkSession) -> DataFrame:
        """End of stream: emit all blocks in progress, gaps and held packets included, and return them.

        The step is written as the batch after the last one.
        """
        last = self._all_meta(spark).where("not final").agg(F.max("batch")).first()[0]
        state = None if last is None else self._load(spark, last + 1)
        if state is None:
            raise RuntimeError("the stream has not accepted a packet")
        meta, marks, opened = state
        blocks = self._blocks(opened, meta["next_block"], None)
        self._emit(blocks, last + 1)
        done = spark.read.schema(blocks.schema).parquet(self._folder("blocks", last + 1))
        emitted, end = done.agg(F.count_distinct("block"), F.max("block")).first()
        after = meta["next_block"] if end is None else end + 1
        self._save(spark, last + 1, opened.limit(0), marks, (meta["start"], after, None, 0, 0, 0, 0, emitted), final=True)
        return done

    # --- results -------------------------------------------------------------------

    def blocks(self, spark: SparkSession) -> DataFrame:
        """All blocks emitted so far."""
        return spark.read.parquet(f"{self.root}/blocks").drop("batch")

    def counters(self, spark: SparkSession) -> DataFrame:
        """Counter row of every micro-batch; the end of the stream counts no packets."""
        return self._all_meta(spark).where("not final").drop("marks", "final")

    def _all_meta(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(META + ", batch long").parquet(f"{self.root}/meta")


def _raise(marks: dict, seen: dict) -> None:
    for key, mark in seen.items():
        marks[key] = max(marks.get(key, mark), mark)


def missing_in(blocks: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Missing packets of each emitted block that has packets of its own (halo not counted)."""
    own = F.count_if(F.col("pkt").between(0, cfg.packets - 1))
    return blocks.groupBy("block").agg((F.lit(cfg.packets_per_block) - own).alias("missing")).where(
        F.col("missing") < cfg.packets_per_block)


def native_progress(packets: DataFrame, cfg: ArrayConfig, start: int, delay: str = "10 seconds") -> DataFrame:
    """Packets per block closed by Spark's own event-time watermark on ``ts``.

    Lighter than the assembler where exact per-stream completion is not needed.
    """
    d = ingest.packet_index(ingest.channel_window(packets, cfg), cfg, F.lit(start))
    d = d.withColumn("block", floor_div("index", cfg.packets))
    return (d.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"), "block", "channel")
            .agg(F.count(F.lit(1)).alias("packets")))
