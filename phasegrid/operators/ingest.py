"""Packets to blocks: filters, source lookup, window membership, duplicates, gaps.

A block is ``packets`` consecutive packets of every source.  One packet before
and one after belong to the block as well (index -1 and N), because alignment
may read across the edge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from phasegrid import scale
from phasegrid.config import ArrayConfig
from phasegrid.functions.numeric import floor_div, idiv
from phasegrid.session import materialize


def _lookup(values: dict[int, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in values.items() for x in kv]),
                        key.cast("long"))


def source_index(cfg: ArrayConfig, fpga_id: str = "fpga_id") -> Column:
    """Position of a source; an unknown id fails the job."""
    known = _lookup({f: i for i, f in enumerate(cfg.fpga_ids)}, F.col(fpga_id))
    message = F.concat(F.lit("unknown FPGA id "), F.col(fpga_id).cast("string"))
    return F.coalesce(known, F.raise_error(message).cast("long")).cast("int")


def channel_window(packets: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Packets of the configured channels, ``channel`` counted from the first one."""
    lo = cfg.min_channel
    return (packets.where(F.col("freq_channel").between(lo, lo + cfg.channels - 1))
            .withColumn("channel", (F.col("freq_channel") - lo).cast("int")))


def packet_delay(cfg: ArrayConfig, fpga_id: str = "fpga_id") -> Column:
    """Whole-packet part of the delay of a source, in samples."""
    return F.coalesce(_lookup({f: d[0] for f, d in cfg.split_delays().items()}, F.col(fpga_id)), F.lit(0))


def stream_start(packets: DataFrame, cfg: ArrayConfig) -> Column:
    """Counter of the first accepted packet, brought to a source without delay.

    "First" means arrival order; the earliest counter may arrive later.
    """
    first = packets.select((F.col("sample_count") - packet_delay(cfg)).alias("s"), "arrival")
    return first.select(F.min_by("s", "arrival")).scalar()


def packet_index(packets: DataFrame, cfg: ArrayConfig, start: Column) -> DataFrame:
    """``index`` of each packet in its source's stream; the first one is 0."""
    aligned = F.col("sample_count") - packet_delay(cfg) - start
    return packets.withColumn("index", floor_div(aligned, cfg.step))


def block_members(indexed: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """One row per block a packet belongs to, with ``pkt`` in -1..N.

    Membership follows from the index, so no range join is needed: an edge packet
    is also the halo of its neighbour.  Blocks before the stream start are dropped.
    """
    n = cfg.packets
    block, pkt = floor_div("index", n), F.pmod("index", F.lit(n)).cast("int")
    member = lambda b, k: F.struct(b.alias("block"), k.cast("int").alias("pkt"))
    members = F.array_compact(F.array(
        member(block, pkt),
        F.when(pkt == 0, member(block - 1, F.lit(n))),
        F.when(pkt == n - 1, member(block + 1, F.lit(-1)))))
    return (indexed.select("*", F.inline(members)).where(F.col("block") >= 0))


def last_wins(rows: DataFrame, keys: list[str], values: list[str], arrival: str = "arrival") -> DataFrame:
    """Keep the latest arrival per key.  Copies fold before the shuffle.

    Arrivals that are equal are ordered by their values, so one row a key is left and it
    is the same on every run.
    """
    latest = F.max_by(F.struct(*values), F.struct(F.col(arrival), *values)).alias("__v")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])


SLOT = ["block", "channel", "source", "pkt"]

#: What :func:`assemble_payloads` counts on its way, once a packet.
COUNTERS = ["received", "discarded_channel", "truncated", "discarded_old", "processed"]


def _members(packets: DataFrame, cfg: ArrayConfig, values: list[str], start: Column | None = None) -> DataFrame:
    accepted = channel_window(packets, cfg).withColumn("source", source_index(cfg))
    indexed = packet_index(accepted, cfg, stream_start(accepted, cfg) if start is None else start)
    return block_members(indexed.select("index", "channel", "source", "arrival", *values), cfg)


def assemble(packets: DataFrame, cfg: ArrayConfig, values: list[str]) -> DataFrame:
    """Filter, look up sources, assign blocks and resolve duplicates.

    Result: ``block, channel, source, pkt`` and ``values``, in one shuffle.
    """
    return last_wins(_members(packets, cfg, values), SLOT, values)


def arrived_slots(packets: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Slots for which a packet with a whole payload arrived, without the payloads."""
    start = stream_start(channel_window(packets.where(has_samples(cfg)), cfg), cfg)
    return _members(packets.where(has_samples(cfg)), cfg, [], start).select(*SLOT).distinct()


def has_samples(cfg: ArrayConfig) -> Column:
    """Whether a payload holds all scales and samples; jobs skip and count the others."""
    return F.coalesce(F.length("payload") >= cfg.scale_bytes + cfg.sample_bytes, F.lit(False))


def usable_payloads(packets: DataFrame, cfg: ArrayConfig) -> tuple[DataFrame, DataFrame]:
    """Packets whose payload holds all scales and samples, and the truncated ones, which jobs skip."""
    return packets.where(has_samples(cfg)), packets.where(~has_samples(cfg))


def usable_start(packets: DataFrame, cfg: ArrayConfig) -> Column:
    """:func:`stream_start` of the packets that jobs use."""
    return stream_start(channel_window(packets.where(has_samples(cfg)), cfg), cfg)


def assemble_payloads(packets: DataFrame, cfg: ArrayConfig, start: Column | None = None,
                      seen: Observation | None = None) -> DataFrame:
    """The same for binary payloads: the rule is the same, whatever number of copies there is.

    Copies fold inside each input task, so a flood of them is one row a task and slot.
    Rows then move once: they are dealt by block and channel, which is also how the next
    step groups them and which keeps all copies of a slot together.  ``seen`` receives
    COUNTERS in the same pass.
    """
    start = usable_start(packets, cfg) if start is None else start
    lo = cfg.min_channel
    inside, whole = F.col("freq_channel").between(lo, lo + cfg.channels - 1), has_samples(cfg)
    tagged = packets.withColumn("__inside", F.coalesce(inside, F.lit(False))).withColumn("__whole", whole)
    tagged = packet_index(tagged, cfg, start)
    good = F.col("__inside") & F.col("__whole")
    if seen is not None:
        old = good & (F.col("index") < -1)
        counts = [F.count(F.lit(1)), F.count_if(~F.col("__inside")), F.count_if(F.col("__inside") & ~F.col("__whole")),
                  F.count_if(old), F.count_if(good & ~old)]
        tagged = tagged.observe(seen, *[c.alias(n) for n, c in zip(COUNTERS, counts, strict=True)])
    accepted = channel_window(tagged.where(good), cfg).withColumn("source", source_index(cfg))
    members = block_members(accepted.select("index", "channel", "source", "arrival", "payload"), cfg)
    dealt = last_of_task(members).repartition("block", "channel")
    return last_wins(dealt, SLOT, ["payload"]).select(*SLOT, "payload")


def last_of_task(members: DataFrame) -> DataFrame:
    """Members without those that a later arrival of the same input batch replaces."""
    def run(batches):
        for batch in batches:
            slots = pa.table([batch.column(c) for c in SLOT], SLOT)
            number = pa.array(np.arange(len(batch)))
            repeated = slots.append_column("n", number).group_by(SLOT).aggregate([("n", "list")])
            groups = repeated.column("n_list").combine_chunks()
            if len(groups) == len(batch):
                yield batch
                continue
            order = {}
            arrivals, payloads = batch.column("arrival"), batch.column("payload")
            for rows in groups.filter(pc.greater(pc.list_value_length(groups), 1)).to_pylist():
                best = max(rows, key=lambda i: (_sortable(arrivals[i].as_py()), payloads[i].as_py() or b""))
                order.update((i, i == best) for i in rows)
            keep = pa.array([order.get(i, True) for i in range(len(batch))])
            yield batch.filter(keep)

    return members.mapInArrow(run, members.schema)


def _sortable(arrival):
    """Arrivals are numbers or structs; Arrow gives structs as dictionaries in field order."""
    return tuple(arrival.values()) if isinstance(arrival, dict) else arrival


def block_bounds(blocks: DataFrame, cfg: ArrayConfig, start: Column) -> DataFrame:
    """First and last packet counter of each block, as seen by source 0."""
    delay = cfg.split_delays()[cfg.fpga_ids[0]][0]
    first = start + delay + F.col("block") * (cfg.packets * cfg.step)
    return (blocks.withColumn("start_seq", first)
            .withColumn("end_seq", first + (cfg.packets - 1) * cfg.step))


#: Blocks without any packet that are listed one by one; a longer gap is an outage, which is one row of :func:`outages`.
HORIZON = 1 << 16


def own_blocks(arrived: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Blocks that hold packets of their own, halo aside, and how many: ``block, n``."""
    return (arrived.where(F.col("pkt").between(0, cfg.packets - 1))
            .groupBy("block").agg(F.count(F.lit(1)).alias("n")))


@dataclass(frozen=True)
class BlockGaps:
    """Blocks of a stream in order, which everything that asks for gaps goes by.

    ``blocks``: block, n, prev (the block with packets before it, null for the first).
    ``strays``: blocks of a single packet more than ``horizon`` blocks from all others, a
    wrong counter and not the end of an outage; they are not in ``blocks``, and None
    stands for none.  Both are written once.
    """

    blocks: DataFrame
    strays: DataFrame | None
    horizon: int

    def axis(self) -> DataFrame:
        """Blocks from the first to the last, those of a gap up to the horizon included."""
        near = F.col("block") - F.col("prev") <= self.horizon
        listed = F.sequence(F.when(near, F.col("prev") + 1).otherwise(F.col("block")), F.col("block"))
        return self.blocks.select(F.explode(listed).alias("block"), F.col("block").alias("__end"), "n").select(
            "block", F.when(F.col("block") == F.col("__end"), F.col("n")).otherwise(F.lit(0)).alias("n"))

    def outages(self, cfg: ArrayConfig) -> DataFrame:
        """Gaps that :meth:`axis` does not list, a row each: first and last block, blocks, missing packets."""
        d = self.blocks.where(F.col("block") - F.col("prev") > self.horizon)
        n = F.col("block") - F.col("prev") - 1
        return d.select((F.col("prev") + 1).alias("first_block"), (F.col("block") - 1).alias("last_block"), n.alias("blocks"),
                        (n * cfg.packets_per_block).alias("missing"))

    def without_strays(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``block``) of the stream's own blocks."""
        return rows if self.strays is None else rows.join(scale.broadcast_if_small(self.strays, 1 << 16), "block", "left_anti")


def block_gaps(occupied: DataFrame, horizon: int = HORIZON) -> BlockGaps:
    """Gaps and strays of ``occupied`` (``block, n``, a row a block), which is computed once.

    Where every packet is alone there is no stream to be away from, and none is stray.
    """
    d = scale.ordered_neighbours(materialize(occupied.select("block", "n"), "occupied-blocks"), "block")
    far = lambda gap: F.coalesce(gap > horizon, F.lit(True))
    alone = (F.col("n") == 1) & far(F.col("block") - F.col("prev")) & far(F.col("next") - F.col("block"))
    d = materialize(d.withColumn("alone", alone), "block-gaps")
    some = d.agg(F.bool_or("alone").alias("alone"), F.bool_or(~F.col("alone")).alias("stream")).first()
    if not (some["alone"] and some["stream"]):
        return BlockGaps(d.select("block", "n", "prev"), None, horizon)
    rest = scale.ordered_neighbours(d.where("not alone").select("block", "n"), "block")
    return BlockGaps(materialize(rest.select("block", "n", "prev"), "block-gaps"), d.where("alone").select("block"), horizon)


def gaps_of(arrived: DataFrame, cfg: ArrayConfig, horizon: int = HORIZON) -> BlockGaps:
    return block_gaps(own_blocks(arrived, cfg), horizon)


def stray_packets(packets: DataFrame, cfg: ArrayConfig, gaps: BlockGaps) -> DataFrame:
    """Counters of the packets in stray blocks, and how many packets (copies included) have them."""
    keys = ["fpga_id", "freq_channel", "sample_count"]
    if gaps.strays is None:
        return packets.where(F.lit(False)).groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"))
    usable = packets.where(has_samples(cfg))
    at = packet_index(channel_window(usable, cfg), cfg, usable_start(packets, cfg)).withColumn("block", floor_div("index", cfg.packets))
    return at.join(scale.broadcast_if_small(gaps.strays, 1 << 16), "block", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"))


def cell_contents(arrived: DataFrame, cfg: ArrayConfig, values: list[str] = (), gaps: BlockGaps | None = None) -> DataFrame:
    """Every (block, channel, source) between the first and the last block with what arrived.

    Gaps beyond the horizon are rows of :meth:`BlockGaps.outages` instead, and stray
    blocks take no part.  ``have`` maps packet numbers to ``values``; it is bounded by N+2
    entries and null for a cell without packets.  A block that only holds halo packets of
    its neighbour does not extend the range.  Folding the packets first leaves one row per
    cell to join with the grid.
    """
    gaps = gaps or gaps_of(arrived, cfg)
    entry = F.struct(F.col("pkt"), F.struct("pkt", *values))
    cells = arrived.groupBy("block", "channel", "source").agg(F.map_from_entries(F.collect_list(entry)).alias("have"))
    axis = lambda size: F.sequence(F.lit(0), F.lit(size - 1))
    grid = (gaps.axis().select("block", F.explode(axis(cfg.channels)).alias("channel"))
            .select("block", "channel", F.explode(axis(cfg.fpgas)).alias("source")))
    return grid.join(cells, ["block", "channel", "source"], "left")


def missing_packets(arrived: DataFrame, cfg: ArrayConfig, gaps: BlockGaps | None = None) -> DataFrame:
    """Expected packets that never arrived; the halo does not count.

    An anti join by set difference inside each cell.  Those of an outage are counted in :meth:`BlockGaps.outages`.
    """
    every = F.sequence(F.lit(0), F.lit(cfg.packets - 1))
    gone = F.array_except(every, F.coalesce(F.map_keys("have"), F.array().cast("array<int>")))
    return cell_contents(arrived, cfg, gaps=gaps).select("block", "channel", "source", F.explode(gone).alias("pkt"))


def _slots(arrived: DataFrame, cfg: ArrayConfig, values: list[str], gaps: BlockGaps | None) -> DataFrame:
    slots = F.sequence(F.lit(-1), F.lit(cfg.packets))
    return (cell_contents(arrived, cfg, values, gaps)
            .select("block", "channel", "source", "have", F.explode(slots).alias("pkt"))
            .select("block", "channel", "source", "pkt", F.element_at("have", F.col("pkt")).alias("cell")))


def arrival_flags(arrived: DataFrame, cfg: ArrayConfig, gaps: BlockGaps | None = None) -> DataFrame:
    """Arrived flag of every packet slot of every block, halo included; outages are rows of :meth:`BlockGaps.outages`."""
    d = _slots(arrived.select("block", "channel", "source", "pkt"), cfg, [], gaps)
    return d.select("block", "channel", "source", "pkt", F.col("cell").isNotNull().alias("arrived"))


def impute_missing(arrived: DataFrame, cfg: ArrayConfig, values: list[str], gaps: BlockGaps | None = None) -> DataFrame:
    """Complete every slot; a missing packet gets zeros (a zero scale silences it).  Outages are rows of :meth:`BlockGaps.outages`."""
    return _slots(arrived, cfg, values, gaps).select(
        "block", "channel", "source", "pkt", F.col("cell").isNotNull().alias("arrived"),
        *[F.coalesce(F.col(f"cell.{v}"), F.lit(0)).alias(v) for v in values])


def missing_by_integration(gaps: BlockGaps, cfg: ArrayConfig) -> DataFrame:
    """Missing and expected packets and the percentage of every integration.

    Blocks without any packet count in full, at any length of a gap: an outage is added to its first and
    last integration by arithmetic, and those between are one row that stands for ``integrations`` of them.
    """
    one = F.lit(1).cast("long")
    part = lambda at, width, blocks, n: F.struct(
        at.alias("integration"), width.alias("integrations"), blocks.alias("blocks"), n.alias("n"))
    # A block and the gap before it: the block itself, and up to three parts of the gap.
    first, last, zero = F.col("prev") + 1, F.col("block") - 1, F.lit(0).cast("long")
    a, b = floor_div(first, cfg.accumulate), floor_div(last, cfg.accumulate)
    gap = last >= first
    parts = F.array_compact(F.array(
        part(floor_div("block", cfg.accumulate), one, one, F.col("n")),
        F.when(gap, part(a, one, F.least(last, (a + 1) * cfg.accumulate - 1) - first + 1, zero)),
        F.when(gap & (b - a > 1), part(a + 1, b - a - 1, (b - a - 1) * cfg.accumulate, zero)),
        F.when(gap & (b > a), part(b, one, last - b * cfg.accumulate + 1, zero))))
    per = gaps.blocks.select(F.inline(parts)).groupBy("integration").agg(
        F.max("integrations").alias("integrations"), (F.sum("blocks") * cfg.packets_per_block).alias("total"), F.sum("n").alias("have"))
    missing = F.col("total") - F.col("have")
    return per.select("integration", missing.alias("missing"), "total", (F.lit(100.0) * missing / F.col("total")).alias("pct"),
                      "integrations")


def single_integrations(per: DataFrame) -> DataFrame:
    """:func:`missing_by_integration` with a row for every integration of an outage."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("integrations") - 1, F.lit(scale.RANGE).cast("long"))
    d = per.withColumn("__from", F.explode(starts)).repartition("integration", "__from")      # a long row is dealt in parts
    step = F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + (scale.RANGE - 1), F.col("integrations") - 1)))
    d = d.withColumn("__step", step)
    return d.select((F.col("integration") + F.col("__step")).alias("integration"),
                    *[idiv(F.col(c), F.col("integrations")).alias(c) for c in ("missing", "total")], "pct")


def counters(packets: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """One row of packet counters for a whole capture."""
    lo = cfg.min_channel
    inside = F.col("freq_channel").between(lo, lo + cfg.channels - 1)
    accepted = packets.where(inside)
    tagged = packet_index(packets.withColumn("ok", inside), cfg, stream_start(accepted, cfg))
    old = F.col("ok") & (F.col("index") < -1)
    return tagged.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(~F.col("ok")).alias("discarded_channel"),
        F.count_if(old).alias("discarded_old"), F.count_if(F.col("ok") & ~old).alias("processed"))


def numbered_arrivals(packets: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Packets whose arrival is an integer: another type, such as (time, file, position), is replaced by its order.

    The numbers ascend with the arrivals and are unique, but not dense.
    """
    if isinstance(packets.schema[arrival].dataType, T.IntegralType):
        return packets
    ordered = packets.repartitionByRange(arrival).sortWithinPartitions(arrival)
    return materialize(ordered.withColumn(arrival, F.monotonically_increasing_id()), "numbered-arrivals")


def watermarks(packets: DataFrame, keys: list[str], seq: str = "sample_count",
               arrival: str = "arrival", width: int = scale.RANGE) -> DataFrame:
    """Highest counter seen so far by key, in arrival order."""
    return scale.ordered_prefix(numbered_arrivals(packets, arrival), keys, arrival, seq, "max", "watermark", True, width)


def sequence_gaps(packets: DataFrame, keys: list[str], step: int, seq: str = "sample_count",
                  arrival: str = "arrival", width: int = scale.RANGE) -> DataFrame:
    """Packets whose counter is not one step after the previous arrival of the key."""
    d = scale.ordered_prev(numbered_arrivals(packets, arrival), keys, arrival, seq, "previous", width)
    return (d.withColumn("gap", F.col(seq) - F.col("previous"))
            .where(F.col("gap").isNotNull() & (F.col("gap") != step)))


def capture_extent(packets: DataFrame, samples_per_packet: int = 64) -> DataFrame:
    """Range of counters and channels, and how many packets that range should hold."""
    d = packets.agg(F.min("sample_count").alias("first_seq"), F.max("sample_count").alias("last_seq"),
                    F.min("freq_channel").alias("first_channel"), F.max("freq_channel").alias("last_channel"),
                    F.count(F.lit(1)).alias("packets"))
    channels = F.col("last_channel") - F.col("first_channel") + 1
    span = F.col("last_seq") - F.col("first_seq") + 1
    return d.withColumn("expected", channels.cast("long") * floor_div(span, samples_per_packet))


def replay(packets: DataFrame, loops: int, jump: int = 64) -> DataFrame:
    """Repeat a capture; every pass of a source starts one jump after the last one.

    The shift per pass is (last - first + jump) of that source.
    """
    span = packets.groupBy("fpga_id").agg(
        (F.max("sample_count") - F.min("sample_count") + jump).alias("__span"))
    return (packets.join(scale.broadcast_if_small(span, 256), "fpga_id")   # few keys: not by shuffle
            .withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
            .withColumn("sample_count", F.col("sample_count") + F.col("loop") * F.col("__span"))
            .drop("__span"))


def replicate_sources(packets: DataFrame, fpgas: int) -> DataFrame:
    """Copy every packet to sources 0..fpgas-1."""
    return packets.drop("fpga_id").withColumn(
        "fpga_id", F.explode(F.sequence(F.lit(0), F.lit(fpgas - 1))))


def channels_complete(arrived: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Blocks with a flag whether every channel saw every source's last packet."""
    done = F.bool_or(F.col("pkt") >= cfg.packets - 1)
    per = arrived.groupBy("block", "channel", "source").agg(done.alias("done"))
    return per.groupBy("block").agg(
        (F.bool_and("done") & (F.count(F.lit(1)) == cfg.channels * cfg.fpgas)).alias("complete"))
