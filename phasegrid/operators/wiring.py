"""Stream wiring: canonical order, permutation, audit tables, baseline identities.

Every table carries ``run``, so many observations are handled at once; one run
has at most ``fpgas * recv_per_fpga * pols`` streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from phasegrid import scale
from phasegrid.config import ArrayConfig
from phasegrid.functions import numeric as N

# Built-in wiring: antenna of each of the ten streams of an FPGA (fixed values,
# a negative antenna is a null input).
BUILT_IN_ANTENNAS = {
    0: [-100, 35, -100, 1, -100, 14, -100, 36, 18, 25],
    1: [15, 16, 23, 24, 26, 32, 17, 33, 11, 13],
    2: [4, 6, 5, 29, 10, 20, 7, 9, 2, 3],
    3: [19, 28, 31, 34, 27, 30, 12, 22, 8, 21],
}


def built_in_wiring(spark: SparkSession, fpga_ids: list[int]) -> DataFrame:
    """Receiver to antenna for the selected FPGAs, ten receivers per position."""
    unknown = [f for f in fpga_ids if f not in BUILT_IN_ANTENNAS]
    if unknown:
        raise ValueError(f"unknown FPGA ID: {unknown[0]}")
    rows = [(10 * pos + s, a) for pos, f in enumerate(fpga_ids) for s, a in enumerate(BUILT_IN_ANTENNAS[f])]
    return spark.createDataFrame(rows, "recv int, antenna_id int")


def connected(wiring: DataFrame) -> DataFrame:
    return wiring.where(F.col("antenna_id") >= 0)


def canonical_receivers(wiring: DataFrame) -> DataFrame:
    """Connected antennas of a run in ascending order, counted from 0."""
    ants = connected(wiring).select("run", "antenna_id").distinct()
    rank = F.dense_rank().over(W.partitionBy("run").orderBy("antenna_id")) - 1
    return ants.withColumn("canonical", rank.cast("int"))


def canonical_map(wiring: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Antenna of every canonical receiver; unused receivers hold -1."""
    slots = wiring.select("run").distinct().withColumn(
        "canonical", F.explode(F.sequence(F.lit(0), F.lit(cfg.receivers - 1))))
    return (slots.join(canonical_receivers(wiring), ["run", "canonical"], "left")
            .select("run", "canonical", F.coalesce("antenna_id", F.lit(-1)).alias("antenna_id")))


def check_polarizations(wiring: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Connected streams, failing when an antenna lacks a polarization."""
    w = W.partitionBy("run", "antenna_id")
    d = connected(wiring).withColumn("__pols", F.size(F.collect_set("polarization").over(w)))
    message = F.concat(F.lit("antenna "), F.col("antenna_id").cast("string"), F.lit(" is missing a polarization"))
    return (d.withColumn("polarization", F.when(F.col("__pols") == cfg.pols, F.col("polarization"))
                         .otherwise(F.raise_error(message).cast("int"))).drop("__pols"))


def permutation(wiring: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Hardware receiver and polarization feeding each canonical slot; -1 if unused.

    Result: ``run, slot, recv_perm, pol_perm`` with slot = canonical * pols + pol.
    """
    streams = check_polarizations(wiring, cfg).join(canonical_receivers(wiring), ["run", "antenna_id"])
    # a later stream of the same antenna and polarization replaces an earlier one
    order = F.struct("fpga_id", "stream")
    source = streams.groupBy("run", (F.col("canonical") * cfg.pols + F.col("polarization")).alias("slot")).agg(
        F.max_by(F.struct((F.col("fpga_id") * cfg.recv_per_fpga + N.idiv(F.col("stream"), cfg.pols)).cast("int")
                          .alias("recv"), F.pmod("stream", F.lit(cfg.pols)).cast("int").alias("pol")), order)
        .alias("src"))
    slots = wiring.select("run").distinct().withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(cfg.receivers * cfg.pols - 1))))
    return (slots.join(source, ["run", "slot"], "left")
            .select("run", "slot", F.coalesce("src.recv", F.lit(-1)).alias("recv_perm"),
                    F.coalesce("src.pol", F.lit(0)).alias("pol_perm")))


def reorder_streams(samples: DataFrame, perm: DataFrame, pols: int) -> DataFrame:
    """Samples in canonical receiver order.

    ``perm`` has one row per slot (bounded by the array).  Every slot of every
    (block, channel, pkt, t) exists in the result; unused slots are zero.
    """
    used = perm.where(F.col("recv_perm") >= 0).select(
        F.col("recv_perm").alias("recv"), F.col("pol_perm").alias("pol"),
        N.idiv(F.col("slot"), pols).cast("int").alias("canonical"),
        F.pmod("slot", F.lit(pols)).cast("int").alias("canonical_pol"))
    cell = ["block", "channel", "pkt", "t"]
    moved = samples.join(scale.broadcast_if_small(used, 4096), ["recv", "pol"]).select(
        *cell, F.col("canonical").alias("recv"), F.col("canonical_pol").alias("pol"), "re", "im")
    empty = perm.where(F.col("recv_perm") < 0).select(
        N.idiv(F.col("slot"), pols).cast("int").alias("r"), F.pmod("slot", F.lit(pols)).cast("int").alias("p"))
    slots = empty.agg(F.collect_list(F.struct("r", "p"))).scalar()  # bounded by the array
    zeros = (samples.select(*cell).distinct().select(*cell, F.explode(slots).alias("s"))
             .select(*cell, F.col("s.r").alias("recv"), F.col("s.p").alias("pol"),
                     F.lit(0).alias("re"), F.lit(0).alias("im")))
    return moved.unionByName(zeros)


def forward_table(wiring: DataFrame, cfg: ArrayConfig, authoritative: bool = True) -> DataFrame:
    """Audit row of every hardware stream: 12 integer columns per run."""
    per = cfg.recv_per_fpga * cfg.pols
    streams = (wiring.select("run").distinct()
               .withColumn("global_datastream_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.fpgas * per - 1)))))
    flat = F.col("global_datastream_id")
    streams = (streams.withColumn("fpga_input_index", N.idiv(flat, per).cast("int"))
               .withColumn("fpga_stream_id", F.pmod(flat, F.lit(per)).cast("int")))
    ids = F.array(*[F.lit(f) for f in cfg.fpga_ids])
    known = wiring.select("run", F.col("fpga_id").alias("__f"), F.col("stream").alias("fpga_stream_id"),
                          "antenna_id", "polarization")
    d = (streams.withColumn("fpga_id", ids[F.col("fpga_input_index")]).withColumn("__f", F.col("fpga_id"))
         .join(known, ["run", "__f", "fpga_stream_id"], "left")
         .join(canonical_receivers(wiring), ["run", "antenna_id"], "left"))
    slot = N.idiv(F.col("fpga_stream_id"), cfg.pols).cast("int")
    raw_pol = F.pmod("fpga_stream_id", F.lit(cfg.pols)).cast("int")
    antenna = F.coalesce("antenna_id", F.lit(-1))
    receiver = (F.col("fpga_input_index") * cfg.recv_per_fpga + slot).cast("int")
    auth = 1 if authoritative else 0
    return d.select(
        "run", "global_datastream_id", "fpga_input_index", "fpga_id", "fpga_stream_id",
        slot.alias("receiver_slot"), raw_pol.alias("raw_polarization"),
        (F.coalesce("polarization", raw_pol) if authoritative else raw_pol).alias("canonical_polarization"),
        antenna.alias("antenna_id"),
        (F.coalesce("canonical", F.lit(-1)) if authoritative else receiver).alias("canonical_receiver_index"),
        (antenna < 0).cast("int").alias("configured_disconnected"),
        ((antenna < 0).cast("int") * auth).alias("zeroed_after_reorder"),
        F.lit(auth).alias("stream_map_authoritative"))


def reverse_table(wiring: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """Audit row of every canonical slot: where it comes from, -1 if nowhere."""
    back = (forward_table(wiring, cfg)
            .where((F.col("antenna_id") >= 0) & (F.col("canonical_receiver_index") >= 0))
            .groupBy("run", F.col("canonical_receiver_index").alias("canonical"),
                     F.col("canonical_polarization").alias("pol"))
            .agg(F.max_by(F.struct("global_datastream_id", "fpga_input_index", "fpga_id", "fpga_stream_id"),
                          "global_datastream_id").alias("src")))
    slots = canonical_map(wiring, cfg).withColumn(
        "pol", F.explode(F.sequence(F.lit(0), F.lit(cfg.pols - 1))))
    names = ["global_datastream_id", "fpga_input_index", "fpga_id", "fpga_stream_id"]
    return slots.join(back, ["run", "canonical", "pol"], "left").select(
        "run", F.col("canonical").alias("canonical_receiver_index"), "antenna_id",
        F.col("pol").alias("canonical_polarization"),
        *[F.coalesce(F.col(f"src.{n}"), F.lit(-1)).alias(n) for n in names],
        (F.col("antenna_id") < 0).cast("int").alias("zeroed_after_reorder"))


def stream_mapping(wiring: DataFrame, cfg: ArrayConfig, interfaces: list[str],
                   authoritative: bool = True) -> DataFrame:
    """The 13 column stream mapping that is written next to a product."""
    names = F.array(*[F.lit(i) for i in interfaces + [""] * (cfg.fpgas - len(interfaces))])
    source = "stream_antenna_map" if authoritative else "legacy_registry"
    return forward_table(wiring, cfg, authoritative).select(
        "run", "global_datastream_id", "fpga_input_index", "fpga_id",
        names[F.col("fpga_input_index")].alias("network_interface"), "fpga_stream_id", "receiver_slot",
        "raw_polarization", "canonical_polarization", "antenna_id", "canonical_receiver_index",
        "configured_disconnected", "zeroed_after_reorder", F.lit(source).alias("mapping_source"))


def baseline_table(receivers: DataFrame, zero_negative: bool = True) -> DataFrame:
    """Identity of every baseline of every run from ``run, canonical, antenna_id``.

    The antennas of a run are one bounded array, expanded by position.
    """
    ants = receivers.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("canonical", "antenna_id"))).alias("a"))
    d = (ants.select("run", "a", F.posexplode("a").alias("j", "aj"))
         .select("run", "j", "aj", F.posexplode(F.slice("a", 1, F.col("j") + 1)).alias("i", "ai")))
    neg = (F.col("ai.antenna_id") < 0) | (F.col("aj.antenna_id") < 0)
    return d.select(
        "run", N.baseline_index(F.col("i"), F.col("j")).cast("int").alias("baseline"), "i", "j",
        F.col("ai.antenna_id").alias("ant_i"), F.col("aj.antenna_id").alias("ant_j"),
        N.baseline_id(F.col("ai.antenna_id"), F.col("aj.antenna_id")).alias("baseline_id"),
        (neg.cast("int") if zero_negative else F.lit(0)).alias("zeroed"))


def antenna_positions(receivers: DataFrame, positions: DataFrame) -> DataFrame:
    """East, north, up of each receiver through its antenna; the origin by default."""
    d = receivers.join(scale.broadcast_if_small(positions, 4096), "antenna_id", "left")
    return d.select("run", "canonical", "antenna_id",
                    *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("east", "north", "up")])


def antenna_sources(wiring: DataFrame, cfg: ArrayConfig) -> DataFrame:
    """FPGA of each canonical receiver, looked up on the first hardware polarization."""
    first = (forward_table(wiring, cfg).where((F.col("raw_polarization") == 0) & (F.col("antenna_id") >= 0))
             .groupBy("run", "antenna_id").agg(F.max_by("fpga_id", "global_datastream_id").alias("fpga_id")))
    return (canonical_map(wiring, cfg).join(first, ["run", "antenna_id"], "left")
            .select("run", "canonical", "antenna_id", F.coalesce("fpga_id", F.lit(-1)).alias("fpga_id")))
