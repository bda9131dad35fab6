"""Command line: ``python -m phasegrid JOB --input captures/ --output products/ ...``"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation

from phasegrid.config import ArrayConfig
from phasegrid.plans import jobs
from phasegrid.plans.setup import RunFiles, load_calibration, receivers, wired_streams
from phasegrid.session import build_session, ship_package
from phasegrid.sinks import products
from phasegrid.sources import capture, dims, pcap, wire
from phasegrid.streaming import rollup
from phasegrid.streaming.assembler import BlockAssembler

JOBS = ("observe", "observe-stream", "adaptive", "antenna-spectra", "bandpass", "projection", "pulsar-fold", "offline")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phasegrid", description="Array-signal jobs on Spark")
    p.add_argument("job", choices=JOBS)
    p.add_argument("--input", required=True, help="folder of captures, or of stored frames")
    p.add_argument("--output", required=True, help="folder for the products")
    p.add_argument("--split-bytes", type=int, default=pcap.SPLIT_BYTES, help="bytes of a capture file in one task")
    p.add_argument("--capture-backend", choices=("pcap", "table"), default="pcap")
    shape = p.add_argument_group("array shape")
    shape.add_argument("--channels", type=int, default=8)
    shape.add_argument("--min-channel", type=int, default=0)
    shape.add_argument("--fpga-ids", type=lambda s: tuple(int(x) for x in s.split(",")), default=(0,))
    shape.add_argument("--receivers-per-fpga", type=int, default=10)
    shape.add_argument("--steps", type=int, default=64, help="time steps per packet")
    shape.add_argument("--packets", type=int, default=256, help="packets per block")
    shape.add_argument("--beams", type=int, default=1)
    shape.add_argument("--accumulation-length", type=int, default=56, help="blocks per integration")
    shape.add_argument("--fpga-id-from-ip", action="store_true", help="use the third octet of the source address")
    files = p.add_argument_group("configuration files")
    for flag, text in (("config", "site, frequency plan, antenna positions"), ("stream-antenna-map", "stream wiring"),
                       ("gains", "calibration gains"), ("fine-delays", "antenna delays in ns"),
                       ("beam-weights", "fixed beam weights"), ("targets", "beam targets"),
                       ("delay-file", "source delays in samples"), ("eigenvalue-num-filename", "signal vectors by channel")):
        files.add_argument(f"--{flag}", help=text)
    files.add_argument("--utc", help="pointing time of the targets (default: now)")
    files.add_argument("--steering-interval", type=float, help="seconds after which beams are pointed anew (default: never)")
    files.add_argument("--obs-length", type=float, default=0.0, help="seconds of the observation, for which beams are pointed")
    rfi = p.add_argument_group("interference removal")
    rfi.add_argument("--shrink-eigenvalues", action="store_true", help="shrink instead of null")
    rfi.add_argument("--detect-signal-eigenmodes", action="store_true")
    rfi.add_argument("--detection-threshold-delta", type=float, default=3.0)
    rfi.add_argument("--signal-vectors", type=int, default=3, help="vectors of the projection job")
    rfi.add_argument("--runs", type=int, default=4, help="blocks per averaged projection")
    rfi.add_argument("--vectors", help="projection product whose vectors are removed from beam 1")
    spec = p.add_argument_group("spectra and folding")
    spec.add_argument("--downsample", type=int, default=64)
    spec.add_argument("--period", type=float, default=1000.0, help="fold period in samples")
    spec.add_argument("--phase-bins", type=int, default=64)
    p.add_argument("-n", "--num-packets", type=int, default=0, help="process only the first n packets (0: all)")
    return p


def _write(output: str, results: Mapping[str, DataFrame]) -> None:
    for name, df in results.items():
        products.write_product(df, output, name, "overwrite")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session("phasegrid")
    ship_package(spark)
    delays = {}
    if args.delay_file:
        delays = {r["fpga_id"]: r["samples"] for r in
                  dims.integer_map(spark, args.delay_file, "fpga_id", "samples").collect() if r["fpga_id"] in args.fpga_ids}
    cfg = ArrayConfig(channels=args.channels, fpgas=len(args.fpga_ids), recv_per_fpga=args.receivers_per_fpga,
                      steps=args.steps, packets=args.packets, beams=args.beams, min_channel=args.min_channel,
                      accumulate=args.accumulation_length, fpga_ids=args.fpga_ids, fpga_delays=delays)
    files = RunFiles(args.config, args.stream_antenna_map, args.gains, args.fine_delays, args.beam_weights, args.targets)
    cal = load_calibration(spark, cfg, files, args.utc, args.steering_interval, args.obs_length)
    streams = wired_streams(spark, cfg, files)
    products.write_baselines(receivers(spark, cfg, streams), args.output)
    streaming = args.job == "observe-stream"
    seen = Observation()
    packets = capture.open_capture(spark, args.capture_backend, args.input, cfg, streaming=streaming,
                                   source_from_ip=args.fpga_id_from_ip, split_bytes=args.split_bytes, seen=seen)
    if streaming:
        sums = rollup.Integrator(cfg, cal, f"{args.output}/integrations")
        assembler = BlockAssembler(cfg, f"{args.output}/assembly", ["payload"], on_blocks=sums)
        rollup.run_batches(packets, assembler, f"{args.output}/checkpoint", end=True)
        _write(args.output, {"visibilities": sums.integrations(spark), "counters": assembler.counters(spark)})
        return
    if args.num_packets:
        packets = packets.orderBy("arrival").limit(args.num_packets)
    if args.job == "observe":
        _write(args.output, jobs.observe(packets, cfg, cal))
    elif args.job == "adaptive":
        modes: int | dict[int, int] = 1
        if args.eigenvalue_num_filename:
            modes = {r["channel"] - cfg.min_channel: r["k"] for r in
                     dims.integer_map(spark, args.eigenvalue_num_filename, "channel", "k").collect()}
        delta = args.detection_threshold_delta if args.detect_signal_eigenmodes else None
        _write(args.output, jobs.adaptive_spectra(packets, cfg, cal, "shrink" if args.shrink_eigenvalues else "null",
                                                  modes, delta))
    elif args.job == "antenna-spectra":
        _write(args.output, {"spectra": jobs.antenna_spectra(packets, cfg, cal, args.downsample)})
    elif args.job == "bandpass":
        if args.vectors:
            cal = jobs.project_beam(cal, spark.read.parquet(args.vectors), 0, 1, args.signal_vectors)
        _write(args.output, {"spectra": jobs.beamformed_bandpass(packets, cfg, cal, args.downsample)})
    elif args.job == "projection":
        _write(args.output, {"projection": jobs.projection_matrix(packets, cfg, cal, args.signal_vectors, args.runs)})
    elif args.job == "pulsar-fold":
        _write(args.output, {"profile": jobs.pulsar_fold(packets, cfg, cal, args.period, args.phase_bins)})
    else:
        _write(args.output, {"visibilities": jobs.offline_correlation(packets, cfg)})
    gate = spark.createDataFrame([tuple(seen.get[c] for c in wire.GATE_COUNTERS)], ", ".join(f"{c} long" for c in wire.GATE_COUNTERS))
    products.write_product(gate, args.output, "frame_counters", "overwrite")
    print(json.dumps({"job": args.job, "output": args.output}))


if __name__ == "__main__":
    main()
