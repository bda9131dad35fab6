"""Packet captures as a Spark data source, and as rows of binary files.

``spark.read.format("pcap")`` reads classic pcap and pcapng files.  Large pcap files are
cut at any byte: a split finds its first record by itself, and the split before checks
that its last one ends there.  With the option ``framelength`` every record has the same
size and splits are exact by arithmetic.  :func:`read_pcap` can also survey the heads of
all splits first (``index``), which cuts pcapng files as well and is exact for any
content.  :func:`frames_of_files` reads both formats through ``binaryFile``, also on streams.
"""

from __future__ import annotations

import glob
import io
import os
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phasegrid.session import materialize
from phasegrid.sources import packet_files as files
from phasegrid.sources.packet_files import GLOBAL_HEADER, RECORD_HEADER, DamagedCapture

SPLIT_BYTES = 128 << 20
BATCH_ROWS = 4096
PCAP_SCHEMA = "file string, position long, ts timestamp, wire_length int, frame binary"
_ARROW = pa.schema([("file", pa.string()), ("position", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")),
                    ("wire_length", pa.int32()), ("frame", pa.binary())])
SUFFIXES = (".pcap", ".pcapng")


def _batch(path: str, positions, micros, lengths, frames) -> pa.RecordBatch:
    n = len(positions)
    frames = frames if isinstance(frames, pa.Array) else pa.array(frames, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(positions, pa.int64()),
                                       pa.array(micros, _ARROW.field("ts").type), pa.array(lengths, pa.int32()), frames], schema=_ARROW)


def batches_of(path: str, stream, kind, start: int, end: int, expect: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the records that start in [start, end)."""
    if isinstance(kind, files.Classic):
        for positions, micros, lengths, frames in kind.arrays(stream, start, end, expect):
            yield _batch(path, positions, micros, lengths, frames)
        return
    rows: list[tuple] = []
    for record in kind.walk(stream, start, end, bodies=True):
        rows.append(record)
        if len(rows) == BATCH_ROWS:
            yield _batch(path, *zip(*rows, strict=True))
            rows = []
    if rows:
        yield _batch(path, *zip(*rows, strict=True))


def listed(path: str) -> list[str]:
    """Capture files of a folder, a pattern or a name, in order."""
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if p.endswith(SUFFIXES))
    return sorted(glob.glob(path))


class PcapSplit(InputPartition):
    def __init__(self, path: str, start: int, end: int, guessed: bool = False):
        self.path, self.start, self.end, self.guessed = path, start, end, guessed


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options.get("path")
        if not path:
            raise ValueError("pcap needs a path")
        self.path = path
        length = options.get("framelength")
        self.frame = int(length) if length else None
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[PcapSplit]:
        out: list[PcapSplit] = []
        for path in listed(self.path):
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                classic = isinstance(files.layout(f), files.Classic)
            if not classic:
                out.append(PcapSplit(path, 0, size))
                continue
            record = RECORD_HEADER + self.frame if self.frame else 1
            step = max(self.split // record, 1) * record
            out += [PcapSplit(path, s, min(s + step, size), self.frame is None) for s in range(GLOBAL_HEADER, max(size, GLOBAL_HEADER + 1), step)]
        return out

    def read(self, partition: PcapSplit) -> Iterator[pa.RecordBatch]:
        with files.open_file(partition.path) as f:
            kind = files.layout(f)
            start = kind.next_start(f, partition.start) if partition.guessed else partition.start
            last = None
            for batch in batches_of(partition.path, f, kind, start, partition.end, self.frame):
                last = batch.column("position")[-1].as_py()
                yield batch
            if partition.guessed and partition.end < kind.size:
                stop = start if last is None else kind.after(f, last)
                if stop != kind.next_start(f, partition.end):
                    raise DamagedCapture(f"{partition.path} cannot be cut at byte {partition.end} by its looks; read it with index=True")


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PCAP_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(self.options)


def read_pcap(spark: SparkSession, path: str, frame_length: int | None = None,
              split_bytes: int = SPLIT_BYTES, index: bool | None = None) -> DataFrame:
    """Frames of captures: file, position, ts, wire_length, frame.

    ``index`` surveys the heads of all splits before anything is read.  By default that is
    done where a pcapng file is longer than a split, as its splits need the interfaces
    that were described before them.
    """
    if index is None:
        index = frame_length is None and any(os.path.getsize(p) > split_bytes and _is_blocks(p) for p in listed(path))
    if index:
        return read_indexed(spark, path, split_bytes)
    spark.dataSource.register(PcapSource)
    reader = spark.read.format("pcap").option("splitbytes", split_bytes)
    if frame_length is not None:
        reader = reader.option("framelength", frame_length)
    return reader.load(path)


def _is_blocks(path: str) -> bool:
    with open(path, "rb") as f:
        return isinstance(files.layout(f), files.Blocks)


_INDEX = "file string, k int, begin long, end long, start long, stop long, scope array<struct<at: long, block: binary>>"


def survey(splits: DataFrame) -> DataFrame:
    """First record, first record after it, and scope blocks of every split; a known ``start`` is taken as it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["stop"] is None:
                    with files.open_file(r["file"]) as f:
                        found = files.survey(f, r["begin"], r["end"], r["start"])
                    r |= {"start": found.start, "stop": found.stop, "scope": [{"at": at, "block": block} for at, block in found.scope]}
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return splits.mapInArrow(run, _INDEX)


def index_splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Splits of captures with where their records start, written once.

    A split starts where the one before it stops.  Where it had found another place by
    looks, it is surveyed again from the right one, until all agree; the first split of a
    file is right, so every turn settles one more at least.  Splits after a damaged place
    stay as found: reading raises at that place.
    """
    rows = []
    for name in listed(path):
        size = os.path.getsize(name)
        rows += [(name, k, s, min(s + split_bytes, size), None, None, None) for k, s in enumerate(range(0, max(size, 1), split_bytes))]
    splits = spark.createDataFrame(rows, _INDEX).repartition(max(len(rows), 1))
    found = materialize(survey(splits), "capture-index")
    while True:
        before = F.lag("stop").over(Window.partitionBy("file").orderBy("k"))       # a row a split
        checked = found.withColumn("before", before).withColumn("wrong", (F.col("before") >= 0) & (F.col("before") != F.col("start")))
        checked = checked.withColumn("wrong", F.coalesce("wrong", F.lit(False)))
        wrong = checked.where("wrong").count()
        if not wrong:
            return found
        again = checked.select("file", "k", "begin", "end", F.when(F.col("wrong"), F.col("before")).otherwise(F.col("start")).alias("start"),
                               F.when(~F.col("wrong"), F.col("stop")).alias("stop"), F.when(~F.col("wrong"), F.col("scope")).alias("scope"))
        found = materialize(survey(again.repartition(wrong)), "capture-index")


def read_indexed(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames by an index of all splits; each is read with the scope blocks of its file that come before it."""
    found = index_splits(spark, path, split_bytes)
    scopes = found.select("file", F.explode("scope").alias("b")).groupBy("file").agg(F.array_sort(F.collect_list("b")).alias("scopes"))
    splits = found.drop("scope").join(scopes, "file", "left").repartition(max(found.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                scope = [(b["at"], b["block"]) for b in r["scopes"] or [] if b["at"] < r["start"]]
                with files.open_file(r["file"]) as f:
                    yield from batches_of(r["file"], f, files.layout(f, scope), r["start"], r["end"])

    return splits.mapInArrow(run, PCAP_SCHEMA)


def frames_of_files(binary: DataFrame) -> DataFrame:
    """Frames of ``binaryFile`` rows (batch or stream).  One file is one row, so
    captures should be rotated; use :func:`read_pcap` for large files."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                stream = io.BytesIO(content.as_buffer())
                kind = files.layout(stream)
                yield from batches_of(path, stream, kind, kind.begin, kind.size)

    return binary.select("path", "content").mapInArrow(parse, PCAP_SCHEMA)


def stream_pcap(spark: SparkSession, directory: str, files_per_trigger: int = 16) -> DataFrame:
    """Captures dropped into a directory, as a stream of frames."""
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng}")
             .option("maxFilesPerTrigger", files_per_trigger)
             .schema("path string, modificationTime timestamp, length long, content binary").load(directory))
    return frames_of_files(files)


def with_arrival(frames: DataFrame) -> DataFrame:
    """A total arrival order: capture time, then file and position.

    The order is a struct, compared field by field, so no global sort is needed.
    """
    return frames.withColumn("arrival", F.struct("ts", "file", "position"))


def pcap_bytes(frames: list[tuple[int, bytes]]) -> bytes:
    """A capture of (microseconds, frame) pairs, for fixtures."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for micros, frame in frames:
        out.append(struct.pack("<IIII", micros // 10 ** 6, micros % 10 ** 6, len(frame), len(frame)) + frame)
    return b"".join(out)


def pcapng_bytes(frames: list[tuple[int, bytes]], order: str = "<", resolution: int = 6, section_every: int = 0) -> bytes:
    """The same as pcapng, for fixtures: clocks of 10^-resolution seconds, a new section after so many frames."""
    def block(kind: int, body: bytes) -> bytes:
        body += bytes(-len(body) % 4)
        return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)

    def scope() -> bytes:
        section = block(files.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        return section + block(files.INTERFACE, struct.pack(order + "HHIHHB3xHH", 1, 0, 65535, 9, 1, resolution, 0, 0))

    out = [scope()]
    for i, (micros, frame) in enumerate(frames):
        if section_every and i and i % section_every == 0:
            out.append(scope())
        ticks = micros * 10 ** resolution // 10 ** 6
        out.append(block(files.PACKET, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame))
    return b"".join(out)


def micros(ts: datetime) -> int:
    return int(ts.replace(tzinfo=timezone.utc).timestamp() * 10 ** 6)
