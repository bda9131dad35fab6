"""Token counts of flat, unindexed token files by a separator scan.

A file is a run of little-endian ids; a document ends with the separator id.
Blocks of a file are searched on their own.  A block knows its separators but not
where its first document began: that is the last separator of the blocks before,
a running maximum over the blocks of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from phasegrid.llm.bitpack import CHUNK_BYTES, put
from phasegrid.llm.common import F, bounded_slices, column, materialize, open_fs, text_sizes
from phasegrid.llm.word_encoder import shared_encoder
from phasegrid.scale import ordered_prefix

FILE_IDS = 1 << 22
BLOCK_IDS = 1 << 18


def write_flat(docs: DataFrame, out: str, tokenizer: str, separator: int, id_bytes: int = 2,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode texts to flat files, a separator after each document; no index is written.

    Documents stay in the order of their input partition and never cross files.
    Special strings in texts are ordinary text, so ids below the separator only.
    Returns where each document went: file, ordinal in the file, doc_id.
    """
    if id_bytes not in (2, 4):
        raise ValueError("ids take 2 or 4 bytes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, True)
        if max(encoder.vocabulary - 1, separator) >> (8 * id_bytes):
            raise ValueError(f"ids do not fit {id_bytes} bytes")
        task, shard, held, size, keys = TaskContext.get().partitionId(), 0, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal shard, held, size, keys
            name = f"flat-{task:06d}-{shard:06d}.ids"
            put(f"{out}/{name}", b"".join(held))
            ids = pa.concat_arrays(keys)
            batch = pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(np.arange(len(ids))), ids],
                                               ["file", "ordinal", "doc_id"])
            shard, held, size, keys = shard + 1, [], 0, []
            return batch

        for batch in batches:
            texts = batch.column("text")
            sizes = text_sizes(texts)
            for a, b in bounded_slices(sizes, CHUNK_BYTES):
                flat, counts = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts + 1)
                ids = np.full(int(ends[-1]), separator, f"<u{id_bytes}")
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep] = flat
                held.append(ids.tobytes())
                keys.append(batch.column("doc_id").slice(a, b - a))
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    fs, folder = open_fs(out)
    fs.create_dir(folder, recursive=True)      # without documents no task makes it
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(write, "file string, ordinal long, doc_id long"), "flat-places")


def scan_counts(spark: SparkSession, path: str, separator: int, id_bytes: int = 2, block_ids: int = BLOCK_IDS,
                pattern: str = "*.ids") -> DataFrame:
    """Documents of flat token files: file, ordinal, start, n_tokens (separator included), complete.

    ``start`` counts ids in the file.  Ids after the last separator of a file are one
    more document with ``complete`` false.  An empty file has no documents; a file
    whose bytes do not divide by the id size fails the job.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
             .select(F.col("path").alias("uri"), F.col("length"))
             .where("length > 0"))
    step = block_ids * id_bytes
    # A file gives as many rows as it has blocks, so the expansion follows the bytes.
    blocks = (files.select("uri", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"))
              .repartition(F.col("uri"), F.col("block")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri, length, block in zip(*(batch.column(c).to_pylist() for c in ("uri", "length", "block")), strict=True):
                if length % id_bytes:
                    raise ValueError(f"{uri}: {length} bytes do not divide by {id_bytes}")
                fs, name = open_fs(uri)
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(step, length - block * step), block * step), f"<u{id_bytes}")
                at = np.flatnonzero(ids == separator) + block * block_ids
                out.append((uri, block, length // id_bytes, at, int(at[-1]) if len(at) else -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                 pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.list_(pa.int64())),
                 pa.array([len(r[3]) for r in out], pa.int64()), pa.array([r[4] for r in out], pa.int64())],
                ["uri", "block", "n_ids", "seps", "n_seps", "last_sep"])

    found = blocks.mapInArrow(search, "uri string, block long, n_ids long, seps array<long>, n_seps long, last_sep long")
    found = materialize(found, "scan-blocks")
    found = ordered_prefix(found, ["uri"], "block", "last_sep", "max", "prev_sep", inclusive=False)
    found = ordered_prefix(found, ["uri"], "block", "n_seps", "sum", "before", inclusive=False)
    prev, before = F.coalesce("prev_sep", F.lit(-1).cast("long")), F.coalesce("before", F.lit(0).cast("long"))
    name = F.element_at(F.split("uri", "/"), -1).alias("file")
    seps = (found.select(name, prev.alias("prev"), before.alias("before"), "seps")
            .select("file", "prev", "before", "seps", F.posexplode("seps").alias("k", "sep")))
    begin = F.when(F.col("k") == 0, F.col("prev")).otherwise(F.element_at("seps", F.greatest("k", F.lit(1)))) + 1
    whole = seps.select("file", (F.col("before") + F.col("k")).alias("ordinal"), begin.alias("start"),
                        (F.col("sep") + 1 - begin).alias("n_tokens"), F.lit(True).alias("complete"))
    ends = found.groupBy("uri").agg(F.max("last_sep").alias("last"), F.max("n_ids").alias("n_ids"), F.sum("n_seps").alias("ordinal"))
    rest = (ends.where("last + 1 < n_ids")
            .select(name, "ordinal", (F.col("last") + 1).alias("start"), (F.col("n_ids") - F.col("last") - 1).alias("n_tokens"),
                    F.lit(False).alias("complete")))
    return whole.unionByName(rest)
