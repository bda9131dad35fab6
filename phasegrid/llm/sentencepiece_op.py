"""Spark operator around the shared-prefix encoder and decoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from phasegrid.llm.common import F, bounded_slices, column, release, text_sizes
from phasegrid.llm.pieces import shared_pieces

CHUNK_BYTES = 1 << 20


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece ids of whole texts: doc_id, n_pieces, ids, n_bytes, round_trip.

    ``round_trip`` tells whether decoding the ids gives the text back, byte for byte; a
    text that itself holds the mark character does not (the model turns it to a space).
    Null and empty texts have no ids; rows with equal ids or texts stay separate rows;
    other columns are left out.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_pieces(model)
        for batch in batches:
            texts = batch.column("text")
            for a, b in bounded_slices(text_sizes(texts), CHUNK_BYTES):
                part = texts.slice(a, b - a)
                ids, counts = encoder.encode(part)
                raw = part.fill_null("").cast(pa.binary())
                same = pc.equal(pa.array(encoder.decode_bytes(ids, counts), pa.binary()), raw)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                     pa.array(text_sizes(raw)), same],
                    ["doc_id", "n_pieces", "ids", "n_bytes", "round_trip"])
            release()
        encoder.forget()        # the model stays with the worker, the words of these texts do not
        release()

    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, n_bytes long, round_trip boolean")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: doc_id, text.  Bytes that are not UTF-8 become replacement characters;
    a null list is an empty text, null ids in a list are skipped."""
    picked = rows.select(column(id_col).cast("long").alias("doc_id"),
                         F.coalesce(F.filter(column(ids_col), lambda x: x.isNotNull()).cast("array<int>"),
                                    F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_pieces(model)
        for batch in batches:
            lists = batch.column("ids")
            sizes = lists.value_lengths().to_numpy()
            texts = encoder.decode_bytes(lists.flatten().to_numpy().astype(np.int64), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t.decode(errors="replace") for t in texts], pa.string())],
                ["doc_id", "text"])

    return picked.mapInArrow(run, "doc_id long, text string")
