"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A sketch is three tables of cells (count, xor of digests, xor of digest checks); each
digest is put into one cell of each.  The difference of two sketches holds only the
digests that one side has alone, and peeling cells that hold a single digest recovers
them.  When peeling stalls, the sketches are made again with more cells.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from phasegrid.llm.common import F, column, mix64

TABLES = 3
CELLS = 8               # cells of each table in the stored fingerprint
FULL = 0.95             # share of used cells beyond which peeling is not tried
GROWTH = 4              # more cells for each retry
LONG = 100              # lines over so many characters are cut into sentences, and those into word runs
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK_CHARS = 2 << 20


def paragraphs(text: str) -> list[str]:
    """Non-empty lines; long ones in sentences; long sentences cut after words whose length 4 divides."""
    out = []
    for line in text.split("\n"):
        if len(line) <= LONG:
            if line.strip():
                out.append(line.strip())
            continue
        for sentence in _SENTENCE.findall(line) or [line]:
            if len(sentence) <= LONG:
                if sentence.strip():
                    out.append(sentence.strip())
                continue
            run: list[str] = []
            for word in sentence.split():
                run.append(word)
                if len(word) % 4 == 0:
                    out.append(" ".join(run))
                    run = []
            if run:
                out.append(" ".join(run))
    return out


def digests(text: str) -> np.ndarray:
    """64-bit digests of a text's paragraphs; the nth copy of a paragraph has its own."""
    seen: dict[bytes, int] = {}
    out = []
    for p in paragraphs(text):
        raw = hashlib.blake2b(p.encode(), digest_size=8).digest()
        n = seen[raw] = seen.get(raw, -1) + 1
        out.append((int.from_bytes(raw, "little") + n * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    return np.array(out, np.uint64)


def _check(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ _STEP) >> np.uint64(32)


def _cells(keys: np.ndarray, width: int) -> np.ndarray:
    """Cell of each key in each table, tables side by side."""
    out = np.empty((TABLES, len(keys)), np.int64)
    for t in range(TABLES):
        salt = np.uint64((0xA0761D6478BD642F * (2 * t + 1) + width) & 0xFFFFFFFFFFFFFFFF)
        out[t] = (mix64(keys ^ salt) % np.uint64(width)).astype(np.int64) + t * width
    return out


class Sketches:
    """Sketches of many texts, one row each."""

    def __init__(self, rows: int, width: int) -> None:
        self.width = width
        self.count = np.zeros((rows, TABLES * width), np.int64)
        self.key = np.zeros((rows, TABLES * width), np.uint64)
        self.check = np.zeros((rows, TABLES * width), np.uint64)

    def add(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(keys)
        for cell in _cells(keys, self.width):
            np.add.at(self.count, (row, cell), sign)
            np.bitwise_xor.at(self.key, (row, cell), keys)
            np.bitwise_xor.at(self.check, (row, cell), check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.width)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, side) of recovered differences, and which rows came out empty.

        Rows whose cells are nearly all in use hold too many differences to peel and are
        left for a larger sketch at once.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero(np.count_nonzero(self.key, 1) <= FULL * self.key.shape[1])
        while len(rows):
            at, cell = np.nonzero(np.abs(self.count[rows]) == 1)
            row = rows[at]
            keys = self.key[row, cell]
            pure = _check(keys) == self.check[row, cell]
            row, keys, sign = row[pure], keys[pure], self.count[row[pure], cell[pure]]
            if not len(row):
                break
            order = np.lexsort((keys, row))
            row, keys, sign = row[order], keys[order], sign[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            row, keys, sign = row[first], keys[first], sign[first]
            found.append((row, keys, sign))
            self.add(row, keys, -sign)
            rows = np.unique(row)     # only these can have become peelable
        clean = ~(self.count.any(1) | self.key.any(1) | self.check.any(1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), clean
        return (*(np.concatenate([f[i] for f in found]) for i in range(3)), clean)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def sketch(sets: list[np.ndarray], width: int) -> Sketches:
    out = Sketches(len(sets), width)
    out.add(*_flat(sets))
    return out


def differences(left: list[np.ndarray], right: list[np.ndarray], width: int = CELLS) -> tuple[list[np.ndarray], list[int]]:
    """Digests that only one side of each pair has, by subtracting and peeling; and the width that did it."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(left)
    used = [0] * len(left)
    todo = np.arange(len(left))
    while len(todo):
        a, b = [left[i] for i in todo], [right[i] for i in todo]
        row, keys, _, clean = sketch(a, width).minus(sketch(b, width)).peel()
        order = np.argsort(row, kind="stable")
        row, keys = row[order], keys[order]
        cuts = np.searchsorted(row, np.arange(len(todo) + 1))
        for k in np.flatnonzero(clean):
            out[todo[k]], used[todo[k]] = keys[cuts[k]:cuts[k + 1]], width
        todo, width = todo[~clean], width * GROWTH
    return out, used


def likeness(left: list[np.ndarray], right: list[np.ndarray], width: int = CELLS) -> np.ndarray:
    """Shared paragraphs over all paragraphs of each pair, by recovered differences; two empty sides are alike."""
    apart, _ = differences(left, right, width)
    total = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], float)
    d = np.array([len(x) for x in apart], float)
    return np.where(total > 0, (total - d) / np.maximum(total + d, 1.0), 1.0)


def texts_of(sketches: Sketches, sets: list[np.ndarray]) -> list[str]:
    """Stored form: number of digests, then counts, digest xors and check xors, base64."""
    n = np.array([len(s) for s in sets], "<u4")
    raw = np.concatenate([n[:, None].view(np.uint8).reshape(len(sets), 4),
                          sketches.count.astype("<i4").view(np.uint8).reshape(len(sets), -1),
                          sketches.key.astype("<u8").view(np.uint8).reshape(len(sets), -1),
                          sketches.check.astype("<u4").view(np.uint8).reshape(len(sets), -1)], 1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows dealt so that each task sees its documents in descending order of id, with the one after its last.

    Ids are cut into ranges at approximate quantiles; a range gets the first document of
    the range below as a ``ghost`` row, the lowest range that of the highest.  Null ids
    come last; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(column(id_col).cast("long").alias("doc_id"),
                       F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1, np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(np.float64), side="left")
        return pd.Series(out)

    rows = rows.withColumn("part", bucket("doc_id"))
    # One row for each range: bounded by the number of ranges.
    tops = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = sorted((r["part"] for r in tops.select("part").collect()), reverse=True)
    above = {p: order[i - 1] for i, p in enumerate(order)}
    if not order:
        return rows.withColumn("ghost", F.lit(False)), parts
    move = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    named = tops.select(F.col("part").alias("top_part"), F.col("top"))
    heads = (rows.join(F.broadcast(named), (F.col("part") == F.col("top_part")) & F.col("doc_id").eqNullSafe(F.col("top")))
             .groupBy("top_part", "doc_id").agg(F.min("text").alias("text"))
             .select("doc_id", "text", move[F.col("top_part")].alias("part"), F.lit(True).alias("ghost")))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(heads)
    return (both.repartition(F.col("part"))
            .sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "text")), parts


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = CELLS) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, and what the sketches say of their likeness.

    The edited text is the text with its last half (rounded down) replaced by as many
    first code points of the next document in descending order of id; the one after the
    last is the first, so a single document is its own next.  Null texts are empty.
    Equal texts have equal fingerprints.  Rows with equal ids follow each other by text.
    """
    rows, _ = with_next(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs"]

    def work(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        texts = [p[1] for p in pairs]
        edited = [t[:len(t) - len(t) // 2] + nxt[:len(t) // 2] for _, t, nxt in pairs]
        own, changed = [digests(t) for t in texts], [digests(t) for t in edited]
        following = own[1:] + [digests(pairs[-1][2])]
        following = [f if i + 1 == len(pairs) or texts[i + 1] == pairs[i][2] else digests(pairs[i][2])
                     for i, f in enumerate(following)]
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(texts_of(sketch(own, width), own), pa.string()),
            pa.array(texts_of(sketch(changed, width), changed), pa.string()),
            pa.array(likeness(own, changed, width)), pa.array(likeness(own, following, width)),
            pa.array([len(s) for s in own], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int | None, str] | None = None
        held: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for doc, text, part, ghost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ghost")), strict=True):
                if last is not None and last[0] == part:
                    held.append((last[1], last[2], text))
                    size += len(last[2]) + 64
                    if size >= CHUNK_CHARS:
                        yield work(held)
                        held, size = [], 0
                last = None if ghost else (part, doc, text)
        if held:
            yield work(held)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double, n_paragraphs long")
