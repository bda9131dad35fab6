"""Finding equal windows of a fixed length across documents without moving the windows.

A document is a sequence of units.  Every window of ``length`` units has one anchor, a
place inside it chosen from its content alone, so equal windows have equal anchors at
equal offsets.  Windows next to each other mostly share their anchor; the stretch they
cover is the anchor's context.  What moves first is a row an anchor: its name, a digest
of its context and its place.  Names met once are dropped, contexts met more than once
are settled, and only names with several different contexts need their content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from phasegrid.llm.common import F, column, materialize, mix64

NO_ID = -(1 << 63)      # stands for a null id
SMALL_ROWS = 1_000_000  # id lists up to this length are broadcast
MAX_LENGTH = 4095       # lead and span share a long with the start

PRIME = (1 << 61) - 1
BASES = (0x15A4E35B7C3D9F21, 0x0B7E151628AED2A6)    # polynomials at two points do not collide together
KEPT_POWERS = (1 << 20) + 1     # powers of a base that a worker keeps; longer texts make their own
_M61, _M31, _M30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_BLOCK = 1 << 15


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2^61 - 1."""
    x = (x & _M61) + (x >> np.uint64(61))
    return np.minimum(x, x - _M61)      # below the prime the difference wraps around and is larger


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, from halves of 31 bits, a block at a time."""
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), _BLOCK):
        x, y = a[i:i + _BLOCK], b[i:i + _BLOCK]
        xh, xl, yh, yl = x >> np.uint64(31), x & _M31, y >> np.uint64(31), y & _M31
        middle = xl * yh + xh * yl
        out[i:i + _BLOCK] = _reduced(((xh * yh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _M30) << np.uint64(31)) + xl * yl)
    return out


def _power_list(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = times(out[:more], np.full(more, pow(base, done, PRIME), np.uint64))
        done += more
    return out


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers of a base modulo 2^61 - 1."""
    if n > KEPT_POWERS:
        return _power_list(base, n)
    if len(_powers.get(base, ())) < n:
        _powers[base] = _power_list(base, min(1 << int(n - 1).bit_length(), KEPT_POWERS))
    return _powers[base][:n]


class Prefix:
    """Hashes of any stretch of a sequence of 64-bit units: a polynomial in a fixed point modulo a prime."""

    def __init__(self, units: np.ndarray, base: int = BASES[0]) -> None:
        n = len(units)
        up, self.down = powers(n + 1, base)[:n], powers(n + 1, pow(base, -1, PRIME))
        self.sums = np.zeros(n + 1, np.uint64)
        if units.dtype == np.uint8:
            # Bytes times halves of 31 bits: sums of a block stay far below 2^64.
            total = np.uint64(0)
            for a in range(0, n, _BLOCK):
                part, unit = up[a:a + _BLOCK], units[a:a + _BLOCK] + np.uint64(1)
                low = np.cumsum((part & _M31) * unit, dtype=np.uint64)
                high = _reduced(np.cumsum((part >> np.uint64(31)) * unit, dtype=np.uint64))
                here = _reduced(_reduced(low) + (((high << np.uint64(31)) & _M61) | (high >> np.uint64(30))) + total)
                self.sums[a + 1:a + 1 + len(part)] = here
                total = here[-1]
            return
        term = times(_reduced(_reduced(units) + np.uint64(1)), up)
        # Sums of halves of 32 and 29 bits fit into 64 for any text.
        low = np.cumsum(term & np.uint64(0xFFFFFFFF), dtype=np.uint64)
        high = np.cumsum(term >> np.uint64(32), dtype=np.uint64)
        self.sums[1:] = _reduced(_reduced(low) + (((high << np.uint64(32)) & _M61) | (high >> np.uint64(29))))

    def _between(self, low: np.ndarray, high: np.ndarray, down: np.ndarray) -> np.ndarray:
        return times(_reduced(high + (_M61 - low)), down)

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self._between(self.sums[start], self.sums[stop], self.down[start])

    def fixed(self, length: int) -> np.ndarray:
        """Hash of every stretch of ``length``."""
        n = len(self.sums) - length
        return self._between(self.sums[:n], self.sums[length:], self.down[:n])


def pack_place(start: np.ndarray, lead: np.ndarray, span: np.ndarray) -> np.ndarray:
    """First window, distance from it to the anchor, number of windows less one."""
    return start.astype(np.int64) << 24 | lead.astype(np.int64) << 12 | span.astype(np.int64)


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 12) & 0xFFF, place & 0xFFF


def context_hash(prefix: Prefix, start: np.ndarray, lead: np.ndarray, span: np.ndarray, length: int) -> np.ndarray:
    """Digest of the units under a context's windows and of where the anchor is among them.

    ``prefix`` is of the second base: with an anchor's name, by the first, classes have some 120 bits.
    """
    raw = prefix.hash(start, start + span + length)
    return mix64(raw ^ mix64((lead.astype(np.uint64) << np.uint64(20)) ^ span.astype(np.uint64) ^ np.uint64(length << 40)))


def twin_of(text: Column) -> Column:
    """What rows of one id are told apart by: 64 bits of their text."""
    return F.xxhash64(text)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, twin, text.  ``twin`` tells rows with one id and different texts apart; rows that
    repeat id and text have equal results anyway.  Null texts are empty."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(column(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), twin_of(text).alias("twin"), text.alias("text"))


def anchor_rows(name: np.ndarray, ctx: np.ndarray, doc: pa.Array, twin: pa.Array, of: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    take = pa.array(of)
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ctx.view(np.int64)), doc.take(take), twin.take(take),
                                       pa.array(place)], ["name", "ctx", "doc", "twin", "place"])


ANCHORS = "name long, ctx long, doc long, twin long, place long"


def shared_anchors(anchors: DataFrame, across_docs: bool) -> DataFrame:
    """Anchors whose name occurs more than once (``across_docs``: in more than one document).

    Adds ``low``, the least document of the name, and ``single``: all its contexts are
    equal.  Names are summed up before they move; a frequent name is one row a task.
    """
    names = anchors.groupBy("name").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"),
                                        F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    names = names.where("low < high" if across_docs else "n > 1").select("name", "low", (F.col("c0") == F.col("c1")).alias("single"))
    # Written first, so that the join has plain shuffles on both sides and a frequent name can be split among tasks.
    names = materialize(names, "shared-names")
    return materialize(anchors.join(names, "name"), "shared-anchors")


def classes_of(mixed: DataFrame) -> DataFrame:
    """One row a context of names that have several: n, ``low`` (least doc) and a representative."""
    classes = mixed.groupBy("name", "ctx").agg(F.count("*").alias("n"), F.min("doc").alias("low"),
                                               F.min(F.struct("doc", "twin", "place")).alias("rep"))
    return materialize(classes, "window-classes")


def wanted_places(classes: DataFrame, *columns: str) -> DataFrame:
    """Representatives by document: doc, twin, ``wanted`` (list, bounded by the text)."""
    flat = classes.select("name", "ctx", *columns, F.col("rep.doc").alias("doc"), F.col("rep.twin").alias("twin"), F.col("rep.place").alias("place"))
    return materialize(flat.groupBy("doc", "twin").agg(F.collect_list(F.struct("name", "ctx", *columns, "place")).alias("wanted")), "wanted-places")


def attach(rows: DataFrame, lists: DataFrame, keep_all: bool) -> DataFrame:
    """Texts with their list; with ``keep_all`` also those without.

    Texts without a list stay where they are if the ids of those with one are few enough
    to be broadcast; otherwise all texts move.  The rows are the same either way.
    """
    ids = lists.select("doc", "twin")
    if ids.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return rows.join(lists, ["doc", "twin"], "left" if keep_all else "inner")
    some = rows.join(F.broadcast(ids), ["doc", "twin"], "left_semi").join(lists, ["doc", "twin"])
    if not keep_all:
        return some
    rest = rows.join(F.broadcast(ids), ["doc", "twin"], "left_anti")
    for field in lists.schema.fields:
        if field.name not in ("doc", "twin"):
            rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    return some.unionByName(rest)


def covered_units(places: np.ndarray, masks: list[bytes | None], length: int, n_units: int) -> np.ndarray:
    """Which units lie under a marked window; a mask of None marks all windows of its place."""
    start, _, span = unpack_place(places)
    edge = np.zeros(n_units + length + 1, np.int32)
    whole = np.array([m is None for m in masks], bool)
    np.add.at(edge, start[whole], 1)
    np.add.at(edge, start[whole] + span[whole] + length, -1)
    for k in np.flatnonzero(~whole).tolist():
        on = np.flatnonzero(np.unpackbits(np.frombuffer(masks[k], np.uint8))[:span[k] + 1]) + start[k]
        np.add.at(edge, on, 1)
        np.add.at(edge, on + length, -1)
    return np.cumsum(edge)[:n_units] > 0
