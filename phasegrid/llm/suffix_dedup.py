"""Removal of byte strings that occur more than once, by suffix arrays of anchored pieces.

The anchor of a window is the least hash among its stretches of half its length, the
leftmost if several are equal.  Windows of one name share the anchor's own bytes, so a
context is kept as the bytes before the anchor, a symbol for the anchor, and the bytes
after it; two windows are equal if the suffixes where they start have a common prefix of
the window's length.  Pieces of one name meet in a task, where a suffix array by
two-stage sorting and its adjacent common prefixes find them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phasegrid.llm import windows as win
from phasegrid.llm.common import F, binary_buffer, bounded_slices, materialize, mix64, release, text_sizes
from phasegrid.llm.suffix_array import common_prefixes, suffix_array
from phasegrid.scale import broadcast_if_small

LENGTH = 200
CHUNK_BYTES = 1 << 20   # bytes hashed at once; longer texts are cut into pieces that overlap by a window
BLOCK_BYTES = 3 << 20   # bytes of pieces in one suffix array
GROUP = 4096            # contexts of one name that are sorted together; more are salted
_DIGITS = 4             # bytes of the anchor's symbol after the byte that marks it
_MARK = 255             # no byte of UTF-8 plus one


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by running minima of blocks from both sides."""
    n = len(h)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def _leftmost(h: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value among ``w`` from each start, the leftmost of equals."""
    out = np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 8192):
        part = starts[a:a + 8192]
        out[a:a + 8192] = part + h[part[:, None] + np.arange(w)].argmin(1)
    return out


def anchors_of(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts laid out in ``raw``: text, first window, lead, span, name, context digest.

    Positions are within the text.
    """
    k = length // 2
    w = length - k + 1
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sizes = np.diff(offsets)
    if not len(raw) or sizes.max(initial=0) < length:
        return empty
    prefix = win.Prefix(raw)
    h = mix64(prefix.fixed(k))
    least = _least(h, w)
    # First and last window of each text that has one.
    some = np.flatnonzero(sizes >= length)
    first, last = offsets[some], offsets[some + 1] - length
    inside = np.zeros(len(least) + 1, np.int8)
    inside[first] += 1
    inside[last + 1] -= 1
    valid = np.cumsum(inside[:-1]) > 0
    begins = np.zeros(len(least), bool)
    begins[first] = True
    begins[1:] |= least[1:] != least[:-1]
    start = np.flatnonzero(begins & valid)
    text = np.searchsorted(first, start, side="right") - 1
    stop = np.minimum(np.append(start[1:] - 1, len(least)), last[text])
    place = _leftmost(h, start, w)
    starts, stops, places = [], [], []
    for turn in range(4):
        gone = place < stop       # a window after the anchor has an equal one further on
        starts.append(start)
        stops.append(np.where(gone, place, stop))
        places.append(place)
        start, stop = place[gone] + 1, stop[gone]
        if not len(start):
            break
        if turn < 2:
            place = _leftmost(h, start, w)
            continue
        # Repeats with a short period: every window by itself, then runs of one anchor.
        span = stop - start + 1
        every = np.repeat(start - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        own = _leftmost(h, every, w)
        new = np.ones(len(every), bool)
        new[1:] = (own[1:] != own[:-1]) | (every[1:] != every[:-1] + 1)
        at = np.flatnonzero(new)
        starts.append(every[at])
        stops.append(every[np.append(at[1:], len(every)) - 1])
        places.append(own[at])
        break
    start, stop, place = (np.concatenate(x) for x in (starts, stops, places))
    lead, span = place - start, stop - start
    text = some[np.searchsorted(first, start, side="right") - 1]
    return text, start - offsets[text], lead, span, h[place], win.context_hash(win.Prefix(raw, win.BASES[1]), start, lead, span, length)


def _pieces(sizes: np.ndarray, length: int):
    """(row, from byte, to byte) of texts, long ones cut so that every window lies in one piece."""
    for row, size in enumerate(sizes.tolist()):
        at = 0
        while True:
            stop = min(size, at + CHUNK_BYTES)
            yield row, at, stop
            if stop == size:
                break
            at = stop - length + 1


def anchor_frame(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = binary_buffer(batch.column("text"))
            cut = [p for p in _pieces(np.diff(offsets), length) if p[2] - p[1] >= length]
            sizes = np.array([b - a for _, a, b in cut], np.int64)
            for lo, hi in bounded_slices(sizes, CHUNK_BYTES):
                part = cut[lo:hi]
                flat = np.concatenate([raw[offsets[r] + a:offsets[r] + b] for r, a, b in part])
                text, start, lead, span, name, ctx = anchors_of(flat, np.concatenate([[0], np.cumsum(sizes[lo:hi])]), length)
                row, base = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64)
                yield win.anchor_rows(name, ctx, batch.column("doc"), batch.column("twin"), row[text],
                                      win.pack_place(start + base[text], lead, span))
            release()

    return rows.mapInArrow(run, win.ANCHORS)


def _symbol(number: np.ndarray) -> np.ndarray:
    """Digits 1 to 200 of a group number: bytes that are not 0."""
    out = np.empty((len(number), _DIGITS), np.uint8)
    for k in range(_DIGITS):
        out[:, _DIGITS - 1 - k] = number % 200 + 1
        number = number // 200
    return out


def repeated_windows(group: np.ndarray, lead: np.ndarray, span: np.ndarray, before: list[bytes], after: list[bytes],
                     length: int) -> list[np.ndarray]:
    """Which windows of each piece start with the bytes of another piece's window.

    ``before`` and ``after`` are the bytes next to the anchor, up to the first window's
    start and the last window's end.
    """
    k = length // 2
    depth = length - k + 1 + _DIGITS
    symbols = _symbol(np.unique(group, return_inverse=True)[1])
    parts, starts, at = [], np.empty(len(group), np.int64), 0
    for i in range(len(group)):
        a = np.frombuffer(before[i], np.uint8) + np.uint8(1)
        b = np.frombuffer(after[i], np.uint8) + np.uint8(1)
        parts += [a, np.array([_MARK], np.uint8), symbols[i], b, np.zeros(1, np.uint8)]
        starts[i] = at
        at += len(a) + 1 + _DIGITS + len(b) + 1
    text = np.concatenate(parts)
    order = suffix_array(text, depth)
    shared = common_prefixes(text, order, depth) >= depth
    hit = np.zeros(len(text), bool)
    hit[order[shared]] = True
    hit[order[np.flatnonzero(shared) - 1]] = True
    return [hit[s:s + n + 1] for s, n in zip(starts.tolist(), span.tolist())]


def settle(pieces: DataFrame, length: int) -> DataFrame:
    """Masks of repeated windows, ``name, ctx, mask``, and window digests of salted names.

    ``pieces``: name, salt, salts, ctx, lead, span, before, after.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def solve(rows: list[dict]) -> pa.RecordBatch:
            lead, span = np.array([r["lead"] for r in rows]), np.array([r["span"] for r in rows])
            before, after = [r["before"] for r in rows], [r["after"] for r in rows]
            hits = repeated_windows(np.array([r["name"] for r in rows], np.int64), lead, span, before, after, length)
            names = []
            for i, r in enumerate(rows):
                if r["salts"] > 1:     # other blocks of this name: compare digests of what surrounds the anchor
                    p = win.Prefix(np.frombuffer(before[i] + after[i], np.uint8))
                    at = np.arange(span[i] + 1)
                    digest = mix64(p.hash(at, at + length - length // 2) ^ mix64((lead[i] - at).astype(np.uint64)))
                    names.append(digest.view(np.int64).tolist())
                else:
                    names.append(None)
            return pa.RecordBatch.from_arrays([
                pa.array([r["name"] for r in rows], pa.int64()), pa.array([r["ctx"] for r in rows], pa.int64()),
                pa.array([np.packbits(h).tobytes() if h.any() else None for h in hits], pa.binary()),
                pa.array(names, pa.list_(pa.int64()))], ["name", "ctx", "mask", "digests"])

        for batch in batches:
            for r in batch.to_pylist():
                if size >= BLOCK_BYTES and (r["name"], r["salt"]) != (held[-1]["name"], held[-1]["salt"]):
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["before"]) + len(r["after"]) + 6
        if held:
            yield solve(held)

    dealt = pieces.repartition("name", "salt").sortWithinPartitions("name", "salt")
    return dealt.mapInArrow(run, "name long, ctx long, mask binary, digests array<long>")


def mark_repeats(rows: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """Places with repeated windows: doc, twin, place, mask and ats (both null: all windows)."""
    mixed = hits.where("not single")
    classes = win.classes_of(mixed)
    # Names with so many contexts that they are salted: at most one in GROUP rows.
    large = materialize(classes.groupBy("name").agg(F.count("*").alias("n_ctx")).where(F.col("n_ctx") > GROUP), "large-names")
    sized = classes.join(broadcast_if_small(large, win.SMALL_ROWS), "name", "left").withColumn("n_ctx", F.coalesce("n_ctx", F.lit(1)))
    by_doc = win.wanted_places(sized, "n_ctx")
    k = length // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist()
            for lo, hi in bounded_slices(text_sizes(batch.column("text")), CHUNK_BYTES):
                out: list[tuple] = []
                for i in range(lo, hi):
                    raw = texts[i].as_buffer().to_pybytes()
                    for r in lists[i]:
                        start, lead, span = r["place"] >> 24, (r["place"] >> 12) & 0xFFF, r["place"] & 0xFFF
                        anchor = start + lead
                        salts = -(-r["n_ctx"] // GROUP)
                        out.append((r["name"], (r["ctx"] & 0x7FFFFFFF) % salts, salts, r["ctx"], lead, span, raw[start:anchor],
                                    raw[anchor + k:start + span + length]))
                cols = list(zip(*out)) if out else [[]] * 8
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 ["name", "salt", "salts", "ctx", "lead", "span", "before", "after"])
            release()

    # One text may hold the representatives of many contexts; a document is read once for all of them.
    pieces = win.attach(rows, by_doc, keep_all=False).select("text", "wanted").mapInArrow(
        cut, "name long, salt int, salts int, ctx long, lead int, span int, before binary, after binary")
    solved = materialize(settle(pieces, length), "suffix-blocks")
    # Windows that repeat between blocks of one name.
    far = solved.where("digests is not null").select("name", "ctx", F.posexplode("digests").alias("at", "digest"))
    twice = far.groupBy("name", "digest").agg(F.count("*").alias("n")).where("n > 1").select("name", "digest")
    more = far.join(twice, ["name", "digest"]).groupBy("name", "ctx").agg(F.collect_list("at").alias("ats"))
    ats = F.lit(None).cast("array<int>").alias("ats")
    whole = classes.where("n > 1").select("name", "ctx", F.lit(None).cast("binary").alias("mask"), ats)
    part = (solved.select("name", "ctx", "mask").join(more, ["name", "ctx"], "left")
            .where("mask is not null or ats is not null")
            .join(classes.where("n = 1").select("name", "ctx"), ["name", "ctx"]))
    found = mixed.join(whole.unionByName(part), ["name", "ctx"]).select("doc", "twin", "place", "mask", "ats")
    # A name whose contexts are all equal: every window repeats.
    return found.unionByName(hits.where("single").select("doc", "twin", "place", F.lit(None).cast("binary").alias("mask"), ats))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text when bytes under repeated windows go.

    doc_id, kept (bytes), spans (from, to of maximal removed runs), n_bytes, n_removed.
    A window is removed wherever its bytes start in more than one place, the same text
    included.  Null texts are empty; rows that repeat count as separate places; texts
    shorter than a window stay whole.
    """
    if not 2 <= length <= win.MAX_LENGTH:
        raise ValueError("window length out of range")
    rows = win.keyed(docs, id_col, text_col)
    hits = win.shared_anchors(anchor_frame(rows, length), across_docs=False)
    cover = mark_repeats(rows, hits, length)
    by_doc = materialize(cover.groupBy("doc", "twin").agg(F.collect_list(F.struct("place", "mask", "ats")).alias("marks")), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks_ = batch.column("text").cast(pa.binary()), batch.column("marks")
            for lo, hi in bounded_slices(text_sizes(batch.column("text")), CHUNK_BYTES * 4):
                kept, spans, sizes, gone = [], [], [], []
                for i in range(lo, hi):
                    raw = np.frombuffer(texts[i].as_buffer(), np.uint8)
                    found = marks_[i].as_py() or []
                    masks = []
                    for m in found:
                        mask = m["mask"]
                        if m["ats"]:
                            on = np.zeros((m["place"] & 0xFFF) + 1, bool)
                            on[m["ats"]] = True
                            if mask is not None:
                                on |= np.unpackbits(np.frombuffer(mask, np.uint8))[:len(on)].astype(bool)
                            mask = np.packbits(on).tobytes()
                        masks.append(mask)
                    off = win.covered_units(np.array([m["place"] for m in found], np.int64), masks, length, len(raw))
                    edges = np.flatnonzero(np.diff(off.astype(np.int8), prepend=0, append=0))
                    kept.append(raw[~off].tobytes())
                    spans.append(edges.reshape(-1, 2).tolist())
                    sizes.append(len(raw))
                    gone.append(int(off.sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                     pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["doc", "kept", "spans", "n_bytes", "n_removed"])
            release()

    out = win.attach(rows, by_doc, keep_all=True).select("doc", "text", "marks").mapInArrow(
        run, "doc long, kept binary, spans array<array<long>>, n_bytes long, n_removed long")
    return out.select(F.when(F.col("doc") != win.NO_ID, F.col("doc")).alias("doc_id"), "kept", "spans", "n_bytes", "n_removed")


def digest_columns(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[list[bool]]:
    """Removed bytes of each text, by counting all windows; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        off = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                off[i:i + length] = [True] * length
        out.append(off)
    return out


__all__ = ["anchors_of", "brute_force", "digest_columns", "remove_repeats", "repeated_windows"]
