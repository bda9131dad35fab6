"""Removal of long word sequences met in an earlier document, by recompression.

Words become 64-bit symbols.  A round first replaces runs of one symbol, then joins
neighbours of which the first is coloured left and the second right.  New names and
colours are hashes of what they stand for, so they are the same in every task and
document.  A symbol keeps the words on which its making depends; where those lie inside
a repeated passage, the symbol is in every copy of it.  A window's anchor is the symbol
of least name among those of the highest round that depend on nothing outside the
window, so windows with equal words have equal anchors, and shared symbols reveal and
verify repeats.  (A symbol is coloured by its own name, so no pair has twice the same
symbol, and runs need not be named in every round; naming them widens dependences.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phasegrid.llm import windows as win
from phasegrid.llm.common import F, binary_buffer, bounded_slices, materialize, mix64, release, text_sizes

LENGTH = 50
ROUNDS = 5
RUN_EVERY = 3           # rounds in which runs are named
FEW = 4                 # symbols of fewer words are anchors only where a window has no other
CHUNK_BYTES = 1 << 19
PIECE_WORDS = 1 << 17   # words of one text that are named at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words (runs without ASCII white space), and words before each text."""
    dark = ~_SPACE[raw]
    begins = dark.copy()
    begins[1:] &= ~dark[:-1]
    ends = dark.copy()
    ends[:-1] &= ~dark[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] = dark[edge]
    ends[edge - 1] = dark[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_symbols(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix64(win.Prefix(raw).hash(start, stop) ^ mix64((stop - start).astype(np.uint64)))


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix64(a * np.uint64(0xA0761D6478BD642F) + mix64(b + np.uint64(salt)))


class Level:
    """Symbols of a round: name, first word, and the words lo to hi on which each depends."""

    def __init__(self, name: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, last: np.ndarray) -> None:
        self.name, self.at, self.lo, self.hi, self.last = name, at, lo, hi, last    # last: the text ends after it

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether there is a symbol before and after in the same text, and lo before, hi after.

        At the edge of a text the dependence reaches outside: no window holds it.
        """
        has_after = ~self.last
        has_before = np.zeros(len(self.name), bool)
        has_before[1:] = has_after[:-1]
        lo = np.where(has_before, np.roll(self.lo, 1), np.int64(-1))
        hi = np.where(has_after, np.roll(self.hi, -1), np.int64(1) << 62)
        return has_before, has_after, lo, hi

    def runs(self) -> Level:
        has_before, has_after, lo, hi = self._neighbours()
        same = np.zeros(len(self.name), bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & has_before[1:]
        first = np.flatnonzero(~same)
        end = np.append(first[1:], len(self.name)) - 1
        size = end - first + 1
        name = np.where(size > 1, _join(self.name[first], size.astype(np.uint64), 1), self.name[first])
        return Level(name, self.at[first], lo[first], hi[end], self.last[end])

    def pairs(self, turn: int) -> Level:
        has_before, has_after, lo, hi = self._neighbours()
        right = (mix64(self.name + np.uint64(2 * turn + 3)) >> np.uint64(63)).astype(bool)
        joined = np.zeros(len(self.name), bool)      # a pair starts here
        joined[:-1] = ~right[:-1] & right[1:] & has_after[:-1]
        second = np.zeros(len(self.name), bool)
        second[1:] = joined[:-1]
        keep = np.flatnonzero(~second)
        pair = joined[keep]
        mate = np.minimum(keep + 1, len(self.name) - 1)
        name = np.where(pair, _join(self.name[keep], self.name[mate], 2 * turn + 5), self.name[keep])
        # Alone, a left symbol depends on the one after it, a right one on the one before.
        new_lo = np.where(pair | ~right[keep], self.lo[keep], np.minimum(lo[keep], self.lo[keep]))
        new_hi = np.where(pair, np.maximum(self.hi[keep], self.hi[mate]), np.where(right[keep], self.hi[keep], np.maximum(hi[keep], self.hi[keep])))
        new_lo = np.where(pair, np.minimum(new_lo, self.lo[mate]), new_lo)
        return Level(name, self.at[keep], new_lo, new_hi, np.where(pair, self.last[mate], self.last[keep]))


def _preference(level: Level, n: int, height: int) -> np.ndarray:
    """Order in which symbols are taken for anchors: those of several words first, then by name."""
    words = np.diff(level.at, append=n)
    return (level.name >> np.uint64(1)) | (((words < FEW) & (height > 0)).astype(np.uint64) << np.uint64(63))


def _least(value: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Place of the least value in each range ``start <= i < stop``, the leftmost of equals.

    Least places of all ranges of 1, 2, 4, ... are made once; a range is two of these.
    """
    size = stop - start
    best = np.arange(len(value))
    out = np.empty(len(start), np.int64)
    width = 1
    while len(start):
        mine = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(mine):
            a, b = best[start[mine]], best[stop[mine] - width]
            out[mine] = np.where(value[b] < value[a], b, a)
        if width * 2 > size.max(initial=0):
            break
        a, b = best[:len(best) - width], best[width:]
        best = np.where(value[b] < value[a], b, a)
        width *= 2
    return out


def anchors_of(symbols: np.ndarray, docs: np.ndarray, length: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Anchors of the texts laid out in ``symbols``: text, first window, lead, span, name, context digest.

    ``docs`` has the number of words before each text, and of all.  Positions are within the text.
    """
    sizes = np.diff(docs)
    some = np.flatnonzero(sizes >= length)
    if not len(some):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n = len(symbols)
    last = np.zeros(n, bool)
    last[docs[1:][sizes > 0] - 1] = True
    at = np.arange(n)
    level = Level(symbols, at, at, at + 1, last)
    levels = [level]
    for turn in range(rounds):
        level = (level.runs() if turn % RUN_EVERY == 0 else level).pairs(turn)
        levels.append(level)
    count = sizes[some] - length + 1
    first = docs[some]
    window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    text = np.repeat(np.arange(len(some)), count)
    anchor, name = np.full(len(window), -1, np.int64), np.zeros(len(window), np.uint64)
    open_ = np.arange(len(window))
    for height in range(rounds, -1, -1):
        level = levels.pop()        # a level is not needed after its anchors are taken
        # Dependences grow along the text, so the symbols inside a window are neighbours.
        low, high = np.maximum.accumulate(level.lo), np.minimum.accumulate(level.hi[::-1])[::-1]
        from_ = np.searchsorted(low, window[open_])
        to = np.searchsorted(high, window[open_] + length, side="right")
        fits = from_ < to
        which = _least(_preference(level, n, height), from_[fits], to[fits])
        got = open_[fits]
        anchor[got] = level.at[which]
        name[got] = mix64(level.name[which] ^ np.uint64(height + 1))
        open_ = open_[~fits]
        if not len(open_):
            break
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1]) | (window[1:] != window[:-1] + 1) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    start, stop = window[head], window[np.append(head[1:], len(window)) - 1]
    lead, span = anchor[head] - start, stop - start
    prefix = win.Prefix(symbols, win.BASES[1])
    return (some[text[head]], start - docs[some[text[head]]], lead, span, name[head],
            win.context_hash(prefix, start, lead, span, length))


def _word_pieces(docs: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that hold every window: one for several texts, overlapping ones for a long text.

    What a symbol is made of lies inside a piece or reaches outside it, and then no window
    of the piece has it; so a window has the same anchor in any piece that holds it.
    """
    n, at = int(docs[-1]), 0
    while len(docs) == 2 and n - at > PIECE_WORDS:
        yield at, at + PIECE_WORDS
        at += PIECE_WORDS - length + 1
    yield at, n


def anchor_frame(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in bounded_slices(text_sizes(texts), CHUNK_BYTES):
                raw, offsets = binary_buffer(texts.slice(lo, hi - lo))
                start, stop, docs = word_spans(raw, offsets)
                symbols = word_symbols(raw, start, stop)
                for a, b in _word_pieces(docs, length):
                    text, first, lead, span, name, ctx = anchors_of(symbols[a:b], docs if hi - lo > 1 else np.array([0, b - a]), length)
                    yield win.anchor_rows(name, ctx, batch.column("doc"), batch.column("twin"), text + lo, win.pack_place(first + a, lead, span))
            release()

    return rows.mapInArrow(run, win.ANCHORS)


def verify(rows: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """Windows of contexts whose name has several: name, ctx, at, digest.  One representative text a context."""
    by_doc = win.wanted_places(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("wanted")
            for lo, hi in bounded_slices(text_sizes(texts), CHUNK_BYTES):
                raw, offsets = binary_buffer(texts.slice(lo, hi - lo))
                start, stop, docs = word_spans(raw, offsets)
                digest = mix64(win.Prefix(word_symbols(raw, start, stop)).fixed(length)) if len(start) >= length else np.zeros(0, np.uint64)
                part = lists.slice(lo, hi - lo)
                flat = part.flatten()
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                place = flat.field("place").to_numpy()
                begin, _, span = win.unpack_place(place)
                count = span + 1
                inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                take = pa.array(np.repeat(np.arange(len(flat)), count))
                yield pa.RecordBatch.from_arrays(
                    [flat.field("name").take(take), flat.field("ctx").take(take), pa.array(inner.astype(np.int32)),
                     pa.array(digest[np.repeat(docs[row] + begin, count) + inner].view(np.int64))], ["name", "ctx", "at", "digest"])
            release()

    return win.attach(rows, by_doc, keep_all=False).select("text", "wanted").mapInArrow(run, "name long, ctx long, at int, digest long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text when words under windows of an earlier document go.

    doc_id, kept (words joined by a space), n_words, n_removed, removed (from, to word of
    maximal runs).  A window of ``length`` words goes if its words also start in a document
    with a smaller id.  Null texts have no words; a null id is smaller than all; rows with
    one id do not remove each other's words; extra columns are left out.
    """
    if not 1 <= length <= win.MAX_LENGTH:
        raise ValueError("window length out of range")
    rows = win.keyed(docs, id_col, text_col)
    hits = win.shared_anchors(anchor_frame(rows, length), across_docs=True)
    mixed = hits.where("not single")
    classes = win.classes_of(mixed)
    spots = verify(rows, classes, length).join(classes.select("name", "ctx", "low"), ["name", "ctx"])
    spots = materialize(spots, "recompression-windows")
    least = spots.groupBy("name", "digest").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most")
    # Windows of a context with the least document that has them, where that is not the context's own least.
    better = (spots.join(least, ["name", "digest"]).where("least < low").groupBy("name", "ctx")
              .agg(F.collect_list(F.struct("at", "least")).alias("better")))
    marks = classes.select("name", "ctx", "low").join(better, ["name", "ctx"], "left")
    cover = mixed.drop("low").join(marks, ["name", "ctx"]).where("low < doc or better is not null")
    ats = F.when(F.col("low") >= F.col("doc"), F.transform(F.filter("better", lambda b: b["least"] < F.col("doc")), lambda b: b["at"]))
    cover = cover.select("doc", "twin", "place", ats.alias("ats")).where("ats is null or size(ats) > 0")
    # A name whose contexts are all equal: all windows go but in its least document.
    plain = hits.where("single and low < doc").select("doc", "twin", "place", F.lit(None).cast("array<int>").alias("ats"))
    by_doc = cover.unionByName(plain).groupBy("doc", "twin").agg(F.collect_list(F.struct("place", "ats")).alias("marks"))
    by_doc = materialize(by_doc, "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text"), batch.column("marks")
            for lo, hi in bounded_slices(text_sizes(texts), CHUNK_BYTES):
                part = texts.slice(lo, hi - lo)
                raw, offsets = binary_buffer(part)
                start, stop, docs_ = word_spans(raw, offsets)
                n = len(start)
                edge = np.zeros(n + length + 1, np.int32)
                lists = found.slice(lo, hi - lo)
                flat = lists.flatten()
                row = np.repeat(np.arange(hi - lo), lists.fill_null([]).value_lengths().to_numpy())
                begin, _, span = win.unpack_place(flat.field("place").to_numpy().astype(np.int64))
                ats = flat.field("ats")
                whole = np.array(ats.is_null())
                from_ = docs_[row] + begin
                np.add.at(edge, from_[whole], 1)
                np.add.at(edge, from_[whole] + span[whole] + length, -1)
                some = ats.fill_null([])
                at = np.repeat(from_, some.value_lengths().to_numpy()) + some.flatten().to_numpy().astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                off = np.cumsum(edge)[:n] > 0
                kept, runs, gone = [], [], []
                for i in range(hi - lo):
                    a, b = docs_[i], docs_[i + 1]
                    on = ~off[a:b]
                    base = raw[offsets[i]:offsets[i + 1]].tobytes()
                    words = base.split()
                    kept.append(b" ".join(words if on.all() else [w for w, k in zip(words, on.tolist()) if k]))
                    runs.append(np.flatnonzero(np.diff(off[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist())
                    gone.append(int(b - a - on.sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(docs_)),
                     pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), batch.column("twin").slice(lo, hi - lo)],
                    ["doc", "kept", "n_words", "n_removed", "removed", "twin"])
            release()

    out = win.attach(rows, by_doc, keep_all=True).select("doc", "twin", "text", "marks").mapInArrow(
        run, "doc long, kept string, n_words long, n_removed long, removed array<array<long>>, twin long")
    return out.select(F.when(F.col("doc") != win.NO_ID, F.col("doc")).alias("doc_id"), "kept", "n_words", "n_removed", "removed", "twin")


def digest_columns(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, str]]:
    """The same by a table of all windows; for tests.  Ids are distinct."""
    words = {d: (t or "").encode().split() for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i:i + length]), d)
    out = {}
    for d, w in words.items():
        off = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < d:
                off[i:i + length] = [True] * length
        kept = b" ".join(x for x, o in zip(w, off) if not o)
        out[d] = len(w), sum(off), hashlib.sha256(kept).hexdigest()
    return out
