"""Suffix arrays by two-stage sorting, in memory, for one bounded block of text.

A suffix is of the first kind if it is smaller than its successor, else of the second.
Only the first kind is sorted directly.  The second follows by scanning the buckets of
first characters in order: when a suffix is reached whose preceding character is not
smaller, the suffix starting there is next in that character's bucket.
"""

from __future__ import annotations

import numpy as np


def kinds(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; 0 ends a string and is smaller than all."""
    n = len(text)
    up = np.zeros(n, bool)
    if n < 2:
        return up
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    # Equal neighbours take the kind of the first place after them that differs.
    at = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    up = step[following] > 0
    up[text == 0] = False
    return up


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, first byte highest; past the end is 0."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= padded[k:k + len(text)] << np.uint64(8 * (7 - k))
    return out


def _sort_directly(text: np.ndarray, word: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes, ties by position.

    Groups still equal after eight more bytes are sorted by the next eight.
    """
    ends = np.append(np.flatnonzero(text == 0), len(text))
    stop = ends[np.searchsorted(ends, which)]      # bytes past the end of a string do not count
    order = which.copy()
    group = np.zeros(len(which), np.int64)
    live = np.arange(len(which))
    for at in range(0, depth, 8):
        pos = order[live] + at
        inside = np.maximum(np.minimum(stop[live] - pos, 8), 0)
        key = word[np.minimum(pos, len(text) - 1)]
        shift = ((8 - inside) * 8).astype(np.uint64)
        key = np.where(inside > 0, (key >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0))
        # Old groups are runs of neighbours, so a stable sort by group and key stays inside them.
        by = np.lexsort((key, group[live]))
        order[live], stop[live], key, g = order[live][by], stop[live][by], key[by], group[live][by]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        alone = new & np.append(new[1:], True)
        live = live[~alone]
        if not len(live):
            break
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of all zero-ended strings of ``text``, ordered by ``depth`` bytes at least."""
    text = np.ascontiguousarray(text, np.uint8)
    up = kinds(text)
    word = words_at(text)
    direct = _sort_directly(text, word, np.flatnonzero(up), depth)
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def hand_on(entries: np.ndarray, above: int) -> None:
        before = entries[entries > 0] - 1
        char = text[before]
        later = char > above
        before, char = before[later], char[later]
        if len(before):
            by = np.argsort(char, kind="stable")
            before, char = before[by], char[by]
            edges = np.flatnonzero(np.diff(char, prepend=char[0] - 1 if char[0] else 255))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(char)]):
                waiting[char[a]].append(before[a:b])

    ended = np.flatnonzero(text == 0)
    out.append(ended)
    hand_on(ended, 0)
    for c in range(1, 256):
        induced = list(waiting[c])
        waiting[c] = []
        wave = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
            if len(wave):
                induced.append(wave)
        bucket = np.concatenate([*induced, direct[cuts[c]:cuts[c + 1]]])
        if len(bucket):
            out.append(bucket)
            hand_on(bucket, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix and the one before it in ``order``, up to ``cap``; strings end at 0."""
    word = words_at(text)
    ends = np.append(np.flatnonzero(text == 0), len(text))
    room = ends[np.searchsorted(ends, order)] - order
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    most = np.minimum(np.minimum(room[1:], room[:-1]), cap)
    at = 0
    while len(live) and at < cap:
        a, b = np.minimum(order[live] + at, len(text) - 1), np.minimum(order[live - 1] + at, len(text) - 1)
        differ = word[a] ^ word[b]
        equal = differ == 0
        # Bytes before the first that differs.
        lead = (differ == 0).astype(np.int64)
        for k in range(1, 8):
            lead += differ < np.uint64(1 << (64 - 8 * k))
        out[live] = np.minimum(at + lead, most[live - 1])
        live = live[equal & (out[live] < most[live - 1])]
        at += 8
    return out
