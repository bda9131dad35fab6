"""Prefix trie of sorted distinct words, with the vocabulary pieces that end at each node.

Words that share a prefix share its nodes, so whatever a caller computes for a node
is computed once for all of them.  The trie is walked subtree by subtree (a run of
neighbouring sorted words), and inside a subtree all nodes of one depth are handled
with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SPARSE = 32            # slots for each piece of a length, so that few other strings pass


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, flat, and word lengths."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat, np.fromiter(map(len, words), np.int64, len(words))


def string_hash(word: str) -> int:
    h = 0
    for c in word:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class PieceTable:
    """Pieces of a vocabulary by length and 64-bit string hash."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.longest = max(map(len, pieces), default=0)
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.longest + 1)]
        for piece, number in pieces.items():
            groups[len(piece)].append((string_hash(piece), number))
        for group in groups:
            group.sort()
            keys = np.array([g[0] for g in group], np.uint64)
            bits = np.zeros(1 << (_SPARSE * len(keys)).bit_length(), bool)
            bits[self._slot(keys, bits)] = True
            self.keys.append(keys)
            self.ids.append(np.array([g[1] for g in group], np.int64))
            self.bits.append(bits)

    @staticmethod
    def _slot(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> np.uint64(32)).astype(np.int64) & (len(bits) - 1)

    def find(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are pieces of ``length``, and the piece numbers."""
        keys = self.keys[length]
        if not len(keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[length][self._slot(h, self.bits[length])])
        pos = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        ok = keys[pos] == h[at]
        return at[ok], self.ids[length][pos[ok]]


class Level:
    """Nodes of one depth: numbers ``first`` and up, their parents and characters."""

    def __init__(self, table: PieceTable, depth: int, first: int, parent: np.ndarray, char: np.ndarray,
                 above: Level | None) -> None:
        self.table, self.depth, self.first, self.parent, self.char = table, depth, first, parent, char
        c = char.astype(np.uint64) + np.uint64(1)
        self.hashes = [c]
        if above is not None:
            up = parent - above.first
            self.hashes += [h[up] * _BASE + c for h in above.hashes[:table.longest - 1]]

    def __len__(self) -> int:
        return len(self.char)

    def matches(self, length: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (by position in the level) whose last ``length`` characters are a piece."""
        if length > len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self.hashes[length - 1]
        at, piece = self.table.find(h if among is None else h[among], length)
        return (at if among is None else among[at]), piece


class Trie:
    """Nodes are numbered by depth from the root, 0; ``ends`` has the node of each word."""

    def __init__(self, words: list[str], table: PieceTable) -> None:
        self.table = table
        self.codes, self.sizes = codes_of(words)
        room = int(self.sizes.sum()) + 1
        self.parent = np.zeros(room, np.int64)
        self.char = np.zeros(room, np.uint32)
        self.ends = np.zeros(len(words), np.int64)
        self.count = 1

    def levels(self) -> Iterator[Level]:
        at = np.cumsum(self.sizes) - self.sizes
        active, depth, above = np.arange(len(self.sizes)), 0, None
        while True:
            active = active[self.sizes[active] > depth]
            if not len(active):
                return
            char, parent = self.codes[at[active] + depth], self.ends[active]
            new = np.ones(len(active), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])
            self.ends[active] = self.count + np.cumsum(new) - 1
            depth += 1
            level = Level(self.table, depth, self.count, parent[new], char[new], above)
            stop = self.count + len(level)
            self.parent[self.count:stop], self.char[self.count:stop] = level.parent, level.char
            self.count, above = stop, level
            yield level

    def up(self, nodes: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            nodes = self.parent[nodes]
        return nodes
