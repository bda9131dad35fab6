"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The public model here is a byte-pair model.  Its result is not the segmentation
with the largest score sum, but it has the same forward structure: the last piece
of a prefix's encoding is the one piece whose removal leaves the encoding of a
shorter prefix, and which the merge order keeps apart from that encoding's last
piece.  So a forward pass over prefixes finds it, and prefixes are shared in a trie
of the sorted distinct marked words.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phasegrid.llm.trie import PieceTable, Trie
from phasegrid.llm.word_encoder import WordTable, _Tokens

MARK = "▁"
CACHE_WORDS = 100_000
SUBTREE_CHARS = 1 << 19
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_FAR = np.int64(1) << np.int64(60)
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Pieces of a model file and how each is merged.

    ``rank`` orders merges (earlier first; single characters before all), ``left`` and
    ``right`` are the parts of a piece's last merge.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a byte-pair model with byte fallback is expected")
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model that leaves its text unchanged is expected")
        if not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("a model with a dummy prefix is expected")
        self.strings = [p.piece for p in model.pieces]
        self.byte_ids = np.zeros(256, np.int64)
        self.surface: list[bytes] = []
        normal = {}
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif p.type == NORMAL:
                normal[p.piece] = i
                self.surface.append(p.piece.replace(MARK, " ").encode())
            elif p.type in (CONTROL, UNKNOWN):
                self.surface.append(b" \xe2\x81\x87 " if p.type == UNKNOWN else b"")
            else:
                raise ValueError(f"pieces of type {p.type} are not handled")
        if any(MARK in s.lstrip(MARK) for s in normal):
            raise ValueError("pieces that run across words are not handled")
        order = sorted(normal, key=lambda s: (-model.pieces[normal[s]].score, normal[s]))
        n = len(self.strings)
        self.rank = np.full(n, -1, np.int64)
        for r, s in enumerate(order):
            if len(s) > 1:
                self.rank[normal[s]] = r
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        usable = {}
        for s in order:
            parts = self._last_parts(s, normal) if len(s) > 1 else ()
            if parts is None:
                continue    # the merges never arrive at this piece
            usable[s] = normal[s]
            if parts:
                self.left[normal[s]], self.right[normal[s]] = parts
        self.table = PieceTable(usable)
        self.size = np.array([len(s) for s in self.strings], np.int64)
        self.joined = self._pairs(usable)

    def _last_parts(self, piece: str, normal: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge gives ``piece``, following the merge order."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.rank[normal[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in normal), default=None)
            if best is None:
                return None
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if any(p not in normal for p in parts):
            return None
        return normal[parts[0]], normal[parts[1]]

    @staticmethod
    def _pairs(usable: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (left, right) that concatenate to a piece, as sorted keys, with the piece."""
        keys, pieces = [], []
        for s, i in usable.items():
            for cut in range(1, len(s)):
                a, b = usable.get(s[:cut]), usable.get(s[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    pieces.append(i)
        keys, pieces = np.array(keys, np.int64), np.array(pieces, np.int64)
        order = np.argsort(keys)
        keys, pieces = keys[order], pieces[order]
        bits = np.zeros(1 << 22, bool)
        bits[PieceModel._slot(keys)] = True
        return keys, pieces, bits

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, pieces, bits = self.joined
        out = np.full(len(a), _FAR, np.int64)
        want = a << np.int64(32) | b
        at = np.flatnonzero(bits[self._slot(want)])
        pos = np.minimum(np.searchsorted(keys, want[at]), len(keys) - 1)
        ok = keys[pos] == want[at]
        out[at[ok]] = self.rank[pieces[pos[ok]]]
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of ``a`` followed by ``b`` is those two pieces.

        Seen backwards in time, the symbols next to the border are ``a`` and ``b``, then
        the inner part of whichever was merged last, and so on down to characters.  The
        border holds if no two that stood side by side would merge before one of them
        was merged away; of merges with one rank the leftmost is first.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        gone_a, gone_b = np.full(len(a), _FAR), np.full(len(a), _FAR)
        while len(live):
            q = self._merge_rank(a, b)
            bad = (q < gone_a) & (q <= gone_b) & (q < _FAR)
            ok[live[bad]] = False
            more = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b, gone_a, gone_b = live[more], a[more], b[more], gone_a[more], gone_b[more]
            back_a = self.rank[a] > self.rank[b]
            gone_a, gone_b = np.where(back_a, self.rank[a], gone_a), np.where(back_a, gone_b, self.rank[b])
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
        return ok


class PieceEncoder:
    """Encodes texts; distinct marked words are cached between calls, up to a bound."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        self.model, self.cache_words = PieceModel(path), cache_words
        self.words, self.ids = WordTable(), _Tokens()
        lengths = np.array([len(s) for s in self.model.surface], np.int64)
        self._surface = np.frombuffer(b"".join(self.model.surface), np.uint8)
        self._surface_at, self._surface_len = np.cumsum(lengths) - lengths, lengths

    def forget(self) -> None:
        """Drop the words seen so far."""
        self.words, self.ids = WordTable(), _Tokens()

    def _split(self, text: str) -> list[str]:
        """Marked words without their first mark."""
        return [w[1:] for w in _MARKED.findall(MARK + text.replace(" ", MARK))] if text else []

    def _words(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Marked words of all texts without their first mark, flat, and their numbers by text.

        Texts with single spaces inside only are split by Arrow, the others by pattern.
        """
        texts = texts.fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, f"  |{MARK}|^ | $"), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        rest = [self._split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = plain.value_lengths().to_numpy()
        counts[odd] = [len(r) for r in rest]
        flat = pa.concat_arrays([plain.flatten(), pa.array([w for r in rest for w in r], pa.string())])
        if odd.any():
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            start = np.empty(len(texts), np.int64)
            start[order] = np.cumsum(counts[order]) - counts[order]
            ends = np.cumsum(counts)
            flat = flat.take(pa.array(np.repeat(start - (ends - counts), counts) + np.arange(int(ends[-1]))))
        return flat, counts

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and ids of each text; null and empty texts have none."""
        self.ids.keep(self.words.shrink(self.cache_words))
        words, counts = self._words(texts)
        numbers, fresh = self.words.numbers(words)
        fresh = fresh.to_pylist()
        if fresh:
            order = sorted(range(len(fresh)), key=fresh.__getitem__)
            flat, size = self._viterbi([MARK + fresh[i] for i in order])
            place = np.empty(len(order), np.int64)
            place[np.array(order)] = np.arange(len(order))
            piece = _Tokens()
            piece.add(flat, size)
            self.ids.add(*piece.take(place))
        flat, size = self.ids.take(numbers)
        ends = np.concatenate([[0], np.cumsum(size)])
        docs = np.concatenate([[0], np.cumsum(counts)])
        return flat.astype(np.int64), np.diff(ends[docs])

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted distinct words, subtree by subtree."""
        flats, sizes, start, chars = [], [], 0, 0
        for i, w in enumerate(words):
            chars += len(w)
            if chars >= SUBTREE_CHARS or i + 1 == len(words):
                flat, size = self._subtree(words[start:i + 1])
                flats.append(flat)
                sizes.append(size)
                start, chars = i + 1, 0
        return np.concatenate(flats), np.concatenate(sizes)

    def _subtree(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model, trie = self.model, Trie(words, self.model.table)
        last = np.full(len(trie.parent), -1, np.int64)     # piece that ends a prefix's encoding; -1 at the root
        back = np.ones(len(trie.parent), np.int64)         # its length
        for level in trie.levels():
            open_ = np.arange(len(level))
            for length in range(min(level.depth, model.table.longest), 0, -1):
                at, piece = level.matches(length, open_)
                if not len(at):
                    continue
                before = last[trie.up(at + level.first, length)]
                ok = before < 0
                inner = np.flatnonzero(~ok)
                ok[inner] = model.stay_apart(before[inner], piece[inner])
                node = at[ok] + level.first
                last[node], back[node] = piece[ok], length
                done = np.zeros(len(level), bool)
                done[at[ok]] = True
                open_ = open_[~done[open_]]
                if not len(open_):
                    break
            last[open_ + level.first] = -2                 # a character without a piece: its bytes
        word, node = np.arange(len(words)), trie.ends.copy()
        steps = []
        while len(node):
            steps.append((word, last[node], trie.char[node]))
            node, hops = node.copy(), back[node]
            for k in range(1, int(hops.max()) + 1):
                go = hops >= k
                node[go] = trie.parent[node[go]]
            live = node > 0
            word, node = word[live], node[live]
        word, piece, char = (np.concatenate([s[k] for s in reversed(steps)]) for k in range(3))
        order = np.argsort(word, kind="stable")
        word, piece, char = word[order], piece[order], char[order]
        width = np.where(piece >= 0, 1, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)).astype(np.int64)
        ends = np.cumsum(width)
        out = np.repeat(piece, width)
        unknown = np.flatnonzero(piece < 0)
        if len(unknown):
            raw = np.frombuffer(char[unknown].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            out[np.repeat(piece < 0, width)] = model.byte_ids[raw]
        per = np.zeros(len(words), np.int64)
        np.add.at(per, word, width)
        assert len(ends) == 0 or ends[-1] == len(out)
        return out, per

    def decode_bytes(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 text of each id list; the space of the dummy prefix is left out."""
        n = self._surface_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = self._surface[np.repeat(self._surface_at[ids] - (ends - n), n) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = []
        for a, b in zip(cuts, cuts[1:]):
            out.append(raw[a + 1:b] if b > a and raw[a] == 32 else raw[a:b])
        return out


@functools.lru_cache(1)
def shared_pieces(path: str) -> PieceEncoder:
    return PieceEncoder(path)
