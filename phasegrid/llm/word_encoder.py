"""Encoding of whole texts with a ``tokenizers`` model, one distinct word at a time.

The models meant here drop white space and never join across it, so the ids of a
text are the ids of its words in order.  Words repeat, so each is given to the
library once per cache life and texts become array lookups.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phasegrid.llm.common import binary_buffer

CACHE_WORDS = 300_000
CACHE_BYTES = 32 << 20
_TAIL = ".,;:!?"


class WordTable:
    """Distinct words seen so far, numbered; kept as one Arrow array."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.uses = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def numbers(self, flat: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
        """Number of each word, and the words seen for the first time in order of their numbers."""
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        known = pc.index_in(distinct, self.words)
        fresh = distinct.filter(known.is_null())
        number = known.fill_null(-1).to_numpy().astype(np.int64)
        number[number < 0] = len(self.words) + np.arange(len(fresh))
        self.words = pa.concat_arrays([self.words, fresh])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        self.uses[number] += 1
        return number[coded.indices.to_numpy()], fresh

    def shrink(self, bound: int) -> np.ndarray | None:
        """Beyond ``bound`` words or CACHE_BYTES, forget those seen in one call only (all, if that is not enough).

        Returns the old numbers of the words that stay, or nothing if all stay.
        """
        if len(self.words) <= bound and self.words.nbytes <= CACHE_BYTES:
            return None
        stay = np.flatnonzero(self.uses > 1)
        size = pc.sum(pc.binary_length(self.words.take(pa.array(stay)))).as_py() or 0
        stay = stay if len(stay) <= bound // 2 and size <= CACHE_BYTES // 2 else stay[:0]
        self.words, self.uses = self.words.take(pa.array(stay)), np.ones(len(stay), np.int64)
        return stay


class _Tokens:
    """Token lists by number, flat."""

    def __init__(self) -> None:
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        ends = np.cumsum(size) + len(self.flat)
        self.start = np.concatenate([self.start, ends - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def keep(self, numbers: np.ndarray | None) -> None:
        """Only these lists stay, renumbered; nothing changes without ``numbers``."""
        if numbers is not None:
            flat, size = self.take(numbers)
            self.flat, self.size = flat, size
            self.start = np.cumsum(size) - size

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[numbers] - (ends - size), size) + np.arange(total)
        return self.flat[at], size


class WordEncoder:
    """``encode(texts)`` gives all ids, flat, and the number of ids of each text.

    ``special_as_text``: strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, cache_words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.cache_words = cache_words
        self._letters: dict[str, bool] = {}     # by last code point, of which there are as many as Unicode has
        self.words, self.word_ids = WordTable(), _Tokens()
        self.stems, self.stem_ids = WordTable(), _Tokens()
        # Models that mark word ends tell where one word of letters stops in a run of ids.
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(self.vocabulary, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    @property
    def vocabulary(self) -> int:
        return self.model.get_vocab_size(with_added_tokens=True)

    def _encode_each(self, words: list[str]) -> None:
        got = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.stem_ids.add(np.fromiter((x for ids in got for x in ids), np.uint32, int(size.sum())), size)

    def _encode_letters(self, words: list[str]) -> bool:
        """Words of letters in one call, cut at closing ids; says whether every word closed once."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return False
        self.stem_ids.add(ids, np.diff(ends, prepend=0))
        return True

    def _ends_in_letter(self, stems: pa.StringArray) -> pa.Array:
        """Whether the last code point of each stem stays a letter when the model normalises it."""
        last = pc.utf8_slice_codeunits(stems, -1, None).dictionary_encode()
        keep = []
        for c in last.dictionary.to_pylist():
            if c not in self._letters:
                made = self.model.normalizer.normalize_str(c) if self.model.normalizer is not None else c
                self._letters[c] = made[-1:].isalpha()
            keep.append(self._letters[c])
        return pa.array(keep, pa.bool_()).take(last.indices)

    def _learn(self, fresh: pa.StringArray) -> None:
        """Ids of words seen for the first time.

        A word of letters before closing punctuation has the ids of both parts, if its
        last letter is still a letter at the end of what the model makes of it (not a
        mark, which would join the punctuation); ASCII letters are encoded in lower
        case, as the model lowers them anyway.
        """
        if not len(fresh):
            return
        stem = pc.utf8_rtrim(fresh, characters=_TAIL)
        letters = pc.and_(pc.utf8_is_alpha(stem), self._ends_in_letter(stem))
        whole = pc.if_else(letters, stem, fresh)
        whole = pc.if_else(pc.and_(letters, pc.string_is_ascii(whole)), pc.ascii_lower(whole), whole)
        cut = np.where(letters.to_numpy(zero_copy_only=False), pc.binary_length(stem).to_numpy(), 0)
        raw, offsets = binary_buffer(fresh)
        lengths = np.where(letters.to_numpy(zero_copy_only=False), np.diff(offsets) - cut, 0)
        at = np.repeat(offsets[:-1] + cut - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        tail = pa.StringArray.from_buffers(len(fresh), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                                           pa.py_buffer(raw[at]))
        both = pa.concat_arrays([whole, tail])
        number, new = self.stems.numbers(both)
        is_word = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
        new = new.to_pylist()
        for a in range(0, len(new), 5000):
            part = new[a:a + 5000]
            some = is_word[a:a + 5000]
            ordered = np.concatenate([np.flatnonzero(some), np.flatnonzero(~some)])
            keep = len(self.stem_ids.size)
            if not (some.any() and self._encode_letters([part[i] for i in np.flatnonzero(some)])):
                ordered = np.arange(len(part))
                self._encode_each(part)
            elif not some.all():
                self._encode_each([part[i] for i in np.flatnonzero(~some)])
            place = np.empty(len(part), np.int64)
            place[ordered] = keep + np.arange(len(part))
            self.stem_ids.start[keep:], self.stem_ids.size[keep:] = self.stem_ids.start[place], self.stem_ids.size[place]
        flat, size = self.stem_ids.take(number.reshape(2, -1).T.ravel())
        self.word_ids.add(flat, size.reshape(-1, 2).sum(1))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        self.word_ids.keep(self.words.shrink(self.cache_words))
        self.stem_ids.keep(self.stems.shrink(self.cache_words))
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        numbers, fresh = self.words.numbers(words.flatten())
        self._learn(fresh)
        flat, size = self.word_ids.take(numbers)
        ends = np.concatenate([[0], np.cumsum(size)])
        docs = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        return flat, np.diff(ends[docs])


@functools.lru_cache(2)
def shared_encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One encoder for the life of a Python worker."""
    return WordEncoder(path, special_as_text)
