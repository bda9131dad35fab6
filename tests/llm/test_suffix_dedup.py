"""Repeated byte strings against counting all windows."""

import hashlib
import random

import pytest

from phasegrid.llm import suffix_dedup as sd
from phasegrid.llm import windows as win


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(20) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [prose(rng.randint(0, 30)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        out.append(" ".join(parts))
    out += out[:5] + [out[7][:40] + "X" + out[7][41:], out[8][30:] + "tail"]
    out += ["", "a" * 300, "ab" * 120, "a" * 130 + "b" + "a" * 130, "xyz " * 40, "\0" * 90, "=" * 45]
    return out


@pytest.mark.parametrize("length", [24, 40])
def test_matches_brute_force(spark, length, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 3)         # names with many contexts go through salted blocks
    docs = [(i, t) for i, t in enumerate(texts(length))] + [(900, None), (None, texts(length)[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in sd.remove_repeats(df, length).collect()}
    assert len(got) == len(docs)
    raw = [(t or "").encode() for _, t in docs]
    for (doc, _), t, off in zip(docs, raw, sd.brute_force(raw, length)):
        row = got[doc]
        assert bytes(row["kept"]) == bytes(b for b, o in zip(t, off) if not o), doc
        assert (row["n_bytes"], row["n_removed"]) == (len(t), sum(off))
        runs = [(a, b) for a, b in map(tuple, row["spans"])]
        assert sum(b - a for a, b in runs) == sum(off)
        assert all(a < b for a, b in runs) and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 500)
    rng = random.Random(5)
    long = "".join(rng.choice("abcd") for _ in range(2600))
    docs = [(1, long), (2, long[700:1400]), (3, "q" * 60)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 40).collect()}
    raw = [t.encode() for _, t in docs]
    want = [bytes(b for b, o in zip(t, off) if not o) for t, off in zip(raw, sd.brute_force(raw, 40))]
    assert [got[1], got[2], got[3]] == want


def test_empty_extra_columns_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, name string, marks int")
    assert sd.digest_columns(sd.remove_repeats(empty)).collect() == []
    t = "the quick brown fox " * 3 + "jumps over"
    df = spark.createDataFrame([(1, t, "a", 1), (1, t, "b", 2)], "doc_id long, text string, name string, place int")
    rows = sd.digest_columns(sd.remove_repeats(df, 50)).collect()
    assert [(r["n_removed"], r["kept_sha256"]) for r in rows] == [(len(t), hashlib.sha256(b"").hexdigest())] * 2


def test_place_packing():
    import numpy as np
    a = np.array([0, 5, 1 << 30]), np.array([0, 7, 4095]), np.array([1, 0, 4095])
    assert all((x == y).all() for x, y in zip(win.unpack_place(win.pack_place(*a)), a))
