"""The hidden Markov model against plain recursions in Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from phasegrid.llm import hidden_markov as hm
from phasegrid.llm import hmm

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(seqs, emit, first, moves):
    """Log likelihoods and expected counts, one step at a time."""
    k = len(first)
    logs, start, trans, syms = [], np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k))
    for q in seqs:
        a, c = [], []
        for t, o in enumerate(q):
            x = (first if t == 0 else a[-1] @ moves) * emit[o]
            c.append(x.sum())
            a.append(x / x.sum())
        b = [np.ones(k)]
        for o, s in zip(q[:0:-1], c[:0:-1]):
            b.insert(0, moves @ (emit[o] * b[0]) / s)
        logs.append(sum(map(math.log, c)))
        start += a[0] * b[0]
        for t, o in enumerate(q):
            syms[o] += a[t] * b[t]
            if t:
                trans += np.outer(a[t - 1], emit[o] * b[t]) * moves / c[t]
    return np.array(logs), start, trans, syms


@pytest.mark.parametrize("segment,batch", [(2048, 400_000), (3, 40), (7, 10)])
def test_recursions(monkeypatch, segment, batch):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "BATCH", batch)
    rng = np.random.default_rng(segment)
    first, moves, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.uniform(.01, 1, (6, 3))
    seqs = [rng.integers(0, 6, n).tolist() for n in [1, 9, 2, 30, 1, 7, 100, 3, 14]]
    logs, start, trans, syms = plain(seqs, emit, first, moves)
    got, counts = hmm.sequences(np.concatenate(seqs), np.array([len(s) for s in seqs]), emit, first, moves, True)
    assert np.allclose(got, logs) and np.allclose(counts.first, start)
    assert np.allclose(counts.moves, trans) and np.allclose(counts.symbols, syms)
    alone, none = hmm.sequences(np.concatenate(seqs), np.array([len(s) for s in seqs]), emit, first, moves, False)
    assert np.array_equal(alone, got) and none is None


def test_likelihood_sums_over_paths():
    first, moves = np.array([.6, .4]), np.array([[.7, .3], [.2, .8]])
    emit = np.array([[.5, .1], [.5, .9]])
    total = sum(math.exp(hmm.sequences(np.array([a, b, c]), np.array([3]), emit, first, moves, False)[0][0])
                for a in (0, 1) for b in (0, 1) for c in (0, 1))
    assert total == pytest.approx(1)


def corpus(seed, n=150):
    rng = random.Random(seed)
    tongues = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    docs = [" ".join(rng.choice(tongues[i % 3][:rng.choice([5, 40])]) for _ in range(rng.randint(0, 60))) for i in range(n)]
    return [(i, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (None, "X1 x1\tunknownword"), (5, "x1 y2"), (902, "  ")]


def expected(docs, own):
    out = {i % 7: 0 for i in range(7)}
    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [""] for _, t in docs]
    c = Counter(w for (i, _), ws in zip(docs, tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = []
    for (i, _), ws in zip(docs, tokens):
        rows.append((held(i), len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)))
    return rows, tokens, c, out


def test_counts_and_base(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    got = hm.scores(df, hm.held_out_of(), rounds=1).collect()
    rows, *_ = expected(docs, 5)
    key = lambda r: (str(r[0]), r[1:5], round(r[5], 6))
    assert sorted(key(tuple(r)[:6]) for r in got) == sorted(key((i, *r)) for (i, _), r in zip(docs, rows))


def test_probabilities_and_training(spark, monkeypatch):
    """The trained model's score equals plain recursions over the same probabilities, and held-out texts gain."""
    docs = corpus(2, 400)
    total = expected(docs, 12)[0][0][3]
    monkeypatch.setattr(hm, "OWN_PART", total // 12)
    own = -(-total // (total // 12))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    kept = {}
    real = hm.train
    def spy(texts, symbols, total, states, rounds):
        counts, now = real(texts, symbols, total, states, rounds)
        kept.update(counts={r["symbol"]: np.array([r[s] for s in hm.names(states)]) for r in counts.collect()}, now=now, total=total)
        return counts, now
    monkeypatch.setattr(hm, "train", spy)
    got = hm.scores(df, hm.held_out_of(), states=4, rounds=6).collect()
    rows, tokens, c, _ = expected(docs, 12)
    def symbol(w):
        return "e" if w == "" else "w" + w if c[w] >= own else "r" + w[-2:]
    z = Counter()
    for w, k in c.items():
        z[symbol(w)] += k + 1
    names = sorted({symbol(w) for ws in tokens for w in ws})
    emit = hm.emissions(np.array([kept["counts"].get(s, np.zeros(4)) for s in names]), kept["now"], kept["total"])
    logs, *_ = plain([[names.index(symbol(w)) for w in ws] for ws in tokens], emit, kept["now"].first, kept["now"].moves)
    want = [x / math.log(10) + sum(math.log10((c[w] + 1) / (z[symbol(w)] + 1)) for w in ws if symbol(w)[0] == "r") for x, ws in zip(logs, tokens)]
    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    theirs = sorted((str(i), len(ws), s) for (i, _), ws, s in zip(docs, tokens, want))
    assert [m[:2] for m in mine] == [t[:2] for t in theirs] and np.allclose([m[2] for m in mine], [t[2] for t in theirs])
    seen = {s: kept["counts"][s] for s in kept["counts"]}
    whole = hm.emissions(np.array([*seen.values(), np.zeros(4)]), kept["now"], kept["total"]).sum(0)
    assert np.allclose(whole, 1, atol=1e-6)        # symbols and one never met
    held = [r for r in got if r["held_out"]]
    gain = sum(r["score"] for r in held) - sum(r["base_score"] for r in held)
    assert gain > .15 * sum(r["n_tokens"] for r in held)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hm.scores(none, hm.held_out_of()).collect() == []
    row = hm.scores(spark.createDataFrame([(1, "A b")], "doc_id long, text string"), hm.F.lit(True)).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["base_score"] == 0 and math.isfinite(row["score"])


def test_packing():
    codes = np.array([0, 1, 65534, 65535, 65536, 9, 400000])
    narrow, wide = hm.pack(codes, np.array([3, 0, 4]))
    back, size = hm.unpack(narrow.slice(1), wide.slice(1))
    assert back.tolist() == codes[3:].tolist() and size.tolist() == [0, 4]
