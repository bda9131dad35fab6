"""Components of the n-gram Jaccard join against all pairs."""

import random

import pytest

from phasegrid.llm import group_join as gj


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(30)
    docs = []
    for _ in range(25):
        base = prose(rng.randint(5, 220))
        if rng.random() < 0.5:
            at = rng.randint(0, len(base))
            base[at:at] = passage
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 35))):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = prose(rng.randint(0, 1))
            docs.append(" ".join(copy))
        if rng.random() < 0.3:
            docs.append(" ".join(base).upper() + " ")
    # A chain: neighbours are similar, ends are not.
    chain = prose(120)
    for k in range(8):
        docs.append(" ".join(chain[k * 6:] + prose(k * 6)))
    docs += ["", " \n", "one", "one", "Two words", "two  words", "a b c d e", "a b c d e f", "nbsp word " * 3]
    rng.shuffle(docs)
    return [(i * 2 + 3, d) for i, d in enumerate(docs)] + [(9999, None)]


@pytest.mark.parametrize("seed,wide", [(1, 64), (2, 2), (3, 1), (4, 0)])
def test_matches_all_pairs(spark, seed, wide, monkeypatch):
    monkeypatch.setattr(gj, "WIDE", wide)       # few groups make a token frequent
    monkeypatch.setattr(gj, "SMALL_ROWS", 64 if wide > 1 else 0)
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in gj.link_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == gj.brute_force(docs, 5, 80)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    assert gj.link_groups(empty).collect() == []
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(7, t, 1), (7, t, 2), (None, t, 3), (8, "x", 4), (9, None, 5)], "doc_id long, text string, token int")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in gj.link_groups(df).collect())
    assert got == [(0, 26, None), (7, 26, None), (7, 26, None), (8, 1, 8), (9, 0, 9)]


def test_need_is_a_lower_bound():
    import numpy as np
    n = np.arange(1, 400)
    p = np.minimum(n, n * 25 // 100 + 1)
    for size in n.tolist():
        for other in range(-(-80 * size // 100), min(399, size * 100 // 80) + 1):
            overlap = -(-80 * (size + other) // 180)
            for a in (size, other):
                assert p[a - 1] - (a - min(overlap, a)) >= gj.need(np.array([size]), 80, 5)[0] or p[a - 1] == a
