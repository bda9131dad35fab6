"""Repeated word sequences against a table of all windows."""

import random

import pytest

from phasegrid.llm import recompression as rc


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    shared = [prose(25) for _ in range(4)]
    docs = []
    for i in range(70):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        sep = rng.choice([" ", "\n", "  ", "\t"])
        docs.append(sep.join(w for p in parts for w in p))
    docs += docs[:5]
    edited = docs[7].split()
    edited[len(edited) // 2] = "EDIT"
    docs += [" ".join(edited), "", " ", "one", "x " * 90, "x y " * 60, "x " * 30 + "z " + "x " * 40, " ".join(shared[0]), " nbsp em " * 30]
    rng.shuffle(docs)
    return [(i * 3 + 1, d) for i, d in enumerate(docs)] + [(5000, None)]


@pytest.mark.parametrize("length", [1, 8, 20])
def test_matches_brute_force(spark, length):
    docs = corpus(length)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rc.digest_columns(rc.remove_repeats(df, length)).collect()}
    assert got == rc.brute_force(docs, length)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, low int")
    assert rc.digest_columns(rc.remove_repeats(empty)).collect() == []
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(2, t, 1), (2, t, 2), (None, t, 3), (1, None, 4)], "doc_id long, text string, name int")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rc.digest_columns(rc.remove_repeats(df)).collect())
    assert got == [(0, 60, 0), (1, 0, 0), (2, 60, 60), (2, 60, 60)]
