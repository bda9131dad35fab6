"""Sketches, peeling and the document query against plain sets."""

import hashlib
import random

import numpy as np

from phasegrid.llm import iblt


def jaccard(a, b):
    x, y = set(iblt.digests(a).tolist()), set(iblt.digests(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_peeling_recovers_differences():
    rng = np.random.default_rng(2)
    left, right = [], []
    for n, m, both in [(0, 0, 5), (1, 0, 3), (3, 4, 100), (40, 60, 10), (700, 900, 50), (0, 0, 0)]:
        shared = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        left.append(np.concatenate([shared, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))
        right.append(np.concatenate([rng.integers(0, 1 << 63, m, dtype=np.uint64), shared]))
    found, width = iblt.differences(left, right)
    for a, b, got in zip(left, right, found):
        assert set(got.tolist()) == set(a.tolist()) ^ set(b.tolist())
    assert width[0] == iblt.CELLS and width[4] > iblt.CELLS     # large differences took larger sketches


def test_repeated_paragraphs_count():
    assert len(set(iblt.digests("same\nsame\nsame\n\nother").tolist())) == 4
    assert iblt.paragraphs("") == [] and iblt.paragraphs(" \n\n ") == []


def prose(rng, n):
    return "\n".join(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 30))) + "." for _ in range(n))


def test_query(spark):
    rng = random.Random(4)
    docs = [(i * 5, prose(rng, rng.randint(0, 12))) for i in range(120)] + [(1000, None), (1001, ""), (1002, "one line without end " * 200)]
    docs[7] = (35, docs[8][1])
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as part", "true as ghost").repartition(5)
    got = {r["doc_id"]: r for r in iblt.fingerprints(df).collect()}
    assert len(got) == len(docs)
    order = sorted(docs, reverse=True, key=lambda d: d[0])
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, row = text or "", following or "", got[doc]
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row["near_edited"] - jaccard(text, edited)) < 1e-12 and abs(row["near_next"] - jaccard(text, following)) < 1e-12
        assert row["edited_fingerprint"] == iblt.texts_of(iblt.sketch([iblt.digests(edited)], iblt.CELLS), [iblt.digests(edited)])[0]
    assert got[35]["fingerprint"] == got[40]["fingerprint"] and got[1000]["fingerprint"] == got[1001]["fingerprint"]


def test_edges(spark):
    one = spark.createDataFrame([(3, "a\nb")], "doc_id long, text string")
    row = iblt.fingerprints(one).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"a\na").hexdigest()
    assert iblt.fingerprints(one.limit(0)).collect() == []
    tied = spark.createDataFrame([(3, "b"), (3, "a"), (3, "a"), (None, "n"), (None, None)], "doc_id long, text string")
    got = iblt.fingerprints(tied).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 1), (3, 1), (3, 1), (3, 1)]
