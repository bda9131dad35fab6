"""Dual-tree search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm.cover_tree import CoverTree, dual_search, top_k


def all_pairs(queries, query_ids, data, data_ids, k):
    out = []
    for q, qi in zip(queries.tolist(), query_ids.tolist()):
        rows = [(-sum(x * y for x, y in zip(q, d)), di) for d, di in zip(data.tolist(), data_ids.tolist()) if di != qi]
        out += [(qi, di, -s) for s, di in sorted(rows)[:k]]
    return sorted(out)


def clustered(rng, n, dim):
    centres = rng.normal(size=(max(2, n // 60), dim)) * 200
    return np.floor(centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * 5).astype(np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_match_all_pairs(seed):
    rng = np.random.default_rng(seed)
    data = clustered(rng, 700, 4 + seed)
    data[50:150] = data[50]                    # many equal vectors
    ids = rng.permutation(700)
    rows = ids % 10 == 0
    counters: dict[str, int] = {}
    assert sorted(dual_search(data[rows], ids[rows], data, ids, 5, counters)) == all_pairs(data[rows], ids[rows], data, ids, 5)
    if seed == 0:
        assert counters["products"] < 0.7 * rows.sum() * 700      # pairs of nodes were pruned


def test_large_components_stay_exact():
    data = np.array([[2 ** 40, 1], [2 ** 40, 2], [1, 2 ** 40]])
    ids = np.array([1, 2, 3])
    assert sorted(dual_search(data, ids, data, ids, 2)) == all_pairs(data, ids, data, ids, 2)


def test_tree_covers_and_nests():
    points = clustered(np.random.default_rng(3), 900, 5).astype(float)
    tree = CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(900)) and len(tree.centre) > 1
    for node, children in enumerate(tree.children):
        lo, hi = tree.span[node]
        far = np.sqrt(((points[tree.order[lo:hi]] - points[tree.centre[node]]) ** 2).sum(1))
        assert far.max() <= tree.radius[node] + 1e-9
        if children:
            assert tree.centre[children[0]] == tree.centre[node]
            assert [tree.span[c][0] for c in children] == [lo] + [tree.span[c][1] for c in children[:-1]]


def test_operator(spark):
    rng = np.random.default_rng(9)
    vectors = clustered(rng, 300, 6) / 256.0
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)] + [
        (500, None, 1), (550, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (600, [float("nan")] + [0.0] * 5, 1), (650, [float("inf")] + [0.0] * 5, 1),
        (None, [1.0] * 6, 1), (700, [], 1), (800, [1.0, 2.0], 1), (801, [3.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=4)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    ids = np.arange(300)
    whole = np.floor(vectors * 256).astype(np.int64)
    want = all_pairs(whole[ids % 50 == 0], ids[ids % 50 == 0], whole, ids, 5) + [(800, 801, 256 * 256 * 11)]
    assert sorted((r[0], r[2], r[3]) for r in got.collect()) == sorted(want)
    assert all(r["rank"] in range(1, 6) for r in got.collect())
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(4)
    whole = clustered(rng, 200, 4)
    ids = np.arange(200) // 2                   # every id twice, with vectors of its own
    whole = np.concatenate([whole, np.repeat(whole[-1:], 8, 0)])    # and one row nine times
    ids = np.concatenate([ids, np.repeat(ids[-1:], 8)])
    df = spark.createDataFrame([(int(i), (v / 256.0).tolist()) for i, v in zip(ids, whole)], "vec_id long, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 33 == 0, block_rows=64, query_rows=4)
    want = []
    for q in range(0, 100, 33):
        pairs = [(-int(a @ b), int(i)) for a in whole[ids == q] for b, i in zip(whole, ids) if i != q]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(pairs)[:5], 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
