"""Exact top-k inner-product search with a dual-tree cover-tree traversal.

Rows are dealt into blocks.  A task holds one block of data and one block of queries,
builds a cover tree of each, and walks pairs of nodes.  For all queries below one node
and all data below another, the inner product is at most

    <a, b> + |a| r_b + |b| r_a + r_a r_b

with centres a, b and covering radii r_a, r_b.  A pair is dropped when that is below
the worst kth score among the node's queries.  Blocks leave k rows a query, and the
blocks' rows are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W

from phasegrid.llm.common import F, column

BLOCK_ROWS = 8192
QUERY_ROWS = 4096
LEAF = 48
BASE = 1.3


class CoverTree:
    """Nodes in arrays; the points of a node are one run of ``order``.

    A node covers its points within ``radius`` of ``centre``.  Children are centred on
    points of the node, the first on its own centre (nesting), at least one cover step
    apart (separation), and every point belongs to a child that covers it.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            start = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
            self._build(start)

    def _node(self, centre: int, lo: int, hi: int, far: float) -> int:
        self.centre.append(centre)
        self.radius.append(far)
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.centre) - 1

    def _distance(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(1))

    def _build(self, start: int) -> None:
        all_ = self._distance(self.order, start)
        stack = [(self._node(start, 0, len(self.order), float(all_.max())), all_)]
        while stack:
            node, dist = stack.pop()
            lo, hi = self.span[node]
            far = self.radius[node]
            if hi - lo <= LEAF or far == 0.0:
                continue
            step = far / BASE
            left, left_dist = self.order[lo:hi].copy(), dist
            groups: list[tuple[int, np.ndarray, np.ndarray]] = []
            near = left_dist <= step
            groups.append((self.centre[node], left[near], left_dist[near]))
            left, left_dist = left[~near], left_dist[~near]
            while len(left):
                centre = int(left[np.argmax(left_dist)])
                d = self._distance(left, centre)
                near = d <= step
                groups.append((centre, left[near], d[near]))
                left, left_dist = left[~near], left_dist[~near]
            if len(groups) == 1 or len(groups) * 2 > hi - lo:
                continue    # the points are too even to part: the node stays a leaf
            at = lo
            for centre, members, d in groups:
                self.order[at:at + len(members)] = members
                child = self._node(centre, at, at + len(members), float(d.max(initial=0.0)))
                self.children[node].append(child)
                stack.append((child, d))
                at += len(members)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int,
                counters: dict[str, int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(query id, data id, score) of each query's ``k`` best rows of this block, itself left out.

    Ties go to smaller data ids.  Vectors are integers small enough that float64
    products are exact; others are multiplied as Python integers.
    """
    n = len(queries)
    if not n or not len(data):
        return
    limit = max(float(np.abs(queries).max(initial=0)), 1.0) * max(float(np.abs(data).max(initial=0)), 1.0) * queries.shape[1]
    exact = limit < 2.0 ** 53
    kind = np.float64 if exact else object
    q, d = queries.astype(np.float64), data.astype(np.float64)
    qx, dx = (q, d) if exact else (queries.astype(object), data.astype(object))
    qt, dt = CoverTree(q), CoverTree(d)
    q_norm = np.sqrt((q[qt.centre] ** 2).sum(1))
    d_norm = np.sqrt((d[dt.centre] ** 2).sum(1))
    slack = 1e-9 * (1.0 + limit)
    low = -np.inf
    best = np.full((n, k), low, kind)
    ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    worst = np.full(n, low)
    counters = counters if counters is not None else {}
    counters.update(pairs=0, products=0)

    def bounds(a: int, many: list[int]) -> np.ndarray:
        many_ = np.array(many)
        dots = d[np.array(dt.centre)[many_]] @ q[qt.centre[a]]
        r = np.array([dt.radius[m] for m in many])
        return dots + q_norm[a] * r + d_norm[many_] * qt.radius[a] + qt.radius[a] * r + slack

    def bound(a: int, b: int) -> float:
        return float(bounds(a, [b])[0])

    def group_worst(a: int) -> float:
        lo, hi = qt.span[a]
        return float(worst[qt.order[lo:hi]].min())

    def base_case(a: int, b: int) -> None:
        rows, cols = qt.order[slice(*qt.span[a])], dt.order[slice(*dt.span[b])]
        for at in range(0, len(cols), 4096):
            part = cols[at:at + 4096]
            scores = qx[rows] @ dx[part].T
            counters["products"] += scores.size
            scores = np.where(query_ids[rows][:, None] == data_ids[part][None, :], low, scores)
            both = np.concatenate([best[rows], scores], 1)
            names = np.concatenate([ids[rows], np.broadcast_to(data_ids[part], scores.shape)], 1)
            names = np.where(both == low, np.iinfo(np.int64).max, names)
            top = np.lexsort((names, -both))[:, :k] if exact else np.array(
                [sorted(range(both.shape[1]), key=lambda j, i=i: (-both[i, j], names[i, j]))[:k] for i in range(len(rows))])
            best[rows], ids[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
            worst[rows] = best[rows][:, -1].astype(float)

    heap = [(-bound(0, 0), 0, 0, 0)]
    serial = 0
    while heap:
        negative, _, a, b = heapq.heappop(heap)
        if -negative < group_worst(a):
            continue
        counters["pairs"] += 1
        qs, ds = qt.children[a], dt.children[b]
        if not qs and not ds:
            base_case(a, b)
            continue
        # The wider side is opened; a leaf leaves it to the other.
        open_data = bool(ds) and (not qs or dt.radius[b] >= qt.radius[a])
        if open_data:
            for child, value in zip(ds, bounds(a, ds).tolist(), strict=True):
                if value >= group_worst(a):
                    serial += 1
                    heapq.heappush(heap, (-value, serial, a, child))
        else:
            for child in qs:
                value = bound(child, b)
                if value >= group_worst(child):
                    serial += 1
                    heapq.heappush(heap, (-value, serial, child, b))
    for i in range(n):
        for score, name in zip(best[i].tolist(), ids[i].tolist(), strict=True):
            if score != low:
                yield int(query_ids[i]), int(name), int(score)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` best other rows of each query row by integer inner product: query_id, rank, id, score.

    Components become floor(scale * x), x as double.  Vectors that are null, hold null
    or non-finite components take no part; nor do rows without id.  Vectors of another
    length than a query's are no candidates for it.  Rows that
    repeat an id are rows of their own, no candidates for each other, and share the ``k``
    places of their id.  ``is_query`` is a condition on the id column; queries are compared
    with all rows, in blocks of a bounded number of rows.
    """
    x = column(vector_col).cast("array<double>")
    good = vectors.where(column(id_col).isNotNull() & column(vector_col).isNotNull())
    good = good.select(column(id_col).cast("long").alias("id"), x.alias("v"), is_query.alias("q"))
    good = good.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size("v") > 0))
    # Equal rows give equal results, so no more than k copies of one can be among a query's k best.
    rows = (good.select("id", "q", F.transform("v", lambda c: F.floor(c * scale)).alias("v"))
            .groupBy("id", "v").agg(F.count("*").alias("n"), F.first("q").alias("q"))
            .select("id", "q", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")))
    counts = rows.groupBy().agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("m")).first()
    blocks, query_blocks = -(-counts["n"] // block_rows), -(-(counts["m"] or 0) // query_rows)
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score long"
    if not query_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = F.pmod(F.xxhash64("id", "v", "copy"), F.lit(blocks)).cast("int")
    mine = F.pmod(F.xxhash64("id", "v", "copy"), F.lit(query_blocks)).cast("int")
    data = rows.select("id", "v", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    asked = rows.where("q").select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), mine.alias("query_block"))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        sizes = queries["v"].map(len)
        for size in sorted(set(sizes)):
            some, part = queries[sizes == size], block[block["v"].map(len) == size]
            if len(part):
                found += dual_search(np.stack(some["v"].to_numpy()), some["id"].to_numpy(),
                                     np.stack(part["v"].to_numpy()), part["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["block", "query_block"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, out)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
