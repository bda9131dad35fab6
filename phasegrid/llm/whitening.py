"""Whitening of vectors by exact moments and the exact characteristic polynomial.

Entries become integers, so counts, sums and products over the distinct vectors are
exact.  Tasks sum blocks of rows as small matrices, Spark adds the matrices cell by
cell.  The polynomial of the scatter matrix is found modulo primes, one prime a row of
a DataFrame; what reaches the driver has the size of the matrix or of its polynomial,
never of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from phasegrid.llm import exact_roots as roots
from phasegrid.llm.common import F, column, materialize

SCALE = 256
LIMB = 30           # bits of the pieces in which exact sums travel
BLOCK = 4096        # rows multiplied at once
_LONG = 1 << 63


@dataclass
class Whitening:
    """n and S of the distinct vectors, trace of n * n * covariance, unit vectors, roots of that matrix as doubles."""

    n: int
    sums: list[int]
    trace: int
    vectors: np.ndarray     # component by dimension
    explained: list[float]
    deviations: list[float]     # standard deviation along each component


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of long) of rows whose vector has entries, all finite.

    Rows with a null vector, a null, infinite or NaN entry, or no entries take no part.
    Repeated and null ids stay rows of their own; other columns are dropped.  Entries
    beyond a long are held at its ends.
    """
    v = column(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))).select(column(id_col).alias("vec_id"), x.alias("x"))


def usual_width(vectors: DataFrame) -> int | None:
    """Number of entries most rows have, the smaller of equals; None without rows."""
    row = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return None if row is None else row["d"]


def matrix_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(len(batch), width)


def products(x: np.ndarray) -> np.ndarray:
    """x'x of a block of longs, exact: in doubles, longs or Python integers, as its entries allow."""
    big = max(int(x.max()), -int(x.min()), 1)
    if big * big * len(x) < 1 << 53:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64)
    return x.T @ x if big * big * len(x) < _LONG else x.astype(object).T @ x.astype(object)


def moments(distinct: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and sums of products over all rows, exact at any size of entries."""
    size = width + 1
    upper = np.triu_indices(size)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        seen = False
        for batch in batches:
            x = matrix_of(batch, width)
            for a in range(0, len(x), BLOCK):
                part = x[a:a + BLOCK]
                # a column of ones makes the count and the sums cells of the same matrix
                total += products(np.concatenate([np.ones((len(part), 1), np.int64), part], 1))
                seen = True
        if not seen:
            return
        cells, limb = total[upper], 0
        while True:
            last = all(-(1 << LIMB) < c < 1 << LIMB for c in cells)
            now = cells if last else cells & ((1 << LIMB) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                                              pa.array(np.full(len(now), limb), pa.int32()), pa.array(now.astype(np.int64))],
                                             ["i", "j", "limb", "v"])
            if last:
                return
            cells, limb = cells >> LIMB, limb + 1

    cells = distinct.mapInArrow(blocks, "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    full = [[0] * size for _ in range(size)]
    for r in cells.toLocalIterator():       # (width + 1)^2 cells of a few limbs
        full[r["i"]][r["j"]] += r["v"] << (LIMB * r["limb"])
    for i in range(size):
        for j in range(i):
            full[i][j] = full[j][i]
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, highest power first, of a symmetric integer matrix without negative roots."""
    size = len(matrix)
    primes = roots.enough_primes(roots.coefficient_bound(sum(matrix[i][i] for i in range(size)), size))
    shared = spark.sparkContext.broadcast(matrix)       # the size of the matrix

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shared.value, object)
        for batch in batches:
            rows = [roots.polynomial_mod(whole, p) for p in batch.column("prime").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("prime"), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))],
                                             ["prime", "coefs"])

    frame = spark.createDataFrame([(i, p) for i, p in enumerate(primes)], "i int, prime long")
    frame = frame.repartitionByRange(min(len(primes), 64), "i").select("prime")
    found = {r["prime"]: r["coefs"] for r in frame.mapInArrow(reduce, "prime long, coefs array<long>").collect()}
    return roots.recombine(primes, np.array([found[p] for p in primes], np.int64))


def fit(distinct: DataFrame, width: int, components: int) -> Whitening:
    """Components of the covariance of distinct integer vectors by falling variance; fewer, if its rank is less."""
    n, sums, cross = moments(distinct, width)
    scatter = [[n * cross[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]     # n * n * covariance
    trace = sum(scatter[i][i] for i in range(width))
    if not trace:
        return Whitening(n, sums, 0, np.zeros((0, width)), [], [])
    coefs = characteristic_polynomial(distinct.sparkSession, scatter)
    found, vectors = roots.top_components(scatter, coefs, components)
    explained = [roots.ratio(value, trace << power) for value, power in found]
    # sqrt(e) with e = root / n^2, from the square root of a wide integer
    deviations = [roots.ratio(roots.math.isqrt(value << (2 * roots.GUARD + power)), n << (roots.GUARD + power)) for value, power in found]
    return Whitening(n, sums, trace, vectors, explained, deviations)


def deviation_of(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S)^2 of each row; null where a long cannot hold it."""
    biggest = n * max(int(np.abs(x.astype(float)).max(initial=0)), 1) + max(map(abs, sums))
    if biggest * biggest * x.shape[1] < _LONG // 2:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v < _LONG else None for v in (d * d).sum(1)]


def projected(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened coordinates of every row."""
    width = len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        whole = np.array([s // m.n for s in m.sums], np.int64)
        part = np.array([roots.ratio(s % m.n, m.n) for s in m.sums])
        for batch in batches:
            x = matrix_of(batch, width)
            centred = (x - whole).astype(float) - part
            y = (centred @ m.vectors.T) / np.array(m.deviations)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation_of(x, m.n, m.sums), pa.int64()),
                                              pa.array(y.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit rows' covariance minus the identity."""
    k = len(model.deviations)
    y = projected(distinct.select(F.lit(None).cast("long").alias("vec_id"), "x"), model).select("whitened")
    cell: list[Column] = [F.sum(F.col("whitened")[i]).alias(f"s{i}") for i in range(k)]
    cell += [F.sum(F.col("whitened")[i] * F.col("whitened")[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    r = y.agg(*cell).first()
    mean = [r[f"s{i}"] / model.n for i in range(k)]
    return max(abs(r[f"p{i}_{j}"] / model.n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(rows: DataFrame, components: int = 4, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The covariance is that of the distinct integer vectors.  Components are numbered by
    falling variance; directions without variance have none, so a table whose vectors
    are all equal, or that has none, gives no rows.  Among equal variances any
    directions at right angles may be meant; the ones given are the same for all rows.
    A direction's sign is that of its largest entry.  Vectors with another number of
    entries than most have (the smaller number, if equally many) take no part.
    """
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    width = usual_width(vectors)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = rows.sparkSession.createDataFrame([], schema)
    if width is None:
        return nothing
    vectors = vectors.where(F.size("x") == width)
    distinct = materialize(vectors.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, width, components)
    if not model.deviations:
        return nothing
    error = identity_error(distinct, model)
    explained = F.element_at(F.array(*[F.lit(e) for e in model.explained]), F.col("component"))
    return (projected(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
            .withColumn("component", F.col("place") + 1)
            .select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    explained.alias("explained"), F.lit(error).alias("identity_error")))
