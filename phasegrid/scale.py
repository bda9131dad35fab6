"""Ordered analytics and expansions that never put a whole key into one task.

Spark's window functions sort a full partition key in one task.  The functions
here cut each key into ranges of the ordering column, work inside the ranges,
and carry a per-range summary across them.  The summaries are smaller by the
range width and are handled by the same function again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from phasegrid.functions.numeric import floor_div, idiv

RANGE = 1 << 16


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys (keys are never null here), keeping left's columns once."""
    return left.join(right, keys, "left")


def ordered_prev(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                 width: int = RANGE, levels: int = 2) -> DataFrame:
    """``lag(value)`` by ``keys`` in ``order``; ``order`` is an integer unique per key."""
    bucket, last, carry = f"__{out}_b", f"__{out}_l", f"__{out}_c"
    if levels == 0:
        return df.withColumn(out, F.lag(value).over(W.partitionBy(*keys).orderBy(order)))
    d = df.withColumn(bucket, floor_div(order, width))
    w = W.partitionBy(*keys, bucket).orderBy(order)
    edges = d.groupBy(*keys, bucket).agg(F.max_by(value, order).alias(last))
    edges = ordered_prev(edges, keys, bucket, last, carry, width, levels - 1).drop(last)
    d = d.withColumn(out, F.lag(value).over(w)).withColumn(f"{bucket}f", F.row_number().over(w) == 1)
    return (_join_null_safe(d, edges, keys + [bucket])
            .withColumn(out, F.when(F.col(f"{bucket}f"), F.col(carry)).otherwise(F.col(out)))
            .drop(bucket, carry, f"{bucket}f"))


def ordered_neighbours(df: DataFrame, order: str, width: int = RANGE) -> DataFrame:
    """``df`` with ``prev`` and ``next``, the values before and after in ``order`` (an integer, unique), null at the ends.

    Ranges of ``width`` are sorted by themselves; their ends, a row a range that has
    rows, are put in order by one task.  ``df`` is read twice.
    """
    d = df.withColumn("__range", floor_div(order, width))
    inside, ends = W.partitionBy("__range").orderBy(order), W.partitionBy(F.lit(0)).orderBy("__range")
    edges = d.groupBy("__range").agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    edges = edges.select("__range", F.lag("__high").over(ends).alias("__before"), F.lead("__low").over(ends).alias("__after"))
    return (d.withColumn("prev", F.lag(order).over(inside)).withColumn("next", F.lead(order).over(inside)).join(edges, "__range")
            .select(*df.columns, F.coalesce("prev", "__before").alias("prev"), F.coalesce("next", "__after").alias("next")))


def ordered_prefix(df: DataFrame, keys: list[str], order: str, value: str, how: str, out: str,
                   inclusive: bool = True, width: int = RANGE, levels: int = 2) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` by ``keys`` in ``order`` (unique per key).

    With ``inclusive=False`` the current row is left out and the first row gets null.
    """
    fn = {"sum": F.sum, "max": F.max}[how]
    end = W.currentRow if inclusive else -1
    if levels == 0:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, end)
        return df.withColumn(out, fn(value).over(w))
    bucket, total, carry = f"__{out}_b", f"__{out}_t", f"__{out}_c"
    d = df.withColumn(bucket, floor_div(order, width))
    w = W.partitionBy(*keys, bucket).orderBy(order).rowsBetween(W.unboundedPreceding, end)
    edges = d.groupBy(*keys, bucket).agg(fn(value).alias(total))
    edges = ordered_prefix(edges, keys, bucket, total, how, carry, False, width, levels - 1).drop(total)
    d = _join_null_safe(d.withColumn(out, fn(value).over(w)), edges, keys + [bucket])
    here, before = F.col(out), F.col(carry)
    both = F.greatest(here, before) if how == "max" else (
        F.when(here.isNull() & before.isNull(), None)
        .otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))))
    return d.withColumn(out, both).drop(bucket, carry)


def dense_rank(df: DataFrame, keys: list[str], value: str, out: str, width: int = RANGE) -> DataFrame:
    """0-based dense rank of an integer column by ``keys``, for keys of any size."""
    distinct = df.select(*keys, value).distinct().withColumn("__one", F.lit(1).cast("long"))
    ranks = ordered_prefix(distinct, keys, value, "__one", "sum", out, False, width).drop("__one")
    ranks = ranks.withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))
    return df.join(ranks, keys + [value], "left")


def histogram_positions(df: DataFrame, keys: list[str], value: str, resolution: float,
                        bins_per_range: int = 4096) -> DataFrame:
    """Distinct values by key with their count and the number of smaller values.

    Counting by value first folds repeated values before any shuffle; ranges of
    ``bins_per_range * resolution`` bound what one task sorts.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("hits"))
    rng = "__range"
    counts = counts.withColumn(rng, F.floor(F.col(value) / F.lit(resolution * bins_per_range)))
    w = W.partitionBy(*keys, rng).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranges = counts.groupBy(*keys, rng).agg(F.sum("hits").alias("__n"))
    ranges = ordered_prefix(ranges, keys, rng, "__n", "sum", "__before", False, levels=1)
    ranges = ranges.select(*keys, rng, F.coalesce("__before", F.lit(0)).alias("__before"))
    return (counts.withColumn("__inside", F.coalesce(F.sum("hits").over(w), F.lit(0)))
            .join(ranges, keys + [rng], "left")
            .select(*keys, value, "hits", (F.col("__before") + F.col("__inside")).alias("smaller")))


def explode_range(df: DataFrame, lo, hi, out: str, chunk: int = RANGE) -> DataFrame:
    """One row per integer of ``[lo, hi]``, expanded in two steps.

    The first explode only yields chunk numbers; they are redistributed before
    the second, so that a single ``(lo, hi)`` row does not grow inside one task.
    """
    lo, hi = F.lit(lo) if isinstance(lo, int) else lo, F.lit(hi) if isinstance(hi, int) else hi
    d = (df.withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long"))
         .where(F.col("__hi") >= F.col("__lo"))
         .withColumn("__chunk", F.explode(F.sequence(F.lit(0), idiv(F.col("__hi") - F.col("__lo"), chunk)))))
    first = F.col("__lo") + F.col("__chunk") * chunk
    return (d.repartition("__chunk")
            .withColumn(out, F.explode(F.sequence(first, F.least(F.col("__hi"), first + (chunk - 1)))))
            .drop("__lo", "__hi", "__chunk"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast only after counting that at most ``max_rows`` rows exist.

    The count stops at ``max_rows + 1``.  A larger table is returned as it is and
    joins by shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
