"""Mixing sources to target weights by hierarchical budgets.  DataFrame operations only.

Leaves are the distinct values of the level columns, say domain, language, source.
From the top, a node's budget is shared among its children by weight; a child that
cannot use its share leaves the rest to its siblings (again by weight), so a shortage
reaches an ancestor's siblings only after all siblings are full.  Arithmetic is on
whole tokens.  A leaf spends its budget on whole epochs, then on the prefix of one
more epoch in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W

from phasegrid.llm.common import F, materialize

#: Seeded positions are cut into 2**STEP_BITS ranges at each of the two refinements.
STEP_BITS = 12


def words(text: Column) -> Column:
    """Tokens of a text: runs of characters that are not ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def leaf_rows(docs: DataFrame, levels: dict[str, Column], key: Column, text: Column) -> DataFrame:
    """What the mixture needs of each row: key, tie, tokens, levels.  Null level values are one value, ``(none)``."""
    named = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(name) for name, c in levels.items()]
    return docs.select(key.cast("long").alias("key"), tie_of(levels, text).alias("tie"), words(text).alias("tokens"), *named)


def tie_of(levels: dict[str, Column], text: Column) -> Column:
    """Tells rows of one key apart by their content."""
    return F.xxhash64(text, *levels.values())


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Budgets of children: adds ``budget`` to rows with parent, ``child``, ``weight``, ``capacity``, ``total``.

    Sorted by capacity over weight, a child is full if its share of what the fuller ones
    leave covers its capacity; the others share the rest.  Tokens lost to rounding go to
    the first children in order that have room.
    """
    by = W.partitionBy(*parent)
    filled = by.orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), "child")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    # Weights of 0 come last and get nothing.
    d = nodes.withColumn("left_tokens", F.col("total") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).over(before), F.lit(0)))
    d = d.withColumn("left_weight", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    wide = "decimal(19,0)"
    full = (F.col("weight") > 0) & (F.col("capacity").cast(wide) * F.col("left_weight").cast(wide)
                                    <= F.greatest("left_tokens", F.lit(0)).cast(wide) * F.col("weight").cast(wide))
    d = d.withColumn("full", full)
    # What is left for the children that are not full, and their weights.
    d = d.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0)))
    d = d.withColumn("rest_weight", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(by), F.lit(0)))
    part = F.when(F.col("full"), F.col("capacity")).when(
        F.col("weight") > 0, F.expr("(cast(rest as decimal(28,0)) * cast(weight as decimal(10,0))) div cast(rest_weight as decimal(18,0))")
    ).otherwise(F.lit(0))
    d = d.withColumn("budget", part.cast("long"))
    open_ = ~F.col("full") & (F.col("weight") > 0)
    d = d.withColumn("odd", F.col("rest") - F.coalesce(F.sum(F.when(open_, F.col("budget"))).over(by), F.lit(0)))
    rank = F.row_number().over(W.partitionBy(*parent, open_).orderBy("child"))
    d = d.withColumn("budget", F.col("budget") + F.when(open_ & (rank <= F.col("odd")), 1).otherwise(0))
    return d.drop("left_tokens", "left_weight", "full", "rest", "rest_weight", "odd")


def budgets(sizes: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: Column | int, epochs: int,
            default_weight: int = 1) -> DataFrame:
    """Token budget of each leaf: levels, ``tokens``, ``budget``.

    ``sizes`` has a row for each leaf with ``tokens``.  ``weights[level][value]`` are whole
    numbers below a billion; values not named have ``default_weight``.  A leaf can take
    ``epochs`` times its tokens.
    """
    root = "__root"
    leaves = sizes.withColumn("capacity", F.col("tokens") * epochs).withColumn(root, F.lit(0))
    whole = leaves.groupBy(root).agg(F.sum("capacity").cast("long").alias("whole"))
    total = F.lit(total) if isinstance(total, int) else total
    above = whole.select(root, F.least(F.floor(total), F.col("whole")).cast("long").alias("total"))
    for depth, level in enumerate(levels):
        path = [root, *levels[:depth]]
        nodes = leaves.groupBy(*path, level).agg(F.sum("capacity").cast("long").alias("capacity")).withColumn("child", F.col(level))
        weight = F.lit(default_weight)
        if weights.get(level):
            table = F.create_map(*[F.lit(x) for pair in sorted(weights[level].items()) for x in pair])
            weight = F.coalesce(table[F.col(level)], weight)
        nodes = nodes.withColumn("weight", weight.cast("long")).join(above, path)
        above = _share(nodes, path).select(*path, level, F.col("budget").alias("total"))
    return leaves.join(above.withColumnRenamed("total", "budget"), [root, *levels]).select(*levels, "tokens", "budget")


def select(rows: DataFrame, leaves: DataFrame, levels: list[str], seed: int) -> DataFrame:
    """Rows with ``copies`` > 0: how often a document is taken from its leaf's epochs.

    ``rows`` has ``key`` (long), ``tokens``, ``tie`` and the levels.  In the last, partial epoch documents
    come in the order of a seeded hash and are taken while their running sum stays
    within what is left of the budget.  The sum is found by histogram: whole ranges of
    the hash are taken or left, and only the range where the budget ends is refined,
    twice, before its few rows are ordered.
    """
    plan = leaves.select(*levels, F.when(F.col("tokens") > 0, F.expr("budget div nullif(tokens, 0)")).otherwise(0).alias("whole"),
                         F.when(F.col("tokens") > 0, F.expr("budget % nullif(tokens, 0)")).otherwise(0).alias("rest"))
    d = rows.join(plan, levels)
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    d = d.withColumn("order", order)
    d = d.withColumn("r1", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    d = d.withColumn("r2", F.conv(F.substring("order", 4, 3), 16, 10).cast("int"))

    def ends(part: DataFrame, keys: list[str], cell: str, start: Column) -> DataFrame:
        """Where the budget ends: the cell, and the tokens before it."""
        cells = part.groupBy(*keys, cell).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first(start).alias("start"))
        run = F.sum("t").over(W.partitionBy(*keys).orderBy(cell))
        cells = cells.withColumn("to", run + F.col("start"))
        return cells.where("to > rest").groupBy(*keys).agg(F.min_by(F.struct(F.col(cell).alias("cell"), (F.col("to") - F.col("t")).alias("base")), cell).alias("cut"))

    top = ends(d, levels, "r1", F.lit(0)).select(*levels, F.col("cut.cell").alias("c1"), F.col("cut.base").alias("b1"))
    d = d.join(top, levels, "left")
    edge = d.where(F.col("r1") == F.col("c1"))
    low = ends(edge, levels, "r2", F.col("b1")).select(*levels, F.col("cut.cell").alias("c2"), F.col("cut.base").alias("b2"))
    d = d.join(low, levels, "left")
    last = d.where((F.col("r1") == F.col("c1")) & (F.col("r2") == F.col("c2")))
    run = F.sum("tokens").over(W.partitionBy(*levels).orderBy("order", "key", "tie").rowsBetween(W.unboundedPreceding, 0))
    taken = last.withColumn("in_prefix", (F.col("b2") + run <= F.col("rest")) & (F.col("rest") > 0))
    clear = d.where(F.col("c1").isNull() | (F.col("r1") != F.col("c1")) | (F.col("r2") != F.col("c2")))
    clear = clear.withColumn("in_prefix", (F.col("rest") > 0) & (F.col("c1").isNull() | (F.col("r1") < F.col("c1"))
                                                               | ((F.col("r1") == F.col("c1")) & (F.col("r2") < F.col("c2")))))
    both = clear.unionByName(taken)
    copies = (F.col("whole") + F.col("in_prefix").cast("long"))
    return both.withColumn("copies", copies).where("copies > 0").drop("whole", "rest", "order", "r1", "r2", "c1", "b1", "c2", "b2", "in_prefix")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int,
        seed: int, key: Column | None = None, text: Column | None = None) -> DataFrame:
    """Documents of a mixture: key, tie, tokens, the levels, ``copies``.

    The total budget is ``share`` (numerator, denominator) of the tokens of all epochs.
    An empty table gives no rows, an empty text has no tokens and is taken when its place
    in the order is; repeated rows are separate documents, ordered by key and content.
    """
    key = F.col("doc_id") if key is None else key
    text = F.col("text") if text is None else text
    rows = materialize(leaf_rows(docs, levels, key, text), "mix-rows")      # texts are read once
    names = list(levels)
    sizes = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = materialize(budgets(sizes, names, weights, F.expr(f"whole * {share[0]} div {share[1]}"), epochs), "mix-budgets")
    return select(rows, plan, names, seed)
