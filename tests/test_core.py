"""Configuration, ordered helpers and scalar functions."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from phasegrid import scale
from phasegrid.config import ArrayConfig, nearest_multiple
from phasegrid.functions import numeric as N, text


def test_nearest_multiple_halves_away_from_zero():
    assert nearest_multiple(32, 64) == (64, -32)
    assert nearest_multiple(-32, 64) == (-64, 32)
    assert nearest_multiple(133, 64) == (128, 5)
    assert nearest_multiple(-7, 4) == (-8, 1)
    assert nearest_multiple(0, 8) == (0, 0)


def test_config_rejects_bad_shapes():
    good = dict(channels=1, fpgas=2, recv_per_fpga=2, steps=8, packets=4)
    cfg = ArrayConfig(**good, fpga_ids=(3, 9), fpga_delays={9: 17})
    assert cfg.split_delays() == {3: (0, 0), 9: (16, 1)}
    assert cfg.receivers == 4 and cfg.baselines == 10 and cfg.packets_per_block == 8
    for bad in ({"channels": 0}, {"fpgas": 300}, {"fpga_ids": (1, 1)}, {"fpga_delays": {7: 1}}):
        with pytest.raises(ValueError):
            ArrayConfig(**{**good, **bad})


@settings(max_examples=200, deadline=None)
@given(st.integers(-10 ** 12, 10 ** 12), st.integers(1, 10 ** 6))
def test_nearest_multiple_property(x, k):
    closest, rest = nearest_multiple(x, k)
    assert closest % k == 0 and closest + rest == x and 2 * abs(rest) <= k


def test_column_arithmetic_matches_python(spark):
    xs = [-129, -128, -97, -64, -33, -32, -1, 0, 1, 31, 32, 63, 64, 2 ** 60 + 1, -(2 ** 60) - 1]
    d = spark.createDataFrame([(x,) for x in xs], "x long")
    closest, rest = N.nearest_multiple("x", 64)
    rows = d.select("x", N.floor_div("x", 64).alias("f"), closest.alias("c"), rest.alias("r")).collect()
    for r in rows:
        assert r["f"] == r["x"] // 64
        assert (r["c"], r["r"]) == nearest_multiple(r["x"], 64)


def test_baseline_index_round_trip(spark):
    d = spark.range(210).select(F.col("id").cast("int").alias("b"))
    i, j = N.baseline_receivers("b", 20)
    rows = d.select("b", i.alias("i"), j.alias("j"), N.baseline_index(i, j).alias("back")).collect()
    assert all(r["back"] == r["b"] and 0 <= r["i"] <= r["j"] < 20 for r in rows)
    assert len({(r["i"], r["j"]) for r in rows}) == 210


def test_gain_inversion_rules(spark):
    d = spark.createDataFrame([(3.0, 4.0), (0.0, 0.0), (1e-7, 0.0)], "re double, im double")
    a = d.select(*[c.alias(n) for c, n in zip(N.inverse_gain("re", "im"), ("re", "im"))]).collect()
    assert [(round(r.re, 3), round(r.im, 3)) for r in a] == [(0.12, -0.16), (1.0, 0.0), (1.0, 0.0)]
    b = d.select(*[c.alias(n) for c, n in zip(N.inverse_gain("re", "im", keep_tiny=True), ("re", "im"))]).collect()
    assert b[2].re == pytest.approx(1e-7) and b[1].re == 0.0


def test_text_helpers(spark):
    d = spark.createDataFrame([("4,5,6", "a=1 b/s=2.5% a=3 c=-. d=1e3"), (None, ""), ("4,x,6", "plain")],
                              "cpus string, line string")
    rows = d.select(text.nth_cpu("cpus", F.lit(2)).alias("cpu"), text.key_values("line").alias("kv")).collect()
    assert [r.cpu for r in rows] == [6, -1, -1]
    assert rows[0].kv == {"a": 3.0, "b/s": 2.5, "d": 1000.0} and rows[1].kv == {}
    names = spark.createDataFrame([("void a::b::kern<int, 4>(float*, x<2>)",), ("plain",), ("q" * 50,)], "k string")
    got = [r[0] for r in names.select(text.clean_kernel_name("k")).collect()]
    assert got == ["kern", "plain", "q" * 50]
    assert names.select(text.short_label(text.clean_kernel_name("k"))).collect()[2][0] == "q" * 39 + "…"
    paths = spark.createDataFrame([("/a.b/run",), ("/a/run.h5",), ("x",)], "p string")
    assert [r[0] for r in paths.select(text.sidecar_name("p")).collect()] == [
        "/a.b/run.streams.csv", "/a/run.streams.csv", "x.streams.csv"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key, several ranges per key."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.hash("id"), F.lit(7)))
    return spark.range(3000).select(k.alias("k"), (F.col("id") - 1500).alias("o"),
                                    F.pmod(F.col("id") * 7919, F.lit(1009)).alias("v")).persist()


def test_ordered_prev_equals_lag(skewed):
    got = scale.ordered_prev(skewed, ["k"], "o", "v", "p", width=16)
    want = skewed.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("o")))
    assert got.select("k", "o", "p").exceptAll(want.select("k", "o", "p")).count() == 0
    assert got.count() == 3000


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_ordered_prefix_equals_window(skewed, how, inclusive):
    end = W.currentRow if inclusive else -1
    w = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, end)
    fn = F.sum if how == "sum" else F.max
    want = skewed.withColumn("r", fn("v").over(w)).select("k", "o", "r")
    got = scale.ordered_prefix(skewed, ["k"], "o", "v", how, "r", inclusive, width=32).select("k", "o", "r")
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_dense_rank_equals_window(skewed):
    want = skewed.withColumn("r", (F.dense_rank().over(W.partitionBy("k").orderBy("v")) - 1).cast("long"))
    got = scale.dense_rank(skewed, ["k"], "v", "r", width=10)
    assert got.select("k", "o", "r").exceptAll(want.select("k", "o", "r")).count() == 0


def test_histogram_positions(skewed):
    rows = scale.histogram_positions(skewed, ["k"], "v", 1.0, bins_per_range=8).collect()
    data = {}
    for r in skewed.collect():
        data.setdefault(r.k, []).append(r.v)
    for r in rows:
        assert r.smaller == sum(x < r.v for x in data[r.k]) and r.hits == data[r.k].count(r.v)


def test_explode_range_covers_every_integer(spark):
    d = spark.createDataFrame([(5, 5), (-10, 990), (7, 6)], "lo long, hi long")
    rows = scale.explode_range(d, F.col("lo"), F.col("hi"), "x", chunk=64).groupBy("lo").agg(
        F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.count_distinct("x").alias("u")).collect()
    assert {(r.lo, r.n, r.a, r.b, r.u) for r in rows} == {(5, 1, 5, 5, 1), (-10, 1001, -10, 990, 1001)}


def test_broadcast_only_when_small(spark):
    small, large = spark.range(10), spark.range(1000)
    plan = lambda d: large.join(d, "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(scale.broadcast_if_small(small, 10))
    assert "strategy=broadcast" not in plan(scale.broadcast_if_small(large.select("id"), 10))
