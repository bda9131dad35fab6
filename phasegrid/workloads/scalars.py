"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions import numeric as N, text
from phasegrid.sources import tables as tb
from phasegrid.workloads import query
from phasegrid.workloads.bindings import LINE_SAMPLES


def _r(c, n=6):
    return F.round(c, n) + F.lit(0.0)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) - 25 AS re,
CAST(round(l_discount * 100) AS INTEGER) - 5 AS im FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, re * 3 - im * -2 AS mul_re, re * -2 + im * 3 AS mul_im,
re * 3 + im * -2 AS conj_re, im * 3 - re * -2 AS conj_im, 0 - im AS im_conj, re * re + im * im AS power,
round(sqrt(CAST(re * re + im * im AS DOUBLE)), 6) AS magnitude, round(atan2(im, re), 6) + 0.0 AS angle FROM s""")
def complex_arithmetic(spark, root):
    s = tb.table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") - 25).alias("re"),
        (F.rint(F.col("l_discount") * 100).cast("int") - 5).alias("im"))
    mul, cj = N.cmul("re", "im", 3, -2), N.cmul_conj("re", "im", 3, -2)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mul[0].alias("mul_re"),
                    mul[1].alias("mul_im"), cj[0].alias("conj_re"), cj[1].alias("conj_im"),
                    N.conj("re", "im")[1].alias("im_conj"), N.power("re", "im").alias("power"),
                    _r(N.magnitude("re", "im")).alias("magnitude"), _r(N.angle("re", "im")).alias("angle"))


@query("""SELECT event_id, CAST(round((event_id - 5003) / 64.0) * 64 AS BIGINT) AS closest,
event_id - 5003 - CAST(round((event_id - 5003) / 64.0) * 64 AS BIGINT) AS remainder,
CAST(floor((event_id - 5003) / 64.0) AS BIGINT) AS block FROM events""")
def nearest_multiple(spark, root):
    x = F.col("event_id") - 5003
    closest, rest = N.nearest_multiple(x, 64)
    return tb.table(spark, root, "events").select(
        "event_id", closest.alias("closest"), rest.alias("remainder"), N.floor_div(x, 64).alias("block"))


@query("""SELECT o_orderkey, CAST((o_custkey % 512) * 781250.0 AS DOUBLE) AS freq_hz,
round(40587.0::DOUBLE + epoch_us(o_orderdate) / 86400e6::DOUBLE, 9) AS mjd FROM orders""")
def frequency_and_date(spark, root):
    return tb.table(spark, root, "orders").select(
        "o_orderkey", N.channel_frequency_hz(F.pmod("o_custkey", F.lit(512)), 0.0, 781250.0).alias("freq_hz"),
        F.round(N.mjd_utc("o_orderdate"), 9).alias("mjd"))


@query("""WITH p AS (SELECT event_id, user_id % 4 AS c, event_id % 64 AS k, value AS ns FROM events),
q AS (SELECT event_id, -2 * pi() * ((192 + c) * 781250.0::DOUBLE
  + (CASE WHEN k < 32 THEN k ELSE k - 64 END) / 64.0::DOUBLE * 781250.0::DOUBLE) * (ns * 1e-9::DOUBLE) AS phi FROM p)
SELECT event_id, round(cos(phi), 6) + 0.0 AS re, round(sin(phi), 6) + 0.0 AS im FROM q""")
def fine_delay_phasor(spark, root):
    hz = N.channel_frequency_hz(F.pmod("user_id", F.lit(4)) + 192, 0.0, 781250.0)
    phi = N.fine_delay_phase(F.pmod("event_id", F.lit(64)), 64, hz, 781250.0, F.col("value"))
    c, s = N.phasor(phi)
    return tb.table(spark, root, "events").select("event_id", _r(c).alias("re"), _r(s).alias("im"))


@query("""WITH b AS (SELECT o_orderkey, CAST(o_custkey % 210 AS INTEGER) AS b FROM orders),
t AS (SELECT CAST(i.i AS INTEGER) AS i, CAST(j.j AS INTEGER) AS j, CAST(j.j * (j.j + 1) // 2 + i.i AS INTEGER) AS b
      FROM (SELECT unnest(range(20)) AS i) i JOIN (SELECT unnest(range(20)) AS j) j ON i.i <= j.j)
SELECT o_orderkey, b.b AS baseline, t.i, t.j, b.b AS again FROM b JOIN t ON t.b = b.b""")
def baseline_inverse(spark, root):
    b = F.pmod("o_custkey", F.lit(210)).cast("int")
    i, j = N.baseline_receivers(b, 20)
    d = tb.table(spark, root, "orders").select("o_orderkey", b.alias("baseline"), i.alias("i"), j.alias("j"))
    return d.withColumn("again", N.baseline_index(F.col("i"), F.col("j")).cast("int"))


@query("""SELECT o_orderkey, CAST(CASE WHEN a < 0 OR b < 0 THEN -2147483648 ELSE 256 * a + b END AS INTEGER) AS baseline_id,
CASE WHEN a < 0 OR b < 0 THEN NULL ELSE CAST(a AS INTEGER) END AS ant_i,
CASE WHEN a < 0 OR b < 0 THEN NULL ELSE CAST(b AS INTEGER) END AS ant_j
FROM (SELECT o_orderkey, o_custkey % 38 - 2 AS a, o_orderkey % 37 AS b FROM orders)""")
def baseline_ids(spark, root):
    a, b = F.pmod("o_custkey", F.lit(38)) - 2, F.pmod("o_orderkey", F.lit(37))
    d = tb.table(spark, root, "orders").select("o_orderkey", N.baseline_id(a, b).alias("baseline_id"))
    i, j = N.baseline_antennas("baseline_id")
    ok = F.col("baseline_id") >= 0
    return d.withColumns({"ant_i": F.when(ok, i), "ant_j": F.when(ok, j)})


@query("""SELECT event_id, CAST((event_id % 54 + 27) % 54 AS BIGINT) AS shifted,
round((event_id - 777) / 100.5::DOUBLE - floor((event_id - 777) / 100.5::DOUBLE), 6) AS fraction,
CAST((user_id + 31) // 32 * 32 AS BIGINT) AS padded FROM events""")
def index_arithmetic(spark, root):
    return tb.table(spark, root, "events").select(
        "event_id", N.fft_shift_index(F.pmod("event_id", F.lit(54)), 54).alias("shifted"),
        F.round(N.cycle_fraction(F.col("event_id") - 777, 100.5), 6).alias("fraction"),
        N.round_up_32("user_id").alias("padded"))


@query("""SELECT vec_id, CAST(e AS INTEGER) AS e, CAST(greatest(least(round_even(CAST(v AS DOUBLE) * 300, 0), 127), -128)
AS INTEGER) AS q FROM (SELECT vec_id, unnest(range(64)) AS e, unnest(embedding) AS v FROM embeddings)""")
def quantise(spark, root):
    d = tb.table(spark, root, "embeddings").select("vec_id", F.posexplode("embedding").alias("e", "v"))
    return d.select("vec_id", "e", N.quantise_int8(F.col("v").cast("double") * 300).alias("q"))


@query("""SELECT event_id, round(log10(greatest(value - 5, 1e-12)), 6) + 0.0 AS level,
abs(value - 10) <= greatest(0.5, 0.1 * 10) AS near_ten FROM events""")
def levels_and_tolerance(spark, root):
    return tb.table(spark, root, "events").select(
        "event_id", _r(N.log10_floor(F.col("value") - 5)).alias("level"),
        N.within_tolerance(F.col("value"), F.lit(10.0), 0.5, 0.1).alias("near_ten"))


@query("""SELECT o_orderkey, round(15500.0::DOUBLE * c * f * 2660 / 1e9, 9) AS gbps FROM
(SELECT o_orderkey, 8 * (1 + o_orderkey % 4) AS c, 1 + o_custkey % 5 AS f FROM orders)""")
def realtime_rate(spark, root):
    c, f = 8 * (1 + F.pmod("o_orderkey", F.lit(4))), 1 + F.pmod("o_custkey", F.lit(5))
    return tb.table(spark, root, "orders").select("o_orderkey", F.round(N.realtime_gbps(c, f), 9).alias("gbps"))


@query("""SELECT event_id, round(value * CASE event_id % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000
WHEN 3 THEN 1000000 ELSE 1 END, 6) AS us FROM events""")
def unit_normalisation(spark, root):
    units = F.array(*[F.lit(u) for u in ("ns", "usecond", " MS", "second", "parsec")])
    unit = units[F.pmod("event_id", F.lit(5)).cast("int")]
    return tb.table(spark, root, "events").select(
        "event_id", F.round(N.to_microseconds(F.col("value"), unit), 6).alias("us"))


@query("""SELECT o_orderkey, 'vis_' || strftime(o_orderdate, '%Y%m%d-%H%M') || '_' || (o_custkey % 100) || '_' ||
(o_custkey % 100 + 7) || '_ALVEO' || (o_orderkey % 4) || '_ALVEO' || (o_orderkey % 4 + 1) || '.hdf5' AS filename
FROM orders""")
def product_filename(spark, root):
    first = F.pmod("o_custkey", F.lit(100))
    ids = F.array(F.pmod("o_orderkey", F.lit(4)), F.pmod("o_orderkey", F.lit(4)) + 1)
    return tb.table(spark, root, "orders").select(
        "o_orderkey", text.default_filename("vis", "o_orderdate", first, 8, ids).alias("filename"))


@query("""SELECT page_id, regexp_replace(url, '\\.[^./\\\\]*$', '') || '.streams.csv' AS sidecar FROM pages""")
def sidecar_filename(spark, root):
    return tb.table(spark, root, "pages").select("page_id", text.sidecar_name("url").alias("sidecar"))


@query("""SELECT c_custkey, 'ts:fft:ch:' || (c_custkey % 8) || ':p:' || (c_custkey % 2) || ':b:' || (c_nationkey % 3)
|| ':f:' || ((c_custkey % 54 + 27) % 54) AS series,
len(list_filter(string_split(replace(c_name, '0', ','), ','), lambda s: s <> '')) AS names FROM customer""")
def series_keys(spark, root):
    key = text.series_key(F.lit("ts:fft"), F.pmod("c_custkey", F.lit(8)), F.pmod("c_custkey", F.lit(2)),
                          F.pmod("c_nationkey", F.lit(3)), N.fft_shift_index(F.pmod("c_custkey", F.lit(54)), 54))
    names = text.split_names(F.replace(F.col("c_name"), F.lit("0"), F.lit(",")))
    return tb.table(spark, root, "customer").select("c_custkey", key.alias("series"),
                                                    F.size(names).cast("long").alias("names"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN repeat(k, 9) ELSE k END AS kernel
FROM (SELECT p_partkey, lower(p_type) AS k FROM part)""")
def kernel_names(spark, root):
    """Raw profiler names (namespaces, templates, arguments) reduced to the bare kernel."""
    k = F.lower("p_type")
    base = F.when(F.pmod("p_partkey", F.lit(3)) == 2, F.repeat(k, 9)).otherwise(k)
    raw = F.concat(F.lit("void lib::"), F.col("p_brand"), F.lit("::"), base, F.lit("<int, "),
                   F.col("p_size").cast("string"), F.lit(">(float const*, std::pair<int, int>)"))
    return tb.table(spark, root, "part").select("p_partkey", text.clean_kernel_name(raw).alias("kernel"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN -1 WHEN o_custkey % 5 < 3
THEN o_custkey % 7 + o_custkey % 5 ELSE -1 END AS INTEGER) AS cpu FROM orders""")
def cpu_list(spark, root):
    first = F.pmod("o_custkey", F.lit(7))
    cpus = F.concat_ws(",", *[(first + i).cast("string") for i in range(3)])
    cpus = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, F.concat(F.lit("x,"), cpus)).otherwise(cpus)
    return tb.table(spark, root, "orders").select(
        "o_orderkey", text.nth_cpu(cpus, F.pmod("o_custkey", F.lit(5)).cast("int")).alias("cpu"))


@query("""SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, CAST(-1 AS DOUBLE) AS missing,
'{"type":"' || event_type || '","run":{"user":' || user_id || '}}' AS doc, CAST(user_id AS DOUBLE) AS back FROM events""")
def json_access(spark, root):
    """Numbers with defaults from JSON, and a manifest written and read back."""
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user")).alias("run")))
    d = tb.table(spark, root, "events").select(
        "event_id", text.json_number("props", "$.k", -1).alias("k"),
        text.json_number("props", "$.absent.real", -1).alias("missing"), doc.alias("doc"))
    return d.withColumn("back", text.json_number("doc", "$.run.user", -1))


@query("""SELECT vec_id, CAST(1 AS INTEGER) AS default_k, CAST(16 AS INTEGER) AS d0, CAST(2 AS INTEGER) AS d1,
CAST(2 AS INTEGER) AS d2, CAST(500 AS INTEGER) AS ids FROM embeddings""")
def maps_and_dims(spark, root):
    """Default map of 500 ids and the extents of a payload as a nested array."""
    step = lambda t: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda p: F.slice(
        F.col("embedding"), (t * 4 + p * 2 + 1).cast("int"), 2))
    nested = F.transform(F.sequence(F.lit(0), F.lit(15)), step)
    d = tb.table(spark, root, "embeddings").select(
        "vec_id", text.default_counts().alias("m"), text.nested_dims(nested, 3).alias("d"))
    return d.select("vec_id", F.element_at("m", F.pmod("vec_id", F.lit(500)).cast("int")).alias("default_k"),
                    *[F.col("d")[i].alias(f"d{i}") for i in range(3)], F.size("m").alias("ids"))


@query(f"""WITH {LINE_SAMPLES} SELECT recv, CAST(sum(CAST(re AS FLOAT)) AS DOUBLE) AS as_float,
CAST(sum(CAST(im AS DOUBLE)) AS DOUBLE) AS as_double FROM ls GROUP BY recv""")
def type_widening(spark, root):
    from phasegrid.operators.ingest import last_wins
    s = last_wins(tb.lineitem_samples(spark, root), ["block", "channel", "t", "recv"], ["re", "im"])
    return s.groupBy("recv").agg(F.sum(F.col("re").cast("float")).alias("as_float"),
                                 F.sum(F.col("im").cast("double")).alias("as_double"))
