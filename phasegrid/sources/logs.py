"""Benchmark logs and profiler exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from phasegrid.functions import text
from phasegrid.operators import reports


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number; log files are small, each is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def benchmark_log(spark: SparkSession, path: str) -> DataFrame:
    """Result lines tagged with the sweep they belong to (``corr`` after its banner)."""
    lines = numbered_lines(spark, path)
    banner = F.when(F.col("line").startswith("==="),
                    F.when(F.contains("line", F.lit("corr-packet sweep")), "corr").otherwise("channel"))
    w = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("sweep", F.coalesce(F.last(banner, ignorenulls=True).over(w), F.lit("channel")))
    return reports.parse_benchmark_log(lines)


#: A comma outside quotes; cells of a CSV line are cut there.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_cells(line: str) -> Column:
    """Cells of a CSV line, trimmed, without their quotes."""
    cells = F.split(line, _COMMA)
    bare = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(bare(c), '""', '"')))


def profiler_csv(spark: SparkSession, path: str) -> DataFrame:
    """Kernel metrics of profiler CSVs: leading chatter skipped, long or wide layout.

    Result: ``launch, kernel, metric, unit, value`` with thousands separators removed; a
    wide export (one column per metric, a units row after the header) is unpivoted.
    Every file goes by its own header, so exports of different columns can be read
    together; a long export without a needed column is an error, a file without a header
    has no rows, and empty cells have no value.
    """
    lines = numbered_lines(spark, path)
    per_file = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)      # a log file is read whole
    is_head = F.col("line").rlike('^("ID"|ID,)')
    lines = lines.withColumn("head", F.min(F.when(is_head, F.struct("n", "line"))).over(per_file))
    lines = lines.where((F.col("n") > F.col("head.n")) & (F.trim("line") != ""))
    d = lines.select("n", F.col("head.n").alias("head"), csv_cells("head.line").alias("names"), csv_cells("line").alias("cells"))
    wide = ~F.array_contains("names", "Metric Name")
    d = d.where(~wide | (F.col("n") > F.col("head") + 1))
    needed = F.array(*[F.lit(c) for c in ("ID", "Kernel Name", "Metric Name", "Metric Value")])
    lacks = ~wide & (F.size(F.array_except(needed, "names")) > 0)
    message = F.concat(F.lit("profiler export lacks required columns, found "), F.array_join("names", ", "))
    d = d.withColumn("names", F.when(lacks, F.raise_error(message).cast("array<string>")).otherwise(F.col("names")))
    at = lambda name: F.try_element_at("cells", F.nullif(F.array_position("names", name), F.lit(0)).cast("int"))
    metric = lambda name, unit, raw: F.struct(name.alias("metric"), unit.alias("unit"), raw.alias("raw"))
    none = F.lit(None).cast("string")
    pairs = F.filter(F.arrays_zip("names", "cells"), lambda p: ~p["names"].isin("ID", "Kernel Name"))
    rows = F.when(wide, F.transform(pairs, lambda p: metric(p["names"], none, p["cells"]))).otherwise(
        F.array(metric(at("Metric Name"), at("Metric Unit"), at("Metric Value"))))
    number = F.regexp_replace("raw", ",", "").try_cast("double")
    return (d.select(at("ID").alias("launch"), text.clean_kernel_name(at("Kernel Name")).alias("kernel"), F.inline(rows))
            .select("launch", "kernel", "metric", F.nullif("unit", F.lit("")).alias("unit"), number.alias("value")))
