"""Time series kept by key: batches are added, reads merge them, compaction rewrites them.

A point is a key, a time and a value; of points with one key and time the one of the
latest batch counts.  A batch is a folder named after its number, so a repeated batch
replaces itself.  Compaction folds the batches up to a number into a new base and then
names that base in a small table; until that is written readers go by the old one, and a
compaction that dies is simply done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasegrid.functions import numeric as N
from phasegrid.sinks.products import path_exists

FILES = 16      # parts a base is cut in by key, so that a key's points lie in one place


class SeriesStore:
    """Points ``key, <time>, value`` below ``root``; with ``keep`` those more than so far behind a key's latest are dropped."""

    def __init__(self, root: str, time: str = "block", keep: int | None = None, files: int = FILES):
        self.root, self.time, self.keep, self.files = root.rstrip("/"), time, keep, files

    def upsert(self, points: DataFrame, batch_id: int) -> None:
        points.select("key", self.time, "value").write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch_id}")

    def __call__(self, points: DataFrame, batch_id: int) -> None:
        """For use as a ``foreachBatch`` function."""
        self.upsert(points, batch_id)

    def _base(self, spark: SparkSession) -> tuple[int, int]:
        """Number of the current base, and the last batch in it; -1 for none."""
        if not path_exists(spark, f"{self.root}/bases"):
            return -1, -1
        row = spark.read.json(f"{self.root}/bases", schema="base long, upto long").agg(F.max(F.struct("base", "upto")).alias("b")).first()
        return (-1, -1) if row["b"] is None else (row["b"]["base"], row["b"]["upto"])

    def _merged(self, spark: SparkSession, upto: int | None) -> DataFrame | None:
        base, done = self._base(spark)
        parts = []
        if base >= 0:
            parts.append(spark.read.parquet(f"{self.root}/base/{base}").withColumn("batch", F.lit(-1).cast("long")))
        if path_exists(spark, f"{self.root}/batches"):
            fresh = spark.read.parquet(f"{self.root}/batches").withColumn("batch", F.col("batch").cast("long"))
            fresh = fresh.where(F.col("batch") > done)
            parts.append(fresh if upto is None else fresh.where(F.col("batch") <= upto))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # equal points of one batch are ordered by value, so that a read is the same every time
        last = rows.groupBy("key", self.time).agg(F.max_by("value", F.struct("batch", "value")).alias("value"))
        if self.keep is None:
            return last
        newest = last.groupBy("key").agg(F.max(self.time).alias("newest"))
        return last.join(newest, "key").where(F.col(self.time) > F.col("newest") - self.keep).drop("newest")

    def read(self, spark: SparkSession) -> DataFrame:
        """All points, each once."""
        found = self._merged(spark, None)
        if found is None:
            raise FileNotFoundError(f"no series below {self.root}")
        return found

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Fold the batches up to ``upto`` into a new base; points read the same before and after."""
        base, done = self._base(spark)
        merged = self._merged(spark, upto)
        if upto <= done or merged is None:
            return
        path = f"{self.root}/base/{base + 1}"
        merged.repartition(self.files, "key").sortWithinPartitions("key", self.time).write.mode("overwrite").parquet(path)
        spark.createDataFrame([(base + 1, upto)], "base long, upto long").coalesce(1).write.mode("append").json(f"{self.root}/bases")


def eigen_points(eigen: DataFrame, receivers: int, channels_per_write: int, channels: int, block: str = "block") -> DataFrame:
    """Points of eigenvalues and eigenvectors of equal polarizations: key, block, value.

    A block contributes the channels of its turn only.  Keys name channel, polarization
    pair and mode, then ``val``, or the vector's component and ``re`` or ``im``.
    """
    slots = -(-channels // channels_per_write)
    turn = N.idiv(F.col("channel"), channels_per_write) == F.pmod(block, F.lit(slots))
    own = eigen.where(turn & (F.col("p") == F.col("q")))
    pol = F.concat_ws("-", F.col("p").cast("string"), F.col("q").cast("string"))
    key = F.concat(F.lit("ts:ch:"), F.col("channel").cast("string"), F.lit(":p:"), pol, F.lit(":k:"))
    values = own.select(key.alias("key"), block, F.posexplode("eigvals").alias("k", "value")).select(
        F.concat("key", F.col("k").cast("string"), F.lit(":val")).alias("key"), block, "value")
    # vectors are flat, component by component: entry j * n + k is component j of mode k
    cells = own.select(key.alias("key"), block, F.posexplode(F.arrays_zip("vec_re", "vec_im")).alias("at", "v"))
    place = F.concat("key", F.pmod("at", F.lit(receivers)).cast("string"), F.lit(":vec:j:"), N.idiv(F.col("at"), receivers).cast("string"))
    both = F.explode(F.array(F.struct(F.lit(":re").alias("part"), F.col("v.vec_re").alias("value")),
                             F.struct(F.lit(":im").alias("part"), F.col("v.vec_im").alias("value"))))
    vectors = cells.select(place.alias("key"), block, both.alias("x")).select(F.concat("key", "x.part").alias("key"), block, "x.value")
    return values.unionByName(vectors)
