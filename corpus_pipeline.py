"""Corpus pipeline: language, near copies, repeated passages, mixture, piece ids.

Every stage takes what its predecessor kept, whole, and all but the last return the
columns of ``documents``; other columns, whatever their names, are left out.  Rows that
share a ``doc_id`` are one document; rows without an id are one document that comes
before all others.  Null texts are empty, an empty table stays empty, and of equals the
least id comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasegrid.llm import group_join, langid, mixing, recompression, sentencepiece_op
from phasegrid.llm import windows as win
from phasegrid.llm.common import materialize, ship_package
from phasegrid.llm.queries import MIX_SEED, PIECES, WEIGHTS, mix_levels
from phasegrid.scale import broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5       # language share below which a document is of no language
MIX_SHARE = (9, 10)     # of all tokens that reach the mixture, each used once at most
ID_ROWS = 1_000_000     # id lists up to this length are broadcast
BATCH_ROWS = 1_000      # texts that move between Spark and Python at once, whatever a session allows


def _prepare(spark: SparkSession) -> None:
    """Executors know the package, and batches of texts are bounded: both sides hold them, and keep room for them."""
    ship_package(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go: without letters, or without one language that outweighs the others.

    The model learns from labelled documents outside the held-out fifth.  A document
    without a label gets the predicted one.
    """
    _prepare(spark)
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.where(~langid.held_out()), PIECES)
    known = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles with a similarity of 0.8 or more, the document of least id stays."""
    _prepare(spark)
    docs = docs.select(*COLUMNS)
    classes = materialize(group_join.link_groups(docs), "pipeline-classes")
    gone = classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    gone = broadcast_if_small(gone, ID_ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; documents left without words go."""
    _prepare(spark)
    docs = docs.select(*COLUMNS)
    cut = recompression.remove_repeats(docs).where("n_removed > 0")
    cut = cut.select(F.coalesce("doc_id", F.lit(win.NO_ID)).alias("doc"), "twin", F.col("kept").alias("kept_text"),
                     (F.col("n_words") > F.col("n_removed")).alias("stays")).distinct()
    cut = materialize(cut, "pipeline-cut")
    rows = docs.withColumn("doc", F.coalesce("doc_id", F.lit(win.NO_ID))).withColumn("twin", win.twin_of(F.coalesce("text", F.lit(""))))
    both = win.attach(rows, cut, keep_all=True).where("stays is null or stays")
    return (both.withColumn("text", F.coalesce("kept_text", "text"))
            .withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
            .select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources at their weights; every document is taken once at most."""
    levels = mix_levels()
    chosen = mixing.mix(docs, levels, WEIGHTS, MIX_SHARE, epochs=1, seed=MIX_SEED)
    chosen = materialize(chosen.select("key", "tie").distinct(), "pipeline-mixture")
    chosen = broadcast_if_small(chosen, ID_ROWS)
    rows = docs.withColumn("__tie", mixing.tie_of(levels, F.col("text")))
    on = rows["doc_id"].cast("long").eqNullSafe(chosen["key"]) & (rows["__tie"] == chosen["tie"])
    return rows.join(chosen, on, "left_semi").select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as ids of the public piece vocabulary."""
    _prepare(spark)
    docs = docs.select(*COLUMNS)
    return sentencepiece_op.encode(docs, PIECES)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
          ("mixture", mixture), ("piece_ids", piece_ids)]

#: SQL cannot express piece encoding or language scores; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    _prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
