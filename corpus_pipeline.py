"""The training-data pipeline: each stage is one of the operators, applied to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecast_duel.llm.common import stored, unused
from forecast_duel.llm.decontamination import build_index, contamination, search
from forecast_duel.llm.ngram_join import one_of_each
from forecast_duel.llm.packing import pack
from forecast_duel.llm.quality import THRESHOLD, fit_quality, score_quality
from forecast_duel.llm.secrets import without_secrets


#: Rows and bytes of an Arrow batch while the stages run, whichever is reached first. Texts are long: a batch of the default 10,000 rows
#: takes tens of megabytes, several times over, and a thousand long texts do as well.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def prepared(spark: SparkSession) -> None:
    """Set the session up for tables of texts; the setting stays, as a stage's plan is run after its function has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    prepared(spark)
    trees = fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = unused("_score", docs.columns)
    return score_quality(docs, trees, score_col=name).where(F.col(name) >= THRESHOLD).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id."""
    prepared(spark)
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share a twentieth of their words or more with the benchmark's windows."""
    prepared(spark)
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    index = build_index(docs.select(key.alias("key"), "text"), id_col="key")
    found = contamination(search(index, table(spark, sf_dir, "benchmark"), id_col="key"))
    bad = found.where("contaminated").select("key.doc_id", "key.text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; every document stays."""
    return without_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences: one row a piece with its place."""
    prepared(spark)
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained scores and token ids are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
