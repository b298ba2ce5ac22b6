"""A corpus pipeline of five stages over the table ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlake.llm import langid, mixing, neardup, pieces, pii
from variantlake.llm.common import Workspace, crc_mod
from variantlake.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH = 2000  # rows with whole texts that Spark and a Python worker hold at once; Spark's own value is 10,000


def _small_batches(spark: SparkSession) -> None:
    """Sets Spark's Arrow batches to BATCH rows in this session, which changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letters, or no language with three tenths of the letters) go."""
    _small_batches(spark)
    return langid.kept(docs.select(*COLUMNS), crc_mod("doc_id", 4) != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest doc_id."""
    _small_batches(spark)
    return neardup.deduplicate(docs.select(*COLUMNS), Workspace(spark, "stage-near"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows the new text."""
    _small_batches(spark)
    return pii.redact(docs.select(*COLUMNS), Workspace(spark, "stage-private")).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes it: not at all, once or twice."""
    _small_batches(spark)
    return mixing.repeat(docs.select(*COLUMNS), Workspace(spark, "stage-mix"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    _small_batches(spark)
    return pieces.encode_digests(docs.select("doc_id", "source", "text"), tokenizer_path()).drop("text")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("tokenize", tokenize)]
ORACLE_SQL = None  # no stage can be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each over what the one before it wrote."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
