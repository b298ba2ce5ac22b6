"""Scoring in batches that survives interruptions: progress is the output itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .enrich import unscored


def scores(spark: SparkSession, root: str) -> DataFrame | None:
    """All scores written so far, or None."""
    try:
        return spark.read.option("basePath", root).parquet(f"{root.rstrip('/')}/run=*/batch=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def score_in_batches(df: DataFrame, root: str, on: list[str], score: Callable[[DataFrame], DataFrame], batch: int) -> DataFrame:
    """Scores the rows of ``df`` that have no score below ``root`` and returns all scores.

    ``score`` maps rows to rows with the columns ``on`` and its own. Rows are dealt by a hash of their keys over as many
    batches of about ``batch`` rows as they need, each written on its own as ``run=.../batch=n``. A run that ends early
    leaves its finished batches, and the next one asks only for what is left, so nothing is scored twice. Repeated keys
    are scored once; a row that ``score`` leaves out is asked for again by the next call. Plans don't grow: a batch reads
    the rows, and the scores only once a run.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    done = scores(spark, root)
    todo = df.dropDuplicates(on)
    todo = unscored(todo, done, on) if done is not None else todo
    n = -(-todo.count() // batch)
    run = uuid.uuid4().hex
    dealt = todo.withColumn("_batch", F.pmod(F.xxhash64(*on), F.lit(max(n, 1))))
    for i in range(n):
        score(dealt.filter(F.col("_batch") == i).drop("_batch")).write.parquet(f"{root}/run={run}/batch={i}")
    done = scores(spark, root)
    return done.drop("run", "batch") if done is not None else score(df.limit(0))
