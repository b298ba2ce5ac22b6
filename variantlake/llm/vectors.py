"""What the vector operators share: which vectors take part, and classes of equal vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_size(df: DataFrame, vector: str) -> int:
    """The most frequent length among vectors, the smallest of equally frequent ones; 0 if there are none."""
    top = df.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return top[0]["n"] if top else 0


def lengths(df: DataFrame, vector: str) -> list[int]:
    """The different lengths of vectors, ascending; they are few, as one is at most a few thousand. [0] if there are none."""
    return sorted(r["n"] for r in df.select(F.size(vector).alias("n")).distinct().collect()) or [0]


def equal_classes(df: DataFrame, key: str, vector: str, least: int) -> DataFrame:
    """One row per different vector: rep (its smallest key), vector, copies, and the ``least`` smallest keys, sorted.

    Keys are cut to the smallest ones first within salted parts of a class, so a vector that a third of all rows share
    is never gathered.
    """
    part = W.partitionBy(vector, "salt").orderBy(key)
    whole = W.partitionBy(vector).orderBy(key)
    salted = df.select(F.col(key), F.col(vector), F.pmod(F.col(key), F.lit(32)).alias("salt"))
    few = salted.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= least)
    few = few.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= least)
    heads = few.groupBy(vector).agg(F.sort_array(F.collect_list(key)).alias("keys"))
    return heads.select(F.col("keys")[0].alias("rep"), F.col(vector).alias("vector"), "keys")
