"""Records by genomic region: written once by chromosome and hierarchical bin, so a region reads only its own files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF, LEVELS = 20, 5  # a smallest bin spans 2**20 bases or more; each level above spans eight times as many
SMALLEST = 9  # 2**9 smallest bins a chromosome at most: they are widened to that, so folders don't grow with the positions


def bin_of(start: Column, end: Column, leaf: int = LEAF) -> Column:
    """The smallest bin that holds the closed range [start, end], positions from 1. Bin 0 spans everything.

    Bins of a level are numbered after those of the levels above: 1, 9, 73, 585...
    """
    out = F.lit(0)
    for level in range(1, LEVELS + 1):
        size = leaf + 3 * (LEVELS - level)
        a, b = F.shiftright(start.cast("long") - 1, size), F.shiftright(end.cast("long") - 1, size)
        out = F.when((a == b) & (a < 8 ** level), a + _first(level)).otherwise(out)
    return out.cast("int")


def _first(level: int) -> int:
    return (8 ** level - 1) // 7


def bins_of(start: int, end: int, leaf: int = LEAF) -> list[int]:
    """All bins that a record can lie in which shares a base with [start, end]."""
    out = [0]
    for level in range(1, LEVELS + 1):
        size, last = leaf + 3 * (LEVELS - level), 8 ** level - 1
        a, b = (max(start, 1) - 1) >> size, (end - 1) >> size
        out += range(_first(level) + min(a, last + 1), _first(level) + min(b, last) + 1)
    return out


def write_binned(df: DataFrame, path: str, chrom: str = "chrom", start: str = "pos", end: Column | None = None) -> None:
    """Writes records in folders by chromosome and bin, each sorted by start. ``end`` is the last base, by default that of
    ``ref``. Rows without a chromosome or start are not written.

    The bins' width follows the last base of all, and is the name of a folder above. A bin with many records is dealt over
    several tasks, each with a file of its own."""
    end = F.coalesce(end if end is not None else F.col(start) + F.greatest(F.length("ref"), F.lit(1)) - 1, F.col(start))
    rows = df.filter(F.col(chrom).isNotNull() & F.col(start).isNotNull()).withColumns({"_end": end.cast("long"), "_chrom": F.col(chrom)})
    last = rows.agg(F.max(F.greatest(F.col(start).cast("long"), "_end"))).first()[0] or 1
    leaf = max(LEAF, (max(last, 1) - 1).bit_length() - SMALLEST)
    rows = rows.withColumns({"_leaf": F.lit(leaf), "_bin": bin_of(F.col(start), F.col("_end"), leaf)})
    rows.hint("rebalance", "_chrom", "_bin").sortWithinPartitions("_chrom", "_bin", start).write.mode("overwrite").partitionBy("_leaf", "_chrom", "_bin").parquet(path)


def read_region(spark: SparkSession, path: str, chrom: str, first: int, last: int, start: str = "pos") -> DataFrame:
    """Records that share a base with the closed region; folders of other chromosomes and bins aren't read."""
    df = spark.read.option("basePath", path).parquet(path)
    leaf = df.select("_leaf").first()
    own = (F.col("_chrom").cast("string") == chrom) & F.col("_bin").isin(bins_of(first, last, leaf[0] if leaf else LEAF))
    return df.filter(own & (F.col(start) <= last) & (F.col("_end") >= first)).drop("_leaf", "_chrom", "_bin", "_end")
