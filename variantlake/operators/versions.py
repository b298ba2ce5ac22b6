"""Releases: latest version by key, history, append, removal, soft deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current_version(df: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """The newest row of each key. A row limit of one per key is also applied before the shuffle."""
    w = W.partitionBy(*key).orderBy(*newest)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def history(df: DataFrame, key: list[str], newest: list[Column], previous: dict[str, str]) -> DataFrame:
    """All versions, numbered from the newest (``version``), each with what named columns held before it."""
    w = W.partitionBy(*key).orderBy(*newest)
    return df.withColumn("version", F.row_number().over(w)).withColumns({new: F.lead(old).over(w) for new, old in previous.items()})


def live(df: DataFrame, change: str = "change_type", deleted: str = "deleted") -> DataFrame:
    return df.filter(~F.col(change).eqNullSafe(F.lit(deleted)))


def facet_counts(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition, in one pass; ``total`` is the number of rows."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in facets.items()])


def counts_by(df: DataFrame, group: list[Column], facets: dict[str, Column]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in facets.items()])


def history_join(df: DataFrame, key: str, version: str, same: list[str] | None = None, extra: Column | None = None) -> DataFrame:
    """Each row as ``cur`` with every version of its key up to its own, as ``old`` (structs)."""
    keys = [key, *(same or [])]
    cur = df.select(*[F.col(k) for k in keys], F.struct("*").alias("cur"))
    old = df.select(*[F.col(k) for k in keys], F.struct("*").alias("old"))
    joined = cur.join(old, keys).filter(F.col(f"old.{version}") <= F.col(f"cur.{version}"))
    return joined.filter(extra) if extra is not None else joined


def history_summary(df: DataFrame, key: str, version: str, count: str, least: dict[str, str], where: Column | None = None) -> DataFrame:
    """Each row with the number of versions of its key up to its own (``count``), and the least of named columns over
    them (new name -> column). Only versions that meet ``where`` count; rows without any go. What history_join and a
    grouping would give, from one sorted pass over each key instead of pairs of its versions.
    """
    w = W.partitionBy(key).orderBy(version).rangeBetween(W.unboundedPreceding, W.currentRow)
    hit = F.lit(True) if where is None else where
    out = df.withColumns({count: F.count_if(hit).over(w), **{n: F.min(F.when(hit, F.col(c))).over(w) for n, c in least.items()}})
    return out.filter(F.col(count) > 0)


class Releases:
    """A versioned table: one partition per release, replaced as a whole, so an append that fails leaves no part."""

    def __init__(self, spark: SparkSession, path: str, column: str = "release"):
        self.spark, self.path, self.column = spark, path, column

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, rows: DataFrame, release: int, removed: DataFrame | None = None, change: str = "change_type") -> None:
        """Stores the changed rows of a release (those with a change type) and its deletions."""
        out = rows.filter(F.col(change).isNotNull())
        if removed is not None:
            out = out.unionByName(removed.withColumn(change, F.lit("deleted")), allowMissingColumns=True)
        out.withColumn(self.column, F.lit(release)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.column).parquet(self.path)

    def current(self, key: list[str]) -> DataFrame:
        return current_version(self.read(), key, [F.desc(self.column)])

    def remove_latest(self) -> int | None:
        """Deletes the newest release's partition and returns its number."""
        last = self.read().agg(F.max(self.column)).first()[0]
        if last is not None:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.column}={last}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return last


def soft_delete_upsert(stored: DataFrame, incoming: DataFrame, key: list[str], deleted: str = "deleted") -> DataFrame:
    """Incoming rows replace stored ones; stored rows that are not incoming stay, marked deleted."""
    new = incoming.withColumn(deleted, F.lit(False))
    gone = stored.join(incoming.select(*key).distinct(), key, "left_anti").withColumn(deleted, F.lit(True))
    return new.unionByName(gone, allowMissingColumns=True)


def backfill(history_rows: DataFrame, current: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Historic rows with the given columns taken from the current row of their key, where there is one."""
    cur = current.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = history_rows.join(cur, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*history_rows.columns)


def attach_reports(variants: DataFrame, reports: DataFrame, ids: dict[str, str], source: str = "Source") -> DataFrame:
    """Reports with the variant whose id list of the report's source names them: (source -> id column in both)."""
    lists = None
    for s, c in ids.items():
        part = variants.select("variant_id", F.lit(s).alias(source), F.explode(F.split(c, ",")).alias("report_id")).filter("trim(report_id) not in ('', '-')")
        lists = part if lists is None else lists.unionByName(part)
    own = F.coalesce(*[F.when(F.col(source) == s, F.col(c)) for s, c in ids.items()])
    return reports.withColumn("report_id", own).join(lists.withColumn("report_id", F.trim("report_id")).distinct(), [source, "report_id"], "left")


def number_by_date(df: DataFrame, date: str, name: str = "name") -> DataFrame:
    """Names 1..n in order of date. For small tables such as the list of releases."""
    return df.withColumn(name, F.row_number().over(W.orderBy(date)))
