"""Shared pieces of the corpus operators: workspace folders, materialised steps and token rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS = 1000, 20_000  # a key is hot beyond HOT_ROWS rows and one in HOT_KEYS of all: HOT_KEYS at most
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark's, from 4.1 on; older ones ignore it
SPACE = b" \t\n\x0b\x0c\r"  # fixed values: bytes.split() separates words at exactly these


class Workspace:
    """A folder of its own below ``spark.checkpoint.dir``, which the driver and all executors share.

    Steps whose lineage should end are written here as Parquet and read back, so a lost executor costs only the
    tasks it ran. One workspace serves one call of an operator: a second call would replace the steps that the first
    one's result still reads. Where the setting is absent a temporary folder serves, in local mode only.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="variantlake-")
            spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, step: str) -> str:
        return f"{self.root}/{step}"

    def sub(self, name: str) -> Workspace:
        """A workspace below this one, for a part of the work whose steps have the same names."""
        other = object.__new__(Workspace)
        other.spark, other.root = self.spark, self.path(name)
        return other

    def keep(self, df: DataFrame, step: str) -> DataFrame:
        """Writes ``df`` and returns what reads it back; the plan behind it ends here."""
        df.write.mode("overwrite").parquet(self.path(step))
        return self.spark.read.schema(df.schema).parquet(self.path(step))

    def drop(self, *steps: str) -> None:
        """Deletes steps that nothing reads any more."""
        jvm = self.spark._jvm
        for step in steps:
            at = jvm.org.apache.hadoop.fs.Path(self.path(step))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    @contextmanager
    def freed(self) -> Iterator[None]:
        """In it, Spark deletes the shuffle files of each query as soon as that ends. Without it they stay until the driver's
        collector has found the plan unused, often until steps later. No step needs them again: it is read from its Parquet."""
        before = self.spark.conf.get(FREED, None)
        self.spark.conf.set(FREED, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(FREED) if before is None else self.spark.conf.set(FREED, before)

    def clean(self) -> None:
        """Lets Spark delete the shuffle files of finished steps: it does when the driver's collector has found that
        nothing refers to their plans any more, which in a long job can come late."""
        gc.collect()
        self.spark._jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n: the fold rule of the held-out splits. Null ids count as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def join_split(many: DataFrame, few: DataFrame, key: str, by: str, work: Workspace, how: str = "inner", most: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``many`` joined with ``few`` (one row per key) by an equi-join in which no key's rows meet in one task.

    The rows of hot keys are dealt by a hash of ``by`` over as many parts as they fill, and the other side's row is
    repeated for each part. Hot keys are counted first; by their definition there are HOT_KEYS at most, so their table
    is broadcast. Null keys find nothing. Where bounds of the rows are known, ``most`` saves the count: one row per key
    with a bound ``n``, and a bound of the sum of ``n``.
    """
    if most:
        sizes, total = most
    else:
        sizes = work.keep(many.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS), f"sizes-{uuid.uuid4().hex}")
        total = sizes.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(sizes.filter(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def slices(array: pa.Array, rows: int = 256):
    """The values of an Arrow array as Python objects, turned a few rows at a time."""
    for start in range(0, len(array), rows):
        yield from array.slice(start, rows).to_pylist()


def keep_freed() -> None:
    """Lets a worker keep 64 MB that it freed: to get each short-lived array from the system takes longer than to fill it."""
    try:
        ctypes.CDLL(None).mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
        ctypes.CDLL(None).mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
    except AttributeError:  # only some C libraries have it
        pass


def give_back() -> None:
    """Hands memory that a task used and freed back to the system: Python workers live on and are shared by stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only some C libraries have it
        pass
