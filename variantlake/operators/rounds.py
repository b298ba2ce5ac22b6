"""Steps of iterative operators: written once, so that plans stay short and a lost executor repeats only its tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def keeper(spark: SparkSession, name: str = "rounds") -> Callable[[DataFrame], DataFrame]:
    """A function that writes a frame as Parquet below ``spark.checkpoint.dir``, which the driver and all executors share,
    and returns what reads it. Where the setting is absent a temporary folder serves, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="variantlake-")
    root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    steps = iter(range(1 << 62))

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(steps)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
