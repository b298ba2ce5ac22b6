"""Extendible-hash sharding: a directory indexed by hash-prefix bits, in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

HASH_BITS = 60  # fixed value: 15 hex digits of an md5, which other engines can compute too
STEP_BITS = 8


def hash60(key: Column) -> Column:
    """The first 60 bits of md5(key as text), as a non-negative long; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def extendible_shards(
    df: DataFrame, work: Workspace, key: str, size: Column, max_bytes: int, salt: Column | None = None
) -> DataFrame:
    """Adds shard_depth, shard_prefix and shard_bytes to ``df``: the bucket of each row in an extendible directory.

    The directory starts as one bucket (depth 0). A bucket above ``max_bytes`` splits on the next hash bit, others
    stay, so depths differ and no bucket splits without need. A shard above the limit remains only where all 60
    bits are used up: rows that share one hash. A key that repeats so often that it fills a shard by itself can be
    spread with ``salt``, a column that is hashed along with the key.

    Sizes are summed once per fine hash cell with map-side partial sums; the splitting then works on cells, each
    counted towards all its prefixes, which takes one shuffle for every STEP_BITS levels and never meets the rows
    again. Only cells that still hold too much are refined from the rows.

    Nulls: a null key hashes as empty text, a null size counts 0. Repeated rows share their key's shard. An empty
    table gives no rows. Columns of the same names as the added ones are replaced.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    spark = df.sparkSession
    hashed = hash60(F.col(key)) if salt is None else hash60(F.concat_ws("/", F.col(key).cast("string"), salt.cast("string")))
    df = df.drop("shard_depth", "shard_prefix", "shard_bytes")
    rows = df.withColumns({"_hash": hashed, "_bytes": F.coalesce(size.cast("long"), F.lit(0))})
    sized = rows.select("_hash", "_bytes")

    leaves, low, over, parts = None, 0, None, []
    while low < HASH_BITS:
        high = min(HASH_BITS, low + STEP_BITS) if low else min(HASH_BITS, 16)
        cells = sized.withColumn("cell", F.shiftright("_hash", HASH_BITS - high))
        if over is not None:
            cells = cells.join(over, F.shiftright("cell", high - low) == F.col("full")).drop("full")
        cells = work.keep(cells.groupBy("cell").agg(F.sum("_bytes").alias("bytes")), f"cells-{high}")
        nodes = (
            cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        nodes = work.keep(nodes, f"nodes-{high}")
        split = nodes.filter(F.col("bytes") > max_bytes).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")
        )
        under_split = nodes.withColumn("parent", F.shiftright("prefix", 1)).join(split, ["depth", "parent"], "left_semi")
        if low == 0:
            under_split = under_split.drop("parent").unionByName(nodes.filter("depth = 0"))
        last = high == HASH_BITS
        fits = under_split.filter((F.col("bytes") <= max_bytes) | (F.col("depth") == HASH_BITS))
        parts.append(fits.select("depth", "prefix", "bytes"))
        over = nodes.filter((F.col("depth") == high) & (F.col("bytes") > max_bytes)).select(F.col("prefix").alias("full"))
        low = high
        if last or over.isEmpty():
            break
    for p in parts:
        leaves = p if leaves is None else leaves.unionByName(p)
    leaves = work.keep(leaves, "directory")
    # A row looks its shard up by prefix, at the depths that occur only (few: they differ by how uneven sizes are).
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most 61 numbers
    if not depths:
        depths = [0]
    probes = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("_hash", HASH_BITS - d).alias("prefix")) for d in depths])
    directory = leaves.select(
        F.struct("depth", "prefix").alias("_probe"), F.col("bytes").alias("shard_bytes")
    )
    if len(depths) == 1:
        located = rows.withColumn("_probe", probes[0]).join(directory, "_probe", "left")
        return located.withColumns({"shard_depth": F.col("_probe.depth"), "shard_prefix": F.col("_probe.prefix")}).drop(
            "_probe", "_hash", "_bytes"
        )
    # The bucket of a fine cell follows from the directory alone: cells meet it, rows then meet their cell's bucket.
    deepest = depths[-1]
    cell = F.shiftright("_hash", HASH_BITS - deepest)
    all_probes = F.array(*[
        F.struct(F.lit(d).alias("depth"), F.shiftright("cell", deepest - d).alias("prefix")) for d in depths
    ])
    cells = rows.select(cell.alias("cell")).distinct().withColumn("_probe", F.explode(all_probes))
    found = cells.join(directory, "_probe").select(
        F.col("cell").alias("_cell"), F.col("_probe.depth").alias("shard_depth"),
        F.col("_probe.prefix").alias("shard_prefix"), "shard_bytes",
    )
    return rows.withColumn("_cell", cell).join(found, "_cell").drop("_cell", "_hash", "_bytes")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard to a folder of its own, ``shard=<depth>-<prefix>``; a shard is one task's work by its limit."""
    named = sharded.withColumn("shard", F.concat_ws("-", "shard_depth", "shard_prefix"))
    named.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
