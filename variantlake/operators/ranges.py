"""Intervals: point and overlap lookups, bands, nearest edges, coalescing, windows over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_cells(df: DataFrame, start: Column, end: Column, width: int, name: str = "_cell") -> DataFrame:
    """A row for each grid cell of ``width`` that [start, end] touches: turns a range condition into an equi-join."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def point_lookup(points: DataFrame, ranges: DataFrame, on: list[str], pos: str, start: str, end: str, width: int, how: str = "left", closed: bool = False) -> DataFrame:
    """Each point with the ranges that hold it (half-open, or closed).

    Ranges are spread over cells of ``width``, so points meet only the ranges of their own cell and a table of ranges
    of any size is joined by key; Spark broadcasts it if it is small.
    """
    p = points.withColumn("_cell", F.floor(F.col(pos) / width))
    r = with_cells(ranges, F.col(start), F.col(end), width)
    inside = (F.col(pos) >= F.col(start)) & ((F.col(pos) <= F.col(end)) if closed else (F.col(pos) < F.col(end)))
    cond = inside & (p["_cell"] == r["_cell"])
    for c in on:
        cond = cond & (p[c] == r[c])
    out = p.join(r, cond, how).drop(p["_cell"])
    if how in ("left_semi", "left_anti"):
        return out
    for c in on:
        out = out.drop(r[c])
    return out.drop(r["_cell"])


def outside(points: DataFrame, ranges: DataFrame, on: list[str], pos: str, start: str, end: str, width: int) -> DataFrame:
    """Points in no range (closed)."""
    return point_lookup(points, ranges, on, pos, start, end, width, "left_anti", closed=True)


def exactly_one(df: DataFrame, key: list[str], message: str) -> DataFrame:
    """``df``, which fails while running when a key matches no range or several."""
    n = F.count("*").over(W.partitionBy(*key))
    return df.withColumn("_n", n).filter(F.coalesce(F.assert_true(F.col("_n") == 1, F.lit(message)).isNull(), F.lit(True))).drop("_n")


def first_overlap(rows: DataFrame, ranges: DataFrame, key: list[str], on: list[str], start: str, end: str, r_start: str, r_end: str, order: list[str], width: int, how: str = "left") -> DataFrame:
    """Each row with the first range, in ``order``, that shares a point with it (both closed)."""
    a = with_cells(rows, F.col(start), F.col(end), width)
    b = with_cells(ranges, F.col(r_start), F.col(r_end), width)
    hit = a.join(b, [*on, "_cell"]).filter((F.col(start) <= F.col(r_end)) & (F.col(end) >= F.col(r_start)))
    payload = [c for c in ranges.columns if c not in on]
    best = hit.groupBy(*key).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_r"))
    return rows.join(best.select(*key, "_r.*"), key, how)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(a_start, b_start) <= F.least(a_end, b_end)


def band_statistics(bands: DataFrame, values: DataFrame, key: list[str], on: list[str], pos: str, start: str, end: str, value: str, width: int) -> DataFrame:
    """Mean and median of the values in each closed band, and whether there are any (``observable``)."""
    inside = point_lookup(values, bands.select(*key, *on, start, end), on, pos, start, end, width, "inner", closed=True)
    stats = inside.groupBy(*key).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))
    return bands.join(stats, key, "left").withColumn("observable", F.col("mean").isNotNull() & F.col("median").isNotNull())


def coalesce_intervals(df: DataFrame, on: list[str], start: str, end: str, gap: Column | None = None) -> DataFrame:
    """Islands of intervals that touch or lie within ``gap`` of each other: on, island start, end and rows."""
    w = W.partitionBy(*on).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    limit = reach + gap if gap is not None else reach
    marked = df.withColumn("_new", (reach.isNull() | (F.col(start) > limit)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*on, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("rows")).drop("_island")


def nearest_before(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, payload: list[str], name: str = "before") -> DataFrame:
    """Each left row with the last right row of its key at or before it, as a struct; NULL if there is none.

    Both sides are laid along one order per key and the last right row seen is carried forward: one shuffle, and no
    pair of rows is ever formed.
    """
    item = F.struct(F.col(right_at).alias("at"), *[F.col(c) for c in payload])
    r = right.select(*on, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), item.alias("_item"))
    nothing = F.lit(None).cast(r.schema["_item"].dataType)
    l = left.select(*on, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), nothing.alias("_item"), F.struct(*[c for c in left.columns if c not in on]).alias("_row"))  # noqa: E741
    both = r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)).unionByName(l)
    w = W.partitionBy(*on).orderBy("_at", "_side", *[F.col(f"_item.{c}") for c in payload]).rowsBetween(W.unboundedPreceding, 0)
    carried = both.withColumn(name, F.last("_item", ignorenulls=True).over(w))
    return carried.filter("_side = 1").select(*on, "_row.*", name)


def nearest_edge(rows: DataFrame, edges: DataFrame, key: list[str], on: list[str], pos: str, edge: str, payload: list[str], only_past: bool = False) -> DataFrame:
    """Each row with the nearest edge of its key (ties: smaller edge); with ``only_past`` among edges before it.

    Looks both ways along one order, like nearest_before.
    """
    before = nearest_before(rows, edges, on, pos, edge, payload, "_before")
    if only_past:
        return before.withColumnRenamed("_before", "nearest")
    flipped = nearest_before(before.withColumn("_neg", -F.col(pos)), edges.withColumn("_negedge", -F.col(edge)), on, "_neg", "_negedge", [edge, *payload], "_after").drop("_neg")
    dist_b, dist_a = F.col(pos) - F.col("_before.at"), F.col(f"_after.{edge}") - F.col(pos)
    b = F.struct(F.col("_before.at").alias("at"), *[F.col(f"_before.{c}").alias(c) for c in payload])
    a = F.struct(F.col(f"_after.{edge}").alias("at"), *[F.col(f"_after.{c}").alias(c) for c in payload])
    near = F.when(F.col("_after").isNull() | (dist_b <= dist_a), b).otherwise(a)
    return flipped.withColumn("nearest", near).drop("_before", "_after")


def sequence_windows(c: Column, size: int) -> Column:
    """All windows of a text as an array of (offset, window), offsets from 0; none if the text is shorter."""
    n = F.length(c) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(i.alias("offset"), F.substring(c, i + 1, F.lit(size)).alias("window"))))


def best_window(windows: Column, score) -> Column:
    """The window with the largest score, the first of equal ones; ``score`` maps a window text to a Column."""
    ranked = F.transform(windows, lambda w: F.struct(score(w["window"]).alias("score"), (-w["offset"]).alias("neg"), w["window"].alias("window")))
    top = F.array_max(ranked)
    return F.struct((-top["neg"]).alias("offset"), top["window"].alias("window"), top["score"].alias("score"))


def lift_over(df: DataFrame, blocks: DataFrame, chrom: str, pos: str, width: int = 1 << 20) -> DataFrame:
    """Positions mapped through chain blocks (chrom, start, end, to_chrom, to_start, strand); unmapped rows get NULLs."""
    b = blocks.withColumnRenamed("chrom", "_chrom")
    met = point_lookup(df.withColumn("_chrom", F.col(chrom)), b, ["_chrom"], pos, "start", "end", width)
    forward = F.col("to_start") + (F.col(pos) - F.col("start"))
    backward = F.col("to_start") + (F.col("end") - 1 - F.col(pos))
    return met.withColumns({"lifted_chrom": F.col("to_chrom"), "lifted_pos": F.when(F.col("strand") == "-", backward).otherwise(forward)}).drop("_chrom", "start", "end", "to_chrom", "to_start", "strand")


def read_chain(df: DataFrame) -> DataFrame:
    """Chain headers with alignment lines (chain_id, ordinal, chrom, start, to_chrom, to_start, strand, size, gap, to_gap)
    as blocks for lift_over: each block starts where the sizes and gaps before it end."""
    w = W.partitionBy("chain_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    before = lambda a: F.coalesce(F.sum(F.col("size") + F.coalesce(F.col(a), F.lit(0))).over(w), F.lit(0))
    placed = df.withColumns({"_s": F.col("start") + before("gap"), "_t": F.col("to_start") + before("to_gap")})
    return placed.select("chrom", F.col("_s").alias("start"), (F.col("_s") + F.col("size")).alias("end"), "to_chrom", F.col("_t").alias("to_start"), "strand")
