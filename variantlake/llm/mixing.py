"""Mixing sources to target weights by entropy balancing, with document rates rounded to whole copies."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, give_back, slices

WEIGHT_CYCLE = (5, 2, 1)
SHARE_OF_ALL = 1.5
MOST_COPIES = 2
UNIT = 1 << 20  # rates are summed as whole multiples of 1/UNIT, so sums don't depend on the order of tasks
NEWTON_ROUNDS = 80  # bisection alone closes the bracket in as many
CLOSES = 0.1  # share of a source's gap that a repair has to close
BROADCAST_ROWS = 250_000  # keys with their copies, about 120 bytes each when broadcast: more are joined by shuffle


def add_word_count(df: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Adds the number of words, ``[^\\x20\\x09-\\x0D]+``; null text has 0."""

    @F.arrow_udf("long")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([len(t.split()) if t else 0 for t in slices(texts.cast(pa.binary()))], pa.int64())
        give_back()

    return df.withColumn(name, words(F.col(text)))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order (null last) weigh 5, 2, 1, repeating, and share SHARE_OF_ALL of all words by weight.
    A target stops at MOST_COPIES times its source's size; what is over goes to the others by weight until none is
    above. The limit binds exactly for the sources with the smallest limit per weight, so one pass over the sources
    in that order settles it. There is one row per source in these windows, after pre-aggregation.
    """
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHT_CYCLE])
    place = W.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("weight", F.get(cycle, ((F.row_number().over(place) - 1) % len(WEIGHT_CYCLE)).cast("int")))
    ranked = ranked.withColumns(
        {"limit": F.col("source_size") * float(MOST_COPIES), "total": F.sum("source_size").over(W.partitionBy()) * SHARE_OF_ALL}
    )
    rising = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / weights)
    ranked = ranked.withColumn("capped", F.col("limit") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(W.partitionBy())
    return ranked.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * level["level"]).alias("target"),
    )


def entropy_rates(sizes: DataFrame, targets: DataFrame, work: Workspace) -> DataFrame:
    """One row per source: its targets' columns, ``lam`` and ``full``; a document's rate follows by ``rate_of``.

    Among all rates between 0 and MOST_COPIES whose expected words meet each source's target, the rates nearest to
    one copy each (in relative entropy) are ``min(MOST_COPIES, exp(lam * x))``, x the document's words over its
    source's mean. ``lam`` is where the convex dual's derivative, the expected words less the target, is zero: Newton
    steps, kept inside a shrinking bracket (halved on a scale that is fine near zero), each from two sums by source over all documents. Rows are first summed by
    (source, size), so a round reads counts of sizes, not documents. A target of all copies needs no step: ``full``.
    """
    counts = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = work.keep(counts, "size-counts")
    means = counts.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = targets.join(means, targets["source"].eqNullSafe(means["source"]), "left").drop(means["source"]).withColumns({
        "lam": F.lit(0.0), "low": F.lit(-1e9), "high": F.lit(1e9), "done": F.lit(False),
        "full": F.col("target") >= F.col("source_size") * float(MOST_COPIES) * (1 - 1e-12),
    })
    state = work.keep(state.coalesce(1), "state-0")
    for i in range(1, NEWTON_ROUNDS + 1):
        x = F.col("size") / F.col("mean")
        rate = rate_of(F.col("lam"), F.col("full"), x)
        sums = (
            counts.join(F.broadcast(state.select("source", "mean", "lam", "full")).alias("s"),
                        counts["source"].eqNullSafe(F.col("s.source"))).select(counts["source"], "size", "n", "mean", "lam", "full")
            .groupBy("source").agg(
                F.sum(_units(F.col("n") * F.col("size") * rate)).alias("got"),
                F.sum(_units(F.when(rate < MOST_COPIES, F.col("n") * F.col("size") * x * rate).otherwise(0.0))).alias("slope"),
            )
        ) if _few(state) else _sums_by_join(counts, state, rate, x)
        joined = state.join(sums, state["source"].eqNullSafe(sums["source"]), "left").drop(sums["source"])
        got = F.coalesce(F.col("got").cast("double"), F.lit(0.0)) / UNIT
        slope = F.coalesce(F.col("slope").cast("double"), F.lit(0.0)) / UNIT
        gap = got - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / slope
        done = F.col("full") | (F.abs(gap) <= 1e-6 * F.col("target") + 1e-3) | F.col("mean").isNull() | F.col("done")
        step = F.when(done, F.col("lam")).when((slope > 0) & (newton > low) & (newton < high), newton).otherwise(F.sinh((F.asinh(low) + F.asinh(high)) / 2))
        nxt = joined.select("source", "source_size", "target", "mean", "full", step.alias("lam"), low.alias("low"), high.alias("high"), done.alias("done"))
        state = work.keep(nxt.coalesce(1), f"state-{i}")
        work.drop(f"state-{i - 1}")
        if state.filter("not done").isEmpty():
            break
    else:
        raise ValueError(f"targets not met after {NEWTON_ROUNDS} rounds")
    return state.select("source", "source_size", "target", "mean", "full", "lam")


def _few(state: DataFrame) -> bool:
    """Whether the table of sources is small enough to broadcast; beyond that the sums go through an equi-join."""
    return state.count() <= 100_000


def _sums_by_join(counts: DataFrame, state: DataFrame, rate: Column, x: Column) -> DataFrame:
    s = state.select(F.col("source").alias("_s"), "mean", "lam", "full")
    return counts.join(s, F.col("source").eqNullSafe(F.col("_s"))).groupBy("source").agg(
        F.sum(_units(F.col("n") * F.col("size") * rate)).alias("got"),
        F.sum(_units(F.when(rate < MOST_COPIES, F.col("n") * F.col("size") * x * rate).otherwise(0.0))).alias("slope"),
    )


def rate_of(lam: Column, full: Column, x: Column) -> Column:
    """The tilted rate; exponents are kept in a range in which exp() neither overflows nor vanishes."""
    return F.when(full, F.lit(float(MOST_COPIES))).otherwise(
        F.least(F.lit(float(MOST_COPIES)), F.exp(F.greatest(F.lit(-600.0), F.least(F.lit(600.0), lam * x))))
    )


def _units(c: Column) -> Column:
    return F.round(c * UNIT).cast("decimal(38,0)")


def mix_to_weights(docs: DataFrame, work: Workspace, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Returns key, size, source, source_size, target, rate, copies and taken for every document.

    ``copies`` (0, 1 or 2) rounds the rate: along each source's documents in order of size, a document gets the whole
    units by which the running sum of rates moves past it, so each stretch of similar sizes keeps its share. Running
    sums come from totals of (source, size class, hash slot) cells, so no source is ordered in one task. Then the one
    document per source whose copy, added or removed, best closes the gap is changed, as long as that closes enough of it.

    Nulls: a null text has size 0 and takes 0 words; a null source is a source of its own, the last; documents with a
    null key are documents like others. Repeated rows are separate documents. An empty table gives no rows. Other
    columns of ``docs`` are not carried. Sums are of whole units, so reruns give the same copies.
    """
    sizes = add_word_count(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))).drop("text")
    sizes = work.keep(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    mixed = _mix(sizes, work)
    work.drop("sizes", "size-counts")
    return mixed.select(F.col("key").alias(key), "size", "source", "source_size", "target", "rate", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def _mix(sizes: DataFrame, work: Workspace) -> DataFrame:
    """Rates and copies of written rows (row, key, source, size); ``row`` tells rows apart, also where all else is equal."""
    state = entropy_rates(sizes, work.keep(source_targets(sizes).coalesce(1), "targets"), work)
    st = state.select(F.col("source").alias("_s"), "source_size", "target", "mean", "full", "lam")
    st = F.broadcast(st) if _few(st) else st
    rated = sizes.join(st, sizes["source"].eqNullSafe(F.col("_s"))).withColumn(
        "rate", F.when(F.col("size") > 0, rate_of(F.col("lam"), F.col("full"), F.col("size") / F.col("mean"))).otherwise(1.0)
    ).withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
    rated = rated.withColumns({
        "cls": F.when(F.col("size") > 0, F.floor(F.log2("size") * 8)).otherwise(-1).cast("int"),
        "slot": F.pmod(F.xxhash64("key", "size"), F.lit(64)).cast("int"),
    }).drop("_s", "lam", "full", "mean")
    cells = rated.groupBy("source", "cls", "slot").agg(F.sum("units").alias("cell_units"))
    before = W.partitionBy("source").orderBy("cls", "slot").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("cell_units").over(before), F.lit(0))).drop("cell_units")
    c = cells.select(F.col("source").alias("_s"), F.col("cls").alias("_c"), F.col("slot").alias("_l"), "base")
    along = W.partitionBy("source", "cls", "slot").orderBy("size", "key", F.xxhash64("key")).rowsBetween(W.unboundedPreceding, 0)
    placed = rated.withColumn("upto", F.sum("units").over(along)).join(
        c, rated["source"].eqNullSafe(F.col("_s")) & (rated["cls"] == F.col("_c")) & (rated["slot"] == F.col("_l"))
    ).withColumn("upto", F.col("upto") + F.col("base"))
    half = UNIT // 2
    copies = F.floor((F.col("upto") + half) / UNIT) - F.floor((F.col("upto") - F.col("units") + half) / UNIT)
    mixed = placed.select(
        "key", "size", "source", "source_size", "target", "rate",
        F.least(F.lit(MOST_COPIES), copies).cast("int").alias("copies"), "row",
    )
    mixed = work.keep(mixed, "mixed-0")
    fixes = _repairs(mixed, work)
    if fixes is not None:
        mixed = mixed.join(fixes, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
    return mixed


def _repairs(mixed: DataFrame, work: Workspace) -> DataFrame | None:
    """Single-copy changes, as (row, change): in each round and source the one that leaves the least gap, until none
    closes CLOSES of a gap any more. So rounds grow with the logarithm of the gap, not with the number of documents. A gap
    stays if it is below one word, or if every free document is above nearly twice the gap or below a tenth of it; the
    rounding before leaves gaps of about one document, so the last is rare.

    Every round is a minimum by source with partial aggregation. Gaps and changes are tables, whatever the number of
    sources: one row per source and round.
    """
    gaps = mixed.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    gaps = work.keep(gaps, "gaps-0")
    changes: DataFrame | None = None
    for i in itertools.count(1):
        g = gaps.filter(F.abs("gap") >= 1).select(F.col("source").alias("_s"), "gap")
        room = mixed if changes is None else mixed.join(changes.select("row"), "row", "left_anti")
        room = room.join(F.broadcast(g) if _few(g) else g, room["source"].eqNullSafe(F.col("_s"))).withColumn("dir", F.signum("gap").cast("int"))
        free = (F.col("size") > 0) & (F.col("copies") + F.col("dir")).between(0, MOST_COPIES)
        left = F.abs(F.col("gap") - F.col("dir") * F.col("size"))
        best = room.filter(free & (left <= (1 - CLOSES) * F.abs("gap"))).groupBy("source").agg(
            F.min(F.struct(left.alias("left"), F.col("key").alias("key"), F.col("row").alias("row"), F.col("dir").alias("dir"), F.col("size").alias("size"))).alias("b")
        )
        best = work.keep(best.select(F.col("source").alias("_s"), "b.row", F.col("b.dir").alias("change"), "b.size"), f"best-{i}")
        if best.isEmpty():
            break
        made = best.select("row", "change")
        changes = made if changes is None else changes.unionByName(made)
        moved = gaps.join(best, gaps["source"].eqNullSafe(F.col("_s")), "left")
        gaps = work.keep(moved.select("source", (F.col("gap") - F.coalesce(F.col("change") * F.col("size"), F.lit(0))).alias("gap")), f"gaps-{i}")
    return changes


def repeat(docs: DataFrame, work: Workspace, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it: not at all, once or twice; rules as in mix_to_weights.

    Rows are numbered when they are written with their sizes, and copies are joined by that number, so rows that repeat a
    key are mixed one by one.
    """
    rows = add_word_count(docs.withColumn("_row", F.monotonically_increasing_id()), text, "_size")
    rows = work.keep(rows, "rows")
    sizes = rows.select(F.col("_row").alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), F.col("_size").alias("size"))
    taken = work.keep(_mix(sizes, work).filter("copies > 0").select(F.col("row").alias("_row"), F.col("copies").alias("_copies")), "copies")
    small = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    return rows.join(small, "_row").withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_row", "_size", "_copies")
