"""Information measures of sites, identifiability of records, linkage, greedy and exact selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rounds import keeper

LOCAL_EDGES = 1 << 18  # edges that one task turns into stars together


def frequencies(df: DataFrame, site: list[str], value: str) -> DataFrame:
    """site, value, n and share of the site's rows."""
    counted = df.groupBy(*site, value).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*site)))


def diversity(df: DataFrame, site: list[str], value: str) -> DataFrame:
    """Shannon entropy (natural logarithm) and Simpson index of each site."""
    p = F.col("share")
    return frequencies(df, site, value).groupBy(*site).agg((-F.sum(p * F.log(p))).alias("entropy"), F.sum(p * p).alias("simpson"))


def cumulative_shares(df: DataFrame, site: list[str], value: str) -> DataFrame:
    w = W.partitionBy(*site).orderBy(F.desc("share"), value).rowsBetween(W.unboundedPreceding, 0)
    return frequencies(df, site, value).withColumn("cumulative", F.sum("share").over(w))


def profiles(df: DataFrame, individual: str, order: str, value: str, sep: str = "") -> DataFrame:
    """One text per individual: its values in the order of their sites."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(individual).agg(F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias("profile"))


def identifiability(profiled: DataFrame) -> DataFrame:
    """One row: share of different profiles, and share of individuals whose profile no one else has."""
    counted = profiled.groupBy("profile").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counted.agg((F.count("*") / total).alias("distinct_share"), (F.count_if(F.col("n") == 1) / total).alias("unique_share"), total.alias("individuals"))


def hashed_profiles(profiled: DataFrame) -> DataFrame:
    return profiled.withColumn("digest", F.sha2("profile", 256))


def conditional(df: DataFrame, given: list[str], value: str) -> DataFrame:
    """Joint, marginal and conditional shares of (given, value)."""
    n = df.groupBy(*given, value).agg(F.count("*").alias("n"))
    own = F.sum("n").over(W.partitionBy(*given))
    total = n.agg(F.sum("n").alias("_total"))
    return n.crossJoin(F.broadcast(total)).withColumns({"joint": F.col("n") / F.col("_total"), "conditional": F.col("n") / own}).drop("_total")


def linkage(sites: DataFrame, proxies: DataFrame, site: str = "site") -> DataFrame:
    """Mean r² of each site's proxies (0 without any) and whether it has some."""
    mean = proxies.groupBy(site).agg(F.avg("r2").alias("mean_r2"))
    return sites.join(mean, site, "left").select(site, F.coalesce("mean_r2", F.lit(0.0)).alias("mean_r2"), F.col("mean_r2").isNotNull().alias("found"))


def common_sites(df: DataFrame, site: list[str], share: str, least: float) -> DataFrame:
    """Sites at which every allele reaches the share."""
    return df.groupBy(*site).agg(F.min(share).alias("_m")).filter(F.col("_m") >= least).drop("_m")


def components(edges: DataFrame, a: str = "a", b: str = "b", keep=None) -> DataFrame:
    """(node, component): the smallest node reachable over the edges; nodes are texts or whole numbers. Loops, repeats and
    nulls are ignored but for a node's own row.

    Tasks first replace the edges that they hold by stars: each node with the smallest it reaches over these edges, so
    a dense graph shrinks to a few rows a node before anything is shuffled. Then the graph is contracted: each node points to its smallest neighbour if that is smaller, pointers are followed to their
    ends by doubling, and edges between ends make the next graph, with at most half of the nodes, until none is left. Then
    the pointers of all rounds are chained from the last to the first. Every step is a minimum by key or an equi-join with
    one row per node on one side, which Spark can split where a node is hot. ``keep`` materialises a round (Parquet
    by default).
    """
    keep = keep or keeper(edges.sparkSession)
    present = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    loops = present.filter("u = v").select(F.col("u").alias("node"))
    e = keep(_stars(present.filter("u <> v")).distinct())
    rounds = []
    while not e.isEmpty():
        ends = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to"))
        low = e.select(F.col("v").alias("node")).distinct()
        one = low.join(ends, "node", "left").select("node", F.coalesce("to", "node").alias("to")).unionByName(ends.join(low, "node", "left_anti"))
        points = keep(one)
        while True:
            near = points.select(F.col("node").alias("to"), F.col("to").alias("_further"))
            jumped = keep(points.select("node", "to").join(near, "to").select("node", F.col("_further").alias("to"), (F.col("_further") != F.col("to")).alias("moved")))
            points = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        rounds.append(points)
        p = points.select(F.col("node").alias("u"), F.col("to").alias("_pu"))
        q = points.select(F.col("node").alias("v"), F.col("to").alias("_pv"))
        joined = e.join(p, "u").join(q, "v").select(F.greatest("_pu", "_pv").alias("u"), F.least("_pu", "_pv").alias("v"))
        e = keep(joined.filter("u <> v").distinct())
    if not rounds:
        return loops.distinct().select("node", F.col("node").alias("component"))
    last = rounds[-1].select("node", F.col("to").alias("component"))
    for points in reversed(rounds[:-1]):
        on = last.select(F.col("node").alias("to"), "component")
        last = points.join(on, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    alone = loops.distinct().join(last.select("node"), "node", "left_anti")
    return last.unionByName(alone.select("node", F.col("node").alias("component")))


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components, u the larger end: in portions of LOCAL_EDGES, each node beside the smallest
    one of its component there."""
    kind = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[t]) for n, t in edges.dtypes])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= LOCAL_EDGES:
                yield star(held)
                held, n = [], 0
        if held:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[:len(u)], at[len(u):]
        root = np.arange(len(names))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for side in (a, b, root[a], root[b]):
                np.minimum.at(new, side, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[some], kind.field(0).type), pa.array(names[root[some]], kind.field(1).type)], schema=kind)

    return edges.mapInArrow(local, edges.schema)


def select_uncorrelated(ranked: DataFrame, proxies: DataFrame, k: int, keep=None) -> DataFrame:
    """The k best sites of which none is a proxy of a better one taken: rank, site. Null scores come last, ties go to the
    smaller site.

    This is the greedy answer, found in rounds over the whole graph instead of site by site: a site that outranks all its
    remaining neighbours is taken, and its neighbours go. Rounds end when no site is left, or when k taken ones outrank
    all that are left. A round is a maximum by site and two equi-joins; what is left shrinks, and no site is gathered with
    all others. Chains of neighbours of falling rank take a round for each second site. ``keep`` materialises a round
    (Parquet by default).
    """
    keep = keep or keeper(ranked.sparkSession)
    sites = ranked.filter("site is not null").groupBy("site").agg(F.max("score").alias("score"))
    place = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("low"), "site")  # smaller is better
    left = keep(sites.select("site", place.alias("place")))
    both = proxies.select(F.col("site").alias("x"), F.col("proxy").alias("y")).unionByName(proxies.select(F.col("proxy").alias("x"), F.col("site").alias("y"))).filter("x <> y").distinct()
    own, other = left.select(F.col("site").alias("x"), F.col("place").alias("px")), left.select(F.col("site").alias("y"), F.col("place").alias("py"))
    edges = keep(both.join(own, "x").join(other, "y"))
    taken = None
    while True:
        beaten = edges.filter("py < px").select(F.col("x").alias("site")).distinct()
        best = keep(left.join(beaten, "site", "left_anti"))
        taken = best if taken is None else taken.unionByName(best)
        gone = keep(edges.join(best.select(F.col("site").alias("y")), "y", "left_semi").select(F.col("x").alias("site")).unionByName(best.select("site")).distinct())
        left = keep(left.join(gone, "site", "left_anti"))
        first = left.agg(F.min("place")).first()[0]
        if first is None or taken.filter(F.col("place") < F.lit(_literal(first))).limit(k).count() >= k:
            break
        still = left.select("site")
        edges = keep(edges.join(still.withColumnRenamed("site", "x"), "x", "left_semi").join(still.withColumnRenamed("site", "y"), "y", "left_semi"))
    top = taken.orderBy("place").limit(k)  # k rows, so one task numbers them
    return top.select(F.row_number().over(W.orderBy("place")).alias("rank"), "site")


def _literal(place) -> Column:
    return F.struct(F.lit(place["none"]).alias("none"), F.lit(place["low"]).alias("low"), F.lit(place["site"]).alias("site"))


def knapsack(items: DataFrame, capacity: int, most: int) -> DataFrame:
    """The items (name, weight, value; whole weights, positive values) of largest value within the capacity and ``most`` items.

    Of items of one weight, no answer needs more than the ``most`` most valuable ones. Those are at most
    (capacity + 1) * most rows whatever the input, over which one task solves the rest by dynamic programming, exactly.
    Items with a null weight or value, or a negative weight, can't be chosen.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name").reset_index(drop=True)
        best: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {(0, 0): (0.0, ())}
        for i, (w, v) in enumerate(zip(pdf["weight"], pdf["value"])):
            for (used, n), (value, chosen) in list(best.items()):
                at = (used + int(w), n + 1)
                if at[0] <= capacity and at[1] <= most and value + v > best.get(at, (-1.0, ()))[0]:
                    best[at] = (value + v, chosen + (i,))
        value, chosen = max(best.values(), key=lambda x: x[0])
        return pdf.iloc[list(chosen)][["name", "weight", "value"]]

    place = F.row_number().over(W.partitionBy("weight").orderBy(F.desc("value"), "name"))
    able = items.select("name", "weight", "value").filter((F.col("weight") >= 0) & (F.col("weight") <= capacity) & F.col("value").isNotNull())
    top = able.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
    return top.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, "name string, weight long, value double")


def top_k_identifiability(df: DataFrame, individual: str, site: str, value: str, ks: list[int]) -> DataFrame:
    """Share of different profiles when only the k sites of highest entropy are known, for each k."""
    best = diversity(df, [site], value).orderBy(F.desc("entropy"), site).limit(max(ks))
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("entropy"), site)))
    known = df.join(ranked.select(site, "rank"), site).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col(value).alias("v"))))
    per = known.groupBy("k", individual).agg(F.array_join(F.transform(listed, lambda x: x["v"]), "|").alias("profile"))
    return per.groupBy("k").agg((F.count_distinct("profile") / F.count("*")).alias("distinct_share"))


def source_overlap(df: DataFrame, key: str, source: str) -> DataFrame:
    """How many keys each pair of sources shares (a source with itself: its keys)."""
    one = df.select(key, source).distinct()
    pairs = one.select(key, F.col(source).alias("a")).join(one.select(key, F.col(source).alias("b")), key).filter("a <= b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def sample_rows(df: DataFrame, share: float, seed: int) -> DataFrame:
    return df.sample(share, seed)


def unique_share(c: Column) -> Column:
    return F.count_distinct(c) / F.count(c)
