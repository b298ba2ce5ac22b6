"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Returns (node, component) for each node with an edge; component is the smallest node reachable.

    Each round links every neighbour of a node to the smallest one (first the larger neighbours, then the smaller),
    which ends in stars after a number of rounds that grows with the logarithm of the longest path. All steps are
    minima by key and equi-joins, so a node with very many neighbours is pre-aggregated and its join side can be
    split; nothing is gathered by node. Self loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = work.keep(e, f"{name}-0")
    before, i = _mark(e), 0
    while before[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        i += 1
        e = work.keep(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def local_components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number for each of n nodes, by passing minima along the links and jumping to roots."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
